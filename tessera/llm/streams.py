"""Reading a sorted partition group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of each run of equal values in the first ``n_keys`` columns, which are longs without nulls.

    Only the group at hand is held in memory, so the caller must bound groups.
    """
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            at = tuple(keys[:, i].tolist())
            if at != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = at, []
            held.append(b.slice(i, j - i))
    if held:
        yield key, pa.Table.from_batches(held)


def whole(batches: Iterator[pa.RecordBatch], n_keys: int, most: int = 1 << 20) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns as arrays that hold whole groups of equal values in the first ``n_keys`` columns of a sorted partition.

    A group of more than ``most`` rows comes in parts of its own, marked True, so memory is bounded.
    """
    tail: list[np.ndarray] = []
    huge = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if tail:
            cols = [np.concatenate(c) for c in zip(tail, cols, strict=True)]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:n_keys]:
            new[1:] |= c[1:] != c[:-1]
        if huge is not None:
            same = np.ones(len(new), bool)
            for c, h in zip(cols[:n_keys], huge, strict=True):
                same &= c == h
            if same.any():
                yield [c[same] for c in cols], True
                cols, new = [c[~same] for c in cols], new[~same]
            if not len(new):
                tail = []
                continue
            huge = None
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield [c[:cut] for c in cols], False
        tail = [c[cut:] for c in cols]
        if len(tail[0]) > most:
            yield tail, True
            huge, tail = [c[0] for c in tail[:n_keys]], []
    if tail and len(tail[0]):
        yield tail, False


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (a[i], b[i]) once, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[once], b[once]


def sorted_tables(batches: Iterator[pa.RecordBatch], most: int, rows: int = 8192) -> Iterator[tuple[pa.Table, int | None]]:
    """(table of about ``rows`` rows, key) that hold whole groups of equal values in the first column, a long without nulls.

    A group of more than ``most`` rows comes in parts, so memory is bounded; the key names the group, if any, of which
    such a part came before.
    """
    held: list[pa.RecordBatch] = []
    n, huge = 0, None
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n <= max(rows, most):
            continue
        t = pa.Table.from_batches(held)
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key == key[-1], True))
        part = len(key) - cut > most
        cut = len(key) if part else cut
        if cut:
            yield t.slice(0, cut).combine_chunks(), huge
            huge = int(key[-1]) if part else huge
        held, n = t.slice(cut).combine_chunks().to_batches(), len(key) - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks(), huge
