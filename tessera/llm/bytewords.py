"""Words and their hashes for whole Arrow string columns, computed on the UTF-8 bytes with numpy.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; as those are ASCII, splitting bytes splits
characters alike.  Columns are handled in slices of a quarter of a megabyte so that memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but letters and bytes of characters beyond ASCII.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_B, _A1, _A2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for each base, and made longer when that is needed."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(1 << max(14, int(n).bit_length()), base, U)
        held[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(held)
    return held[:n]


@lru_cache(maxsize=4)
def _byte_values(fold: bool) -> np.ndarray:
    at = np.arange(256, dtype=U)
    if fold:
        at[0x41:0x5B] += U(32)
    return mix(at + U(0x51ED270B))


class Words:
    """The words of a slice: byte ranges, hashes, and which rows they belong to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, split: np.ndarray = SPACE, fold: bool = False):
        self.data, self.offsets, self.fold = data, offsets.astype(np.int64), fold
        inside = ~split[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = self.offsets[:-1] < self.offsets[1:]
            at = self.offsets[:-1][full]
            first[at] = inside[at]
            at = self.offsets[1:][full] - 1
            last[at] = inside[at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Words of row i are bounds[i]:bounds[i + 1].
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """64 bits for each word; equal words have equal hashes in any slice."""
        n = len(self.data)
        inverse = pow(_B, -1, 1 << 64)
        sums = np.zeros(n + 1, U)
        np.cumsum(_byte_values(self.fold)[self.data] * powers(_B, n), out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * powers(inverse, n + 1)[self.start]
        return mix(raw + (self.end - self.start).astype(U) * U(0xC2B2AE3D27D4EB4F))


def windows(hashes: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """A hash for each run of ``width`` words; ``second`` gives an independent one."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U)
    base = _A2 if second else _A1
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), n + 1)[: n - width + 1] + U(width))


def sequence_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits for a whole sequence of words."""
    if not len(hashes):
        return 0, 0
    return int(windows(hashes, len(hashes))[0]), int(windows(hashes, len(hashes), True)[0])


def strings(column: pa.Array) -> pa.Array:
    """A plain string array in which null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of a column with their bytes and offsets from 0, about ``most`` bytes at a time; rows are never cut."""
    column = strings(column)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
