"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its ``depth`` nearest reference points (pivots), nearest first: a prefix of the
permutation of all pivots by distance.  Inverted lists belong to pairs of pivots; a vector stands in those whose
ranks in its permutation have a product of at most RANKS (more with many pivots), so the nearest pivot pairs with far ones, and
far ones not with each other.  Lists hold ids and permutations only.  In a list, entries are retrieved that share enough
pivots with another entry; then the vectors are fetched for what is left, and verified by the exact cosine in
double precision, blockwise.

The number of pivots grows with the square root of the number of vectors, so lists, of which there are as many as pairs of
pivots, don't.  Nothing is emitted per pair: a task adds up each vector's links and joins components; a pair that
meets in several lists counts in the first one they share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix
from .components import components
from .store import park
from .streams import groups, sorted_tables

#: Fewest and most pivots, and how many for the square root of the number of vectors; the sample they come from has two to eight vectors for each.
PIVOTS, MOST_PIVOTS, GROWTH = 512, 16_384, 2.0
DEPTH, RANKS, SAMPLE, BLOCK = 12, 12, 4096, 512
#: Pivots are less alike than this.
APART = 0.7
#: Pivots that two vectors must share.
SHARED = 4
#: Deeper by so much, and lists by so many ranks more, for each doubling of the pivots beyond PIVOTS: where pivots are dense, near vectors agree on fewer of the nearest ones.
DEEPER, WIDER = 1.6, 3.2


def _clean(docs: DataFrame, id_col: str, vector: str) -> DataFrame:
    """_id, _node (64 bits of the vector, null where it can't link), _vec (its numbers, floats as floats, all else as doubles)."""
    kind = number_type(docs, vector)
    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, vecs = [], []
            for v in b.column(1):
                x = None if not v.is_valid or v.values.null_count or not len(v.values) else (v.values.to_numpy(zero_copy_only=False) + 0.0).astype(kind)
                if x is None or not np.isfinite(x).all() or not x.any():
                    nodes.append(None)
                    vecs.append(None)
                else:
                    vecs.append(x.tobytes())
                    nodes.append(int.from_bytes(hashlib.md5(vecs[-1]).digest()[:8], "little", signed=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(vecs, pa.binary())], names=["_id", "_node", "_vec"])

    return read.mapInArrow(run, "_id long, _node long, _vec binary")


def number_type(vectors: DataFrame, vector: str) -> str:
    return "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither very large nor very small components over- or underflow."""
    raw = raw.astype(float)
    raw = raw / np.abs(raw).max(axis=-1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=-1, keepdims=True)


def choose_pivots(sample: list[np.ndarray], dim: int, count: int, seed: int = 5) -> np.ndarray:
    """At most ``count`` sample vectors no two of which are near each other, filled up with random directions.

    Were pivots taken as they come, a large group of near copies would be many of them, and its members
    would hardly share any.
    """
    out, n = np.zeros((count, dim)), 0
    for raw in sample:
        if len(raw) == dim and n < count:
            x = unit(raw)
            if not n or (out[:n] @ x).max() < APART:
                out[n] = x
                n += 1
    if n < count:
        out[n:] = unit(np.random.default_rng(seed).normal(size=(count - n, dim)))
    return out


def permutations(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the ``depth`` nearest pivots of each row, nearest first; of equally near ones the first."""
    near = x @ pivots.T
    depth = min(depth, near.shape[1])
    top = np.sort(np.argpartition(-near, depth - 1, axis=1)[:, :depth], axis=1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)


def reach(pivots: int, depth: int = DEPTH, ranks: int = RANKS) -> tuple[int, int]:
    """(depth, greatest rank product) for a number of pivots; recall is held against brute force in the tests up to MOST_PIVOTS."""
    doublings = max(0.0, math.log2(pivots / PIVOTS))
    return min(pivots, depth + math.ceil(DEEPER * doublings)), ranks + math.ceil(WIDER * doublings)


def list_keys(perm: np.ndarray, dim: int, ranks: int = RANKS) -> np.ndarray:
    """The lists of each row of nearest pivots, which come nearest first."""
    pairs = [(i, j) for i, j in combinations(range(perm.shape[1]), 2) if (i + 1) * (j + 1) <= ranks]
    perm = perm.astype(np.uint64)
    low = np.stack([np.minimum(perm[:, i], perm[:, j]) for i, j in pairs], axis=1)
    high = np.stack([np.maximum(perm[:, i], perm[:, j]) for i, j in pairs], axis=1)
    return mix(((low << np.uint64(32)) | high) ^ np.uint64(dim << 20)).view(np.int64)


def bitmaps(perm: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """The pivots of each row as a set of bits, one for each pivot."""
    out = np.zeros((len(perm), -(-pivots // 64)), np.uint64)
    at = perm.astype(np.int64)
    for k in range(perm.shape[1]):
        out[np.arange(len(perm)), at[:, k] // 64] |= np.uint64(1) << (at[:, k] % 64).astype(np.uint64)
    return out


def shared_pivots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots rows of bitmaps have in common."""
    return np.bitwise_count(a & b).sum(axis=-1, dtype=np.int64)


def _perms(column: pa.Array | pa.ChunkedArray, depth: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), depth)


def _retrieve(entries: DataFrame, depth: int, pivots: int, shared: int, block: int) -> DataFrame:
    """(_key, _node) of entries (_key, _node, _perm) that share ``shared`` pivots with another of their list.

    Lists of more than ``block`` entries go on whole; no more than that is compared or held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, huge in sorted_tables(batches, block):
            key = t.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            end, size = np.repeat(first + size, size), np.repeat(size, size)
            keep = (size > block) | (key == huge if huge is not None else False)
            bits = bitmaps(_perms(t.column(2), depth), pivots)
            at = np.flatnonzero((size > 1) & ~keep)
            step = 1
            while len(at := at[at + step < end[at]]):
                hit = at[shared_pivots(bits[at], bits[at + step]) >= shared]
                keep[hit] = keep[hit + step] = True
                step += 1
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(t.column(1).to_numpy()[keep])], names=["_key", "_node"])

    return entries.repartition("_key").sortWithinPartitions("_key", "_node").mapInArrow(run, "_key long, _node long")


def smallest_reachable(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row that links lead to, itself included."""
    label = np.arange(len(linked))
    rows = np.flatnonzero(linked.any(axis=1))
    part = linked[np.ix_(rows, rows)]
    while len(rows):
        least = np.minimum(label[rows], np.where(part, label[rows][None, :], len(linked)).min(axis=1))
        least = label[least]  # a label's own label is at least as small
        if (least == label[rows]).all():
            break
        label[rows] = least
    return label


def _compare(tasks: DataFrame, least: float, kind: str, depth: int, ranks: int, pivots: int, shared: int) -> DataFrame:
    """(_root, _node, _links) found in each task; rows: _key, _part, _other, _side, _node, _w, _vec, _perm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part, other), t in groups(batches, 3):
            if t.num_rows < 2:
                continue
            node, w, side = (t.column(c).to_numpy() for c in ("_node", "_w", "_side"))
            x = unit(np.frombuffer(b"".join(t.column("_vec").to_pylist()), kind).reshape(len(node), -1))
            near = np.triu(x @ x.T >= least, 1)
            if part != other:
                near &= side[:, None] != side[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            perm = _perms(t.column("_perm"), depth)
            bits, own = bitmaps(perm, pivots), np.sort(list_keys(perm, x.shape[1], ranks), axis=1)
            mine = np.zeros_like(near)
            step = max(64, (1 << 19) // bits.shape[1] // 8)
            for i in range(0, len(a), step):
                p, q = a[i : i + step], b[i : i + step]
                enough = shared_pivots(bits[p], bits[q]) >= shared
                p, q = p[enough], q[enough]
                same = (own[p][:, :, None] == own[q][:, None, :]).any(axis=2)
                first = own[p, same.argmax(axis=1)] == key
                mine[p[first], q[first]] = mine[q[first], p[first]] = True
            # Only links counted here: the others are those of another list, which joins their ends as well.
            links = mine @ w
            at = np.flatnonzero(links)
            if len(at):
                roots = node[smallest_reachable(mine)[at]]
                yield pa.RecordBatch.from_arrays([pa.array(roots), pa.array(node[at]), pa.array(links[at])], names=["_root", "_node", "_links"])

    ready = tasks.repartition("_key", "_part", "_other").sortWithinPartitions("_key", "_part", "_other", "_node")
    return ready.mapInArrow(run, "_root long, _node long, _links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.95, pivots: int | None = None, depth: int = DEPTH, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links: other vectors with a cosine of at least ``least``; component_id: the smallest id reachable
    by links, itself included; kept: id = component_id.  Verified in double precision, so no link is
    below; links above are found with a recall that the tests hold against brute force, by bands of cosine.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
    vectors of different lengths don't link.  Equal vectors are one entry of the index with a weight.
    Rows that repeat an id are vectors of their own; a null id counts as a link's other end, but has a
    null component_id.  An empty table gives no rows.

    Only the pivots are fitted on a sample: of ``sample`` vectors, or twice as many as pivots, those with
    the smallest hash; ``pivots`` sets their number, which else grows with the vectors.  All vectors are
    indexed.  A list with more than ``block`` entries is compared in pairs of blocks; their number per list
    is known from a count.  Vectors that link with very many others are so compared with each of them, as
    n_links asks, but spread over tasks.
    """
    named = park(_clean(vectors, id_col, vector))
    entries = park(named.where("_node IS NOT NULL").groupBy("_node", "_vec").agg(F.count(F.lit(1)).alias("_w")))
    kind, total = number_type(vectors, vector), entries.count()
    pivots = pivots or int(min(max(PIVOTS, GROWTH * total**0.5), MOST_PIVOTS))
    depth, ranks = reach(pivots, depth)
    shared = max(2, min(SHARED, depth // 3))
    # At most max(sample, 2 * MOST_PIVOTS) rows come to the driver.
    picked = [np.frombuffer(r["_vec"], kind) for r in entries.orderBy("_node").limit(max(sample, 2 * pivots)).select("_vec").collect()]
    made: dict[int, np.ndarray] = {d: choose_pivots(picked, d, pivots).astype(np.float32) for d in {len(r) for r in picked}}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(r, kind) for r in b.column(1).to_pylist()]
            perms: list[bytes] = [b""] * len(raw)
            lists: list = [None] * len(raw)
            for dim in {len(r) for r in raw}:
                at = [i for i, r in enumerate(raw) if len(r) == dim]
                if dim not in made:
                    made[dim] = choose_pivots([], dim, pivots).astype(np.float32)
                perm = permutations(unit(np.stack([raw[i] for i in at])).astype(np.float32), made[dim], depth)
                for i, p, k in zip(at, perm.astype("<u2"), list_keys(perm, dim, ranks), strict=True):
                    perms[i], lists[i] = p.tobytes(), k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(perms, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["_node", "_vec", "_w", "_perm", "_lists"])

    index = park(entries.select("_node", "_vec", "_w").mapInArrow(describe, "_node long, _vec binary, _w long, _perm binary, _lists array<bigint>"))
    left = park(_retrieve(index.select(F.explode("_lists").alias("_key"), "_node", "_perm"), depth, pivots, shared, block))
    # Parked, the table of large lists has a known size, by which Spark chooses its join.
    large = left.groupBy(F.col("_key").alias("_k")).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_blocks")).where("_blocks > 1")
    rows = left.join(park(large), F.col("_key") == F.col("_k"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
    mine = F.pmod(F.xxhash64("_node"), F.col("_blocks"))
    rows = rows.withColumn("_mine", mine).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select("_key", F.least("_mine", "_with").alias("_part"), F.greatest("_mine", "_with").alias("_other"), F.col("_mine").alias("_side"), F.col("_node").alias("_entry"))
    tasks = rows.join(index.select("_node", "_w", "_vec", "_perm"), F.col("_entry") == F.col("_node")).drop("_entry")
    found = park(_compare(tasks, least, kind, depth, ranks, pivots, shared))
    degrees = found.groupBy(F.col("_node").alias("_d")).agg(F.sum("_links").alias("_links"))
    roots = components(found, "_root", "_node").select(F.col("_node").alias("_m"), "_root")
    all_ = named.select("_id", "_node").join(degrees, F.col("_node") == F.col("_d"), "left")
    weights = entries.select(F.col("_node").alias("_e"), "_w")
    all_ = all_.join(weights, F.col("_node") == F.col("_e"), "left").join(roots, F.col("_node") == F.col("_m"), "left")
    all_ = all_.select("_id", (F.coalesce("_w", F.lit(1)) - 1 + F.coalesce("_links", F.lit(0))).alias("_n"), F.coalesce("_root", "_node").alias("_group"))
    # Parked: a group with very many vectors is then a skewed join, which Spark splits.
    least_id = park(all_.where("_group IS NOT NULL").groupBy(F.col("_group").alias("_g")).agg(F.min("_id").alias("_least")))
    out = all_.join(least_id, F.col("_group") == F.col("_g"), "left")
    own = F.when(F.col("_id").isNotNull(), F.coalesce("_least", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("_id") == own, F.lit(False)).alias("kept"))
