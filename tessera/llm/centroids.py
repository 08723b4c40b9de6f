"""Centroid clustering in whole numbers, with block-norm screening.

A vector is compressed to the norms of its segments, which are computed once and stored beside it.  By the
Cauchy-Schwarz inequality a segment's part of the squared distance to a centroid is at least the squared
difference of the two norms, so their sum is a lower bound.  The centroid of the smallest bound is measured first;
of the others only those whose bound does not exceed that distance are measured, exactly and in 64-bit integers.

A round is one job: tasks send a sum of vectors for each centroid, and only these sums, one row for each centroid, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import park

DIM, CLUSTERS, ROUNDS, SCALE, SEGMENTS, SEED = 64, 8, 10, 1024, 8, "3:"
#: Whole numbers are held to this, so that a squared distance of 64 components fits in 63 bits.
MOST = 1 << 27


def whole_numbers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their vectors as integers) of an array<double> column."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sized)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[good], np.clip(np.floor(x[good] * scale), -MOST, MOST).astype(np.int32)


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """The norms of ``segments`` runs of components, as even as may be, for each row."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    squares = x.astype(np.int64) ** 2
    return np.sqrt(np.stack([squares[:, i:j].sum(axis=1) for i, j in zip(edges, edges[1:], strict=False)], axis=1).astype(float))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of each row's nearest centroid, squared distance, exact distances computed); of equally near ones the first."""
    near = segment_norms(centroids, segments)
    bound = np.zeros((len(x), len(centroids)))
    for s in range(segments):
        # Less what rounding of the norms may have added.
        bound += (norms[:, s, None] - near[None, :, s]) ** 2 - 1e-13 * (norms[:, s, None] + near[None, :, s]) ** 2
    x = x.astype(np.int64)
    first = bound.argmin(axis=1)
    own, best, tried = first.copy(), ((x - centroids[first]) ** 2).sum(axis=1), len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        tried += len(rows)
        far = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        closer = (far < best[rows]) | ((far == best[rows]) & (c < own[rows]))
        best[rows[closer]], own[rows[closer]] = far[closer], c
    return own, best, tried


def _decode(b: pa.RecordBatch, dim: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, dim)
    return x, np.frombuffer(b"".join(b.column(2).to_pylist()), "<f8").reshape(-1, segments)


def _starts(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; of rows that repeat an id those with the smallest bytes first."""
    name = F.sha2(F.concat(F.lit(seed), F.col("_id").cast("string")), 256)
    rows = kept.where("_id IS NOT NULL").orderBy(name, "_vec").limit(clusters).select("_vec").collect()
    return np.array([np.frombuffer(r["_vec"], "<i4") for r in rows], np.int64)


def _round(kept: DataFrame, centroids: np.ndarray, dim: int, segments: int) -> np.ndarray:
    """The centroids after one round: componentwise exact floor of sum by count, empty ones unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            if b.num_rows:
                x, norms = _decode(b, dim, segments)
                own, _, _ = nearest(x, norms, centroids, segments)
                n += np.bincount(own, minlength=len(n))
                for c in np.unique(own).tolist():
                    sums[c] += x[own == c].sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], names=["_c", "_n", "_sums"])

    parts = kept.mapInArrow(run, "_c int, _n long, _sums array<bigint>")
    total = parts.groupBy("_c").agg(F.sum("_n").alias("_n"), F.array(*[F.sum(F.col("_sums")[i].cast("decimal(28,0)")) for i in range(dim)]).alias("_sums"))
    out = centroids.copy()
    for r in total.collect():
        out[r["_c"]] = [int(s) // r["_n"] for s in r["_sums"]]
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, segments: int = SEGMENTS, seed: str = SEED) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``dim`` components, none null or non-finite; a component x counts as floor(``scale`` * x).
    The ``clusters`` vectors whose ids hash lowest are the first centroids; ``rounds`` times vectors go to the
    nearest centroid (squared distance, ties to the smaller number) and centroids to the floor of their vectors' mean.

    Null and empty vectors, and those of other lengths, are left out; zero vectors are like others.  Components beyond
    2**27 after scaling count as 2**27, as distances would not fit in a long.  Repeated rows are vectors of their
    own.  A null id is clustered but starts no centroid; without any id cluster and distance are null.  With fewer
    vectors than clusters there are as many centroids as vectors.  An empty table gives no rows; other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    read = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = whole_numbers(b.column(1), dim, scale)
            cols = [[r.tobytes() for r in part] for part in (x.astype("<i4"), segment_norms(x, segments).astype("<f8"))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *[pa.array(c, pa.binary()) for c in cols]], names=["_id", "_vec", "_norms"])

    kept = park(read.mapInArrow(compress, f"_id {kind}, _vec binary, _norms binary"))
    centroids = _starts(kept, clusters, seed)
    if not len(centroids):
        nothing = F.lit(None).cast("long")
        return kept.select(F.col("_id").alias(id_col), nothing.cast("int").alias("cluster"), nothing.alias("distance"), nothing.alias("cluster_inertia"), nothing.alias("inertia"), nothing.cast("string").alias("centroid_sha256"))
    for _ in range(rounds):
        last, centroids = centroids, _round(kept, centroids, dim, segments)
        if (last == centroids).all():
            break  # the rounds that are left change nothing

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, far, _ = nearest(*_decode(b, dim, segments), centroids, segments)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array(far)], names=["_id", "cluster", "distance"])

    found = park(kept.mapInArrow(assign, f"_id {kind}, cluster int, distance long"))
    own = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    inertia = F.lit(sum(own.values())).cast("long").alias("inertia")
    return found.select(F.col("_id").alias(id_col), "cluster", "distance", of([own.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"), inertia, of(names).alias("centroid_sha256"))
