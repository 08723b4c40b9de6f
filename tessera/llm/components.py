"""Connected components by alternating large-star and small-star steps, on tables of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import beside, park


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_a", "_b")), F.sum(F.pmod(F.xxhash64("_b", "_a"), F.lit(1 << 30)))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(_node, _root) for every node that a link joins to another; _root is the smallest node of its component.

    Nodes are longs.  Self-links and repeated links count for nothing, null ends are left out; no links give
    no rows.  Every step is two aggregations (with map-side sums, so a node with very many links is no
    single row's burden) and two joins with their answers, and is parked; the number of steps grows with the
    logarithm of a component's width.
    """
    now = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = park(now.select(F.greatest(a, b).alias("_a"), F.least(a, b).alias("_b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy(F.col("_a").alias("_k")).agg(F.min("_b").alias("_m")).withColumn("_m", F.least("_k", "_m"))
        least = beside(least, 2 * mark[0])
        large = both.where("_b > _a").join(least, F.col("_a") == F.col("_k")).select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        large = large.where("_a != _b").distinct()
        down = beside(large.groupBy(F.col("_a").alias("_k")).agg(F.min("_b").alias("_m")), 2 * mark[0])
        small = large.join(down, F.col("_a") == F.col("_k"))
        moved = small.where("_b != _m").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        now = park(moved.union(down.select(F.col("_k").alias("_a"), F.col("_m").alias("_b"))).distinct())
        last, mark = mark, _mark(now)
        if last == mark:
            break
    roots = now.select(F.col("_b").alias("_node")).distinct().select("_node", F.col("_node").alias("_root"))
    return now.select(F.col("_a").alias("_node"), F.col("_b").alias("_root")).union(roots)


class Union:
    """Disjoint sets of 0..n-1 in one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
