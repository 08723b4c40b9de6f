"""Hybrid search: exact text hits first, then reciprocal rank fusion of the other rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10


def _merged(text: DataFrame, exact: DataFrame, meaning: DataFrame, visual: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each id of any list: what every list says about it, ranks counted among ids that are not exact.

    One union of lists that are a limit's rows long, one aggregation by id; no joins.  Lists of many queries are told apart by ``by``.
    """
    part = lambda hits, n: hits.select(*by, "id", "pos", F.col("score").cast("double").alias("score"), F.lit(n).alias("_list"))
    union = part(text, 0).union(part(meaning, 1)).union(part(visual, 2)).union(part(exact, 3))
    known = union.withColumn("_exact", F.max(F.col("_list") == 3).over(Window.partitionBy(*by, "id")))
    rank = F.row_number().over(Window.partitionBy(*by, "_list", "_exact").orderBy("pos")) - 1
    of = lambda n, c: F.when(F.col("_list") == n, F.col(c))
    return known.withColumn("_rank", rank).groupBy(*by, "id").agg(
        F.max("_exact").alias("exact"),
        F.min(of(3, "pos")).alias("exact_pos"),
        F.round(F.sum(F.when(F.col("_list") < 3, 1.0 / (k + F.col("_rank")))), 9).alias("score"),
        F.min(of(0, "_rank")).alias("text_rank"),
        F.min(F.when(F.col("_list") < 3, F.struct("_list", "_rank"))).alias("_first"),
        F.max(F.col("_list") == 0).alias("matched_text"),
        F.round(F.max(of(2, "score")), 6).alias("visual_score"),
        F.round(F.max(of(1, "score")), 6).alias("meaning_score"),
    )


def rrf_fusion(text: DataFrame, exact: DataFrame, meaning: DataFrame, visual: DataFrame, k: int = K) -> DataFrame:
    """id, score, text_rank, list, rank of the ids that are not exact; score sums 1 / (k + rank)."""
    rest = _merged(text, exact, meaning, visual, k).where(~F.col("exact"))
    return rest.select("id", "score", "text_rank", F.col("_first._list").alias("list"), F.col("_first._rank").alias("rank"))


def fuse(text: DataFrame, exact: DataFrame, meaning: DataFrame, visual: DataFrame, limit: int = 120, k: int = K, by: tuple[str, ...] = ()) -> DataFrame:
    """pos, id, block (0 exact, 1 fused), score, matched_text, visual_score, meaning_score; at most ``limit`` rows, for each value of ``by``.

    Exact hits keep their order; the others follow by score, then text rank, list and rank there, id.
    """
    all_ = _merged(text, exact, meaning, visual, k, by)
    none = F.lit(2_000_000_000)
    ahead = F.col("exact")
    keyed = all_.select(*by, "id", F.when(ahead, 0).otherwise(1).alias("block"), F.when(~ahead, F.col("score")).alias("score"), "matched_text", "visual_score", "meaning_score", F.when(ahead, F.col("exact_pos")).otherwise(F.coalesce("text_rank", none)).alias("_a"), F.col("_first._list").alias("_b"), F.col("_first._rank").alias("_c"))
    order = ["block", F.desc("score"), "_a", "_b", "_c", "id"]
    if by:
        placed = keyed.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("pos") <= limit)
        return placed.select(*by, "pos", "id", "block", "score", "matched_text", "visual_score", "meaning_score")
    top = keyed.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "id", "block", "score", "matched_text", "visual_score", "meaning_score")


def match_badge(hits: DataFrame, visual_search: bool = False) -> DataFrame:
    """Adds ``badge`` and ``kind``, what a result list says about each hit."""
    number = F.format_string("≈ %.2f", F.col("visual_score"))
    seen, meant = F.col("visual_score").isNotNull(), F.col("meaning_score").isNotNull()
    rest = F.when(F.col("matched_text"), "").when(meant, "≈ related text").when(seen, "≈ looks like").otherwise("")
    badge = F.when(seen, number).otherwise("") if visual_search else rest
    kind = F.when(F.col("matched_text") & seen, "text, and looks like").when(F.col("matched_text"), "text").when(meant, "related text").when(seen, "looks like").otherwise("recent")
    return hits.withColumn("badge", badge).withColumn("kind", kind)
