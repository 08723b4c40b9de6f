"""Index statistics, latency percentiles and retrieval-quality metrics."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats_by_source(images: DataFrame) -> DataFrame:
    return images.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def stats_totals(images: DataFrame, visual: DataFrame, meaning: DataFrame) -> DataFrame:
    """One row: images, with_text, errors, embedded, meaning_embedded; a pass over each table."""
    a = images.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.length("text") > 0).alias("with_text"), F.count_if(F.col("status") == "error").alias("errors"))
    usable = lambda df, name: df.agg(F.count_if(F.size("vec") > 0).alias(name))
    return a.join(usable(visual, "embedded")).join(usable(meaning, "meaning_embedded"))


def file_count_bytes(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def capped_count(listing: DataFrame, most: int = 50_000) -> int:
    """How many files a folder holds, as far as anyone wants to know."""
    return listing.limit(most).count()


def kb_per_image(listing: DataFrame) -> DataFrame:
    return listing.agg((F.sum("size") / 1024 / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("kb_per_image"))


def nearest_index(values: DataFrame, value: str, points: dict[str, float], by: str, accuracy: int = 10_000) -> DataFrame:
    """The sorted values at [int(n * p)] for each group: picked, not interpolated, and exact.

    A sketch brackets each point first; then values below the bracket are counted, and only the few distinct ones
    inside are put in order, so no group is sorted as a whole.  ``accuracy`` is the sketch's: brackets hold some 4 / ``accuracy`` of a group.
    """
    own = values.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("_v"))
    names, room = list(points), 2.0 / accuracy
    marks = [F.lit(min(1.0, max(0.0, p + d))) for p in points.values() for d in (-room, room)]
    sketch = own.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*marks), accuracy).alias("_marks"))
    ranges = [F.struct(F.lit(k).alias("point"), F.lit(p).alias("p"), F.get("_marks", F.lit(2 * i)).alias("low"), F.get("_marks", F.lit(2 * i + 1)).alias("high")) for i, (k, p) in enumerate(points.items())]
    asked = sketch.select(F.col("_by").alias("_g"), "_n", F.explode(F.array(*ranges)).alias("_r"))
    met = own.join(asked, F.col("_by").eqNullSafe(F.col("_g"))).where(F.col("_v") <= F.col("_r.high"))
    # All values below a bracket are one row, by a null value.
    counted = met.groupBy("_by", "_n", F.col("_r.point").alias("_point"), F.col("_r.p").alias("_p"), F.when(F.col("_v") >= F.col("_r.low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_by", "_point").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_to", F.sum("_c").over(upto))
    index = F.least((F.col("_n") * F.col("_p")).cast("long"), F.col("_n") - 1)
    hit = placed.where((F.col("_to") > index) & (F.col("_to") - F.col("_c") <= index))
    return hit.groupBy(F.col("_by").alias(by)).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_point") == k, F.col("_v"))).alias(k) for k in names])


def latency_percentiles(samples: DataFrame, value: str = "value", by: str = "event_type") -> DataFrame:
    return nearest_index(samples, value, {"median": 0.5, "p95": 0.95}, by)


def model_bytes(folder: str) -> int:
    """Bytes of the files of a model's folder, those below it included; 0 without one."""
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def is_answer(path: Column, answers: Column) -> Column:
    """Whether a path ends with one of an array of answers, in any case."""
    return F.exists(answers, lambda a: F.endswith(F.lower(path), F.lower(a)))


def first_answer(results: DataFrame, is_answer: Column, by: list[str], pos: str = "pos") -> DataFrame:
    """rank: place of the first answer in each query's results, null if there is none."""
    return results.groupBy(*by).agg(F.min(F.when(is_answer, F.col(pos))).alias("rank"))


def eval_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """queries, hit1, hit5 and mean reciprocal rank (0 where there is no answer)."""
    rank = F.col("rank")
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.count_if(rank == 1).alias("hit1"), F.count_if(rank <= 5).alias("hit5"), F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 9).alias("mrr"))
