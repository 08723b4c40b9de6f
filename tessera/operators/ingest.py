"""Incremental ingest: which listed files are new, changed, unchanged or gone, and what still lacks vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def claim_first_source(listing: DataFrame) -> DataFrame:
    """A path listed under several sources belongs to the first one (smallest source_ord)."""
    first = Window.partitionBy(F.lower("path")).orderBy("source_ord", "path")
    return listing.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def ingest_diff(listing: DataFrame, known: DataFrame, sources: list[str] | None = None, cloud: Column | None = None, on_disk: Callable[[Column], Column] | None = None) -> DataFrame:
    """path and status, by folded path, size and mtime: one full join.

    new, changed, unchanged; cloud: a placeholder by the expression ``cloud``, whatever is known of it; gone:
    known, not listed and not ``on_disk`` either; elsewhere: not listed, but still on disk.  With ``sources`` only what
    is known of those counts, and a path that another source had is new to its own.
    """
    if sources is not None:
        known = known.where(F.col("source").isin(*sources))
    away = F.lit(False) if cloud is None else F.coalesce(cloud, F.lit(False))
    source = lambda name: [F.col("source").alias(name)] if sources is not None else [F.lit(None).cast("string").alias(name)]
    a = listing.select(F.lower("path").alias("key"), F.col("path").alias("_pa"), F.col("size").alias("_sa"), F.col("mtime").alias("_ma"), away.alias("_away"), *source("_oa"))
    b = known.select(F.lower("path").alias("key"), F.col("path").alias("_pb"), F.col("size").alias("_sb"), F.col("mtime").alias("_mb"), *source("_ob"))
    same = F.col("_sa").eqNullSafe(F.col("_sb")) & F.col("_ma").eqNullSafe(F.col("_mb")) & F.col("_oa").eqNullSafe(F.col("_ob"))
    lost = F.lit("gone") if on_disk is None else F.when(on_disk(F.col("_pb")), "elsewhere").otherwise("gone")
    status = F.when(F.col("_pa").isNull(), lost).when(F.col("_away"), "cloud").when(F.col("_pb").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return a.join(b, "key", "full_outer").select(F.coalesce("_pa", "_pb").alias("path"), status.alias("status"))


def ingest_report(diff: DataFrame, failed: int = 0) -> DataFrame:
    """One row of counters; ``failed`` of the new and changed files could not be read."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return diff.agg(n("new", "changed", "unchanged", "cloud").alias("scanned"), (n("new", "changed") - failed).alias("indexed"), n("unchanged").alias("unchanged"), n("gone").alias("removed"), F.lit(failed).cast("long").alias("failed"), n("cloud").alias("skipped"))


def drop_missing(hits: DataFrame, listing: DataFrame) -> DataFrame:
    """Hits whose file is still there; it runs after the limit and so may leave fewer."""
    there = listing.select(F.lower("path").alias("_there"))
    return hits.join(there, F.lower("path") == F.col("_there"), "left_semi")


def missing_embedding(images: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Indexed images without a vector, failed ones included, of this model; a model change lists all again.

    Unordered: every one of them is encoded, so newest first would be a sort for nothing.
    """
    done = vectors.where(F.col("model") == model).select("image_id")
    return images.where(F.col("status") == "ok").join(done, F.col("id") == F.col("image_id"), "left_anti")


def missing_meaning(images: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The same for images that have text."""
    return missing_embedding(images.where(F.length("text") > 0), vectors, model)


def cloud_only(attributes: Column) -> Column:
    """Placeholder files, by the offline and recall bits of their attributes."""
    return attributes.bitwiseAND(0x1000 | 0x40000 | 0x400000) != 0


def extension_filter(listing: DataFrame, extensions: tuple[str, ...] = T.IMAGE_EXTENSIONS) -> DataFrame:
    return listing.where(T.has_extension(F.col("path"), extensions))
