"""Changes to the index as DataFrame to DataFrame functions; a snapshot commit makes them durable.

Images: (id, path, source, ...); vectors: (image_id, model, vec).  Paths are unique by A-Z-folded value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def upsert(images: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace rows of the same path and keep their ids; new paths get ids after the largest.

    Of several entries for a path the last by ``indexed_at`` counts.
    """
    key = T.ascii_lower(F.col("path"))
    kept = images.join(entries.select(key.alias("_key")).distinct(), key == F.col("_key"), "left_anti")
    new = upserted(images, entries)
    return kept.unionByName(new.select(*[c for c in images.columns if c in new.columns]), allowMissingColumns=True)


def upserted(images: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows that :func:`upsert` adds or puts in place of others, with their ids."""
    key = T.ascii_lower(F.col("path"))
    latest = Window.partitionBy("_key").orderBy(F.desc("indexed_at"), F.desc("path"))
    one = entries.withColumn("_key", key).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    known = images.select(F.col("id").alias("_known"), key.alias("_k"))
    matched = one.join(known, F.col("_key") == F.col("_k"), "left").drop("_k")
    top = images.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = matched.where("_known IS NULL")
    # New ids: a running number by path within hash buckets, offset by the buckets' sizes.
    bucket = F.pmod(F.xxhash64("_key"), F.lit(256))
    fresh = fresh.withColumn("_bucket", bucket)
    sizes = fresh.groupBy("_bucket").count()
    base = sizes.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    numbered = fresh.join(base, F.col("_bucket") == F.col("_b")).withColumn("_known", F.lit(top) + F.col("_base") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_key")))
    return matched.where("_known IS NOT NULL").unionByName(numbered.drop("_bucket", "_b", "_base")).withColumn("id", F.col("_known").cast("long")).drop("_known", "_key")


def changed_ids(images: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids whose files changed; their vectors go."""
    gone = entries.select(T.ascii_lower(F.col("path")).alias("_key")).distinct()
    return images.join(gone, T.ascii_lower(F.col("path")) == F.col("_key"), "left_semi").select("id")


def drop_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, vectors["image_id"] == ids["id"], "left_anti")


def move_path(images: DataFrame, old: str, new: str, source: str) -> tuple[DataFrame, int]:
    """Rename a file or folder: what is at the new place goes, prefixes change, names follow; ids stay.

    A rename that changes letter case only is a move like any other.  Returns the images and how many moved.
    """
    path = F.col("path")
    moving = T.under(path, old)
    kept = images.where(moving | ~T.under(path, new))
    n = images.where(moving).count()
    moved = kept.withColumn("source", F.when(moving, F.lit(source)).otherwise(F.col("source"))).withColumn("path", F.when(moving, T.re_prefix(path, old, new)).otherwise(path))
    if "name" in images.columns:
        moved = moved.withColumn("name", T.file_stem(F.col("path")))
    return moved, n


def remove_path(images: DataFrame, path: str) -> DataFrame:
    """Without a path and all below it."""
    return images.where(~T.under(F.col("path"), path))


def remove_many(images: DataFrame, ids: DataFrame) -> DataFrame:
    return images.join(ids, "id", "left_anti")


def remove_source(images: DataFrame, source: str) -> DataFrame:
    return images.where(~F.col("source").eqNullSafe(source))


def one_vector(new: DataFrame) -> DataFrame:
    """Of several vectors of an image that of the largest ``model``."""
    return new.withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("model")))).where("_n = 1").drop("_n")


def save_embeddings(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """One vector per image: new ones replace old ones of any model; of several new ones the largest ``model`` counts."""
    one = one_vector(new)
    return vectors.join(one.select("image_id"), "image_id", "left_anti").unionByName(one)


def removed_sources(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Sources to forget: gone or pointing elsewhere, by name and path."""
    return previous.join(following, ["name", "path"], "left_anti")
