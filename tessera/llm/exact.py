"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("_body", body).withColumn("_hash", digest(body))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by (hash, text): rows meet by hash, and the grouping itself compares the bytes, so
    texts whose hashes collide stay apart.  Copies collapse in the map-side half of the aggregation, so a
    group with a third of all rows sends one row per task.  What is joined back is narrow: hash, digest, ids.

    Null text counts as empty.  Rows that repeat an id and a text share their answer.  A null id never
    stays while its group has another; a group of null ids only has a null keep_id and its rows stay.
    An empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text).cast("string").alias("_text"))
    keyed = _keyed(narrow, "_text", digest)
    pick = F.max if keep == "largest" else F.min
    classes = keyed.groupBy("_hash", "_body").agg(pick(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select(F.col("_hash").alias("_h"), F.sha2("_body", 256).alias("_sha"), "keep_id", "group_size")
    rows = keyed.select(id_col, "_hash", F.sha2("_body", 256).alias("text_sha256"))
    joined = rows.join(classes, (F.col("_hash") == F.col("_h")) & (F.col("text_sha256") == F.col("_sha")))
    return joined.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One whole row for each distinct text, with the columns of ``docs``; null and empty texts are one group.

    Exactly one row stays even where id and text repeat.  The row's other columns travel with the
    aggregation, so texts are shuffled once and not joined again.
    """
    names = docs.columns
    rest = [c for c in names if c != text]
    order = F.col(id_col) if keep == "largest" else -F.col(id_col)
    one = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)], F.col(text).isNull().alias("_null"))
    keyed = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body"), one.alias("_row"), F.struct(order.isNotNull(), order).alias("_order"))
    kept = keyed.groupBy(digest(F.col("_body")).alias("_hash"), "_body").agg(F.max_by("_row", "_order").alias("_row"))
    at = {c: F.col(f"_row._{i}") for i, c in enumerate(rest)}
    at[text] = F.when(~F.col("_row._null"), F.col("_body"))
    return kept.select(*[at[c].alias(c) for c in names])
