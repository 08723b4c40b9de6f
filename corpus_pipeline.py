"""A corpus pipeline: judge quality, drop copies and near copies, mix sources, pack tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents, whatever they are called.  Null and empty texts pass the classifier on their measures like
others, count as one text in exact dedup, and link with nothing in the join.  Empty tables stay empty.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, mixing, ngram_join, packing, quality
from tessera.llm.store import park, parked, sweep

VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither of low quality nor toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    veiled = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    marks = labels.select(F.col("doc_id").alias(at["doc_id"]), "quality", "toxic")
    kept = quality.classify(veiled, marks, at["doc_id"], at["text"], at["source"], at["lang"], veiled.columns).where("kept")
    return kept.select(*[F.col(at[c]).alias(c) for c in names])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    return exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 of five-word shingles."""
    found = ngram_join.ngram_jaccard(docs, width=5, percent=80)
    gone = park(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, that the mix of sources takes."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row for each piece of a document, with its ids."""
    return packing.pack(docs, VOCABULARY, added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", judge_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: A trained classifier's decisions can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``.

    Each stage's result is written and read again; the tables that the stage parked on its way, and the
    stage's input, are swept then.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = parked()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = park(docs)
            sweep(spark, mark)
    return docs
