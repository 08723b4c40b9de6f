"""Hybrid search for many queries at once, on a kept text index and on vectors.

A list of queries is short and lies on the driver.  Postings (or, for long lists, texts) and vectors are read once for all of them: blocks and batches
give each query's matches, tasks keep each query's best rows, and rankings are fused in groups.  What comes out is what the engine
gives query by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fusion, postings, vector_search
from tessera.operators.postings import TextIndex
from tessera.operators.text_search import idf, term_filter
from tessera.plans.batches import small_batches
from tessera.plans.query import Query

FOLD = str.maketrans(T.UPPER, T.LOWER)
HITS = "item long, pos int, id long, score double"


def plain(queries: dict[int, Query]) -> None:
    """Queries that can be searched together."""
    for q in queries.values():
        if q.source or q.after or q.before or q.like is not None or q.visual_only or not q.terms:
            raise ValueError("queries with filters, or without terms, are searched one by one")
        if any(c in t for t in q.short_terms for c in "%_"):
            raise ValueError("short terms with wildcards are searched one by one")


def text_matches(corpus: DataFrame, index: TextIndex, queries: dict[int, Query]) -> DataFrame:
    """(item, id, length, counts, phrase): for each query the rows with all its terms, how often its long terms and its phrase stand there."""
    plain(queries)
    long = {k: [t.lower() for t in q.long_terms] for k, q in queries.items() if q.long_terms and all(len(t) >= 3 for t in q.long_terms)}
    phrase = {k: queries[k].phrase.lower() for k in long}
    terms = sorted({t for ts in long.values() for t in ts} | {p for p in phrase.values() if len(p) >= 3})
    at = {t: i for i, t in enumerate(terms)}
    asked = [(k, [at[t] for t in ts], at.get(phrase[k], -1)) for k, ts in long.items()]

    def emit(seq, ids, length, counts):
        has = counts > 0
        for k, own, whole in asked:
            rows = np.flatnonzero(has[:, own].all(axis=1))
            if len(rows):
                one = counts[rows, whole] if whole >= 0 else np.zeros(len(rows), np.int32)
                cols = [pa.array(np.full(len(rows), x, np.int64)) for x in (seq, k)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids[rows]), pa.array(length[rows]), postings.number_lists(counts[rows][:, own]), pa.array(one.astype(np.int64))], names=["seq", "item", "id", "length", "counts", "phrase"])

    spark, schema = corpus.sparkSession, "item long, id long, length int, counts array<bigint>, phrase long"
    found = spark.createDataFrame([], schema)
    if terms:
        found = postings.matches(index, terms, emit, schema, postings.scanned(corpus, terms))
    short = [(k, [t.translate(FOLD) for t in queries[k].short_terms]) for k in long if queries[k].short_terms]
    if short:
        # Only rows that hold the long terms are read for the short ones; few are told to all tasks, so that no text is shuffled.
        wanted = spark.createDataFrame(short, "item long, _short array<string>")
        found = found.persist()
        open_ = found.select("item", "id").where(F.col("item").isin(*[k for k, _ in short]))
        open_ = F.broadcast(open_) if open_.count() <= postings.BROADCAST else open_
        fold = lambda c: T.ascii_lower(F.coalesce(c, F.lit("")))
        texts = corpus.select("id", fold(F.col("text")).alias("_text"), fold(F.col("name")).alias("_name"))
        held = texts.join(open_, "id").join(F.broadcast(wanted), "item").where(F.forall("_short", lambda t: F.contains(F.col("_text"), t) | F.contains(F.col("_name"), t)))
        of_short = found.join(held.select("item", "id"), ["item", "id"], "left_semi")
        found = found.where(~F.col("item").isin(*[k for k, _ in short])).unionByName(of_short)
    only = [k for k, q in queries.items() if not q.long_terms]
    if only:
        # Without a long term there is nothing to look up: one pass over the texts for all such queries.
        items = F.filter(F.array(*[F.when(term_filter(queries[k]), F.lit(k).cast("long")) for k in only]), lambda x: x.isNotNull())
        rows = corpus.select(F.col("id").cast("long").alias("id"), F.explode(items).alias("item"))
        found = found.unionByName(rows.select("item", "id", F.lit(0).alias("length"), F.array().cast("array<bigint>").alias("counts"), F.lit(0).cast("long").alias("phrase")))
    return found


def text_hits(corpus: DataFrame, index: TextIndex, queries: dict[int, Query], limit: int) -> DataFrame:
    """(item, pos, id, score, exact): each query's ``limit`` best rows by BM25, newest first among equals, and which of them hold the phrase."""
    spark = corpus.sparkSession
    with small_batches(spark):
        found = text_matches(corpus, index, queries).persist()
        items = [r["item"] for r in found.select("item").distinct().collect()]
    phrase = {k: queries[k].phrase.lower() if len(queries[k].terms) > 1 and len(queries[k].phrase) >= 3 else None for k in items}
    terms = sorted({t.lower() for k in items for t in queries[k].long_terms if len(t) >= 3} | {p for p in phrase.values() if p})
    with small_batches(spark):
        df = postings.document_frequencies(index, terms, postings.scanned(corpus, terms))
    weights = [(k, [idf(index.n, df[t.lower()]) for t in queries[k].long_terms], idf(index.n, df[phrase[k]]) if phrase[k] else None, len(queries[k].terms) == 1) for k in items]
    known = found.join(F.broadcast(spark.createDataFrame(weights, "item long, _idf array<double>, _phrase_idf double, _single boolean")), "item")
    known = known.join(corpus.select(F.col("id").cast("long").alias("id"), "mtime"), "id")
    weigh = 1.2 * (1 - 0.75 + 0.75 * F.col("length") / F.lit(index.mean or 1.0))
    one = lambda f, i: i * f * (1.2 + 1) / (f + weigh)
    score = F.round(F.aggregate(F.zip_with("counts", "_idf", one), F.lit(0.0), lambda s, x: s - x), 9)
    scored = known.select("item", "id", "mtime", "_single", score.alias("score"), F.when(F.col("phrase") > 0, F.round(-one(F.col("phrase"), F.col("_phrase_idf")), 9)).alias("_phrase"))
    by = lambda c: Window.partitionBy("item").orderBy(c, F.desc("mtime"), "id")
    exact = scored.where("_phrase IS NOT NULL").withColumn("_at", F.row_number().over(by("_phrase"))).where(F.col("_at") <= limit).select("item", "id", F.lit(True).alias("_exact"))
    hits = scored.withColumn("pos", F.row_number().over(by("score"))).where(F.col("pos") <= limit).join(exact, ["item", "id"], "left")
    return hits.select("item", "pos", "id", "score", (F.col("_single") | F.coalesce("_exact", F.lit(False))).alias("exact"))


def vector_hits(vectors: DataFrame | None, queries: dict[int, list[float]], limit: int, floor: float, window: float, spark=None) -> DataFrame:
    """(item, pos, id, score): each query's best vectors, above the floor and the window under its best."""
    if vectors is None or not queries:
        return (spark or vectors.sparkSession).createDataFrame([], HITS)
    items = list(queries)
    found = vector_search.best_rows(vectors, np.array([queries[k] for k in items], float), limit, floor)
    number = F.element_at(F.array(*[F.lit(k).cast("long") for k in items]), (F.col("item") + 1).cast("int"))
    return vector_search.ranked(found.withColumn("item", number), limit, window)


def hybrid_hits(text: DataFrame, meaning: DataFrame, visual: DataFrame, limit: int) -> DataFrame:
    """(item, pos, id, block, score, matched_text, visual_score, meaning_score): rankings of many queries fused query by query."""
    cols = ("item", "id", "pos", "score")
    return fusion.fuse(text.select(*cols), text.where("exact").select(*cols), meaning.select(*cols), visual.select(*cols), limit, by=("item",))


def first_answers(hits: DataFrame, answers: Column | str, items: list[int], texts: DataFrame) -> DataFrame:
    """(item, rank): place of each query's first hit that is an answer, null without one; ``answers`` is a condition on hits joined with ``texts`` (id, ...)."""
    known = hits.join(texts, "id").where(answers).groupBy("item").agg(F.min("pos").alias("rank"))
    return hits.sparkSession.createDataFrame([(k,) for k in items], "item long").join(known, "item", "left")
