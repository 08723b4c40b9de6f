"""Relevance of text search, of fused search and of raw vector scores for a whole list of queries at once.

A list of queries is short (hundreds) and lies on the driver; the kept text index and the vectors are read with
all queries in each pass.  Ranks are those that the engine's search gives query by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.encoders import Encoder
from tessera.operators import batch, postings, vector_search
from tessera.operators.postings import TextIndex
from tessera.plans.batches import small_batches
from tessera.plans.query import Query


def _answered(hits: DataFrame, corpus: DataFrame, answers: dict[int, str], most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(item, rank), for each value of ``by``: place of the first hit whose text holds the query's answer, where one does.

    ``most``: hits there can be.  Where they are told to all tasks, only texts are read and nothing of them is shuffled.
    """
    wanted = F.broadcast(corpus.sparkSession.createDataFrame(list(answers.items()), "item long, _answer string"))
    places = hits.select(*by, "item", "id", "pos")
    texts = corpus.select(F.col("id").cast("long").alias("id"), "text")
    known = texts.join(F.broadcast(places) if most <= postings.BROADCAST else places, "id").join(wanted, "item").where(F.contains("text", F.col("_answer")))
    return known.groupBy(*by, "item").agg(F.min("pos").cast("long").alias("rank"))


def _all_items(ranks: DataFrame, answers: dict[int, str]) -> DataFrame:
    return ranks.sparkSession.createDataFrame([(k,) for k in answers], "item long").join(ranks, "item", "left")


def _exact_first(hits: DataFrame) -> DataFrame:
    """Text hits in the order of a search that has no vectors: exact ones first."""
    order = Window.partitionBy("item").orderBy(F.when(F.col("exact"), 0).otherwise(1), "pos")
    return hits.withColumn("pos", F.row_number().over(order))


def search_ranks(corpus: DataFrame, index: TextIndex, queries: dict[int, Query], answers: dict[int, str], limit: int = 120) -> DataFrame:
    """item, rank: place of the first row whose text holds the answer among the query's ``limit`` hits of text search, exact ones first; null if there is none."""
    hits = _exact_first(batch.text_hits(corpus, index, queries, limit))
    return _all_items(_answered(hits, corpus, answers, limit * len(queries)), answers)


def engine_ranks(corpus: DataFrame, index: TextIndex, visual: DataFrame, meaning: DataFrame, queries: dict[int, Query], seen: dict[int, list[float]], meant: dict[int, list[float]], answers: dict[int, str], limit: int = 120, window: float = vector_search.MEANING[1], floors: tuple[float, float] = (vector_search.TEXT_TO_IMAGE[0], vector_search.MEANING[0])) -> DataFrame:
    """engine, item, rank for text alone, with images, with meaning and with both; ``seen`` and ``meant`` are the queries' vectors.

    Each ranking is made once and fused in four ways; the texts are read once for all of them.
    """
    text = batch.text_hits(corpus, index, queries, limit).persist()
    spark = corpus.sparkSession
    look = batch.vector_hits(visual, seen, limit, floors[0], vector_search.TEXT_TO_IMAGE[1], spark).persist()
    mean = batch.vector_hits(meaning, meant, limit, floors[1], window, spark).persist()
    none = look.limit(0)
    engines = ("text", none, none), ("text and images", none, look), ("text and meaning", mean, none), ("all", mean, look)
    out = None
    for name, m, v in engines:
        hits = _exact_first(text) if name == "text" else batch.hybrid_hits(text, m, v, limit)
        one = hits.select(F.lit(name).alias("engine"), "item", "id", "pos")
        out = one if out is None else out.unionByName(one)
    ranks = _answered(out, corpus, answers, len(engines) * limit * len(queries), ("engine",))
    names = spark.createDataFrame([(name, k) for name, _, _ in engines for k in answers], "engine string, item long")
    return names.join(ranks, ["engine", "item"], "left")


def holders(corpus: DataFrame, index: TextIndex, answers: dict[int, str]) -> DataFrame:
    """(item, id): rows whose text holds an item's text; the index, or for long lists one pass over the texts, names the rows to look into."""
    spark = corpus.sparkSession
    texts = sorted({t.lower() for t in answers.values() if len(t) >= 3})
    found = postings.term_counts(index, texts, postings.scanned(corpus, texts)) if texts else spark.createDataFrame([], "id long, counts array<bigint>")
    place = {t: i for i, t in enumerate(texts)}
    wanted = F.broadcast(spark.createDataFrame([(k, t, place.get(t.lower())) for k, t in answers.items()], "item long, _answer string, _at int"))
    pairs = found.select("id", F.posexplode("counts").alias("_at", "_n")).where("_n > 0").select("id", "_at")
    # Few are told to all tasks, so that no text is shuffled.
    with small_batches(spark):
        pairs = pairs.persist()
        met = F.broadcast(pairs) if pairs.count() <= postings.BROADCAST else pairs
    read = corpus.select(F.col("id").cast("long").alias("id"), "text")
    return read.join(met, "id").join(wanted.where("_at IS NOT NULL"), "_at").where(F.contains("text", F.col("_answer"))).select("item", "id")


def vector_ranks(vectors: DataFrame, queries: dict[int, str], encoder: Encoder, answers: DataFrame) -> DataFrame:
    """item, score, rank, best, tenth: of all vectors, without floor or window, the best answer's score and rank, the best score and the tenth.

    ``answers``: item, id.  Null where an item has no answer with a vector, or there are fewer than ten vectors.
    Ties by id.  The vectors are read for the answers, for the best ten and to count what is ahead of each answer.
    """
    spark = vectors.sparkSession
    items = list(queries)
    q = encoder([queries[k] for k in items]).astype(np.float64)
    read = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    row = {k: i for i, k in enumerate(items)}

    def scores(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
        return b.column(0).to_numpy(), np.round(np.einsum("nd,qd->qn", x, q), 9)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, s = scores(b)
            rows: list[tuple] = []
            for i, k in enumerate(items):
                order = np.lexsort((ids, -s[i]))[:10]
                rows += [(k, int(ids[j]), float(s[i, j])) for j in order]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["item", "id", "score"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, s = scores(b)
                mine = s[[row[k] for k in b.column(2).to_pylist()], np.arange(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(ids), pa.array(mine)], names=["item", "id", "score"])

    kind = "item long, id long, score double"
    ten = read.mapInArrow(top, kind).withColumn("_at", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))).where("_at <= 10")
    ends = ten.groupBy("item").agg(F.max("score").alias("best"), F.max(F.when(F.col("_at") == 10, F.col("score"))).alias("tenth"))
    of = answers.join(read, "id").select("id", "vec", F.col("item").cast("long").alias("item")).mapInArrow(own, kind).groupBy("item").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("a")).collect()
    answer = {r["item"]: (-r["a"]["s"], r["a"]["id"]) for r in of}

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = dict.fromkeys(answer, 0)
        for b in batches:
            if b.num_rows:
                ids, s = scores(b)
                for i, k in enumerate(items):
                    if k in answer:
                        best, at = answer[k]
                        count[k] += int(np.count_nonzero((s[i] > best) | ((s[i] == best) & (ids < at))))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["item", "n"])

    before = read.mapInArrow(ahead, "item long, n long").groupBy("item").agg((F.sum("n") + 1).alias("rank"))
    all_ = spark.createDataFrame([(k, *(answer[k][:1] if k in answer else (None,))) for k in items], "item long, score double")
    return all_.join(before, "item", "left").join(ends, "item", "left").select("item", "score", "rank", "best", "tenth")
