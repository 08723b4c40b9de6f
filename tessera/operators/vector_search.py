"""Vector search: exact cosine against every vector, filters first, floor, window under the best score, top-k.

Vectors are scored batch by batch in Arrow, for one query or many at once; a task keeps no more than each query's best
rows, and only these are sorted and shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import CHUNK, dots, rows_of
from tessera.operators.text_search import date_filter, source_prefix
from tessera.plans.query import Query

#: Floors and windows of the three uses.
TEXT_TO_IMAGE, MEANING, IMAGE_TO_IMAGE = (0.20, 0.07), (0.70, 0.03), (0.70, 1.0)


def load_embeddings(images: DataFrame, embeddings: DataFrame, model: str, dim: int | None = None) -> DataFrame:
    """(id, source, mtime, vec) of the model's usable vectors.

    Empty vectors are failed attempts, other lengths than ``dim`` (default: the smallest id's) are skipped.
    """
    rows = embeddings.where((F.col("model") == model) & (F.size("vec") > 0))
    if dim is None:
        first = rows.orderBy("image_id").select(F.size("vec").alias("n")).first()
        dim = first["n"] if first else 0
    usable = rows.where(F.size("vec") == dim)
    return images.join(usable, images["id"] == usable["image_id"]).select("id", "source", "mtime", "vec")


def vector_of(vectors: DataFrame, id_: int) -> list[float] | None:
    row = vectors.where(F.col("id") == id_).select("vec").first()
    return list(row["vec"]) if row else None


def best_rows(vectors: DataFrame, queries: np.ndarray, limit: int, floor: float = 0.0) -> DataFrame:
    """(item, id, score): of each task the ``limit`` best rows for each query (item: its number), with score >= floor; ties by id.

    Vectors of other lengths than the queries, and those with nulls, are passed over.
    """

    def best(item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, -score, item))
        item, ids, score = item[order], ids[order], score[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]][: len(item)])
        keep = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)])) < limit
        return item[keep], ids[keep], score[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # From where on a query's rows can be among its best.
        least = np.full(len(queries), floor)
        for b in (whole.slice(i, CHUNK) for whole in batches for i in range(0, whole.num_rows, CHUNK)):
            rows, x = rows_of(b.column(1), queries.shape[1])
            if not len(rows):
                continue
            score = dots(x, queries)
            at, item = np.nonzero(score >= least[None, :])
            ids = b.column(0).to_numpy()[rows[at]]
            held = tuple(np.concatenate(p) for p in zip(held, (item, ids, score[at, item]), strict=True))
            if len(held[0]) > 2 * limit * len(queries):
                held = best(*held)
                full = np.bincount(held[0], minlength=len(queries)) == limit
                last = np.full(len(queries), floor)
                np.minimum.at(worst := np.full(len(queries), np.inf), held[0], held[2])
                last[full] = worst[full]
                least = last
        held = best(*held)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["item", "id", "score"])

    return vectors.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "item long, id long, score double")


def ranked(found: DataFrame, limit: int, window: float) -> DataFrame:
    """(item, pos, id, score): each query's ``limit`` best rows of all tasks', no more than ``window`` below the best.

    The best rows are taken first; as what the window cuts is the lowest, cutting them gives the same.
    """
    ordered = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    place = found.withColumn("pos", F.row_number().over(ordered)).withColumn("_best", F.first("score").over(ordered))
    return place.where((F.col("pos") <= limit) & (F.col("score") >= F.col("_best") - window)).select("item", "pos", "id", "score")


def filtered(vectors: DataFrame, query: Query) -> DataFrame:
    """The vectors that a query's source and dates leave."""
    kept = vectors.where(date_filter(query))
    return kept.where(source_prefix(query.source)) if query.source else kept


def vector_topk(vectors: DataFrame, vec: list[float], limit: int, floor: float = 0.0, window: float = 1.0, query: Query | None = None, exclude: tuple[int, ...] = ()) -> DataFrame:
    """pos, id, score: at most ``limit`` ids with score >= floor and >= best - window; ties by id."""
    kept = filtered(vectors, query or Query())
    if exclude:
        kept = kept.where(~F.col("id").isin(*exclude))
    top = best_rows(kept, np.array([vec], float), max(limit, 0), floor).orderBy(F.desc("score"), "id").limit(max(limit, 0))
    return ranked(top, max(limit, 0), window).select("pos", "id", "score")


def more_like_this(vectors: DataFrame, id_: int, limit: int, query: Query | None = None, floor: float = IMAGE_TO_IMAGE[0], window: float = IMAGE_TO_IMAGE[1]) -> DataFrame:
    """The item itself, whatever the filters, then at most ``limit`` others; unknown ids give nothing."""
    vec = vector_of(vectors, id_)
    if vec is None:
        return vectors.limit(0).select(F.lit(0).alias("pos"), "id", F.lit(0.0).alias("score"))
    others = vector_topk(vectors, vec, limit, floor, window, query, (id_,))
    own = vectors.where(F.col("id") == id_).select(F.lit(0).alias("pos"), "id", F.lit(1.0).alias("score"))
    return own.unionByName(others)
