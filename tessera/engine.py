"""The search engine over one index: parse, pick the ranker, rank, fuse, drop what is missing."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.encoders import Encoder
from tessera.operators import fusion, ingest, postings, text_search, vector_search
from tessera.plans.query import Query, dispatch, parse
from tessera.plans.together import together


class Engine:
    """``corpus``: id, text, name, source, mtime (and path where files are checked); vector sets: id, source, mtime, vec.

    With ``index``, the kept postings of the corpus, text search reads no text but that of its hits.  With ``present`` hits whose file it says is gone are dropped after the limit, and their ids go to ``forget``,
    on a thread of its own, so that no search waits for the index to be rewritten.
    """

    def __init__(self, corpus: DataFrame, visual: DataFrame | None = None, meaning: DataFrame | None = None, encode_image_query: Encoder | None = None, encode_meaning_query: Encoder | None = None, tz: str = "UTC", meaning_window: float = vector_search.MEANING[1], present: Callable[[str], bool] | None = None, forget: Callable[[list[int]], None] | None = None, index: postings.TextIndex | None = None):
        self.index = index
        self.corpus, self.visual, self.meaning, self.tz = corpus, visual, meaning, tz
        self.image_query, self.meaning_query = encode_image_query, encode_meaning_query
        self.meaning_window, self.present, self.forget = meaning_window, present, forget

    def _nearest(self, vectors: DataFrame | None, encoder: Encoder | None, query: Query, limit: int, floor: float, window: float) -> DataFrame:
        if vectors is None or encoder is None:
            return self.corpus.limit(0).select(F.lit(0).alias("pos"), "id", F.lit(0.0).alias("score"))
        vec = encoder([query.phrase])[0].tolist()
        return text_search.settle(vector_search.vector_topk(vectors, vec, limit, floor, window, query))

    def search(self, text: str, limit: int = 120, listing: DataFrame | None = None) -> DataFrame:
        """pos, id, block, score, matched_text, visual_score, meaning_score, snippet, then the corpus's columns but for the text."""
        query = parse(text, self.tz)
        mode = dispatch(query, self.visual is not None, self.meaning is not None)
        nothing = self.corpus.limit(0).select(F.lit(0).alias("pos"), "id", F.lit(0.0).alias("score"))
        if mode == "like":
            ranked = vector_search.more_like_this(self.visual, query.like, limit, query) if self.visual is not None else nothing
            hits = fusion.fuse(nothing, nothing, nothing, ranked, limit + 1)
        elif mode == "none":
            hits = fusion.fuse(nothing, nothing, nothing, nothing, limit)
        else:
            see = lambda: self._nearest(self.visual, self.image_query, query, limit, *vector_search.TEXT_TO_IMAGE)
            mean = lambda: self._nearest(self.meaning, self.meaning_query, query, limit, vector_search.MEANING[0], self.meaning_window)
            read = lambda: text_search.hits_and_exact(self.corpus, query, limit) if self.index is None else postings.indexed_hits(self.corpus, self.index, query, limit)
            if mode == "visual":
                hits = fusion.fuse(nothing, nothing, nothing, see(), limit)
            elif mode == "text":
                hits = fusion.fuse(*read(), nothing, nothing, limit)
            else:
                found, meant, seen = together(self.corpus.sparkSession, read, mean, see)
                hits = fusion.fuse(*found, meant, seen, limit)
        rows = self._described(text_search.settle(hits), query, mode)
        if listing is not None:
            rows = ingest.drop_missing(rows, listing)
        return rows if self.present is None else self._healed(rows)

    def _described(self, hits: DataFrame, query: Query, mode: str) -> DataFrame:
        """Hits with the corpus's columns, a snippet and, of times, ``local_time``; reads the rows of at most a limit's ids."""
        ids = [r["id"] for r in hits.select("id").collect()]
        rows = self.corpus.where(F.col("id").isin(*ids)) if ids else self.corpus.limit(0)
        term = query.long_terms[0] if query.long_terms and mode in ("text", "hybrid") else None
        snippet = F.when(F.col("matched_text"), T.snippet(F.col("text"), term)).otherwise(T.snippet(F.col("text"), None))
        out = hits.join(rows, "id").withColumn("snippet", F.coalesce(snippet, F.lit("")))
        if dict(rows.dtypes).get("mtime") == "timestamp":
            out = out.withColumn("local_time", F.from_utc_timestamp("mtime", self.tz))
        first = hits.columns
        return out.select(*first, "snippet", *[c for c in out.columns if c not in (*first, "snippet", "text")]).orderBy("pos")

    def _healed(self, rows: DataFrame) -> DataFrame:
        """Without files that are gone; the index forgets them meanwhile."""
        found = rows.collect()
        gone = {r["id"] for r in found if not self.present(r["path"])}
        if gone and self.forget is not None:
            threading.Thread(target=self.forget, args=(sorted(gone),)).start()
        return rows.sparkSession.createDataFrame([r for r in found if r["id"] not in gone], rows.schema)
