"""Text search: substring predicates, BM25 over the whole corpus, newest first among equals.

A corpus is a DataFrame (id, text, name, source, mtime).  ``mtime`` is whatever orders by recency.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.query import Query
from tessera.plans.together import together

RARE = 1e-6


def both(predicate, term: str) -> Column:
    """A term may stand in the text or in the name."""
    return predicate(F.col("text"), term) | predicate(F.col("name"), term)


def term_filter(query: Query) -> Column:
    """All terms: long ones as folded substrings, short ones as wildcard patterns."""
    parts = [both(T.contains_long, t) for t in query.long_terms] + [both(T.like_short, t) for t in query.short_terms]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def source_like(query_source: str) -> Column:
    """Text search's source filter: a prefix with live wildcards, A-Z folded."""
    return T.ascii_lower(F.col("source")).like(query_source.translate(str.maketrans(T.UPPER, T.LOWER)).replace("\\", "\\\\") + "%")


def source_prefix(query_source: str) -> Column:
    """Vector search's source filter: a plain prefix, letters in either case."""
    return F.lower("source").startswith(query_source.lower())


def date_filter(query: Query, column: str = "mtime") -> Column:
    """From ``after`` on, before ``before``."""
    out = F.lit(True)
    if query.after is not None:
        out = out & (F.col(column) >= F.lit(query.after))
    if query.before is not None:
        out = out & (F.col(column) < F.lit(query.before))
    return out


def _matched(c: Column, term: str) -> Column:
    return T.occurrences(F.lower(c), term.lower())


def corpus_statistics(corpus: DataFrame, terms: list[str]) -> dict:
    """Number of rows, mean length and document frequencies, in one pass over the whole corpus."""
    length = F.greatest(F.length("text") - 2, F.lit(0)) + F.greatest(F.length("name") - 2, F.lit(0))
    found = [F.count_if(both(T.contains_long, t)).alias(f"n{i}") for i, t in enumerate(terms)]
    row = corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avg"), *found).first()
    return {"n": row["n"], "avg": row["avg"] or 0.0, "df": [row[f"n{i}"] for i in range(len(terms))]}


def idf(n: int, df: int) -> float:
    value = math.log((n - df + 0.5) / (df + 0.5))
    return value if value > 0 else RARE


def bm25(terms: list[str], stats: dict, k1: float = 1.2, b: float = 0.75) -> Column:
    """Negative, so that ascending order is best first; statistics are literals from :func:`corpus_statistics`."""
    length = F.greatest(F.length("text") - 2, F.lit(0)) + F.greatest(F.length("name") - 2, F.lit(0))
    return bm25_of([_matched(F.col("text"), t) + _matched(F.col("name"), t) for t in terms], length, stats, k1, b)


def bm25_of(counts: list[Column], length: Column, stats: dict, k1: float = 1.2, b: float = 0.75) -> Column:
    """The same from the terms' numbers of occurrences."""
    weigh = k1 * (1 - b + b * length / F.lit(stats["avg"] or 1.0))
    score = F.lit(0.0)
    for f, df in zip(counts, stats["df"], strict=True):
        score = score - F.lit(idf(stats["n"], df)) * f * (k1 + 1) / (f + weigh)
    return score


def text_search(corpus: DataFrame, query: Query, limit: int = 60, stats: dict | None = None) -> DataFrame:
    """At most ``limit`` hits: pos, id, source, mtime, score, snippet, matched_text.

    By BM25, then newest first, then id; newest first alone where no long term ranks.  The substring test
    runs before occurrences are counted; the limit is a top-k, so no more than that is sorted in one place.
    ``stats`` are the corpus statistics of the query's long terms, where the caller has them.  With a kept index
    :func:`tessera.operators.postings.indexed_search` gives the same rows without reading the corpus's texts.
    """
    if limit <= 0:
        return corpus.limit(0).select(F.lit(0).alias("pos"), "id", "source", "mtime", F.lit(0.0).alias("score"), F.col("text").alias("snippet"), F.lit(False).alias("matched_text"))
    terms = query.long_terms
    kept = corpus.where(term_filter(query)).where(date_filter(query))
    if query.source:
        kept = kept.where(source_like(query.source))
    score = bm25(terms, stats or corpus_statistics(corpus, terms)) if terms else F.lit(0.0)
    scored = kept.select("id", "source", "mtime", F.round(score, 9).alias("score"), "text")
    top = scored.orderBy("score", F.desc("mtime"), "id").limit(limit)
    place = F.row_number().over(Window.orderBy("score", F.desc("mtime"), "id"))  # over the top-k only
    return top.select(place.alias("pos"), "id", "source", "mtime", "score", T.snippet(F.col("text"), terms[0] if terms else None).alias("snippet"), F.lit(bool(query.terms)).alias("matched_text"))


def settle(hits: DataFrame) -> DataFrame:
    """The rows of a top-k, computed once: at most its limit's, so that fusing it several times scans nothing again."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def phrase_query(query: Query) -> Query:
    """The same filters with the terms as one phrase."""
    return Query([query.phrase], query.source, query.after, query.before)


def hits_and_exact(corpus: DataFrame, query: Query, limit: int) -> tuple[DataFrame, DataFrame]:
    """(text hits, those in which the terms stand as one phrase); a single term's hits are all exact.

    The terms' and the phrase's statistics come from one pass over the corpus.
    """
    if len(query.terms) <= 1:
        hits = settle(text_search(corpus, query, limit))
        return hits, hits
    phrase, terms = phrase_query(query), query.long_terms
    stats = corpus_statistics(corpus, terms + phrase.long_terms)
    part = lambda df: {**stats, "df": df}
    hits, found = together(
        corpus.sparkSession,
        lambda: settle(text_search(corpus, query, limit, part(stats["df"][: len(terms)]))),
        lambda: text_search(corpus, phrase, limit, part(stats["df"][len(terms) :])).select("id").collect(),
    )
    exact = {r["id"] for r in found}
    return hits, hits.where(F.col("id").isin(*exact)) if exact else hits.limit(0)


def exact_hits(corpus: DataFrame, query: Query, limit: int) -> DataFrame:
    """Text hits in which the terms stand as one phrase."""
    return hits_and_exact(corpus, query, limit)[1]


def loose_hits(corpus: DataFrame, query: Query, limit: int) -> DataFrame:
    """Text hits that are not exact."""
    hits, exact = hits_and_exact(corpus, query, limit)
    return hits.join(exact.select("id"), "id", "left_anti")


def get_texts(corpus: DataFrame, ids: list[int]) -> DataFrame:
    return corpus.where(F.col("id").isin(*ids)).select("id", "text")


def get_hits(corpus: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rows for ranked ids (id, pos, score), in their order; unknown ids drop out."""
    return ranked.join(corpus, "id").select("pos", "id", "source", "mtime", T.snippet(F.col("text"), None).alias("snippet"), F.col("score").alias("visual_score"), F.lit(False).alias("matched_text"))
