"""Relevance and latency of an engine over a fixed list of queries."""

from __future__ import annotations

import statistics
import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions.encoders import Encoder
from tessera.operators import reporting


def evaluate(engines: dict[str, Engine], queries: list[tuple[str, list[str]]], limit: int = 120) -> DataFrame:
    """engine, queries, hit1, hit5, mrr: a hit is a path that ends with one of the query's answers, in any case.

    A search per query and engine, as many rows from each as its limit.
    """
    rows = []
    spark = next(iter(engines.values())).corpus.sparkSession
    for name, engine in engines.items():
        for n, (q, answers) in enumerate(queries):
            hits = engine.search(q, limit).select("pos", "path").collect()
            rows += [(name, n, h["pos"], h["path"], answers) for h in hits] or [(name, n, 0, "", [])]
    results = spark.createDataFrame(rows, "engine string, q int, pos int, path string, answers array<string>")
    hit = reporting.is_answer(F.col("path"), F.col("answers"))
    return reporting.eval_metrics(reporting.first_answer(results, hit, ["engine", "q"]), ["engine"])


def latencies(engine: Engine, queries: list[str], rounds: int = 20, limit: int = 60) -> dict[str, float]:
    """Median and 95th percentile in milliseconds, picked from the sorted times."""
    times = []
    for _ in range(rounds):
        for q in queries:
            start = time.perf_counter()
            engine.search(q, limit).collect()
            times.append(1000 * (time.perf_counter() - start))
    times.sort()
    return {"median": times[len(times) // 2], "p95": times[int(len(times) * 0.95)], "mean": statistics.fmean(times)}


def encoder_agreement(encoder: Encoder, texts: list[str]) -> float:
    """The smallest cosine between vectors made in one batch and one by one."""
    batch = encoder(texts)
    alone = np.concatenate([encoder([t]) for t in texts])
    return float((batch * alone).sum(axis=1).min())
