"""Each query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return db


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{float(v):.6f}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([plain(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pos", "id", "block", "score", "matched_text", "visual_score", "meaning_score"] and df.count() > 0


def test_encoder_stub(spark, sf):
    from pyspark.sql import functions as F

    from tessera.functions import encoders

    vec = encoders.encode_column(F.col("text"))
    assert engine.corpus(spark, sf).select(vec.alias("vec")).where("size(vec) <> 64").count() == 0
