import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions import text as T
from tessera.functions.encoders import ClipTokens, PieceTokens, encode_column, hash_projection, merge_pairs, preprocess_image
from tessera.functions.vectors import l2_normalize
from tessera.operators import fusion, outline, text_search, vector_search
from tessera.plans.query import Query, parse
from tessera.service import answer

ROWS = [
    ("MoCA network setup moca adapter", "net-diagram"),
    ("invoice 2024\nfactura total", "scan_001"),
    ("the network of two works, work networking", "moca"),
    ("", "empty-name"),
    ("ab", "xy"),
    ("résumé RÉSUMÉ Resume straße STRASSE", "unicode"),
    ("moca\nnetwork", "nl"),
    ("moca network", "sp"),
    ("50% off a_b", "pct"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, n, "shots" if i % 2 else "notes", i) for i, (t, n) in enumerate(ROWS, 1)]
    return spark.createDataFrame(rows, "id long, text string, name string, source string, mtime long").cache()


def ids(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_bm25_against_sqlite(corpus):
    """The same rows and scores as SQLite's trigram full-text table, where this Python has it."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(text, name, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram full text")
    db.executemany("insert into f values (?, ?)", ROWS)
    for terms in (["moca"], ["moca", "network"], ["moca network"], ["work"], ["resume"], ["RÉSUMÉ"], ["0% "], ["net"]):
        match = " AND ".join('"' + t.replace('"', '""') + '"' for t in terms)
        want = {i: s for i, s in db.execute("select rowid, bm25(f) from f where f match ?", [match])}
        got = {r["id"]: r["score"] for r in text_search.text_search(corpus, Query(terms)).collect()}
        assert got == pytest.approx(want, abs=1e-8), terms


def test_text_rules(corpus):
    find = lambda q, n=60: ids(text_search.text_search(corpus, parse(q), n))
    assert find("moca") == [8, 7, 1, 3]
    assert find('"moca network"') == [8, 1]
    assert find("straße") == [6] and find("strasse") == [6] and find("resume") == [6]
    assert find("😀a") == []
    assert find("ab") == [5] and find("%b") == [9, 5] and find("É") == [6]
    assert find("") == [9, 8, 7, 6, 5, 4, 3, 2, 1] and find("", 2) == [9, 8] and find("moca", 0) == []
    assert find("in:SHO moca") == [7, 1, 3] and find("in:%o moca") == [8, 7, 1, 3]
    assert [r["matched_text"] for r in text_search.text_search(corpus, parse("moca")).collect()] == [True] * 4


def test_overlaps():
    assert T.has_border("aa") and T.has_border("abca") and not T.has_border("under")


def test_occurrences(spark):
    df = spark.createDataFrame([("aaaa under \\E under",)], "t string")
    got = df.select(T.occurrences(F.col("t"), "aa"), T.occurrences(F.col("t"), "under"), T.occurrences(F.col("t"), "\\E")).first()
    assert list(got) == [3, 2, 1]


def test_exact_and_loose(corpus):
    q = Query(["moca", "network"])
    assert ids(text_search.exact_hits(corpus, q, 9)) == [8, 1] and ids(text_search.loose_hits(corpus, q, 9)) == [7, 3]
    assert ids(text_search.exact_hits(corpus, Query(["moca"]), 9)) == [8, 7, 1, 3]


def test_snippet(spark):
    text = "x" * 100 + "Needle" + "y" * 100
    row = spark.createDataFrame([(text,), ("short needle",), ("none",)], "t string").select(T.snippet(F.col("t"), "needle").alias("s")).collect()
    assert row[0]["s"] == "…" + "x" * 30 + "\u0001Needle\u0002" + "y" * 30 + "…"
    assert row[1]["s"] == "short \u0001needle\u0002" and row[2]["s"] == "none"


def fused(spark, text, exact, meaning, visual, n=120):
    make = lambda xs: spark.createDataFrame([(i, x, 0.5) for i, x in enumerate(xs, 1)], "pos int, id long, score double")
    return fusion.fuse(make(text), make(exact), make(meaning), make(visual), n)


def test_fusion(spark):
    out = fused(spark, [1, 2, 3], [2], [3, 4, 2], [5, 4]).orderBy("pos").collect()
    assert [r["id"] for r in out] == [2, 3, 4, 1, 5]
    by = {r["id"]: r for r in out}
    assert by[4]["score"] == pytest.approx(1 / 11 + 1 / 11, abs=1e-9) and by[3]["score"] == pytest.approx(1 / 11 + 1 / 10, abs=1e-9)
    assert by[2]["block"] == 0 and by[2]["meaning_score"] == 0.5 and by[2]["matched_text"] and not by[5]["matched_text"]
    assert len(fused(spark, [1, 2], [1], [3], [4], 3).collect()) == 3


def test_badges(spark):
    rows = fusion.match_badge(fused(spark, [1, 6], [], [2], [3, 6])).collect()
    assert {r["id"]: (r["badge"], r["kind"]) for r in rows} == {1: ("", "text"), 2: ("≈ related text", "related text"), 3: ("≈ looks like", "looks like"), 6: ("", "text, and looks like")}


def test_vectors(spark):
    v = spark.createDataFrame([(1, "a", 1, [1.0, 0.0]), (2, "A2", 2, [0.8, 0.6]), (3, "b", 3, [0.6, 0.8]), (4, "b", 4, [-1.0, 0.0])], "id long, source string, mtime long, vec array<double>")
    find = lambda **k: [r["id"] for r in vector_search.vector_topk(v, [1.0, 0.0], 10, **k).orderBy("pos").collect()]
    assert find() == [1, 2, 3] and find(window=0.25) == [1, 2] and find(floor=0.7) == [1, 2] and find(query=Query(source="a")) == [1, 2] and find(exclude=(1,)) == [2, 3]
    assert [find(window=w / 10) == find(window=(w + 1) / 10)[: len(find(window=w / 10))] for w in range(5)] == [True] * 5
    like = vector_search.more_like_this(v, 2, 10, Query(source="b")).orderBy("pos").collect()
    assert [r["id"] for r in like] == [2, 3] and vector_search.more_like_this(v, 99, 10).count() == 0
    e = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", []), (3, "m", [1.0]), (4, "old", [1.0, 0.0])], "image_id long, model string, vec array<double>")
    assert [r["id"] for r in vector_search.load_embeddings(v.drop("vec"), e, "m").collect()] == [1]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(l2_normalize(F.col("v")).alias("u")).collect()
    assert unit[0]["u"] == pytest.approx([0.6, 0.8]) and unit[1]["u"] == [0.0, 0.0]


def test_engine_and_service(spark, corpus):
    vec = corpus.select("id", "source", "mtime", encode_column(F.col("text")).alias("vec"))
    engine = Engine(corpus, vec, vec, hash_projection, hash_projection)
    assert ids(engine.search("moca network"))[:2] == [8, 1]
    assert ids(engine.search("like:8"))[0] == 8 and ids(engine.search("~")) == []
    assert 8 in ids(engine.search("~moca network"))
    assert ids(Engine(corpus).search("moca")) == [8, 7, 1, 3]
    import json

    got = json.loads(answer(engine, '{"op": "search", "query": "moca", "limit": 2}'))
    assert [h["id"] for h in got["hits"]] == [8, 7] and "score" not in got["hits"][0]
    assert got["hits"][0]["snippet"] == "\u0001moca\u0002 network" 
    assert json.loads(answer(engine, '{"op": "ping"}'))["ok"] and not json.loads(answer(engine, '{"op": "no"}'))["ok"]


def test_outline(spark):
    rows = [(1, ["Two", "network", "work"]), (2, ["moca", "network"]), (3, []), (4, ["a"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    got = lambda *t: {r["id"]: r["marked"] for r in outline.outline_words(df, list(t), ["id"]).collect()}
    assert got("network") == {1: [1], 2: [1]} and got("moca net") == {2: [0, 1]} and got("work") == {1: [1, 2], 2: [1]} and got("a") == {}
    page = spark.createDataFrame([('[{"text":"a b","words":[{"text":"a","x":2,"y":4,"width":6,"height":8}]}]',), (None,)], "j string")
    out = page.select(outline.from_json(F.col("j")).alias("l")).select(outline.full_text(F.col("l")).alias("t"), outline.rescale(F.col("l"), 2.0).alias("l")).collect()
    assert out[0]["t"] == "a b" and out[0]["l"][0]["words"][0]["x"] == 1.0 and out[1]["l"] == []


def test_encoders(spark):
    import numpy as np

    v = hash_projection(["abc", "abc", "", "xyz"])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and np.allclose(v[0], v[1]) and not np.allclose(v[0], v[3])

    def fragile(texts):
        if "bad" in texts:
            raise ValueError
        return hash_projection(texts, 4)

    got = spark.createDataFrame([("a",), ("bad",), (None,)], "t string").coalesce(1).select(encode_column(F.col("t"), fragile).alias("v")).collect()
    assert [len(r["v"]) for r in got] == [4, 0, 4]
    assert preprocess_image(np.zeros((300, 500, 3), np.uint8)).shape == (3, 224, 224)


def test_described_and_healed_hits(spark, tmp_path):
    """Hits have a snippet and local time; files that are gone are dropped and forgotten."""
    import datetime as dt
    import threading

    (tmp_path / "a.png").write_text("a")
    rows = [(1, "the moca text " * 30, "a", "s", dt.datetime(2024, 1, 1, 12), str(tmp_path / "a.png")), (2, "moca", "b", "s", dt.datetime(2024, 1, 2), str(tmp_path / "b.png"))]
    corpus = spark.createDataFrame(rows, "id long, text string, name string, source string, mtime timestamp, path string")
    forgotten, done = [], threading.Event()

    def forget(found):
        forgotten.extend(found)
        done.set()

    engine = Engine(corpus, tz="Europe/Berlin", present=lambda p: (tmp_path / p).exists(), forget=forget)
    got = engine.search("moca").collect()
    assert [r["id"] for r in got] == [1] and done.wait(10) and forgotten == [2]
    assert got[0]["local_time"] == dt.datetime(2024, 1, 1, 13) and "\u0001moca\u0002" in got[0]["snippet"] and len(got[0]["snippet"]) <= 70 and "text" not in got[0].asDict()
    assert [r["snippet"] for r in Engine(corpus).search("").orderBy("id").collect()] == [("the moca text " * 30)[:160], "moca"]


def test_tokens():
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2}
    assert merge_pairs(list("abcbc"), ranks) == ["abc", "bc"] and merge_pairs(list("aab"), ranks) == ["a", "ab"] and merge_pairs([], ranks) == []
    clip = ClipTokens({"ab</w>": 5, "a": 6, "c</w>": 7}, {("a", "b</w>"): 0}, 1, 2, 6)
    assert clip.encode("AB  c") == [1, 5, 7, 2, 2, 2] and clip.mask([1, 5, 7, 2, 2, 2]) == [1, 1, 1, 1, 0, 0]
    assert ClipTokens.WORDS.findall("a_-b ½x e\u0301 it's 12 <|endoftext|>") == ["a", "_-", "b", "½", "x", "e", "\u0301", "it", "'s", "1", "2", "<|endoftext|>"]
    assert PieceTokens({"e": 4, "\u0301": 5, "é": 6}, {}, 1, 2).encode("e\u0301é") == [1, 4, 5, 6, 2]
    import random

    r = random.Random(2)
    for _ in range(300):
        word = [r.choice("abc") for _ in range(r.randrange(12))]
        table = {p: i for i, p in enumerate(sorted({("".join(r.choice("abc") for _ in range(r.randrange(1, 3))), "".join(r.choice("abc") for _ in range(r.randrange(1, 3)))) for _ in range(12)}))}
        plain = list(word)
        while any(p in table for p in zip(plain, plain[1:])):  # one merge at a time: lowest rank, then leftmost
            k = min((table[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in table)[1]
            plain[k : k + 2] = [plain[k] + plain[k + 1]]
        assert merge_pairs(word, table) == plain
    piece = PieceTokens({"a": 4, "▁": 5, "▁a": 6, "<0xC3>": 7, "<0xA9>": 8}, {("▁", "a"): 0}, 1, 2)
    assert piece.encode("a a é") == [1, 4, 6, 5, 7, 8, 2]


def test_text_functions(spark):
    one = lambda expr, value: spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]
    assert one(T.clean_text, " a\r\n\tb ") == "a b" and one(T.source_slug, " My Notes (2)! ") == "my-notes-2" and one(T.file_stem, "C:\\x\\a.b.png") == "a.b"
    assert one(T.clip_title, "x" * 61) == "x" * 57 + "…" and one(T.line_count, "a\nb\n") == 3 and one(T.clean_snippet, "\u0001a\u0002\r\nb") == "a b"
    assert one(T.extension, "/x.y/a.PNG") == "png" and one(T.extension, "/x.y/a") == ""
    assert math.isclose(text_search.idf(10, 9), 1e-6)


def test_evaluate(spark, corpus):
    from tessera.evaluate import encoder_agreement, evaluate, latencies

    files = corpus.withColumn("path", F.concat(F.lit("/x/"), "name", F.lit(".png")))
    row = evaluate({"text": Engine(files)}, [("moca", ["SP.png"]), ("moca", ["net-diagram.png"]), ("zzz", ["a"])]).first()
    assert (row["queries"], row["hit1"], row["hit5"]) == (3, 1, 2)
    assert set(latencies(Engine(files), ["moca"], 2)) == {"median", "p95", "mean"}
    assert encoder_agreement(hash_projection, ["a", "b c", ""]) > 0.999


def test_postings_change_nothing(spark, corpus):
    from tessera.operators import postings

    index = postings.open_index(postings.build(corpus).cache())
    for q in ("moca", "net work", "RÉSUMÉ", "straße", "aaa", "ab", "moca ab", "😀a"):
        want = {r["id"] for r in text_search.text_search(corpus, parse(q)).collect()}
        assert {r["id"] for r in postings.matching(corpus, index, parse(q)).collect()} == want, q
