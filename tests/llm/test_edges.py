"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names: every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact, mixing, ngram_join, packing, pii, pivots, quality, shards, substrings, urls

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta", "s1", "en", 22),
    (1, "alpha beta gamma delta", "s1", "en", 22),
    (2, "alpha beta gamma delta", None, None, None),
    (3, None, "s2", "en", 0),
    (4, "", "s2", None, 0),
    (5, " \n\t ", "s2", "de", 4),
    (6, LONG, "s1", "en", len(LONG)),
    (7, LONG + " tail", "s3", "en", len(LONG) + 5),
    (None, "alpha beta gamma delta", "s3", "en", 22),
    (None, "only here é 😀", "s3", "fr", 13),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"
CLASH = {"_id": 1, "_text": "x", "_row": 2, "size": 3, "kept": "no", "_n": 4, "_group": 5, "_label": 6, "shard": 7, "target": 8, "_body": "b", "_hash": "h", "_set": 9, "_c0": "c", "keep_id": 10, "start": 11, "p_bad": 0.5}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


def test_exact(docs, none):
    got = exact.duplicate_groups(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["keep_id"] == by[2]["keep_id"] == 2 and by[2]["group_size"] == 4 and by[2]["kept"] and not by[1]["kept"]
    assert by[3]["keep_id"] == by[4]["keep_id"] == 4 and by[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[6]["group_size"] == 1
    assert sum(r["kept"] for r in got if r["doc_id"] is None) == 1
    one = exact.drop_duplicates(docs)
    assert one.columns == docs.columns and one.count() == 6
    assert exact.duplicate_groups(none).count() == exact.drop_duplicates(none).count() == 0


def test_exact_collisions(docs):
    """With a hash under which all texts collide, the bytes still decide."""
    same = lambda t: F.lit(b"0")
    a = exact.duplicate_groups(docs, digest=same).select("doc_id", "keep_id", "group_size").collect()
    b = exact.duplicate_groups(docs).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert exact.drop_duplicates(docs, digest=same).count() == 6


def test_shards(docs, none):
    got = shards.shard_documents(docs, 4).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert len(got) == len(ROWS) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert {r["size"] for r in got if r["doc_id"] in (3, 4)} == {8}
    assert shards.shard_documents(docs, 24).where("shard < 0 or shard > 23 or slot <> 0").count() == 0
    assert shards.shard_documents(none).count() == 0


def test_mixing(docs, none):
    d, pieces = mixing.mix_sources(docs)
    got = d.collect()
    assert len(got) == len(ROWS)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["target"], 0, r["source_size"]])[1] += r["taken"]
    assert None in by and by[None][0] <= 3 * by[None][2]
    for target, taken, _ in by.values():
        assert abs(target - taken) <= max(64, 0.01 * target)
    assert sum(v[0] for v in by.values()) <= total + 1e-6
    assert sorted(map(str, mixing.mix_sources(docs)[0].drop("_row").collect())) == sorted(map(str, d.drop("_row").collect()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and set(out.dtypes) == set(docs.dtypes)
    assert out.select(F.sum(F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))).first()[0] == sum(v[1] for v in by.values())
    assert mixing.mix_sources(none)[0].count() == mixing.mixed_documents(none).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, VOCABULARY).collect()
    tokens = sum({(r["doc_id"], r["sequence_id"], r["offset"]): r["length"] for r in got}.values())
    assert max(r["sequence_id"] for r in got) == (tokens - 1) // 2048
    assert [(r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == 3] == [(1, 1)]
    assert packing.pack(none, VOCABULARY).count() == 0
    for r in packing.sequences(packing.pack(docs, VOCABULARY)).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 2048)


def test_ngrams(docs, none):
    got = ngram_join.ngram_jaccard(docs, width=3, percent=90).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and by[3]["n_shingles"] == by[5]["n_shingles"] == 0
    assert by[3]["component_id"] == 3 and by[7]["component_id"] == 6
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert ngram_join.ngram_jaccard(none).count() == 0


def test_substrings(docs, none):
    got = substrings.substring_dedup(docs, texts=True).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[7]["n_removed"] == 60_000 and by[7]["kept_text"] == "tail"
    assert by[6]["n_removed"] == by[2]["n_removed"] == 0  # repeats inside one document stay, short copies too
    assert by[3]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert substrings.substring_dedup(none).count() == 0


def test_pii(docs, none):
    got = pii.summarise(pii.find_personal_data(docs)).collect()
    assert len(got) == len(ROWS) and {r["spans"] for r in got} == {""}
    assert pii.summarise(pii.find_personal_data(none)).count() == 0
    mail = F.concat(F.coalesce("text", F.lit("")), F.lit(" a@b.co 1.2.3.4"))
    got = pii.summarise(pii.find_personal_data(docs.withColumn("text", mail))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        body = next((t or "") + " a@b.co 1.2.3.4" for i, t, *_ in ROWS if i == r["doc_id"] and (i is not None or f"email:{len(t or '') + 1}:" in r["spans"]))
        at = len(body) - 14
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 0) and r["spans"] == f"email:{at}:{at + 6},ip:{at + 7}:{at + 14}"


def test_quality(docs, none, labels):
    assert quality.classify(docs, labels).count() == len(ROWS)
    assert quality.classify(none, labels).count() == 0
    empty = quality.classify(docs, labels.limit(0))
    assert empty.count() == len(ROWS) and empty.where("kept").count() == len(ROWS)  # without labels nothing is decided
    # With labels of both kinds for both heads: repeated rows are judged alike, every score is a number.
    marks = labels.limit(0).unionByName(labels.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0), (6, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int"))
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(ROWS) and all(0 <= r["p_bad"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in got)
    assert len({(r["p_bad"], r["p_toxic"], r["kept"]) for r in got if r["doc_id"] == 1}) == 1


def test_repeated_labels_are_one_example(spark):
    """An id with many rows and many labels counts once in training, so the bound on labels bounds documents, too."""
    rows = [(i, f"{'good plain words' if i % 2 else 'junk spam words'} number {i % 5}") for i in range(60)]
    marks = [(i, i % 2, 0) for i in range(60)]
    train = lambda d, m: quality.train(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(m, "doc_id long, quality int, toxic int"))
    once, often = train(rows, marks), train(rows + rows[:1] * 300, marks + marks[:1] * 40)
    assert once["bad"].rate == often["bad"].rate == 0.5 and once["bad"].keys.tolist() == often["bad"].keys.tolist()


def test_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0] * 3), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [-1.0, -2.0, -3.0]), (10, [1.0, 2.0]), (None, v), (11, [1e200, 2e200, 3e200]), (12, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"_id": F.lit(0), "_node": F.lit("x"), "kept": F.lit(1), "_w": F.lit(2)})
    got = pivots.near_vectors(df, pivots=16, depth=4).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[1]["n_links"] == 5 and by[3]["component_id"] == by[11]["component_id"] == 1 and by[1]["kept"]
    for i in (4, 5, 6, 7, 8, 9, 10, 12):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert by[None]["component_id"] is None and not by[None]["kept"]
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://WWW.example.com/en/7x?q#f", '<a href="http://bad.org/x">b</a>'),
        (2, "http://bad.org/es/1", None),
        (3, "http://bad.org/fr", "<a HREF='//www.example.com/a'>"),
        (4, None, None),
        (5, "no scheme", "<a href=/x>"),
        (6, "ftp://a.net?x=1", ""),
        (7, "http://shop.com/en/1", None),
        (7, "http://shop.com/en/1", None),
        (8, "x://y://z", None),
        (9, "http://notcom/en/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "_host": F.lit("x"), "_h": F.lit(2), "verdict": F.lit("no")})
    by = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    assert urls.judge_urls(df).count() == len(rows)
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[2]["rule"] == "org/es/" and by[3]["rule"] is None
    assert (by[4]["host"], by[4]["path"], by[4]["verdict"]) == ("", "", "allow") and by[5]["host"] == ""
    assert (by[6]["host"], by[6]["path"]) == ("a.net", "") and by[7]["verdict"] == "block" and by[8]["host"] == "y:"
    assert by[9]["rule"] is None
    # Very long html is searched whole: only its last link makes the host of page 3 a neighbour of the blocked one.
    filler = "<p>x</p>" * 300_000
    long = [(1, "http://far.site.net/fr", filler + '<a href="http://bad.org/es/">'), (2, "http://bad.org/es/1", None), (3, "http://good.net/fr", None), (4, "http://other.net/fr", None), (5, "http://third.net/fr", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(long, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_stages(spark, docs, none, labels, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, none):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            at = out.cache()
            n = at.count()
            assert n == 0 if start is none else n > 0
            assert name == "packing" or n <= 3 * len(ROWS)


def test_sweep(spark, docs):
    from tessera.llm.store import park, parked, sweep

    mark = parked()
    first = park(docs.select("doc_id"))
    second = park(first)
    sweep(spark, mark)
    assert second.count() == len(ROWS) and parked() == mark + 1
    with pytest.raises(Exception, match="(?i)not.?exist|FILE_NOT_EXIST|no such file"):
        first.collect()
