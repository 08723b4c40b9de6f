"""The index as segments: small commits, merge on read, kept postings, damaged files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import postings, text_search
from tessera.pipeline import forget, index_files
from tessera.plans.query import parse
from tessera.sources.snapshots import SCHEMAS, Snapshots

NOW = dt.datetime(2024, 1, 1)
FILES = "path string, source string, size long, mtime timestamp"
QUERIES = ("moca", "net work", "RÉSUMÉ", "straße", "aaa", "aa aaaa", "ab", "moca ab", "moca network", "😀a", "file 1", "nothing at all", "the")


def rows(spark, n, text=lambda i: f"file {i} {'Moca ' * (i % 3)}network aaaa ab {'Straße' if i % 5 == 0 else 'résumé'}"):
    made = [(i, f"/a/f{i}.png", f"f{i}", "ab"[i % 2], 1, NOW + dt.timedelta(seconds=i % 7), None, None, NOW, "ok", None, None, text(i)) for i in range(1, n + 1)]
    return spark.createDataFrame(made, SCHEMAS["images"])


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def same(store, queries=("moca network", "résumé ab"), limits=(5,)):
    """Search on the kept index gives the rows of a search that reads all texts."""
    images, index = store.table("images"), store.text_index()
    assert index.n == images.count() and index.mean == pytest.approx(text_search.corpus_statistics(images, [])["avg"])
    for q in queries:
        for limit in limits:
            want, exact = text_search.hits_and_exact(images, parse(q), limit)
            got, phrase = postings.indexed_hits(images, index, parse(q), limit)
            assert [tuple(r)[:5] for r in got.select("pos", "id", "source", "mtime", "score").collect()] == [tuple(r) for r in want.select("pos", "id", "source", "mtime", "score").collect()], q
            assert {r["id"] for r in phrase.collect()} == {r["id"] for r in exact.collect()}, q
    for q in ("moca network", "ab"):
        assert [tuple(r) for r in postings.indexed_search(images, index, parse(q), 7).collect()] == [tuple(r) for r in text_search.text_search(images, parse(q), 7).collect()]


def test_segments_and_their_index(spark, tmp_path):
    root = str(tmp_path / "ix")
    store = Snapshots(spark, root)
    store.commit(images=rows(spark, 40))
    read = F.concat(F.lit("moca network anew "), "path")
    index_files(store, spark.createDataFrame([("/A/F3.png", "a", 2, NOW), ("/new.png", "b", 2, NOW)], FILES), read)
    forget(store, [5, 6, 41])
    assert len(store.state["tables"]["images"]) == 3
    now = {r["id"]: r["text"] for r in store.table("images").collect()}
    assert len(now) == 38 and now[3] == "moca network anew /A/F3.png" and not {5, 6, 41} & set(now)
    same(store, QUERIES, (7,))
    again = Snapshots(spark, root)
    again.compact("images")
    assert len(again.state["tables"]["images"]) == 2 and {r["id"]: r["text"] for r in again.table("images").collect()} == now
    same(again)
    again.compact("images", whole=True)
    assert len(again.state["tables"]["images"]) == 1 and {r["id"]: r["text"] for r in again.table("images").collect()} == now
    same(again)
    assert again.vacuum(1) > 0 and Snapshots(spark, root).damaged() == []


def test_a_change_writes_what_changed(spark, tmp_path):
    """A burst of one file, whatever the size of the index."""
    wrote = []
    for n in (40, 4000):
        root = str(tmp_path / f"ix{n}")
        store = Snapshots(spark, root)
        store.commit(images=rows(spark, n, lambda i: f"some text {i} " * 30))
        before = size(root)
        index_files(store, spark.createDataFrame([("/a/f3.png", "a", 2, NOW)], FILES), F.lit("one file"))
        wrote.append(size(root) - before)
    assert wrote[1] < 1.2 * wrote[0] and wrote[1] < 0.2 * before


def test_search_reads_the_index_only(spark, tmp_path):
    """Postings are read by trigram, of the images no texts but the hits'."""
    store = Snapshots(spark, str(tmp_path / "ix"))
    store.commit(images=rows(spark, 50))
    index = store.text_index()
    plan = postings.term_counts(index, ["network"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(trigram" in plan or "In(trigram" in plan
    hits = Engine(store.table("images"), index=index).search("moca network", 5).collect()
    want = Engine(store.table("images")).search("moca network", 5).collect()
    assert hits == want and len(hits) == 5


def test_damaged_files_are_found(spark, tmp_path):
    root = str(tmp_path / "ix")
    store = Snapshots(spark, root)
    store.commit(images=rows(spark, 5))
    store.change(images=(rows(spark, 6).where("id = 6"), None))
    first, second = store.state["tables"]["images"]

    def spoil(segment, how):
        folder = os.path.join(root, segment["rows"])
        name = next(n for n in os.listdir(folder) if n.endswith(".parquet"))
        path = os.path.join(folder, name)
        raw = bytearray(open(path, "rb").read())
        for crc in (f for f in os.listdir(folder) if f.endswith(".crc")):
            os.remove(os.path.join(folder, crc))
        how(raw)
        open(path, "wb").write(raw)
        return f"{segment['rows']}/{name}", path

    def flip(raw):
        raw[len(raw) // 2] ^= 255

    name, path = spoil(second, flip)
    assert not Snapshots(spark, root).recovered
    again = Snapshots(spark, root, check="bytes")
    assert again.recovered and again.table("images").count() == 5
    assert store.damaged() == [name]
    # The next commit goes on from the version that was whole, under the next number.
    again.change(images=(rows(spark, 7).where("id = 7"), None))
    assert {r["id"] for r in Snapshots(spark, root, check="bytes").table("images").collect()} == {1, 2, 3, 4, 5, 7}
    last = again.state["tables"]["images"][-1]
    spoil(last, lambda raw: raw.pop())
    shorter = Snapshots(spark, root, check="bytes")
    assert shorter.recovered and shorter.serial == 3 and shorter.table("images").count() == 5
    spoil(first, lambda raw: raw.clear())
    assert Snapshots(spark, root).recovered and Snapshots(spark, root).table("images").count() == 0


def test_an_index_is_built_without_a_shuffle(spark):
    """Tasks write the blocks that they make; each is in the order of trigrams."""
    made = postings.build(rows(spark, 50).coalesce(2))
    assert "Exchange range" not in made._jdf.queryExecution().executedPlan().toString()
    held = {}
    for r in made.collect():
        held.setdefault(r["block"], []).append(r["trigram"])
    assert all(v[0] == "" and v == sorted(set(v)) for v in held.values())


def test_postings_of_odd_texts(spark, tmp_path):
    """Empty and short texts, characters beyond the first plane, names that go on where texts end, nulls."""
    made = [(1, "", ""), (2, "ab", "c"), (3, "abc", None), (4, None, "abc"), (5, "x😀aé😀aéy", "İstanbul"), (6, "ab" * 500, "abab"), (7, "ends in ab", "cab")]
    corpus = spark.createDataFrame(made, "id long, text string, name string").withColumns({"source": F.lit("s"), "mtime": F.lit(1)})
    index = postings.open_index(postings.build(corpus.repartition(3)))
    for term in ("abc", "😀aé", "i̇stan", "ababab", "bca", "abab", "zzz"):
        got = {r["id"]: r["counts"][0] for r in postings.term_counts(index, [term]).collect()}
        count = lambda t: sum((t or "").lower().startswith(term, i) for i in range(len((t or "").lower())))  # noqa: B023, E731
        want = {i: count(t) + count(n) for i, t, n in made}
        assert got == {i: n for i, n in want.items() if n}, term
    assert index.n == 7
