import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest, mutations, reporting
from tessera.pipeline import apply_config, embed_pass, index_pass
from tessera.sources import config, reader
from tessera.sources.folder import FolderEvents, FolderSource, differences
from tessera.sources.snapshots import Conflict, Snapshots
from tessera.streaming import bursts, watch

NOW = dt.datetime(2024, 1, 1)
EVENTS = "ts timestamp, op string, path string, old_path string, source string"


@pytest.fixture()
def tree(tmp_path):
    for name in ("a.PNG", "b.txt", "_c.jpg", ".hidden.png", "sub/d.gif", "sub/deep/e.png", ".git/f.png", "node_modules/g.png"):
        p = tmp_path / "lib" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    return str(tmp_path / "lib")


def scan(spark, tree, **more):
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folder").option("path", tree).option("name", "lib")
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.load()


def test_folder(spark, tree):
    base = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    assert base(scan(spark, tree)) == ["_c.jpg", "a.PNG", "d.gif", "e.png"]
    assert base(scan(spark, tree, recursive="false")) == ["_c.jpg", "a.PNG"]
    assert base(scan(spark, tree + "/none")) == []
    two = scan(spark, tree, path2=tree + "/sub", name2="sub")
    assert two.count() == 6 and ingest.claim_first_source(two).where("source = 'lib'").count() == 4


def test_index_passes(spark, tree, tmp_path):
    store = Snapshots(spark, str(tmp_path / "index"))
    read = F.concat(F.lit("text of "), "path")
    first = index_pass(store, scan(spark, tree), read)
    assert (first["scanned"], first["indexed"], first["removed"]) == (4, 4, 0)
    assert embed_pass(store, "m") == 4 and embed_pass(store, "m") == 0
    os.remove(f"{tree}/a.PNG")
    os.utime(f"{tree}/sub/d.gif", (1, 1))
    kept = {r["path"]: r["id"] for r in store.table("images").collect()}
    second = index_pass(Snapshots(spark, str(tmp_path / "index")), scan(spark, tree), read)
    assert (second["indexed"], second["unchanged"], second["removed"]) == (1, 2, 1)
    store = Snapshots(spark, str(tmp_path / "index"))
    now = {r["path"]: r["id"] for r in store.table("images").collect()}
    assert len(now) == 3 and all(kept[p] == i for p, i in now.items())
    assert store.table("text_embeddings").count() == 2 and embed_pass(store, "m") == 1
    assert embed_pass(store, "other") == 3 and store.table("text_embeddings").count() == 3
    def broken(texts):
        raise ValueError

    assert embed_pass(store, "third", encoder=broken) == 0 and store.table("text_embeddings").where("model = 'third'").count() == 0
    assert apply_config(store, [config.Source("lib", tree)], [config.Source("lib", "/elsewhere")]) == ["lib"]
    assert store.table("images").count() == store.table("text_embeddings").count() == 0
    last = max((tmp_path / "index").glob("pointer-*.json"))
    last.write_text("broken")
    for crc in (tmp_path / "index").glob(".pointer-*.crc"):
        crc.unlink()
    again = Snapshots(spark, str(tmp_path / "index"))
    # The version before the last is what is left: the pass for the third model changed nothing.
    assert again.recovered and again.table("images").count() == 3


def test_mutations(spark):
    rows = [(1, "/a/x.png", "x", "s"), (2, "/A/sub/y.png", "y", "s"), (3, "/ab/z.png", "z", "t"), (4, "/b/x.png", "x", "t")]
    images = spark.createDataFrame(rows, "id long, path string, name string, source string")
    paths = lambda df: {r["id"]: r["path"] for r in df.collect()}
    assert paths(mutations.remove_path(images, "/a")) == {3: "/ab/z.png", 4: "/b/x.png"}
    moved, n = mutations.move_path(images, "/a", "/b", "u")
    assert n == 2 and paths(moved) == {1: "/b/x.png", 2: "/b/sub/y.png", 3: "/ab/z.png"}
    again, n = mutations.move_path(images, "/a/x.png", "/a/X.png", "s")
    assert n == 1 and paths(again)[1] == "/a/X.png" and again.where("name = 'X'").count() == 1
    assert set(paths(mutations.remove_source(images, "t"))) == {1, 2}
    new = spark.createDataFrame([("/a/X.PNG", "X", "s", NOW), ("/new", "new", "s", NOW), ("/new2", "new2", "s", NOW)], "path string, name string, source string, indexed_at timestamp")
    out = paths(mutations.upsert(images, new))
    assert out[1] == "/a/X.PNG" and sorted(out) == [1, 2, 3, 4, 5, 6]
    v = spark.createDataFrame([(1, "m", [1.0]), (2, "m", [])], "image_id long, model string, vec array<double>")
    assert {r["image_id"]: r["model"] for r in mutations.save_embeddings(v, spark.createDataFrame([(1, "n", [2.0])], v.schema)).collect()} == {1: "n", 2: "m"}
    assert mutations.drop_vectors(v, mutations.changed_ids(images, new)).count() == 1


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 1.0)] * 3 + [("b", None)], "event_type string, value double")
    got = {r["event_type"]: (r["n"], r["median"], r["p95"]) for r in reporting.latency_percentiles(df).collect()}
    assert got == {"a": (100, 50.0, 95.0), "b": (3, 1.0, 1.0)}


def test_metrics(spark):
    ranks = spark.createDataFrame([("e", 1), ("e", 4), ("e", None), ("e", 8)], "engine string, rank int")
    row = reporting.eval_metrics(ranks, ["engine"]).first()
    assert (row["queries"], row["hit1"], row["hit5"]) == (4, 1, 2) and row["mrr"] == pytest.approx((1 + 0.25 + 0.125) / 4)


def test_rename_rules(spark):
    rows = [("renamed", "/a.txt", "/b.txt", False, "ignore"), ("renamed", "/a.txt", "/b.png", True, "forget"), ("renamed", "/a.png", "/b.png", True, "move"), ("renamed", "/a.png", "/b.txt", False, "index"), ("deleted", "/dir", None, True, "forget"), ("deleted", "/a.txt", None, False, "ignore"), ("created", "/a.JPG", None, False, "index"), ("changed", "/a.md", None, False, "ignore")]
    df = spark.createDataFrame(rows, "op string, path string, old_path string, indexed boolean, want string")
    assert df.where(bursts.rename_action(F.col("op"), F.col("path"), F.coalesce("old_path", F.lit("")), F.col("indexed")) != F.col("want")).count() == 0


def test_stream_equals_batch(spark, sf, tmp_path):
    """Sessions that the watermark has passed are those of the batch."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    batch = {(r["event_type"], r["first"], r["n"]) for r in watch.debounce(events, "10 minutes", ["event_type"]).collect()}
    stream = watch.debounce(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "10 minutes", ["event_type"], "1 minute")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["event_type"], r["first"], r["n"]) for r in spark.table("bursts").collect()}
    assert got <= batch and len(batch) - len(got) <= 5


def entry_list(rows, spark):
    return spark.createDataFrame(rows, "path string, source string, source_ord int, size long, mtime timestamp, attributes int")


def test_sources_apart(spark, tmp_path):
    """Listing one source leaves another's images; placeholders and unreadable files are counted; files still on disk stay."""
    store = Snapshots(spark, str(tmp_path / "ix"))
    read = F.when(F.col("path").contains("bad"), F.lit(None)).otherwise(F.concat(F.lit("text "), "path"))
    read = F.struct(read.alias("text"), F.lit(None).cast("string").alias("ocr_json"), F.lit(3).alias("width"), F.lit(4).alias("height"), F.when(F.col("path").contains("bad"), "unreadable").alias("error"))
    gone = lambda path: path.contains("/kept/")
    a = [("/a/1.png", "a", 1, 10, NOW, 0), ("/a/cloud.png", "a", 1, 10, NOW, 0x1000), ("/a/bad.png", "a", 1, 10, NOW, 0), ("/a/kept/2.png", "a", 1, 10, NOW, 0)]
    got = index_pass(store, entry_list(a, spark), read, on_disk=gone)
    assert (got["scanned"], got["indexed"], got["skipped"], got["failed"], got["removed"]) == (4, 2, 1, 1, 0)
    got = index_pass(store, entry_list([("/b/1.png", "b", 1, 10, NOW, 0)], spark), read, on_disk=gone)
    assert (got["indexed"], got["removed"]) == (1, 0)
    rows = {r["path"]: r for r in store.table("images").collect()}
    assert set(rows) == {"/a/1.png", "/a/bad.png", "/a/kept/2.png", "/b/1.png"}
    assert (rows["/a/bad.png"]["status"], rows["/a/bad.png"]["error"], rows["/a/bad.png"]["text"]) == ("error", "unreadable", "") and rows["/a/1.png"]["width"] == 3
    got = index_pass(store, entry_list([], spark), read, sources=["a"], on_disk=gone)
    assert (got["scanned"], got["removed"]) == (0, 2)
    assert {r["path"] for r in store.table("images").collect()} == {"/a/kept/2.png", "/b/1.png"}


def test_conflict_and_vacuum(spark, tmp_path):
    root = str(tmp_path / "ix")
    one, two = Snapshots(spark, root), Snapshots(spark, root)
    one.commit(embeddings=spark.createDataFrame([(1, "m", [1.0])], "image_id long, model string, vec array<float>"))
    with pytest.raises(Conflict):
        two.commit(embeddings=one.table("embeddings").limit(0))
    two = Snapshots(spark, root)
    assert two.serial == 1 and two.table("embeddings").count() == 1
    for _ in range(3):
        two.commit(embeddings=two.table("embeddings"))
    # Two old versions, and the files of the commit that came to nothing.
    assert two.vacuum() == 3 and Snapshots(spark, root).table("embeddings").count() == 1
    two.clear()
    assert Snapshots(spark, root).table("embeddings").count() == 0 and len(list((tmp_path / "ix").glob("pointer-*.json"))) == 1


def test_reader(tmp_path):
    import json
    import struct

    png = tmp_path / "a.png"
    png.write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 40))
    (tmp_path / "a.png.json").write_text(json.dumps([{"text": "one two", "words": []}, {"text": "three", "words": []}]))
    got = reader.read_beside(str(png))
    assert (got["text"], got["width"], got["height"], got["error"]) == ("one two\nthree", 30, 40, None)
    (tmp_path / "b.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 5, 6))
    (tmp_path / "b.txt").write_text("beside")
    assert reader.read_beside(str(tmp_path / "b.gif"))["text"] == "beside" and reader.dimensions(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    (tmp_path / "c.png").write_bytes(b"x")
    (tmp_path / "c.png.json").write_text("{broken")
    assert reader.read_beside(str(tmp_path / "c.png"))["error"] and "FileNotFound" in reader.read_beside(str(tmp_path / "none.png"))["error"]
    assert reader.there(str(png)) and not reader.there(str(tmp_path / "none.png")) and reader.there("/no-such-drive/x.png")


def test_watch(spark, tmp_path):
    """Files are created, renamed and deleted; the index follows, without reading again what moved."""
    lib = tmp_path / "lib"
    lib.mkdir()
    store = Snapshots(spark, str(tmp_path / "ix"))
    read = F.concat(F.lit("read at "), "path")
    for name in ("a.png", "b.png", "c.png"):
        (lib / name).write_text(name)
    index_pass(store, scan(spark, str(lib)), read)
    embed_pass(store, "m")
    ids = {os.path.basename(r["path"]): r["id"] for r in store.table("images").collect()}
    at = lambda n: str(lib / n)
    second = lambda k: NOW + dt.timedelta(seconds=k)
    (lib / "a.png").rename(lib / "moved.png")
    (lib / "b.png").unlink()
    (lib / "new.png").write_text("new")
    (lib / "shot.png").write_text("from a temporary file")
    events = [
        (second(1), "renamed", at("moved.png"), at("a.png"), "lib"),
        (second(2), "created", at("b.png"), None, "lib"),
        (second(3), "deleted", at("b.png"), None, "lib"),
        (second(4), "created", at("new.png"), None, "lib"),
        (second(5), "changed", at("new.png"), None, "lib"),
        (second(6), "created", at("vanished.png"), None, "lib"),
        (second(7), "renamed", at("shot.png"), at("shot.tmp.png"), "lib"),
        (second(8), "renamed", at("c.png.bak"), at("c.png"), "lib"),
        (second(9), "changed", at("notes.txt"), None, "lib"),
    ]
    spark.createDataFrame(events, EVENTS).write.parquet(str(tmp_path / "in"))
    done = []
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    act = lambda df, n: done.append(watch.apply_events(store, df, read, lambda s: embed_pass(s, "m")))
    watch.watch(stream, act, str(tmp_path / "cp"), once=True).awaitTermination(120)
    rows = {os.path.basename(r["path"]): r for r in Snapshots(spark, str(tmp_path / "ix")).table("images").collect()}
    assert set(rows) == {"moved.png", "new.png", "shot.png"}
    assert rows["moved.png"]["id"] == ids["a.png"] and rows["moved.png"]["text"] == "read at " + at("a.png") and rows["moved.png"]["name"] == "moved"
    assert done == [{"moved": 1, "forgotten": 2, "indexed": 2}]
    assert {r["image_id"] for r in store.table("text_embeddings").collect()} == {r["id"] for r in rows.values()}


def test_folder_events(spark, tmp_path):
    """A watched folder: the stream tells what happens in it, and the index follows."""
    import time

    one = {"/a": (1, 5, 5, "s"), "/b": (2, 5, 5, "s"), "/c": (3, 5, 5, "s")}
    two = {"/a2": (1, 5, 5, "s"), "/c": (3, 6, 7, "s"), "/d": (4, 1, 1, "s")}
    assert differences(one, two) == [("renamed", "/a2", "/a", "s"), ("deleted", "/b", None, "s"), ("created", "/d", None, "s"), ("changed", "/c", None, "s")]
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "a.png").write_text("a")
    store = Snapshots(spark, str(tmp_path / "ix"))
    index_pass(store, scan(spark, str(lib)), F.col("path"))
    spark.dataSource.register(FolderEvents)
    stream = spark.readStream.format("folder-events").option("path", str(lib)).option("name", "lib").load()
    query = watch.watch(stream, lambda df, n: watch.apply_events(store, df, F.col("path")), str(tmp_path / "cp"), gap=1.0)
    try:
        names = lambda: sorted(r["name"] for r in store.table("images").collect())
        for act, want in ((lambda: (lib / "b.png").write_text("b"), ["a", "b"]), (lambda: (lib / "a.png").rename(lib / "z.png"), ["b", "z"]), ((lib / "b.png").unlink, ["z"])):
            time.sleep(5)  # the listing before
            act()
            end = time.time() + 60
            while names() != want and time.time() < end:
                time.sleep(0.5)
            assert names() == want
    finally:
        query.stop()


def test_config(tmp_path):
    c = config.Config([config.Source("x", "/x")], meaning_search=True)
    config.save(c, str(tmp_path / "c.json"))
    assert config.load(str(tmp_path / "c.json")) == c and config.load(str(tmp_path / "none.json")) == config.Config()
    assert config.unique_name("x", {"x", "x-2"}) == "x-3"


def test_eval_queries(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"q": "a", "a": ["x.png", "y.png"]}]')
    assert config.eval_queries(spark, str(tmp_path / "q.json")).first()["a"] == ["x.png", "y.png"]


def test_cli(tree, tmp_path, spark, capsys):
    from tessera import cli

    root = str(tmp_path / "ix")
    lines = [{"text": "hello wide world", "words": [{"text": w, "x": 10.0, "y": 5.0, "width": 20.0, "height": 10.0} for w in ("hello", "wide", "world")]}]
    with open(f"{tree}/a.PNG.json", "w") as f:
        json.dump(lines, f)
    for verb in (["index", root, tree], ["embed", root], ["stats", root], ["sources", root], ["search", root, "wide"], ["ocr", f"{tree}/a.PNG"], ["vacuum", root]):
        cli.main(verb)
    shown = capsys.readouterr().out
    assert "hello [wide] world" in shown and "'ocr_json'" in shown
    id_ = Snapshots(spark, root).table("images").where("name = 'a'").first()["id"]
    assert cli.marked(Snapshots(spark, root).table("images"), id_, ["wide world"]).first()["marked"] == [1, 2]
    assert cli.marked(Snapshots(spark, root).table("images"), id_, ["wide"]).first()["boxes"][0].asDict() == {"text": "wide", "x": 8.0, "y": 3.0, "width": 24.0, "height": 14.0}
    (tmp_path / "texts.json").write_text('["a b", "c"]')
    cli.main(["meaning-check", str(tmp_path / "texts.json")])
    cli.main(["model", tree])
    (tmp_path / "q.json").write_text('[{"q": "d", "a": ["d.gif"]}]')
    cli.main(["eval", root, str(tmp_path / "q.json")])
    out = capsys.readouterr().out
    assert "'indexed': 4" in shown and "hit1" in out and "1.0" in out
