"""Passes that are stopped, leases, recovered errors, running statistics, configurations that change."""

import datetime as dt
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import diagnostics
from tessera.functions.encoders import hash_projection
from tessera.operators import reporting
from tessera.passes import Busy, Lease, Passes, Stopped
from tessera.pipeline import embed_pass, follow_config, forget, index_files
from tessera.sources.config import Config, Source, differs
from tessera.sources.folder import FolderSource
from tessera.sources.snapshots import SCHEMAS, Snapshots
from tessera.streaming import stats

NOW = dt.datetime(2024, 1, 1)
FILES = "path string, source string, size long, mtime timestamp"


def images(spark, n):
    made = [(i, f"/a/f{i}.png", f"f{i}", "abc"[i % 3], 1, NOW, None, None, NOW, "ok", None, None, f"text {i}") for i in range(1, n + 1)]
    return spark.createDataFrame(made, SCHEMAS["images"])


def test_a_stopped_pass_leaves_the_old_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "ix"))
    store.commit(images=images(spark, 12))
    passes = Passes(store, seconds=5)

    def slow(texts):
        time.sleep(3)
        return hash_projection(texts)

    failed: list = []

    def run():
        try:
            passes.run(embed_pass, store, "m", encoder=slow)
        except Exception as e:
            failed.append(type(e))

    t = threading.Thread(target=run)
    t.start()
    end = time.time() + 30
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < end:
        time.sleep(0.1)
    with pytest.raises(Busy):
        Lease(Snapshots(spark, store.root)).take()
    passes.stop()
    passes.when_idle()
    t.join(60)
    assert failed == [Stopped]
    again = Snapshots(spark, store.root)
    assert again.serial == 1 and again.table("text_embeddings").count() == 0
    with pytest.raises(Stopped):
        passes.run(embed_pass, store, "m")
    assert Passes(again).run(embed_pass, again, "m") == 12


def test_leases(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "ix"))
    one, two = Lease(store, 30), Lease(store, 30)
    one.take()
    with pytest.raises(Busy):
        two.take()
    one.free()
    two.take()
    one.free()  # not its own any more
    assert two.holder()["owner"] == two.owner
    two.free()
    assert two.holder() is None
    # A driver that is gone: its lease runs out.
    gone = Lease(store, 0.2, "gone")
    gone.take()
    gone._done.set()
    time.sleep(0.3)
    one.take()
    assert one.holder()["owner"] == one.owner
    one.free()


def test_errors_of_tasks_reach_the_hook(spark, monkeypatch):
    told: dict = {}
    monkeypatch.setattr(diagnostics, "hook", lambda message, times: told.update({message: told.get(message, 0) + times}))
    errors = diagnostics.Errors(spark)

    def broken(texts):
        if any("bad" in t for t in texts):
            raise ValueError("can't read this")
        return np.ones((len(texts), 4))

    from tessera.functions.encoders import encode_column

    df = spark.createDataFrame([(f"bad {i}" if i % 4 == 0 else "good",) for i in range(20)], "t string").repartition(3)
    made = df.select(encode_column(F.col("t"), broken, errors=errors).alias("v")).collect()
    assert sum(not r["v"] for r in made) == 5
    assert errors.drain() == {"ValueError: can't read this": 5} == told and errors.drain() == {}
    monkeypatch.setattr(diagnostics, "hook", lambda *a: 1 / 0)
    diagnostics.report(ValueError("a hook that fails is passed over"))
    many = diagnostics._Counts().addInPlace({}, {str(i): 1 for i in range(500)})
    assert len(many) == diagnostics.MOST + 1 and many["..."] == 400


def test_running_statistics_are_those_of_a_count(spark, tmp_path):
    """Commits, changes, deletions and merges: the stream's sums are stats_by_source after each, also over a restart."""
    store = Snapshots(spark, str(tmp_path / "ix"))
    now: dict = {}
    same = lambda: {k: v for k, v in now.items() if v} == {r["source"]: r["n"] for r in reporting.stats_by_source(store.table("images")).collect()} == store.by_source()

    def catch_up():
        stats.follow(spark, store.root, now.update, str(tmp_path / "cp"), once=True).awaitTermination(60)

    store.commit(images=images(spark, 9))
    catch_up()
    assert same()
    index_files(store, spark.createDataFrame([("/A/F3.png", "b", 2, NOW), ("/new.png", "d", 2, NOW)], FILES), F.lit("read"))
    forget(store, [1, 4, 7, 99])
    store.compact("images")
    catch_up()
    assert same() and now["d"] == 1
    store.commit(images=images(spark, 2))
    catch_up()
    assert same() and now["d"] == 0


def test_a_new_configuration(spark, tmp_path):
    for name in ("a/1.png", "b/2.png", "b/3.gif"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("")
    spark.dataSource.register(FolderSource)

    def listing(c: Config):
        reader = spark.read.format("folder").option("extensions", ",".join(c.extensions))
        for i, s in enumerate(c.sources, 1):
            n = "" if i == 1 else str(i)
            reader = reader.option(f"path{n}", s.path).option(f"name{n}", s.name)
        return reader.load()

    a, b = Source("a", str(tmp_path / "a")), Source("b", str(tmp_path / "b"))
    one = Config([a], meaning_search=True)
    assert differs(one, Config([a], meaning_search=True)) == {"indexing": False, "visual": False, "meaning": False}
    assert differs(Config([a, b]), Config([b, a]))["indexing"] and not differs(Config([a], ["PNG"]), Config([a], ["png"]))["indexing"]
    store = Snapshots(spark, str(tmp_path / "ix"))
    encoders = {"hash-projection": hash_projection, "other": hash_projection}
    turn = lambda old, new: follow_config(store, old, new, listing, F.col("path"), encoders)
    names = lambda: sorted(r["path"].rpartition("/")[2] for r in store.table("images").collect())
    got = turn(Config([]), one)
    assert names() == ["1.png"] and got["report"]["indexed"] == got["visual_vectors"] == got["meaning_vectors"] == 1
    two = Config([b], ["png"], meaning_search=True)
    got = turn(one, two)
    assert got["forgotten"] == ["a"] and names() == ["2.png"] and got["report"]["indexed"] == 1
    three = Config([b], meaning_search=True, meaning_model="other", visual_search=False)
    got = turn(two, three)
    assert names() == ["2.png", "3.gif"] and got["meaning_vectors"] == 2 and "visual_vectors" not in got
    assert {r["model"] for r in store.table("text_embeddings").collect()} == {"other"}
    serial = store.serial
    assert turn(three, three)["forgotten"] == [] and store.serial == serial
