"""Streams of file events: bursts end when a source is quiet, and nothing is lost in a restart."""

import datetime as dt
import json
import time

import pytest

from tessera.sources.folder import FolderEvents, FolderEventsReader, FolderReader, FolderSource, frontier, scan
from tessera.streaming import watch

EVENTS = "ts timestamp, op string, path string, old_path string, source string"


def put(folder, n, rows):
    """Rows (op, path, old_path, source) as the next file of a stream."""
    now = dt.datetime.now(dt.timezone.utc)
    lines = [json.dumps({"ts": (now + dt.timedelta(milliseconds=i)).isoformat(), "op": op, "path": path, "old_path": old, "source": source}) for i, (op, path, old, source) in enumerate(rows)]
    (folder / f".{n}.tmp").write_text("\n".join(lines))
    (folder / f".{n}.tmp").rename(folder / f"{n}.json")


def started(spark, folder, checkpoint, seen, gap=2.0):
    stream = spark.readStream.schema(EVENTS).json(str(folder))
    return watch.watch(stream, lambda df, n: seen.append((time.time(), sorted((r["op"], r["path"], r["source"]) for r in df.collect()))), str(checkpoint), gap=gap, look=0.2)


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.1)
    return condition()


def test_bursts_end_when_it_is_quiet(spark, tmp_path):
    """Events a second apart stay one burst, which comes two seconds after the last; deletions pass at once; sources are apart."""
    (tmp_path / "in").mkdir()
    seen: list = []
    put(tmp_path / "in", 0, [("created", "/warm.png", None, "w")])
    query = started(spark, tmp_path / "in", tmp_path / "cp", seen)
    try:
        assert until(lambda: seen)
        seen.clear()
        for i in range(4):
            put(tmp_path / "in", 1 + i, [("created", "/a/1.png", None, "a"), ("changed", f"/a/{i}.png", None, "a"), ("changed", "/a/no.txt", None, "a")])
            last = time.time()
            time.sleep(1)
        put(tmp_path / "in", 9, [("deleted", "/a/2.png", None, "a"), ("deleted", "/b/old.png", None, "b"), ("renamed", "/a/now.png", "/a/3.png", "a")])
        last = time.time()
        assert until(lambda: len(seen) >= 2)
        first, burst = seen[0], seen[1]
        assert first[1] == [("deleted", "/a/2.png", "a"), ("deleted", "/b/old.png", "b"), ("renamed", "/a/now.png", "a")]
        assert burst[1] == [("changed", "/a/0.png", "a"), ("created", "/a/1.png", "a"), ("created", "/a/now.png", "a")]
        assert burst[0] - last >= 2
        time.sleep(3)
        assert len(seen) == 2
    finally:
        query.stop()


def test_a_restart_loses_no_pending_path(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen: list = []
    query = started(spark, tmp_path / "in", tmp_path / "cp", seen, gap=6.0)
    put(tmp_path / "in", 0, [("created", "/a/1.png", None, "a")])
    assert until(lambda: any(p["numInputRows"] for p in query.recentProgress))
    query.stop()
    assert not seen
    query = started(spark, tmp_path / "in", tmp_path / "cp", seen, gap=6.0)
    try:
        assert until(lambda: seen) and seen[0][1] == [("created", "/a/1.png", "a")]
    finally:
        query.stop()


def test_folder_events_survive_a_restart(tmp_path):
    """A batch that was planned but not handled is told again word for word, and so is what changed in between."""
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "a.png").write_text("a")
    options = {"path": str(lib), "name": "lib", "log": str(tmp_path / "log")}
    one = FolderEventsReader(options)
    rows, at = one.read(one.initialOffset())
    assert list(rows) == []
    (lib / "b.png").write_text("b")
    rows, planned = one.read(at)
    told = list(rows)
    assert [(r[1], r[4]) for r in told] == [("created", "lib")]
    # The driver ends here, before the batch was handled; meanwhile more happens.
    (lib / "a.png").rename(lib / "z.png")
    two = FolderEventsReader(options)
    assert list(two.readBetweenOffsets(at, planned)) == told
    rows, last = two.read(planned)
    assert [(r[1], r[2].rpartition("/")[2], r[3].rpartition("/")[2]) for r in rows] == [("renamed", "z.png", "a.png")]
    two.commit(last)
    three = FolderEventsReader(options)
    assert list(three.read(last)[0]) == [] and len(list((tmp_path / "log").glob("turn-*.json"))) == 1
    # Told, but the end of the batch was not yet known to the stream.
    (lib / "c.png").write_text("c")
    rows, after = three.read(last)
    kept = list(rows)
    four = FolderEventsReader(options)
    again, end = four.read(last)
    assert list(again) == kept and end == after


def test_killed_between_plan_and_act(spark, tmp_path):
    """The stream itself: the index is brought in line by the run after the one that failed."""
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "a.png").write_text("a")
    spark.dataSource.register(FolderEvents)

    def run(act):
        stream = spark.readStream.format("folder-events").option("path", str(lib)).option("name", "lib").option("log", str(tmp_path / "log")).load()
        return watch.watch(stream, act, str(tmp_path / "cp"), gap=0.5, look=0.2)

    seen: list = []
    query = run(lambda df, n: seen.extend(r["path"] for r in df.collect()))
    try:
        assert until(lambda: list((tmp_path / "log").glob("turn-*.json")))
        (lib / "b.png").write_text("b")
        assert until(lambda: seen)
        assert [p.rpartition("/")[2] for p in seen] == ["b.png"]
    finally:
        query.stop()

    def fail(df, n):
        raise RuntimeError("ends here")

    query = run(fail)
    (lib / "c.png").write_text("c")
    with pytest.raises(Exception, match="ends here"):
        query.awaitTermination(60)
    (lib / "d.png").write_text("d")
    seen.clear()
    query = run(lambda df, n: seen.extend(r["path"] for r in df.collect()))
    try:
        assert until(lambda: len(seen) >= 2)
        assert sorted(p.rpartition("/")[2] for p in seen) == ["c.png", "d.png"]
    finally:
        query.stop()


def test_a_tree_is_listed_in_many_parts(spark, tmp_path):
    """One source with many folders gives many tasks and the same files; hidden folders stay out, depth ends nowhere."""
    for i in range(30):
        for name in (f"d{i}/x.png", f"d{i}/deep/er/y.png", f".h{i}/z.png"):
            p = tmp_path / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("")
    (tmp_path / "top.png").write_text("")
    want = sorted(e.path for e in scan(str(tmp_path), True, ("png",)))
    spark.dataSource.register(FolderSource)
    for most in (1, 7, 40, 1000):
        parts = frontier(str(tmp_path), True, most)
        assert sorted(e.path for p, r in parts for e in scan(p, r, ("png",))) == want and len(parts) >= min(most, 31)
        got = spark.read.format("folder").option("path", str(tmp_path)).option("name", "lib").option("parallel", str(most)).load()
        assert sorted(r["path"] for r in got.collect()) == want and got.where("source <> 'lib' OR source_ord <> 1").count() == 0
    assert len(FolderReader({"path": str(tmp_path)}).partitions()) > 60
    assert sorted(e.path for p, r in frontier(str(tmp_path), False, 50) for e in scan(p, r, ("png",))) == [str(tmp_path / "top.png")]
    assert [f for p, r in frontier(str(tmp_path / "none"), True, 5) for f in scan(p, r, ("png",))] == []
