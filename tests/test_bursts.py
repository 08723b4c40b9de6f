"""Bursts of renames and deletions against handling them one by one."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import IMAGE_EXTENSIONS
from tessera.streaming import bursts

NOW = dt.datetime(2024, 1, 1)
EVENTS = "ts timestamp, op string, path string, old_path string, source string"


def extension(path):
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def under(path, folder):
    return path.lower() == folder.lower() or path.lower().startswith(folder.lower() + "/")


def one_by_one(images, events):
    """({id: (path, source)}, indices of the renames that moved something)."""
    now, acted = {i: (p, s) for i, p, s in images}, set()
    for n, (_, op, path, old, source) in enumerate(sorted(events, key=lambda e: (e[0], e[1], e[2]))):
        image, was = extension(path) in IMAGE_EXTENSIONS, extension(old or "") in IMAGE_EXTENSIONS
        if op == "deleted":
            if image or not extension(path):
                now = {i: v for i, v in now.items() if not under(v[0], path)}
        elif not image and was:
            now = {i: v for i, v in now.items() if not under(v[0], old)}
        elif old and (moving := {i for i, v in now.items() if under(v[0], old)}):
            acted.add(n)
            now = {i: (path + v[0][len(old) :], source) if i in moving else v for i, v in now.items() if i in moving or not under(v[0], path)}
    return now, acted


@pytest.mark.parametrize("seed", [2])
def test_bursts_are_the_sequence(spark, seed):
    """Folders and files, names taken and freed again, letters in either case, chains, deletions above what moved."""
    r = random.Random(seed)
    folders = ["/a", "/a/b", "/A/c", "/d", "/d/e", "/d/e/f"]
    names = ["x.png", "Y.JPG", "z.txt", "sub", "w.png"]
    images = [(i, f"{f}/{n}", "s") for i, (f, n) in enumerate((f, n) for f in folders for n in ("x.png", "Y.JPG", "w.png"))]
    path = lambda: r.choice(folders) + (f"/{r.choice(names)}" if r.random() < 0.7 else "")
    events = []
    for k in range(40):
        renamed = r.random() < 0.85
        events.append((NOW + dt.timedelta(seconds=k // 2), "renamed" if renamed else "deleted", path(), path() if renamed else None, r.choice("st")))
    # One file that goes a long way.
    way = [f"/way/{k}.png" for k in range(30)]
    images.append((99, way[0], "s"))
    events += [(NOW + dt.timedelta(seconds=k, milliseconds=500), "renamed", b, a, "w") for k, (a, b) in enumerate(zip(way, way[1:], strict=False))]
    r.shuffle(events)
    want, acted = one_by_one(images, events)
    turns = bursts.numbered(spark.createDataFrame(events, EVENTS).repartition(3))
    ends, moved = bursts.resolve(spark.createDataFrame(images, "id long, path string, source string"), turns)
    got = {i: (p, s) for i, p, s in images}
    for e in ends.collect():
        if e["gone"]:
            del got[e["id"]]
        else:
            got[e["id"]] = (e["path"], e["source"])
    assert got == want and got[99] == (way[-1], "w")
    names_ = [(e[0], e[1], e[2]) for e in sorted(events, key=lambda e: (e[0], e[1], e[2]))]
    hit = {(x["ts"], x["op"], x["path"]) for x in turns.join(moved, "no").collect()}
    assert hit == {names_[n] for n in acted} or len(set(names_)) < len(names_)


def test_a_hundred_thousand_renames(spark):
    """Chains of fifty renames each, in a few rounds and without the driver."""
    files, times = 2000, 50
    e = spark.range(files * times).select((F.col("id") % files).alias("f"), F.floor(F.col("id") / files).cast("long").alias("k"))
    name = lambda k: F.concat(F.lit("/x/f"), F.col("f").cast("string"), F.lit("-"), k.cast("string"), F.lit(".png"))
    events = e.select(F.timestamp_millis(F.col("k") * 1000 + F.col("f")).alias("ts"), F.lit("renamed").alias("op"), name(F.col("k") + 1).alias("path"), name(F.col("k")).alias("old_path"), F.lit("s").alias("source"))
    images = spark.range(files).select("id", F.concat(F.lit("/x/f"), F.col("id").cast("string"), F.lit("-0.png")).alias("path"), F.lit("s").alias("source"))
    start = time.time()
    ends, moved = bursts.resolve(images, bursts.numbered(events))
    assert {(r["id"], r["path"]) for r in ends.collect()} == {(f, f"/x/f{f}-{times}.png") for f in range(files)}
    assert moved.count() == files * times and time.time() - start < 240


def test_folders_that_no_event_acts_on_are_not_looked_for(spark):
    """Of the folders above a path only those as deep as a path that an event acts on."""
    from tessera.streaming import bursts

    events = spark.createDataFrame([(1, "renamed", "/a/b/new", "/a/b/old", "s"), (2, "deleted", "/a/b/c/d/e.png", None, "s")], "ts int, op string, path string, old_path string, source string")
    effects = bursts._effects(bursts.numbered(events.withColumn("ts", F.timestamp_seconds("ts"))))
    assert effects.depths == [4, 6]
    above = spark.createDataFrame([("/a/b/old/x/y.png",)], "path string").select(bursts._above(F.col("path"), effects.depths).alias("p")).first()["p"]
    assert above == ["/a/b/old", "/a/b/old/x/y.png"]
