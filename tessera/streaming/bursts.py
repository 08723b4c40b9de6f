"""What a burst of renames and deletions comes to, as tables: no event is handled on the driver.

Events act on a path and all below it, one after the other.  For each image the first event that acts on one of the folders
above it (or on itself) is found by a join, applied, and the next one after it looked for, so there are as many rounds as one
image has events, not as the burst has.  Files that are renamed again and again are followed by pointer jumping: which rename comes next
for a renamed file is a table, and doubling it leads from the first to the last in as many steps as their number has digits.

A rename takes the place of what is there, if it moves anything.  Whether it does depends on events before it, so
trajectories are computed until the renames that moved something are those that were assumed to.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.shared import parked

MOVE, OVER, GONE = 0, 1, 2


def rename_action(op: Column, path: Column, old_path: Column, indexed: Column) -> Column:
    """What an event asks for: index, move, forget or ignore.

    Renames between non-images are ignored, from image to non-image forget, of indexed files move, others
    index.  Deletions forget images and paths without extension (folders).
    """
    image, was_image = T.has_extension(path), T.has_extension(old_path)
    renamed = F.when(~image & ~was_image, F.when(indexed, "move").otherwise("ignore")).when(~image, "forget").when(indexed, "move").otherwise("index")
    deleted = F.when(image | (T.extension(path) == ""), "forget").otherwise("ignore")
    return F.when(op == "renamed", renamed).when(op == "deleted", deleted).when(image, "index").otherwise("ignore")


def numbered(events: DataFrame) -> DataFrame:
    """Renames and deletions with ``no``, which grows in their order (time, kind, path)."""
    order = ["ts", "op", "path"]
    turns = events.where(F.col("op").isin("renamed", "deleted")).select("ts", "op", "path", F.coalesce("old_path", F.lit("")).alias("old_path"), "source")
    turns = turns.withColumn("action", rename_action(F.col("op"), F.col("path"), F.col("old_path"), F.lit(True))).where("action <> 'ignore'")
    return parked(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id()))


class Effects(NamedTuple):
    """What events do, and of how many pieces the paths are that they act on: other folders above a path need not be looked for."""

    rows: DataFrame
    depths: list[int]


def _effects(turns: DataFrame) -> Effects:
    """(no, role, subject, origin, new, cut, to): what events do to what stands at or below ``subject``."""
    fold = lambda c: T.ascii_lower(F.col(c))
    moves = turns.where("action = 'move' AND old_path <> ''")
    part = lambda df, role, subject: df.select("no", F.lit(role).alias("role"), fold(subject).alias("subject"), fold("old_path").alias("origin"), F.col("path").alias("new"), F.length("old_path").alias("cut"), F.col("source").alias("to"))
    gone = turns.where("action = 'forget'").withColumn("path", F.when(F.col("op") == "deleted", F.col("path")).otherwise(F.col("old_path")))
    rows = parked(part(moves, MOVE, "old_path").unionByName(part(moves, OVER, "path")).unionByName(part(gone, GONE, "path")))
    depths = rows.where("subject IS NOT NULL").select(F.size(F.split("subject", "/")).alias("n")).distinct().collect()
    return Effects(rows, sorted(r["n"] for r in depths))


def _above(key: Column, depths: list[int]) -> Column:
    """Of a folded path and all folders above it those of so many pieces."""
    pieces = F.split(key, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda n: n.isin(*depths)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))


def _next(rows: DataFrame, effects: Effects, moved: DataFrame | None) -> DataFrame:
    """For rows (id, path, at, ...) the first event after ``at`` that acts on each: id, and a struct ``e`` of the event."""
    key = T.ascii_lower(F.col("path"))
    asked = rows.select("id", "at", key.alias("_key"), F.explode(_above(key, effects.depths)).alias("subject"))
    hit = asked.join(effects.rows, "subject").where("no > at")
    # What an event moves is not what it takes the place of.
    own = (F.col("_key") == F.col("origin")) | F.startswith(F.col("_key"), F.concat("origin", F.lit("/")))
    hit = hit.where((F.col("role") != OVER) | ~own)
    if moved is not None:
        hit = hit.join(moved.select(F.col("no").alias("_m")), F.col("no") == F.col("_m"), "left").where((F.col("role") != OVER) | F.col("_m").isNotNull())
    e = F.struct("no", "role", "new", "cut", "to", (F.col("_key") == F.col("subject")).alias("exact"))
    return hit.groupBy("id").agg(F.min_by(e, F.struct("no", "role")).alias("e"))


def _chains(turns: DataFrame, effects: Effects, moved: DataFrame | None) -> tuple[list[DataFrame], bool]:
    """(tables (no, then): from a rename of a file to the 1st, 2nd, 4th, 8th ... rename of the same file after it; whether a place is taken)."""
    files = turns.where(F.col("action") == "move").where(T.has_extension(F.col("path"))).select(F.col("no").alias("id"), "path", F.col("no").alias("at"))
    first = parked(_next(files, effects, moved))
    step = first.where((F.col("e.role") == MOVE) & F.col("e.exact")).select(F.col("id").alias("no"), F.col("e.no").alias("then"))
    out = []
    while step.limit(1).count():
        out.append(step)
        far = step.select(F.col("no").alias("then"), F.col("then").alias("_far"))
        step = parked(step.join(far, "then").select("no", F.col("_far").alias("then")))
    return out, bool(first.where(F.col("e.role") == OVER).limit(1).count())


def _last(chains: list[DataFrame]) -> DataFrame | None:
    """(no, last): the last rename of each chain, from each rename that has one after it."""
    if not chains:
        return None
    now = chains[0].select("no", F.col("no").alias("last"))
    for step in reversed(chains):
        far = step.select(F.col("no").alias("last"), "then")
        now = now.join(far, "last", "left").select("no", F.coalesce("then", "last").alias("last"))
    return parked(now)


def _follow(rows: DataFrame, turns: DataFrame, effects: Effects, moved: DataFrame | None) -> tuple[DataFrame, DataFrame, bool]:
    """(what becomes of the rows that an event acts on: id, path, source, gone; events that moved something: no; whether a place is taken)."""
    chains, taken = _chains(turns, effects, moved)
    last = _last(chains)
    ends = turns.select(F.col("no").alias("_end"), F.col("path").alias("_path"), F.col("source").alias("_source"))
    done, hits = [], []
    now = rows.select("id", "path", "source", F.lit(-1).cast("long").alias("at"))
    while True:
        found = now.join(_next(now, effects, moved), "id")
        if last is not None:
            jump = last.select(F.col("no").alias("_no"), "last")
            found = found.join(jump, (F.col("e.no") == F.col("_no")) & F.col("e.exact") & (F.col("e.role") == MOVE), "left").join(ends, F.col("last") == F.col("_end"), "left")
        else:
            found = found.withColumns({"last": F.lit(None).cast("long"), "_path": F.lit(None).cast("string"), "_source": F.lit(None).cast("string")})
        step = F.concat(F.col("e.new"), F.substr(F.col("path"), F.col("e.cut") + 1))
        found = parked(found.select("id", F.coalesce("_path", step).alias("path"), F.coalesce("_source", "e.to").alias("source"), F.coalesce("last", "e.no").alias("at"), F.col("e.no").alias("no"), F.col("e.role").alias("role")))
        row = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == OVER).alias("over")).first()
        if not row["n"]:
            break
        taken = taken or row["over"] > 0
        hits.append(found.where(F.col("role") == MOVE).select("no"))
        done.append(found.select("id", "path", "source", "at", (F.col("role") != MOVE).alias("gone")))
        now = found.where(F.col("role") == MOVE).select("id", "path", "source", "at")
    if not done:
        return rows.limit(0).select("id", "path", "source", F.lit(False).alias("gone")), turns.limit(0).select("no"), taken
    all_ = reduce(DataFrame.unionByName, done)
    out = all_.groupBy("id").agg(F.max_by(F.struct("path", "source", "gone"), F.struct("at", "gone")).alias("r")).select("id", "r.path", "r.source", "r.gone")
    acted = reduce(DataFrame.unionByName, hits).distinct()
    for step in chains:
        acted = acted.unionByName(acted.join(step, "no").select(F.col("then").alias("no"))).distinct()
    return parked(out), parked(acted), taken


def resolve(images: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, path, source, gone) of the images (id, path, source) that :func:`numbered` renames and deletions act on, and (no) of the renames that moved any.

    The result is that of handling the events one by one.
    """
    effects = _effects(turns)
    key = T.ascii_lower(F.col("path"))
    touched = images.select("id", F.explode(_above(key, effects.depths)).alias("subject")).join(effects.rows.select("subject").distinct(), "subject", "left_semi").select("id").distinct()
    rows = parked(images.select("id", "path", "source").join(touched, "id", "left_semi"))
    out, moved, taken = _follow(rows, turns, effects, None)
    while taken:
        before = moved
        out, moved, _ = _follow(rows, turns, effects, before)
        taken = bool(moved.exceptAll(before).limit(1).count() or before.exceptAll(moved).limit(1).count())
    return out, moved
