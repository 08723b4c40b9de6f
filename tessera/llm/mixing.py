"""Mixing sources to target weights by blocks.

Each source's words are laid end to end by document id and cut into blocks of fixed length.  The mix has a
fixed number of slots for each source and shards of equally many places.  Which sources a shard gets is
drawn: a pseudorandom permutation deals all slots to all places, so a shard's counts by source follow the
multinomial law under the condition that the sources' totals come out (the multivariate hypergeometric
law).  Independent draws would leave a source of one slot out of a third of all mixes.  Slots run through a
pseudorandom permutation of their source's block numbers, and joining slots with blocks by (source, block)
gives the text of the mix.

Nothing is planned on the driver but two numbers (the words of all sources, and the level at which
targets are even); sources are rows of a table, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .bytewords import Words, mix, slices
from .ordinals import running
from .store import park

WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARD_SLOTS = 16_384
#: Slots that a task makes, and slots of one source that are made in one go.
TASK_SLOTS, STEP = 1 << 18, 4096


def word_counts(docs: DataFrame, id_col: str, text: str, extra: list[str]) -> DataFrame:
    """id, the extra columns and ``size``: the number of words; one pass over the text."""
    read = docs.select(F.col(id_col).cast("long").alias("_id"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)], F.col(text).cast("string").alias("_text"))
    out = read.drop("_text").withColumn("_n", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [Words(data, offsets).count for _, _, data, offsets in slices(b.column(b.num_columns - 1))]
            n = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=out.names)

    names = [F.col("_id").alias(id_col), *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)], F.col("_n").alias("size")]
    return read.mapInArrow(count, out).select(*names)


def plan_sources(sizes: DataFrame, weights: tuple[int, ...], most: float, block: int) -> DataFrame:
    """One row per source of ``sizes`` (_source, n): s, target, and what its slots are; parked.

    Sources rank by code point, null last, and weigh ``weights`` in turn.  A source's target is its share
    by weight of all words; what ``most`` times its size cuts off is shared again among the others, that
    is, the level per weight rises until all words are given.  Whole turns through a source's ``blocks``
    come first, then ``rest`` words of one more turn.  ``first`` numbers the slots of all sources.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = running(sizes.withColumn("_one", F.lit(1).cast("long")), [F.col("_source").asc_nulls_last()], "_one", "s").drop("_one")
    ranked = park(ranked.withColumn("_w", F.element_at(kinds, (F.pmod("s", F.lit(len(weights))) + 1).cast("int"))))
    cap = F.lit(float(most)) * F.col("n")
    words, level, over = float(ranked.agg(F.sum("n")).first()[0] or 0), 0.0, -1
    while True:
        held = F.col("_w") * level > cap
        full, open_, many = ranked.agg(F.sum(F.when(held, cap)), F.sum(F.when(~held, F.col("_w"))), F.count(F.when(held, 1))).first()
        if many == over or not open_:
            break
        over, level = many, (words - (full or 0.0)) / open_
    goal = F.least(F.col("_w") * level, cap)
    turns = F.floor(goal / F.greatest("n", F.lit(1)) + 1e-9).cast("long")
    blocks = F.ceil(F.col("n") / block).cast("long")
    out = ranked.select("s", "_source", "n", goal.alias("target"), turns.alias("turns"), blocks.alias("blocks"))
    out = out.withColumn("rest", F.rint(F.col("target") - F.col("turns") * F.col("n")).cast("long"))
    part = F.least(F.ceil(F.col("rest") / block).cast("long"), F.col("blocks"))
    out = out.withColumn("slots", F.when(F.col("n") > 0, F.col("turns") * F.col("blocks") + part).otherwise(F.lit(0)).cast("long"))
    return park(running(out, [F.col("s")], "slots", "first"))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a four-round Feistel network, walked until below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    at, out = np.arange(len(index)), index.astype(np.uint64)
    while len(at):
        left, right = out[at] >> half[at], out[at] & mask[at]
        for r in range(4):
            left, right = right, left ^ (mix(right + key[at] + np.uint64(r * 0x9E3779B9)) & mask[at])
        out[at] = (left << half[at]) | right
        at = at[out[at] >= n[at].astype(np.uint64)]
    return out.astype(np.int64)


def draw_slots(plan: DataFrame, total: int, block: int, shard_slots: int, seed: int) -> DataFrame:
    """All ``total`` slots of the mix: shard, s, slot, turn, block, owed (words the slot gives at most).

    A slot's place among all is ``first`` + slot run through one permutation, and its shard is the place's.
    Slots are made in parallel, ``TASK_SLOTS`` a task; a source of any size is dealt out over tasks.
    """
    step = max(STEP, -(-total // 1_000_000))
    begin = F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(step).cast("long"))
    runs = plan.where("slots > 0").select("s", "first", "slots", "blocks", "turns", "rest", F.explode(begin).alias("_from"))
    runs = runs.repartition(max(1, -(-total // TASK_SLOTS)), "s", "_from")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                end, n, s = int(min(t["slots"][i], t["_from"][i] + step)), int(t["blocks"][i]), int(t["s"][i])
                for low in range(int(t["_from"][i]), end, STEP):
                    k = np.arange(low, min(low + STEP, end), dtype=np.int64)
                    turn = k // n
                    key = mix(np.full(len(k), seed, np.uint64) + np.uint64(s << 20) + turn.astype(np.uint64))
                    at = permute(k % n, np.full(len(k), n, np.int64), key)
                    place = permute(t["first"][i] + k, np.full(len(k), total, np.int64), mix(np.full(len(k), seed + 1, np.uint64)))
                    owed = np.where(turn < t["turns"][i], block, np.minimum(block, t["rest"][i] - (k % n) * block))
                    cols = (place // shard_slots, np.full(len(k), s, np.int64), k, turn, at, owed.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["shard", "s", "slot", "turn", "block", "owed"])

    return runs.mapInArrow(make, "shard long, s long, slot long, turn long, block long, owed long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: id, source, size, source_size, target, taken, one row per row of ``docs``.
    pieces: shard, s (source number), slot, turn, block, _row, id, start, place, length: ``length`` words of a
    document from its word ``start`` stand at ``place`` of a slot; :func:`mixed_blocks` gives their text.
    _row tells rows of ``docs`` apart: the unique long column ``row`` if named, else a number of our own.

    Sources rank by code point, null last, and weigh ``weights`` in turn; any number of them is planned as
    a table.  Texts without words (null, empty) have size 0 and take 0.  Rows that repeat an id are
    documents of their own.  The mix is deterministic: documents stand by (id, size), draws depend on
    ``seed`` alone.  All shards but the last have ``shard_slots`` slots.  An empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"), *([F.col(row).alias("_row")] if row else []))
    sized = word_counts(plain, "_id", "_text", ["_source", *(["_row"] if row else [])]).withColumnRenamed("size", "_size")
    order = [F.col("_id").asc_nulls_last(), F.col("_size"), *([F.col("_row")] if row else [])]
    laid = running(sized, order, "_size", "_at", "_source")
    laid = park(laid if row else laid.withColumn("_row", F.monotonically_increasing_id()))
    plan = plan_sources(laid.groupBy("_source").agg(F.sum("_size").alias("n")), weights, most, block)
    drawn = draw_slots(plan, int(plan.agg(F.sum("slots")).first()[0] or 0), block, shard_slots, seed)
    by_source = plan.select("s", F.col("_source").alias("_name"), F.col("n").alias("source_size"), "target")
    known = laid.join(by_source, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    ids = F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_size") - 1) / block))
    cut = known.where("_size > 0").select("s", "_row", "_id", "_at", "_size", F.explode(ids).alias("block"))
    begin = F.greatest(F.col("_at"), F.col("block") * block)
    cut = cut.select("s", "block", "_row", "_id", (begin - F.col("_at")).alias("start"), (begin - F.col("block") * block).alias("_in"), (F.least(F.col("_at") + F.col("_size"), (F.col("block") + 1) * block) - begin).alias("_len"))
    # The parked table is so compact that Spark would take its pieces for small enough to broadcast.
    met = drawn.join(cut.hint("merge"), ["s", "block"]).where("_in < owed")
    pieces = met.select("shard", "s", "slot", "turn", "block", "_row", F.col("_id").alias(id_col), "start", F.col("_in").alias("place"), F.least(F.col("_len"), F.col("owed") - F.col("_in")).alias("length"))
    taken = pieces.groupBy("_row").agg(F.sum("length").alias("taken"))
    documents = known.join(taken.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left").select(F.col("_id").alias(id_col), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "_row")
    return documents, pieces


@F.arrow_udf(StringType())
def cut_words(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The words of (start, length) spans, joined by one space; null without spans."""
    out: list[bytes | None] = []
    for i, j, data, offsets in slices(text):
        w, raw = Words(data, offsets), data.tobytes()
        for r in range(i, j):
            own = spans[r].as_py()
            at = w.bounds[r - i]
            pick = [k for s in own or () for k in range(at + s["start"], at + s["start"] + s["length"])]
            out.append(None if own is None else b" ".join([raw[w.start[k] : w.end[k]] for k in pick]))
    return pa.array(out, pa.binary()).cast(pa.string())


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars", **how) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each turn in which a document gives words.

    A whole document keeps its text; of a part, the words taken stand joined by one space.  ``length``, if
    there is such a column, is set to the text's new number of characters.  Documents of which the mix
    takes nothing are not in it.
    """
    names = docs.columns
    tagged = park(docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)]).withColumn("_tag", F.monotonically_increasing_id()))
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    documents, pieces = mix_sources(tagged, at[id_col], at[text], at[source], row="_tag", **how)
    spans = F.array_sort(F.collect_list(F.struct("start", "length")))
    turns = pieces.groupBy("_row", "turn").agg(F.sum("length").alias("_taken"), spans.alias("_spans"))
    sizes = documents.select(F.col("_row").alias("_r"), "size")
    given = turns.join(sizes, F.col("_row") == F.col("_r")).select("_row", F.when(F.col("_taken") < F.col("size"), F.col("_spans")).alias("_spans"))
    joined = tagged.join(given, F.col("_tag") == F.col("_row"))
    # Whole documents pass the function by; only the text of a part goes through it.
    part = cut_words(F.when(F.col("_spans").isNotNull(), F.col(at[text])), F.col("_spans"))
    out = joined.withColumn("_new", F.when(F.col("_spans").isNull(), F.col(at[text])).otherwise(part))
    kinds = dict(docs.dtypes)
    new = {c: F.col(at[c]) for c in names} | {text: F.col("_new")} | ({length: F.length("_new").cast(kinds[length])} if length in names else {})
    return out.select(*[new[c].alias(c) for c in names])


def mixed_blocks(docs: DataFrame, pieces: DataFrame, row: str, text: str = "text") -> DataFrame:
    """The mix itself: shard, source number, slot and the block's words joined by one space.

    ``row`` is the column that told rows apart in :func:`mix_sources`, so ids may repeat.
    """
    split = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    words = docs.where(F.col(text).isNotNull()).select(F.col(row).alias("_d"), split.alias("_words"))
    cut = pieces.join(words, F.col("_row") == F.col("_d")).select("shard", "s", "slot", "place", F.array_join(F.slice("_words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ").alias("_part"))
    parts = F.array_sort(F.collect_list(F.struct("place", "_part")))
    return cut.groupBy("shard", "s", "slot").agg(F.array_join(F.transform(parts, lambda p: p["_part"]), " ").alias("text"))
