"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are a group, which has one label and moves as a whole.  Groups are linked by the
lines that they share.  At first groups lie in the order of their hashes, cut evenly.  In each round a line is
told where most of its groups are, and every group where most of its lines are; groups move there as far as the
shard's quota has room.  At last the surplus of each label, taken from the smallest groups on, fills the
others, so the shard of a document is its label but for the surplus, and counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import running
from .store import beside, park

#: Characters from which a line links the documents that share it.
LINE = 40
#: Parts of a line's groups, in which votes are counted.
VOTE = 1000


def _share(*cols) -> Column:
    """A number in [0, 1) fixed by the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def shared_lines(docs: DataFrame, most: float = float("inf"), least: int = LINE) -> DataFrame:
    """(_line, _group): lines of ``least`` characters that more than one and at most ``most`` groups have; ``docs`` has _group and _body.

    Sharding takes all of them: a line that more groups share than fit into a shard votes by the share of them that its label has, so it
    counts for little beside others, and gathers what nothing else tells where to go.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split("_body", "\n"), lambda x: F.length(x) >= least), lambda x: F.xxhash64(x)))
    held = park(docs.select("_group", F.explode(lines).alias("_line")).distinct())
    often = held.groupBy(F.col("_line").alias("_l")).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col("_n") <= most)).select("_l")
    return park(held.join(park(often), F.col("_line") == F.col("_l"), "left_semi"))


def wishes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(_group, _label, _n, _to): groups whose lines are mostly elsewhere, and where.

    A line votes for the label that most of its groups have (of equally many the smallest), with their share among
    its groups in thousandths; a group wishes for the label with the most votes (again the smallest) if its own has less.
    """
    marked = park(edges.join(labels.select(F.col("_group").alias("_g"), "_label", "_n"), F.col("_group") == F.col("_g")).drop("_g"))
    counts = marked.groupBy("_line", "_label").agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(F.col("_line").alias("_l")).agg(F.max_by("_label", F.struct("_c", -F.col("_label"))).alias("_to"), F.floor(F.max("_c") * VOTE / F.sum("_c")).alias("_votes"))
    told = marked.join(park(best), F.col("_line") == F.col("_l")).groupBy("_group", "_label", "_n", "_to").agg(F.sum("_votes").alias("_votes"))
    own = F.sum(F.when(F.col("_to") == F.col("_label"), F.col("_votes")).otherwise(0))
    top = told.groupBy("_group", "_label", "_n").agg(F.max_by("_to", F.struct("_votes", -F.col("_to"))).alias("_to"), F.max("_votes").alias("_top"), own.alias("_own"))
    return top.where((F.col("_to") != F.col("_label")) & (F.col("_top") > F.col("_own"))).select("_group", "_label", "_n", "_to")


def propagate(labels: DataFrame, edges: DataFrame, n_shards: int, total: int, rounds: int = 6, slack: float = 0.05) -> DataFrame:
    """Move groups (_group, _n, _label) towards the labels of the groups that they share lines with, under quotas.

    A label takes groups as long as it holds no more than ``slack`` over its even share; where more wish to come than
    there is room, a hash decides.  Every table that a round aggregates is narrow; what the driver sees are sizes and
    wishes, one number for each label.  Rounds end when no group moves.
    """
    quota = float(total) / n_shards * (1 + slack)
    for turn in range(rounds):
        sizes = {r["_label"]: r["_s"] for r in labels.groupBy("_label").agg(F.sum("_n").alias("_s")).collect()}
        asked = park(wishes(labels, edges))
        flow = {r["_to"]: r["_in"] for r in asked.groupBy("_to").agg(F.sum("_n").alias("_in")).collect()}
        part = {to: min(1.0, max(0.0, quota - sizes.get(to, 0)) / n) for to, n in flow.items()}
        if not any(part.values()):
            break
        chance = F.element_at(F.array(*[F.lit(part.get(s, 0.0)) for s in range(n_shards)]), F.col("_to") + 1)
        moves = asked.where(_share("_group", F.lit(turn)) < chance).select(F.col("_group").alias("_g"), "_to")
        moves = beside(moves, asked.count())
        labels = park(labels.join(moves, F.col("_group") == F.col("_g"), "left").select("_group", "_n", F.coalesce("_to", "_label").alias("_label")))
    return labels


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text: str = "text", rounds: int = 6, line: int = LINE) -> DataFrame:
    """One row per document: id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Law ``rows``: the numbers of documents of any two shards differ by one at most.  size: UTF-8 bytes of
    the text plus 8; slot: place in the shard, gapless from 0.  Null text counts as empty, and all empty
    texts are one group; texts with one 64-bit hash move together.  Repeated rows are placed each on its own.  A null id
    ranks last in its group.  A group larger than a shard is divided.  Tables with fewer rows than shards leave shards empty; an empty table
    gives an empty result.  Other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("_id"), body.alias("_body"), F.xxhash64(body).alias("_group"))
    nodes = park(read.select("_id", "_group", (F.octet_length("_body") + 8).cast("long").alias("_size"), F.crc32(F.encode("_body", "utf-8")).alias("_crc")))
    total = nodes.count()
    groups = running(nodes.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")), [F.col("_group")], "_n", "_at")
    labels = park(groups.select("_group", "_n", F.floor(F.col("_at") * n_shards / max(total, 1)).cast("int").alias("_label")))
    edges = shared_lines(read, least=line)
    # Only groups with a line in common can move; the others are sizes.
    labels = propagate(labels, edges, n_shards, total, rounds)
    placed = nodes.join(park(labels.withColumnRenamed("_group", "_g")), F.col("_group") == F.col("_g")).drop("_g").withColumn("_one", F.lit(1))
    ranked = running(placed, [F.col("_label"), F.col("_n").desc(), F.col("_group"), F.col("_id").asc_nulls_last(), F.col("_crc"), F.col("_size")], "_one", "_rank")
    shard, slot = fitted({r["_label"]: r["_s"] for r in labels.groupBy("_label").agg(F.sum("_n").alias("_s")).collect()}, n_shards, total)
    return ranked.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def fitted(sizes: dict[int, int], n_shards: int, total: int) -> tuple[Column, Column]:
    """(shard, slot) of a row from its _label and _rank, its place among all rows by label.

    The first rows of a label, as many as its quota, stay; the labels that hold most have the quotas of one more.
    The rows beyond quotas fill the shards below theirs, in order.
    """
    held = [sizes.get(s, 0) for s in range(n_shards)]
    whole, extra = divmod(total, n_shards)
    more = set(sorted(range(n_shards), key=lambda s: (-held[s], s))[:extra])
    quota = [whole + (s in more) for s in range(n_shards)]
    begin, over, lack = [0], [0], [0]
    for s in range(n_shards):
        begin.append(begin[-1] + held[s])
        over.append(over[-1] + max(0, held[s] - quota[s]))
        lack.append(lack[-1] + max(0, quota[s] - held[s]))
    of = lambda values, at: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))
    place = F.col("_rank") - of(begin[:-1], F.col("_label"))
    spare = place - of(quota, F.col("_label"))
    surplus = spare + of(over[:-1], F.col("_label"))
    # The shard whose lack holds this place of the surplus: as many as end at or before it.
    to = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in lack[1:]]), lambda end: end <= surplus))
    to = F.least(to, F.lit(n_shards - 1))
    return F.when(spare < 0, F.col("_label")).otherwise(to), F.when(spare < 0, place).otherwise(of(held, to) + surplus - of(lack[:-1], to))
