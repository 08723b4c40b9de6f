"""Jaccard join of documents' n-gram sets by prefix trees.

The n-grams' 64-bit hashes give the global order; a document's set is its path of hashes in that order.

1. Which paths can meet: the order is cut into k equal ranges.  Two sets that are similar enough differ
   in at most H n-grams, so of k = H + c ranges at least c hold the same run of both paths.  Each document
   sends the hashes of its runs.  Of the runs that it shares with others, a document leaves out the most
   frequent ones, as many less one as any partner must share with it: by the rule of prefix filtering
   similar documents still meet, while a passage that many documents share brings none together.
   The connected clusters of what meets are all that is compared.
2. Comparing: each cluster's sets go into tries.  A lookup walks the trie, sharing the overlap of
   common beginnings, and leaves a subtree once overlap plus what remains of either path is too little.

Clusters of any size are split into blocks (see :func:`_verify`); no pairs are emitted, only links of
each set to its component's first set in the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, mix, slices, windows
from .components import Union, components
from .store import park
from .streams import distinct_pairs, groups, whole

BLOCK = 256
#: Rows of one run, or runs of one set, that a task holds at once.
HELD = 1 << 20
#: Bytes of paths that a block holds at most, but for a single set's.
BLOCK_BYTES = 16 << 20
#: Ranges beyond the differences, as a share of them: what prefix filtering can leave out.
SPARE = 0.25
U = np.uint64


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word n-grams.

    With fewer words the whole sequence is the one n-gram; without words the set is empty.
    """
    for i, j, data, offsets in slices(column):
        w = Words(data, offsets, fold=True)
        h, at = w.hashes(), w.bounds
        for r in range(j - i):
            own = h[at[r] : at[r + 1]]
            yield np.unique(windows(own, min(width, len(own)))) if len(own) else np.zeros(0, U)


def set_id(s: np.ndarray) -> int:
    """64 bits that name a set."""
    return int(np.int64(mix(np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), keepdims=True) + U(len(s))).view(np.int64)[0]))


@lru_cache(maxsize=100_000)
def _ranges(j: int, percent: int) -> tuple[int, int, float]:
    """(k, c, highest size) of the j-th interval of sizes: number of ranges, and spare ones beyond the differences."""
    step = (100 / percent) ** 2
    low, high = step**j, step ** (j + 1.5) * (1 + 1e-9)
    differ = int(2 * high) * (100 - percent) // (100 + percent)
    empty = (differ + 2) * math.exp(-low / (differ + 2))
    spare = 2 + math.ceil(1.3 * empty + 3 * math.sqrt(empty) + SPARE * differ)
    return differ + spare, spare, high


def run_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs by which a set meets every set that is similar enough, how many a partner must share).

    Sizes fall into intervals that overlap so that the sizes of any similar pair share one.  In an
    interval both sets use the same k ranges; a set of size n sends its first H(n) + c, H(n) being the
    most n-grams by which it can differ from a partner.  At least c of the ranges that both send are equal,
    and at least c less its own empty ranges are equal and not empty.  A set with c or more empty ranges
    sends those, too, so that equal empty ranges are never all there is.  A hash's lowest bit tells the intervals apart.
    """
    n = len(s)
    step = (100 / percent) ** 2
    base = int(math.floor(math.log(n) / math.log(step) + 1e-12))
    while step ** (base + 1) <= n:
        base += 1
    while step**base > n:
        base -= 1
    sums = np.zeros(n + 1, U)
    np.cumsum(mix(s), out=sums[1:])
    out, needs = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for j in (base, base - 1):
        k, spare, high = _ranges(j, percent)
        if n > high:
            continue
        differ = (n + min(int(high), n * 100 // percent)) * (100 - percent) // (100 + percent)
        if not differ:
            continue
        send = min(k, differ + spare)
        edges = np.searchsorted(s, _edges(k)[: send + 1])
        if send == k:
            edges[-1] = n
        held = edges[1:] > edges[:-1]
        need = spare - (send - np.count_nonzero(held))
        if need < 1:
            held[:] = True
        at = np.flatnonzero(held)
        hashes = mix(sums[edges[1:][at]] - sums[edges[:-1][at]] + mix(at.astype(U) + U(j + 64 << 32)))
        out.append((hashes & ~U(1) | U(j & 1)).view(np.int64))
        needs.append(np.full(len(at), max(need, 1), np.int32))
    return np.concatenate(out), np.concatenate(needs)


@lru_cache(maxsize=4096)
def _edges(k: int) -> np.ndarray:
    """Where the k ranges of the order begin; the last edge is the end of the order."""
    return np.array([min(i * (1 << 64) // k, (1 << 64) - 1) for i in range(k + 1)], U)


class Trie:
    """Sets as paths in the global order; runs without a branch are one node."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.top = self._build(order, 0) if order else None

    def _build(self, ids: list[int], depth: int) -> list:
        """Nodes (first depth, last depth, example, smallest, largest, ends, children) below ``depth``, made without recursion."""
        out: list = []
        todo = [(ids, depth, out)]
        while todo:
            ids, depth, into = todo.pop()
            i = 0
            while i < len(ids):
                first = self.sets[ids[i]]
                j = i + 1
                if depth == len(first):
                    i += 1  # ends at the parent, which lists it
                    continue
                while j < len(ids) and len(self.sets[ids[j]]) > depth and self.sets[ids[j]][depth] == first[depth]:
                    j += 1
                own = ids[i:j]
                end = self._common(self.sets[own[0]], self.sets[own[-1]], depth)
                sizes = [len(self.sets[x]) for x in own]
                node = (depth, end, own[0], min(sizes), max(sizes), [x for x, n in zip(own, sizes, strict=True) if n == end], [])
                into.append(node)
                if len(node[5]) < len(own):
                    todo.append((own, end, node[6]))
                i = j
        return out

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray, start: int) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[start:n] != b[start:n])
        return start + int(differ[0]) if len(differ) else n

    def similar(self, x: np.ndarray, percent: int, chunk: int = 64) -> Iterator[int]:
        """Numbers of the sets whose Jaccard similarity with ``x`` is at least ``percent`` / 100."""
        n = len(x)
        todo = [(node, 0) for node in self.top or ()]
        while todo:
            (begin, end, example, least, most, ends, kids), overlap = todo.pop()
            if 100 * min(n, most) < percent * max(n, least):
                continue
            path, gone = self.sets[example], False
            for at in range(begin, end, chunk):
                part = path[at : min(at + chunk, end)]
                where = np.searchsorted(x, part)
                overlap += int(np.count_nonzero(x[np.minimum(where, n - 1)] == part))
                left = min(n - int(where[-1]), most - at - len(part))
                if (100 + percent) * (overlap + left) < percent * (n + least):
                    gone = True
                    break
            if gone:
                continue
            for y in ends:
                if (100 + percent) * overlap >= percent * (n + len(self.sets[y])):
                    yield y
            todo += [(kid, overlap) for kid in kids]


def link_sets(sets: list[np.ndarray], percent: int, asking: list[bool] | None = None) -> Union:
    """Components of the sets under similarity.

    Sets similar to the first one are one component at once; the others (or only those ``asking``) go
    into a trie that every set is looked up in, so each link outside that component is seen from one end.
    """
    united, rest = Union(len(sets)), []
    if asking is None:
        first = sets[0]
        for i in range(1, len(sets)):
            s = sets[i]
            common = len(np.intersect1d(first, s, assume_unique=True)) if 100 * min(len(s), len(first)) >= percent * max(len(s), len(first)) else 0
            if (100 + percent) * common >= percent * (len(first) + len(s)):
                united.join(0, i)
            else:
                rest.append(i)
    else:
        rest = [i for i, a in enumerate(asking) if a]
    if rest:
        trie = Trie([sets[i] for i in rest])
        for i, s in enumerate(sets):
            for y in trie.similar(s, percent):
                united.join(i, rest[y])
    return united


def _named(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node = [], []
            for s in shingle_sets(b.column(1), width):
                n.append(len(s))
                node.append(set_id(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["_id", "_n", "_set"])

    return docs.mapInArrow(run, "_id long, _n long, _set long")


def _candidates(docs: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """(_lead, _set): sets that meet in a run, as links to the run's first set; no pairs within a run.

    Three passes over sorted partitions, each a stream: runs with their numbers of sets, each set's runs
    from the rarest, runs again.  A run in more than ``most`` sets counts as in ``most``; sets with more
    than ``most`` runs are read in parts.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for s in shingle_sets(b.column(1), width):
                node = set_id(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                k, need = run_keys(s, percent)
                rows.append((k, np.full(len(k), node, np.int64), need))
                held += len(k)
                if held > 100_000:
                    yield batch(rows, ["_key", "_set", "_need"])
                    rows, held = [], 0
            if rows:
                yield batch(rows, ["_key", "_set", "_need"])

    def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, node, need), huge in whole(batches, 1, most):
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, need = key[once], node[once], need[once]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            many = np.repeat(np.diff(np.r_[first, len(key)]), np.diff(np.r_[first, len(key)]))
            if huge:
                many[:] = most
            keep = many > 1
            yield batch([(node[keep], (key & 1)[keep].astype(np.int32), many[keep].astype(np.int32), key[keep], need[keep])], ["_set", "_odd", "_many", "_key", "_need"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a set that comes in parts, the last need - 1 runs so far are held back until more are seen: only the very last are left out.
        whose, back = None, np.zeros(0, np.int64)
        for (node, odd, _, key, need), part in whole(batches, 2, most):
            if part:
                own = (int(node[0]), int(odd[0]))
                key = np.concatenate([back, key]) if own == whose else key
                cut = max(0, len(key) - int(need[0]) + 1)
                whose, back = own, key[cut:]
                if cut:
                    yield batch([(key[:cut], np.full(cut, node[0], np.int64))], ["_key", "_set"])
                continue
            first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (odd[1:] != odd[:-1])])
            long = np.diff(np.r_[first, len(node)])
            place = np.arange(len(node)) - np.repeat(first, long)
            keep = place <= np.repeat(long, long) - need
            yield batch([(key[keep], node[keep])], ["_key", "_set"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for (key, node), huge in whole(batches, 1, most):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            leads = np.repeat(node[first], np.diff(np.r_[first, len(key)]))
            if huge:
                leads[:] = last[1] if last is not None and last[0] == key[0] else node[0]
                last = (key[0], leads[0])
            other = leads != node
            if other.any():
                yield batch([distinct_pairs(leads[other], node[other])], ["_lead", "_set"])

    # Narrow rows, sorted by Spark (which spills) and read as streams: a run in very many sets needs no memory.
    keys = docs.select("_id", "_text").mapInArrow(send, "_key long, _set long, _need int")
    sized = keys.repartition("_key").sortWithinPartitions("_key", "_set").mapInArrow(size, "_set long, _odd int, _many int, _key long, _need int")
    chosen = sized.repartition("_set").sortWithinPartitions("_set", "_odd", "_many", "_key").mapInArrow(choose, "_key long, _set long")
    return chosen.repartition("_key").sortWithinPartitions("_key", "_set").mapInArrow(lead, "_lead long, _set long").distinct()


def _compare(rows: DataFrame, percent: int, asked: bool, width: int) -> DataFrame:
    """Links (_a, _b) found within each (_cluster, _task), dealt out to ``width`` partitions; rows carry _set, _asks and _path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, 2):
            # Answers first; a set that comes both ways counts once, as asking.
            nodes, asks = t.column("_set").to_numpy(), t.column("_asks").to_numpy()
            last: dict[int, int] = {}
            for i, x in enumerate(nodes.tolist()):
                if x not in last or asks[i]:
                    last[x] = i
            pick = sorted(last.values(), key=lambda i: int(nodes[i]))
            paths = t.column("_path")
            sets = [np.frombuffer(paths[i].as_py(), U) for i in pick]
            united = link_sets(sets, percent, [bool(asks[i]) for i in pick] if asked else None)
            found = [(int(nodes[pick[united.root(i)]]), int(nodes[pick[i]])) for i in range(len(pick)) if united.root(i) != i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["_a", "_b"])

    tasks = rows.select("_cluster", "_task", "_set", "_asks", "_path").repartition(max(1, width), "_cluster", "_task").sortWithinPartitions("_cluster", "_task")
    return tasks.mapInArrow(run, "_a long, _b long")


def _verify(paths: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between sets of one cluster, enough to join every component; ``paths``: _cluster, _set, _path.

    First every block of a cluster is compared with itself and block 0.  In a cluster that is not one
    component by then, every set outside its largest component is compared with all sets of the cluster,
    block by block: a link not yet followed has at least one such end.
    """
    # Blocks are bounded by sets and by bytes: sets of very long texts come few at a time.
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES)).cast("long")
    size = F.octet_length("_path").cast("long")
    paths = park(paths)
    counted = park(paths.groupBy("_cluster").agg(blocks(F.count(F.lit(1)), F.sum(size)).alias("_blocks")).select(F.col("_cluster").alias("_c"), "_blocks"))
    width = -(-paths.count() // BLOCK)
    paths = park(paths.join(counted, F.col("_cluster") == F.col("_c")).drop("_c").withColumn("_block", F.pmod(F.xxhash64("_set"), F.col("_blocks"))))
    zero = F.lit(0).cast("long")
    everywhere = F.sequence(zero, F.col("_blocks") - 1)
    own = F.when(F.col("_block") == 0, everywhere).otherwise(F.array("_block"))
    first = park(_compare(paths.select("_cluster", "_set", "_path", F.lit(False).alias("_asks"), F.explode(own).alias("_task")), percent, False, width))
    if not paths.where("_blocks > 1").limit(1).count():
        return first
    roots = components(first, "_a", "_b")
    labelled = paths.where("_blocks > 1").join(roots, F.col("_set") == F.col("_node"), "left").withColumn("_root", F.coalesce("_root", "_set")).drop("_node")
    sizes = labelled.groupBy("_cluster", "_root").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_bytes"))
    over, more = F.sum("_n") - F.max("_n"), F.sum("_bytes") - F.max_by("_bytes", F.struct("_n", "_root"))
    main = sizes.groupBy("_cluster").agg(F.max_by("_root", F.struct("_n", "_root")).alias("_main"), over.alias("_over"), blocks(over, more).alias("_parts")).where("_over > 0")
    main = park(main.select(F.col("_cluster").alias("_c"), "_main", "_parts"))
    open_ = park(labelled.join(main, F.col("_cluster") == F.col("_c")).drop("_c"))
    if not open_.limit(1).count():
        return first
    parts = F.sequence(zero, F.col("_parts") - 1)
    answer = open_.select("_cluster", "_set", "_path", F.lit(False).alias("_asks"), "_blocks", "_block", F.explode(parts).alias("_part"))
    ask = open_.where("_root != _main").select("_cluster", "_set", "_path", F.lit(True).alias("_asks"), "_blocks", F.explode(everywhere).alias("_block"), F.pmod(F.xxhash64("_set", F.lit(3)), F.col("_parts")).alias("_part"))
    tasks = answer.unionByName(ask).withColumn("_task", F.col("_part") * F.col("_blocks") + F.col("_block"))
    return first.union(park(_compare(tasks, percent, True, width)))


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word
    n-grams; A-Z count as a-z and words are split at ASCII white space.  Links are exact up to 64-bit hashes.
    Null and empty texts have empty sets and link with nothing.  Repeated rows share their answer; a null
    id joins no component and has a null component_id.  An empty table gives no rows; other columns
    are ignored.  Copies are one set from the start and are never expanded into pairs.
    """
    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    named = park(_named(read, width))
    clusters = components(_candidates(read, width, percent, held), "_lead", "_set")
    # One document stands for each set; its text is read again to compare the sets.
    stands = named.where("_id IS NOT NULL AND _set IS NOT NULL").groupBy("_set").agg(F.min("_id").alias("_rep"))
    wanted = park(stands.join(clusters, F.col("_set") == F.col("_node")).select("_rep", "_set", F.col("_root").alias("_cluster")))
    # Merged at any size: the texts of a large corpus are shuffled once, and a small one is treated alike.
    again = read.join(wanted.hint("merge"), F.col("_id") == F.col("_rep")).select("_cluster", "_set", "_text")

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(2), width))
            good = [i for i, (s, node) in enumerate(zip(sets, b.column(1).to_pylist(), strict=True)) if len(s) and set_id(s) == node]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good, pa.int64())), b.column(1).take(pa.array(good, pa.int64())), pa.array([sets[i].tobytes() for i in good], pa.binary())], names=["_cluster", "_set", "_path"])

    paths = again.mapInArrow(path, "_cluster long, _set long, _path binary")
    roots = park(components(_verify(paths, percent, block), "_a", "_b"))
    grouped = named.join(roots, F.col("_set") == F.col("_node"), "left").select("_id", "_n", F.coalesce("_root", "_set").alias("_group"))
    # Parked, it is broadcast while small; beyond that a group with very many rows is a skewed join, which Spark splits.
    least = park(grouped.where("_group IS NOT NULL").groupBy(F.col("_group").alias("_g")).agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_g", "_least"))
    out = grouped.join(least, F.col("_group") == F.col("_g"), "left")
    own = F.when(F.col("_id").isNotNull(), F.coalesce("_least", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), own.alias("component_id"))
