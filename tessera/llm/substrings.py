"""Substring dedup: words of long passages that a document with a smaller id has, too, go.

A sparse suffix tree, divided by prefixes.  Not every suffix is a leaf, only those that begin at an
anchor: every window of ``width`` words has one, the least of its runs of ``half`` words by hash.  Equal
windows have equal anchors at equal places, so a repeat of ``width`` words always holds a common anchor.

1. Which suffixes can meet: an anchor must stand in two texts.  Anchors are thinly spread (two in
   ``width`` / 2 + 2 words), and finding shared ones is one narrow shuffle.
2. Suffixes are grouped by their prefix.  A count pass sizes the groups: a prefix of ``half`` words (the
   anchor) is enough where its group fits in memory; the prefixes of larger groups are lengthened to all
   ``width`` words of a window, and those groups are read as streams.
3. A group is a subtree.  Its suffixes come in order of their words, neighbours' common prefixes are its
   internal nodes, and the words to the left of the anchor extend a node's leaves.  A node of depth d whose
   leaves agree in ``width`` - d words to the left is a repeat of ``width`` words; all such repeats of a leaf
   together, one row for each leaf, are its maximal repeat around this anchor.

Before either shuffle a task settles what it can see itself: an anchor in two of its own texts is shared,
and a window that two of its documents have is a repeat in the larger one.  A window goes on once per
task and text, so neither a passage in a third of all documents nor a line that one document repeats
without end is a hot key.  Equal windows of one document are found again by their hash when it is cut.

Copies of a whole document never enter the trees: the one with the smallest id stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, mix, sequence_hash, slices, windows
from .store import park

WIDTH = 50
#: Leaves of a subtree that is built as one; beyond that its prefixes are lengthened, so that no prefix is a hot key.
LEAVES = 512
#: A null id ranks after all others.
LAST = (1 << 63) - 1
U = np.uint64


def half_of(width: int) -> int:
    """Words of an anchor: half the width, and more only where the offsets of a window would not fit in 62 bits."""
    return max(1, width // 2, width - 61)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def word_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, first bytes, last bytes, bytes) of each text's words."""
    for i, j, data, offsets in slices(column):
        w = Words(data, offsets)
        h, at = w.hashes(), w.bounds
        for r in range(j - i):
            own = slice(at[r], at[r + 1])
            yield h[own], w.start[own], w.end[own], data


def anchors(runs: np.ndarray, span: int) -> np.ndarray:
    """For each window the place of its anchor, the first of the least of its ``span`` runs; never decreasing."""
    return np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(len(runs) - span + 1)


def kept_text(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept words joined by one space."""
    raw = data.tobytes()
    return b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])


def _sha(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> str:
    if not len(starts):
        return hashlib.sha256(b"").hexdigest()
    low, high = int(starts[0]), int(ends[-1])
    return hashlib.sha256(kept_text(starts - low, ends - low, data[low:high], np.ones(len(starts), bool))).hexdigest()


def covered(hashes: np.ndarray, places: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a repeated window: those that begin bit b before an anchor's place, and all equal ones."""
    n = len(hashes)
    starts = np.concatenate([places[(bits >> b & 1) > 0] - b for b in range(width - half_of(width) + 1)])
    own = windows(hashes, width)
    starts = np.flatnonzero(np.isin(own, own[np.unique(starts[(starts >= 0) & (starts <= n - width)])]))
    step = np.zeros(n + 1, np.int32)
    step[starts] += 1
    step[starts + width] -= 1
    return np.cumsum(step[:n]) > 0


def _named(read: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, s, e, data in word_rows(b.column(2)):
                one, two = sequence_hash(h)
                rows.append((len(h), _signed(one), _signed(two), _sha(s, e, data)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["_id", "_raw", "_n", "_h1", "_h2", "_sha"])

    return read.mapInArrow(run, "_id long, _raw long, _n long, _h1 long, _h2 long, _sha string")


def _marks(read: DataFrame, width: int) -> DataFrame:
    """(_anchor, _unit, _place): the distinct anchors of each text, a text being named by 64 bits of its words; parked.

    Where a task's own texts share an anchor, their rows come with a null anchor: settled.  Two rows with
    place -1 then stand for them before the others.  A task holds its anchors, 20 bytes for 13 words.
    Texts with one name share their places, which then are candidates that come to nothing.
    """
    half = half_of(width)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
        for b in batches:
            for h, _, _, _ in word_rows(b.column(2)):
                if len(h) < width or (unit := _signed(sequence_hash(h)[0])) in seen:
                    continue
                seen.add(unit)
                runs = windows(h, half)
                at = anchors(runs, width - half + 1)
                at = at[np.r_[True, at[1:] != at[:-1]]]
                names, first = np.unique(runs[at], return_index=True)
                for c, x in zip(out, (names.view(np.int64), np.full(len(names), unit, np.int64), at[first].astype(np.int32)), strict=True):
                    c.append(x)
        anchor, unit, place = (np.concatenate(c) for c in out)
        order = np.lexsort((unit, anchor))
        anchor, unit, place = anchor[order], unit[order], place[order]
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
        long = np.diff(np.r_[first, len(anchor)])
        last = first + long - 1
        both = unit[first] != unit[last]
        settled = np.repeat(both, long)
        ends = np.concatenate([first[both], last[both]])
        yield from parts(anchor[ends], unit[ends], np.full(len(ends), -1, np.int32))
        yield from parts(anchor[~settled], unit[~settled], place[~settled])
        yield from parts(None, unit[settled], place[settled])

    def parts(anchor: np.ndarray | None, unit: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(unit), 100_000):
            j = min(i + 100_000, len(unit))
            named = pa.nulls(j - i, pa.int64()) if anchor is None else pa.array(anchor[i:j])
            yield pa.RecordBatch.from_arrays([named, pa.array(unit[i:j]), pa.array(place[i:j])], names=["_anchor", "_unit", "_place"])

    return park(read.mapInArrow(send, "_anchor long, _unit long, _place int"))


def _shared_places(marks: DataFrame) -> DataFrame:
    """(_unit, _place): anchors that stand in two different texts."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of anchors with two units; what is held back is one text's, a row for each task that read it."""
        anchor = unit = None
        held: list[pa.RecordBatch] = []
        many = False
        for b in batches:
            a, u = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(a):
                continue
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            new[0] = a[0] != anchor
            group = np.cumsum(new)
            first = np.flatnonzero(new)
            lead = np.concatenate([[u[0] if unit is None else unit], u[first]])[group]
            other = np.bincount(group, u != lead, minlength=group[-1] + 1) > 0
            if not new[0]:
                if many or other[0]:
                    yield from held
                    held, many, other[0] = [], True, True
            keep = other[group]
            if keep.any():
                yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(keep)), b.column(2).filter(pa.array(keep))], names=["_unit", "_place"])
            last = group == group[-1]
            if new.any():
                held, many = [], False
            many = many or bool(other[group[-1]])
            if not many:
                held.append(pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(last)), b.column(2).filter(pa.array(last))], names=["_unit", "_place"]))
            anchor, unit = a[-1], lead[-1]

    routed = marks.where("_anchor IS NOT NULL").repartition("_anchor").sortWithinPartitions("_anchor", "_unit")
    settled = marks.where("_anchor IS NULL").select("_unit", "_place")
    return settled.union(routed.mapInArrow(shared, "_unit long, _place int").where("_place >= 0"))


LEAF = "_anchor long, _rep long, _unit long, _place int, _mask long, _left binary, _right binary"
FOUND = "_rep long, _unit long, _place int, _bits long"


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of words as binary values whose order is that of the words."""
    data = np.ascontiguousarray(x.astype(">u4"))
    width = data.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def _words(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), n).astype(np.uint32)


def _leaves(texts: DataFrame, width: int) -> DataFrame:
    """Suffixes at shared anchors, with the words around them; ``texts``: _rep, _unit, _places, _text; parked.

    ``_mask`` has bit b for the window that begins b words before the anchor.  Windows that a smaller
    document of the same task has come as rows without an anchor: settled as repeats.  Of equal windows
    of one text the first stands for all.
    """
    half = half_of(width)
    more = width - half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, seen = [], 0, set()
        for b in batches:
            reps, units, places = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            for i, (h, _, _, _) in enumerate(word_rows(b.column(3))):
                if len(h) < width or (reps[i], units[i]) in seen:
                    continue
                seen.add((reps[i], units[i]))
                runs = windows(h, half)
                at = anchors(runs, more + 1)
                new = np.r_[True, at[1:] != at[:-1]]
                known = places[i].values.to_numpy()
                live = np.isin(runs[at[new]], runs[known[known < len(runs)]])
                start = np.flatnonzero(live[np.cumsum(new) - 1])
                if not len(start):
                    continue
                held.append((reps[i], units[i], h, start, at[start], windows(h, width)[start], runs[at[start]]))
                words += len(h) + 4 * len(start)
                if words > 4_000_000:
                    yield from settle(held)
                    held, words = [], 0
        if held:
            yield from settle(held)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """At most some 100 MB of windows, or one text's, sorted by hash and document: all but the smallest document's are repeats."""
        rep, unit = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        base = np.concatenate([[0], np.cumsum([len(x[2]) for x in held])])
        code = (np.concatenate([x[2] for x in held]) >> U(32)).astype(np.uint32)
        which = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
        start, at, name, anchor = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5, 6))
        order = np.lexsort((start, which, rep[which], name))
        name, text = name[order], which[order]
        first = np.r_[True, name[1:] != name[:-1]]
        again = rep[text] > rep[text][np.flatnonzero(first)[np.cumsum(first) - 1]]
        once = first | np.r_[True, text[1:] != text[:-1]]
        yield from leaves(rep, unit, base, code, which, start, at, anchor, order[again & once], True)
        yield from leaves(rep, unit, base, code, which, start, at, anchor, order[~again & once], False)

    def leaves(rep, unit, base, code, which, start, at, anchor, pick, settled) -> Iterator[pa.RecordBatch]:
        pick = np.sort(pick)
        text, place = which[pick], at[pick]
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (place[1:] != place[:-1])][: len(pick)])
        mask = np.bitwise_or.reduceat(np.int64(1) << (place - start[pick]), new) if len(new) else np.zeros(0, np.int64)
        far, near = (place - start[pick])[new], (place - start[pick])[np.r_[new[1:], len(pick)] - 1] if len(new) else new
        text, place, anchor = text[new], place[new], anchor[pick][new]
        for i in range(0, len(new), 16_384):
            own = slice(i, i + 16_384)
            t, p, n = text[own], place[own], len(text[own])
            cols = [pa.nulls(n, pa.int64()) if settled else pa.array(anchor[own].view(np.int64)), pa.array(rep[t]), pa.array(unit[t]), pa.array(p.astype(np.int32)), pa.array(mask[own])]
            if settled:
                cols += [pa.nulls(n, pa.binary())] * 2
            else:
                # Only the words that a window of this leaf needs; the rest is 0.
                k = np.arange(more)
                left = np.where(k < far[own][:, None], code[np.maximum((base[t] + p)[:, None] - 1 - k, 0)], 0) if more else np.zeros((n, 0))
                right = np.where(k < more - near[own][:, None], code[np.minimum((base[t] + p + half)[:, None] + k, len(code) - 1)], 0) if more else left
                cols += [_fixed(left), _fixed(right)]
            yield pa.RecordBatch.from_arrays(cols, names=["_anchor", "_rep", "_unit", "_place", "_mask", "_left", "_right"])

    return park(texts.mapInArrow(run, LEAF))


def left_names(left: np.ndarray, salt: int = 0) -> list[np.ndarray]:
    """For 0, 1, 2 ... words to the left of each row's anchor: their hash."""
    out = [np.full(len(left), mix(np.array([salt + 1], U))[0], U)]
    for k in range(left.shape[1]):
        out.append(mix(out[-1] * U(0x9E3779B97F4A7C15) + left[:, k].astype(U) + U(1)))
    return out


def repeats(group: np.ndarray, rep: np.ndarray, mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each leaf the windows (bits of ``mask``) that a leaf of a smaller document has, too.

    Leaves come by group and, in it, by their words to the right.  ``common`` holds the words that
    neighbours share beyond the anchor: the depths of the subtree's internal nodes.  Cut at the depth
    that a window needs, the tree falls into nodes; leaves of one node with the same words to the left have the same window.
    """
    more = right.shape[1]
    equal = right[1:] == right[:-1]
    common = np.where(equal.all(axis=1), more, equal.argmin(axis=1)) if more else np.zeros(len(group) - 1, np.int64)
    common[group[1:] != group[:-1]] = -1
    out = np.zeros(len(group), np.int64)
    for b, name in enumerate(left_names(left)):
        rows = np.flatnonzero(mask >> b & 1)
        if len(rows) < 2:
            continue
        node = np.r_[0, np.cumsum(common < more - b)][rows]
        order = np.lexsort((rep[rows], name[rows], node))
        node, own = node[order], name[rows][order]
        first = np.r_[True, (node[1:] != node[:-1]) | (own[1:] != own[:-1])]
        least = rep[rows][order][np.flatnonzero(first)[np.cumsum(first) - 1]]
        again = rows[order][rep[rows][order] > least]
        out[again] |= np.int64(1) << b
    return out


def _subtrees(leaves: DataFrame, width: int) -> DataFrame:
    """Maximal repeats of leaves whose groups fit in memory: (_rep, _unit, _place, _bits)."""
    more = width - half_of(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > 4 * LEAVES:
                t = pa.Table.from_batches(held)
                anchor = t.column(0).to_numpy()
                # All but the last group, which may go on.
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield build(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                n -= cut
        if n:
            yield build(pa.Table.from_batches(held))

    def build(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        group, rep, mask = (t.column(c).to_numpy() for c in ("_anchor", "_rep", "_mask"))
        bits = repeats(group, rep, mask, *(_words(t.column(c).chunk(0), more) for c in ("_left", "_right")))
        hit = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([*[pa.array(t.column(c).to_numpy()[hit]) for c in ("_rep", "_unit", "_place")], pa.array(bits[hit])], names=["_rep", "_unit", "_place", "_bits"])

    return leaves.repartition("_anchor").sortWithinPartitions("_anchor", "_right").mapInArrow(run, FOUND)


def _long_prefixes(leaves: DataFrame, width: int) -> DataFrame:
    """The same for the leaves of larger groups, by prefixes as long as a window: each group is a stream, whatever its size."""
    more = width - half_of(width)

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, mask = b.column(0).to_numpy().view(U), b.column(4).to_numpy()
            left, right = (_words(b.column(i), more) for i in (5, 6))
            # The words to the right from the anchor on, named as the ones to the left are.
            names = [(left_names(left, s), left_names(right, s + 2)) for s in (0, 1)]
            for bit in range(more + 1):
                rows = np.flatnonzero(mask >> bit & 1)
                if len(rows):
                    keys = [mix(x[bit][rows] * U(3) + mix(y[more - bit][rows]) + mix(anchor[rows]) * U(5) + U(bit)).view(np.int64) for x, y in names]
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*[pa.array(k) for k in keys], *[b.column(i).take(at) for i in (1, 2, 3)], pa.array(np.full(len(rows), 1 << bit, np.int64))], names=["_p1", "_p2", "_rep", "_unit", "_place", "_bits"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, least = None, 0
        for b in batches:
            p, q, rep = (b.column(i).to_numpy() for i in range(3))
            if not len(rep):
                continue
            new = np.ones(len(rep), bool)
            new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            new[0] = path != (int(p[0]), int(q[0]))
            first = np.concatenate([[least], rep[new]])[np.cumsum(new)]
            path, least = (int(p[-1]), int(q[-1])), first[-1]
            again = pa.array(rep > first)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(again) for i in (2, 3, 4, 5)], names=["_rep", "_unit", "_place", "_bits"])

    long = leaves.mapInArrow(lengthen, "_p1 long, _p2 long, " + FOUND)
    return long.repartition("_p1", "_p2").sortWithinPartitions("_p1", "_p2", "_rep").mapInArrow(walk, FOUND)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, texts: bool = False, leaves: int = LEAVES) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (and kept_text if ``texts``, null where nothing was removed).

    A word goes if it lies in a window of ``width`` consecutive words whose sequence also starts in a
    document with a smaller id; windows are judged on the input.  Words are split at ASCII white space and
    compared as they are: whole texts by hashes of 128 bits, windows within a task by 64, in a subtree by 32 bits a word
    and 64 for the anchor, in the groups of long prefixes by 128.  Null and empty texts have no
    words.  Rows that repeat an id and a text share their answer and don't count against each other; an id
    with several texts has each of them judged against the texts of smaller ids.  A null id ranks after all
    others: its rows lose what any document with an id has, and nothing is lost to them.  An empty table
    gives no rows; other columns are ignored.
    """
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    body = F.col(text).cast("string")
    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("_raw"), body.alias("_text"))
    named = park(_named(read))
    # One row's text stands for each sequence of words; it is found again by its id and a hash.
    units = named.groupBy("_h1", "_h2").agg(F.min(F.struct(F.coalesce("_id", F.lit(LAST)).alias("_rep"), F.col("_raw").alias("_rawrep"))).alias("_s"))
    # Parked: it is read three times, and a text with very many copies is then a skewed join, which Spark splits.
    units = park(units.select("_h1", "_h2", "_s._rep", "_s._rawrep"))
    places = park(_shared_places(_marks(read, width)).groupBy("_unit").agg(F.collect_set("_place").alias("_places")))
    wanted = places.join(units, F.col("_unit") == F.col("_h1")).select("_unit", "_rep", "_rawrep", "_places")
    ranked = docs.select(rank.alias("_rank"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("_raw"), body.alias("_text"))
    found = ranked.join(wanted, (F.col("_rank") == F.col("_rep")) & (F.col("_raw") == F.col("_rawrep"))).select("_rep", "_unit", "_places", "_text")
    all_leaves = _leaves(found, width)
    open_ = all_leaves.where("_anchor IS NOT NULL")
    large = park(open_.groupBy(F.col("_anchor").alias("_large")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > leaves).select("_large"))
    on = F.col("_anchor") == F.col("_large")
    hits = all_leaves.where("_anchor IS NULL").select("_rep", "_unit", "_place", F.col("_mask").alias("_bits"))
    hits = hits.union(_subtrees(open_.join(large, on, "left_anti"), width)).union(_long_prefixes(open_.join(large, on, "left_semi"), width))
    gone = park(hits.groupBy("_rep", "_unit").agg(F.collect_list("_place").alias("_places"), F.collect_list("_bits").alias("_bits")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (h, s, e, data) in enumerate(word_rows(b.column(4))):
                out = covered(h, *[b.column(k)[i].values.to_numpy() for k in (2, 3)], width)
                kept = kept_text(s - s[0], e - s[0], data[s[0] : e[-1]], ~out)
                rows.append((int(out.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["_d", "_u", "_gone", "_kept", "_left"])

    reps = units.select(F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), F.col("_rep"), "_rawrep")
    again = gone.join(units.select("_h1", F.col("_rep").alias("_r"), "_rawrep"), (F.col("_unit") == F.col("_h1")) & (F.col("_rep") == F.col("_r"))).select("_rep", "_unit", "_places", "_bits", "_rawrep")
    held = ranked.join(again, (F.col("_rank") == F.col("_rep")) & (F.col("_raw") == F.col("_rawrep"))).select("_rep", "_unit", "_places", "_bits", "_text")
    # Parked for the same reason as the names: the copies of one text all ask for one answer.
    changed = park(held.mapInArrow(cut, "_d long, _u long, _gone long, _kept string, _left string").dropDuplicates(["_d", "_u"]))
    out = named.join(reps, (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))).join(changed, (F.col("_rep") == F.col("_d")) & (F.col("_h1") == F.col("_u")), "left")
    copy = (F.col("_n") >= width) & (F.coalesce("_id", F.lit(LAST)) > F.col("_rep"))
    some = F.col("_gone").isNotNull()
    removed = F.when(copy, F.col("_n")).when(some, F.col("_gone")).otherwise(F.lit(0))
    kept = F.when(copy, F.sha2(F.lit(""), 256)).when(some, F.col("_kept")).otherwise(F.col("_sha"))
    more = [F.when(copy, F.lit("")).when(some, F.col("_left")).alias("kept_text")] if texts else []
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), removed.alias("n_removed"), kept.alias("kept_sha256"), *more)
