"""Trigram postings with places: text search that reads no text but that of its hits.

An index is kept as rows (seq, trigram, block, ids, sizes, places): a block is a list of rows of the corpus, whose texts and names stand one behind
the other, and a row says at which places of that line a trigram stands (as steps from the place before, in
as few bytes as each needs).  The row with an empty trigram has the block's ids, the lengths that BM25 needs as sizes, and how long each text and name is as places.  Rows
of a block are sorted by trigram and written as tasks make them: building shuffles nothing, and Parquet's small pages let a search read the rows of its terms' trigrams only.  A term stands wherever its
trigrams follow each other, so occurrences, document frequencies and scores come from places alone, and are those of the exact predicates.

A long list of terms has nearly all trigrams there are, and texts are smaller than their postings: then the blocks are made from the
texts again, in tasks, and nothing of them is written or shuffled.

Segments are such tables; merging them is a union.  ``seq`` says in which commit a row was
written: a row of the corpus that was replaced or deleted by a later one is passed over (see :func:`visible`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import text_search
from tessera.plans.query import Query
from tessera.plans.together import together

SCHEMA = "seq long, trigram string, block long, ids array<bigint>, sizes array<int>, places binary"
#: Characters and rows that a block gathers before it is written.
CHARACTERS, ROWS = 1 << 21, 1 << 14
#: Counts of rows and terms that are looked at together, and numbers that are packed together: some megabytes, however short the rows and many the terms.
CELLS = 1 << 20
#: Rows of an Arrow batch that become Python's at once.
SLICE = 64
#: Rows whose texts are named one by one where they are read; more are joined.  Matches that are broadcast: a few dozen megabytes.
NAMED, BROADCAST = 10_000, 200_000
#: Trigrams beyond which texts are read instead of postings.
MANY = 2_000


class TextIndex(NamedTuple):
    """Postings of a corpus, what of them is out of date (id, seq; None: nothing), and the corpus's number of rows and mean length."""

    postings: DataFrame
    gone: DataFrame | None
    n: int
    mean: float


def _length() -> Column:
    """Characters of text and name less two each, as BM25 counts them."""
    part = lambda c: F.greatest(F.length(F.coalesce(c, F.lit(""))) - 2, F.lit(0))
    return (part("text") + part("name")).cast("int")


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number's begin and the last one's end): seven bits a byte, low ones first, the highest bit says that more follow."""
    size = np.ones(len(numbers), np.uint8)
    for k in (7, 14, 21, 28):
        size += numbers >= 1 << k
    cuts = np.r_[0, np.cumsum(size, dtype=np.int64)]
    out = np.zeros(cuts[-1], np.uint8)
    for i in range(0, len(numbers), CELLS >> 2):
        v, own, start = numbers[i : i + (CELLS >> 2)], size[i : i + (CELLS >> 2)], cuts[i : i + (CELLS >> 2)]
        for k in range(5):
            more = np.flatnonzero(own > k)
            out[start[more] + k] = v[more] >> 7 * k & 127 | 128 * (own[more] > k + 1)
    return out, cuts


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The numbers that :func:`packed` made bytes of."""
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1]
    shift = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * shift, first)


class _Line(NamedTuple):
    """A block's texts and names one behind the other: ids and lengths of its rows, units' sizes, distinct trigrams as numbers, where each one's places begin, places."""

    ids: np.ndarray
    length: np.ndarray
    size: np.ndarray
    names: np.ndarray
    lead: np.ndarray
    at: np.ndarray


def _line(held: list[tuple]) -> _Line:
    """``held``: (id, length, folded text, folded name)."""
    held.sort(key=lambda r: r[0])
    size = np.array([len(t) for r in held for t in r[2:]], np.int32)
    point = np.frombuffer("".join(t for r in held for t in r[2:]).encode("utf-32-le", "surrogatepass"), np.uint32)
    whole, ends = np.ones(len(point), bool), np.cumsum(size, dtype=np.int64)
    whole[ends[size > 0] - 1] = whole[ends[size > 1] - 2] = False
    at = np.flatnonzero(whole).astype(np.int32)
    del whole
    # Characters by their places among the block's own: few bits, so that a trigram and its place are one number, sorted where it stands.
    seen = np.zeros(int(point.max(initial=0)) + 1, bool)
    seen[point] = True
    letters = np.flatnonzero(seen).astype(np.uint64)
    of = np.cumsum(seen, dtype=np.uint32) - np.uint32(1)
    bits, low = max(len(letters) - 1, 1).bit_length(), max(len(point), 1).bit_length()
    packs = 3 * bits + low <= 64
    code = np.zeros(len(at), np.uint64)
    for j in range(3):
        code <<= np.uint64(bits)
        code |= of[point[at + np.int32(j)]]
    if packs:
        code <<= np.uint64(low)
        code |= at.view(np.uint32)
        code.sort()
        at = (code & np.uint64((1 << low) - 1)).astype(np.int32)
        code >>= np.uint64(low)
    else:
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
    lead = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    first = code[lead]
    names = np.zeros(len(lead), np.uint64)
    for j in (2, 1, 0):
        names = names << np.uint64(21) | letters[(first >> np.uint64(j * bits) & np.uint64((1 << bits) - 1)).astype(np.int64)]
    return _Line(np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int32), size, names, np.r_[lead, len(code)], at)


def _block(held: list[tuple]) -> pa.RecordBatch:
    """The rows of one block."""
    b = _line(held)
    block = int.from_bytes(hashlib.md5(b.ids.tobytes()).digest()[:8], "little", signed=True)
    letters = np.stack([b.names >> np.uint64(s) & np.uint64(0x1FFFFF) for s in (42, 21, 0)], axis=1).astype("<u4")
    trigrams = [r.tobytes().decode("utf-32-le", "surrogatepass") for r in letters]
    step = np.diff(b.at, prepend=b.at[:1]).astype(np.int32)
    step[b.lead[:-1]] = b.at[b.lead[:-1]]
    lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))
    own = np.r_[0, np.full(len(trigrams) + 1, len(b.ids))]
    cols = [pa.array(["", *trigrams], pa.string()), pa.array(np.full(len(trigrams) + 1, block, np.int64)), lists(own, b.ids), lists(own, b.length)]
    raw, cuts = packed(np.r_[b.size, step])
    cuts = cuts[np.r_[0, b.lead + len(b.size)]].astype(np.int32)
    cols.append(pa.Array.from_buffers(pa.binary(), len(trigrams) + 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]))
    return pa.RecordBatch.from_arrays(cols, names=["trigram", "block", "ids", "sizes", "places"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of a task (id, length, folded text, folded name), a block at a time."""
    held: list[tuple] = []
    n = 0
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            for r in zip(*(c.to_pylist() for c in b.slice(i, SLICE).columns), strict=True):
                held.append(r)
                n += len(r[2]) + len(r[3])
                if n > CHARACTERS or len(held) >= ROWS:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def _read(corpus: DataFrame) -> DataFrame:
    fold = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return corpus.select(F.col("id").cast("long"), _length().alias("length"), fold("text").alias("_text"), fold("name").alias("_name"))


def build(corpus: DataFrame, seq: int = 0) -> DataFrame:
    """The postings of a corpus (id, text, name), block by block; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            yield _block(held)

    made = _read(corpus).mapInArrow(run, "trigram string, block long, ids array<bigint>, sizes array<int>, places binary")
    return made.select(F.lit(seq).cast("long").alias("seq"), "*")


def merge(*segments: DataFrame) -> DataFrame:
    """One segment of several, in the order of trigrams."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return out.repartitionByRange("trigram", "block").sortWithinPartitions("trigram", "block")


def statistics(postings: DataFrame, gone: DataFrame | None = None) -> tuple[int, int]:
    """(number of rows, sum of their lengths), from the lists of ids alone."""
    row = visible(listed(postings), gone).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("s")).first()
    return row["n"], row["s"] or 0


def listed(postings: DataFrame) -> DataFrame:
    """(seq, id, length) of all rows of the corpus that the postings hold."""
    pairs = postings.where("trigram = ''").select("seq", F.explode(F.arrays_zip("ids", "sizes")).alias("_p"))
    return pairs.select("seq", F.col("_p.ids").alias("id"), F.col("_p.sizes").alias("length"))


def visible(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows (seq, id, ...) that no later commit replaced or deleted; ``gone``: id, seq, one row for an id."""
    if gone is None:
        return rows
    return rows.join(gone.select(F.col("id").alias("_gone"), F.col("seq").alias("_until")), F.col("id") == F.col("_gone"), "left").where("_until IS NULL OR seq >= _until").drop("_gone", "_until")


def open_index(postings: DataFrame, gone: DataFrame | None = None) -> TextIndex:
    n, total = statistics(postings, gone)
    return TextIndex(postings, gone, n, total / n if n else 0.0)


def _code(trigram: str) -> int:
    return ord(trigram[0]) << 42 | ord(trigram[1]) << 21 | ord(trigram[2])


def trigrams_of(term: str) -> list[str]:
    low = term.lower()
    return [low[i : i + 3] for i in range(len(low) - 2)]


def _follow(keys: dict[str, np.ndarray], grams: list[str]) -> np.ndarray:
    """Where the trigrams follow each other; from the rarest trigram on.  No text has trigrams that reach into the next, so neither do terms."""
    order = sorted(range(len(grams)), key=lambda j: len(keys.get(grams[j], ())))
    out = keys.get(grams[order[0]], np.zeros(0, np.int64)) - order[0]
    for j in order[1:]:
        if not len(out):
            break
        there = keys[grams[j]]
        at = np.minimum(np.searchsorted(there, out + j), len(there) - 1)
        out = out[there[at] == out + j]
    return out


def _answered(index: TextIndex, terms: list[str], emit: Callable[..., Iterator[pa.RecordBatch]], schema: str, corpus: DataFrame | None = None) -> DataFrame:
    """What ``emit`` makes of each block, some rows at a time: seq, ids, lengths, and counts by row and term.  One read of the terms' trigrams; blocks come whole.

    With a ``corpus`` (see :func:`scanned`) its texts are read instead; no row of it is out of date.
    """
    asked = [trigrams_of(t) for t in terms]
    needed = sorted({g for grams in asked for g in grams})

    def counted(seq: int, ids: np.ndarray, length: np.ndarray, size: np.ndarray, keys: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A row is a text and a name.  Cells of rows and terms are numbered; those that have an occurrence are counted for CELLS at a time."""
        ends = np.cumsum(size.reshape(-1, 2).sum(axis=1))
        there = ((i, _follow(keys, grams)) for i, grams in enumerate(asked))
        cell = np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(ends, at, "right") * len(asked) + i for i, at in there if len(at))])
        cell.sort()
        step = max(1, CELLS // len(asked))
        for i in range(0, len(ids), step):
            n = min(step, len(ids) - i)
            a, b = np.searchsorted(cell, [i * len(asked), (i + n) * len(asked)])
            if a < b:
                counts = np.bincount(cell[a:b] - i * len(asked), minlength=n * len(asked)).astype(np.int32).reshape(n, -1)
                yield from emit(seq, ids[i : i + n], length[i : i + n], counts)

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        names = t.column("trigram").to_pylist()
        if names[0] != "" or len(names) < 2:
            return
        ids, length = (t.column(c)[0].values.to_numpy() for c in ("ids", "sizes"))
        steps = [unpacked(np.frombuffer(x.as_buffer(), np.uint8)) for x in t.column("places")]
        keys = {g: np.cumsum(steps[i]) for i, g in enumerate(names[1:], 1)}
        yield from counted(t.column("seq")[0].as_py(), ids, length.astype(np.int32), steps[0], keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.array([_code(g) for g in needed], np.uint64)
        for held in _gathered(batches):
            b = _line(held)
            place = np.searchsorted(b.names, codes)
            there = np.flatnonzero(place < len(b.names))
            there = there[b.names[place[there]] == codes[there]]
            if len(there):
                keys = {needed[i]: b.at[b.lead[place[i]] : b.lead[place[i] + 1]] for i in there}
                yield from counted(0, b.ids, b.length, b.size, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(i).to_numpy() for i in (0, 2)])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if key != (own := tuple(at[:, i].tolist())):
                    if held:
                        yield from answer(held)
                    key, held = own, []
                held.append(b.slice(i, j - i))
        if held:
            yield from answer(held)

    if corpus is not None:
        return _read(corpus).mapInArrow(scan, schema)
    read = index.postings.where(F.col("trigram").isin("", *needed)).repartition("seq", "block").sortWithinPartitions("seq", "block", "trigram")
    return read.mapInArrow(run, schema)


def scanned(corpus: DataFrame, terms: list[str]) -> DataFrame | None:
    """The corpus, if the terms have so many trigrams that its texts are read rather than their postings."""
    return corpus if len({g for t in terms for g in trigrams_of(t)}) > MANY else None


def number_lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists of longs."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.astype(np.int64).ravel()))


def matches(index: TextIndex, terms: list[str], emit: Callable[..., Iterator[pa.RecordBatch]], schema: str, corpus: DataFrame | None = None) -> DataFrame:
    """What ``emit`` makes of the rows that are not out of date; ``schema`` has an id."""
    found = _answered(index, terms, emit, f"seq long, {schema}", corpus)
    return (found if corpus is not None else visible(found, index.gone)).drop("seq")


def term_counts(index: TextIndex, terms: list[str], corpus: DataFrame | None = None) -> DataFrame:
    """(id, length, counts): how often each of the terms, of three characters or more, stands in the rows that have any of them."""

    def emit(seq, ids, length, counts):
        at = np.flatnonzero(counts.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), seq, np.int64)), pa.array(ids[at]), pa.array(length[at]), number_lists(counts[at])], names=["seq", "id", "length", "counts"])

    return matches(index, terms, emit, "id long, length int, counts array<bigint>", corpus)


def document_frequencies(index: TextIndex, terms: list[str], corpus: DataFrame | None = None) -> dict[str, int]:
    """In how many rows each of the terms stands; sums come from each block, and from rows where some are out of date."""

    def sums(seq, ids, length, counts):
        n = np.count_nonzero(counts, axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    def rows(seq, ids, length, counts):
        at, term = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), seq, np.int64)), pa.array(ids[at]), pa.array(term)], names=["seq", "id", "term"])

    if not terms:
        return {}
    if index.gone is None or corpus is not None:
        found = _answered(index, terms, sums, "term long, n long", corpus).groupBy("term").agg(F.sum("n").alias("n"))
    else:
        found = matches(index, terms, rows, "id long, term long").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    own = {r["term"]: r["n"] for r in found.collect()}
    return {t: own.get(i, 0) for i, t in enumerate(terms)}


def _has(i: int) -> Column:
    return F.col("counts")[i] > 0


def _survivors(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the corpus with these ids; few are named, so that Parquet reads their pages only."""
    named = [r["id"] for r in ids.select("id").limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        return corpus.where(F.col("id").isin(*named)) if named else corpus.limit(0)
    return corpus.join(ids.select("id"), "id", "left_semi")


def matching(corpus: DataFrame, index: TextIndex, query: Query) -> DataFrame:
    """Rows of the corpus that hold all terms of a query, short ones included; only rows that hold the long ones are read."""
    terms = query.long_terms
    if any(len(t) < 3 for t in terms):
        return corpus.limit(0)
    if not terms:
        return corpus.where(text_search.term_filter(query))
    found = term_counts(index, terms)
    for i in range(len(terms)):
        found = found.where(_has(i))
    rows = corpus.join(found.select("id"), "id", "left_semi") if not query.short_terms else _survivors(corpus, found)
    return rows.where(text_search.term_filter(Query(query.short_terms)))


def indexed_hits(corpus: DataFrame, index: TextIndex, query: Query, limit: int, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(text hits, those in which the terms stand as one phrase) as :func:`tessera.operators.text_search.hits_and_exact` gives them.

    Columns are pos, id, source, mtime, score, matched_text.  Document frequencies of terms and phrase come from one read of
    their postings, which is kept for both rankings.  Of the corpus only id, source and mtime are read, and the
    texts of rows with all long terms where there are short ones.  Without ``exact`` the phrase is not looked for, and the second is empty.
    """
    terms = query.long_terms
    if limit <= 0 or not terms or any(len(t) < 3 for t in terms):
        return tuple(h.drop("snippet") for h in text_search.hits_and_exact(corpus, query, limit))
    several = exact and len(query.terms) > 1
    phrase = text_search.phrase_query(query).long_terms if several else []
    counts = term_counts(index, [*terms, *[p for p in phrase if len(p) >= 3]]).persist()
    width = len(terms) + len([p for p in phrase if len(p) >= 3])
    long = reduce(lambda a, b: a & b, [_has(i) for i in range(len(terms))])
    row = counts.agg(*[F.count_if(_has(i)).alias(f"n{i}") for i in range(width)], F.count_if(long).alias("hits")).first()
    stats = {"n": index.n, "avg": index.mean, "df": [row[f"n{i}"] for i in range(width)]}

    def ranked(places: list[int], short: list[str]) -> DataFrame:
        kept = counts
        for i in places:
            kept = kept.where(_has(i))
        rows = corpus
        if short:
            rows = _survivors(corpus, kept).where(text_search.term_filter(Query(short)))
        rows = rows.where(text_search.date_filter(query))
        if query.source:
            rows = rows.where(text_search.source_like(query.source))
        score = text_search.bm25_of([F.col("counts")[i] for i in places], F.col("length"), {**stats, "df": [stats["df"][i] for i in places]})
        # Their number is known: few are broadcast, so that nothing of the corpus is shuffled.
        met = row["hits"] if len(places) == len(terms) else row[f"n{places[0]}"]
        scored = rows.select("id", "source", "mtime").join(F.broadcast(kept) if met <= BROADCAST else kept, "id").select("id", "source", "mtime", F.round(score, 9).alias("score"))
        top = scored.orderBy("score", F.desc("mtime"), "id").limit(limit)
        place = F.row_number().over(Window.orderBy("score", F.desc("mtime"), "id"))  # over the top-k only
        return text_search.settle(top.select(place.alias("pos"), "id", "source", "mtime", "score", F.lit(True).alias("matched_text")))

    jobs = [lambda: ranked(list(range(len(terms))), query.short_terms)]
    if width > len(terms):
        jobs.append(lambda: {r["id"] for r in ranked([width - 1], []).select("id").collect()})
    hits, *own = together(corpus.sparkSession, *jobs)
    counts.unpersist()
    if exact and not several:
        return hits, hits
    return hits, hits.where(F.col("id").isin(*own[0])) if own and own[0] else hits.limit(0)


def indexed_search(corpus: DataFrame, index: TextIndex, query: Query, limit: int = 60) -> DataFrame:
    """The rows of :func:`tessera.operators.text_search.text_search`, snippets included, whose texts are all that is read."""
    hits = indexed_hits(corpus, index, query, limit, exact=False)[0]
    ids = [r["id"] for r in hits.select("id").collect()]
    texts = corpus.where(F.col("id").isin(*ids)) if ids else corpus.limit(0)
    snippet = T.snippet(F.col("text"), query.long_terms[0] if query.long_terms else None)
    return hits.join(texts.select("id", snippet.alias("snippet")), "id").select("pos", "id", "source", "mtime", "score", "snippet", "matched_text")
