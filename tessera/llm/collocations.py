"""Phrases whose words keep company, by suffix sorting.

1. One narrow pass counts words in 2**BUCKETS buckets by hash (and all words of a language).  A word whose bucket
   stays below ``least`` is in no phrase that counts, so suffixes end before it; first words of heavy buckets
   are the ones whose suffixes get dealt out in parts.
2. Each place in a piece of text gives its suffix, cut to ``longest`` words.  Tasks add up equal suffixes and shuffle them by language
   and first word; suffixes of heavy first words are dealt out by the words that follow as well.
3. A partition is sorted in reverse order of the words and read once.  The words that a suffix shares with its
   predecessor stay on the stack, the others are popped with their counts: a count for every prefix, that is, every phrase.
4. Phrases are joined with the counts of their parts, cut at each place.

Suffixes travel as text in which every word ends with a line end, which no word can hold, so phrases with a
common beginning stand together in the order of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import U, Words, mix, slices
from .store import beside, park

LONGEST, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Words are counted in 2**BUCKETS buckets: two megabytes of bits that tasks get.
BUCKETS = 24
#: Words that a task gathers before it adds up equal suffixes, and rows that it reads in one go.
GATHER, ROWS = 1 << 20, 1 << 16
#: Parts in which the first rows of a language are looked for.
PARTS = 64
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPLIT = PIECE.copy()
SPLIT[[0x20, 0x09]] = True
LINE = np.zeros(256, bool)
LINE[0x0A] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
_STEP, _STEP2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def lang_token(lang: str) -> bytes:
    """A language as the first word of its suffixes: never empty, without a line end."""
    return b"=" + lang.encode().replace(b"%", b"%25").replace(b"\n", b"%0A")


def _join(a: np.ndarray, b: np.ndarray, step: np.uint64 = _STEP) -> np.ndarray:
    """A hash of a sequence and the word that follows it."""
    return mix(a * step + b + U(1))


def _lang_hash(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(tokens), np.uint8)
    return Words(data, np.cumsum([0, *map(len, tokens)]), LINE).hashes()


def ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of each row as a string."""
    size = end - start
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    out = data[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])


class Tokens:
    """Words of some rows: hash, language and piece of each; their bytes stand in ``data``, a line end after each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        data = FOLD[data]
        w = Words(data, offsets, SPLIT)
        row = np.repeat(np.arange(len(w.count)), w.count)
        cuts = np.zeros(len(data) + 1, np.int64)
        np.cumsum(PIECE[data], out=cuts[1:])
        #: Rows and pieces only grow, so neighbours are in one piece if both agree.
        self.same = (row[1:] == row[:-1]) & (cuts[w.start[1:]] == cuts[w.start[:-1]]) if len(row) else np.zeros(0, bool)
        self.hash, self.lang = w.hashes(), langs[row]
        size = w.end - w.start + 1
        self.to = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=self.to[1:])
        at = np.arange(self.to[-1]) + np.repeat(w.start - self.to[:-1], size)
        self.data = np.append(data, 0)[at].astype(np.uint8)
        self.data[self.to[1:] - 1] = 0x0A


def _tokens(b: pa.RecordBatch, known: dict[str, int]) -> Iterator[Tokens]:
    """Tokens of (language, text) rows; ``known`` numbers languages as they come."""
    langs = np.array([known.setdefault(x, len(known)) for x in b.column(0).to_pylist()], np.int64)
    for i, j, data, offsets in slices(b.column(1)):
        yield Tokens(data, offsets, langs[i:j])


def _word_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """(_bucket, _lang, _n) from each task: words by bucket, and words by language (with a null bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known, n = np.zeros(1 << buckets, np.uint32), {}, np.zeros(0, np.int64)
        for b in batches:
            for t in _tokens(b, known):
                if len(n) < len(known):
                    n = np.append(n, np.zeros(len(known) - len(n), np.int64))
                names = _lang_hash([lang_token(x) for x in known])
                np.add.at(counts, (_join(names[t.lang], t.hash) >> U(64 - buckets)).astype(np.int64), np.uint32(1))
                n += np.bincount(t.lang, minlength=len(n))
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            own = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.nulls(len(own), pa.string()), pa.array(counts[own].astype(np.int64))], names=["_bucket", "_lang", "_n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int32()), pa.array(list(known)[: len(n)], pa.string()), pa.array(n)], names=["_bucket", "_lang", "_n"])

    return docs.mapInArrow(run, "_bucket int, _lang string, _n long")


def _suffixes(docs: DataFrame, bits: np.ndarray, heavy: dict[int, int], longest: int, buckets: int) -> DataFrame:
    """(_p, _s, _n): suffixes with their numbers; ``_p`` is what they are dealt out by, odd for heavy first words."""
    heavy_at, heavy_parts = np.array(sorted(heavy), np.int64), np.array([heavy[x] for x in sorted(heavy)], U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held: list[Tokens] = []
        n = 0
        for b in batches:
            for t in _tokens(b, known):
                if len(t.hash):
                    held.append(t)
                    n += len(t.hash)
                if n > GATHER:
                    yield from emit(held, known)
                    held, n = [], 0
        if held:
            yield from emit(held, known)

    def emit(held: list[Tokens], known: dict[str, int]) -> Iterator[pa.RecordBatch]:
        tokens = [lang_token(x) for x in known]
        names, prefix = _lang_hash(tokens), pa.array([x.decode() + "\n" for x in tokens], pa.string())
        lang, h = np.concatenate([t.lang for t in held]), np.concatenate([t.hash for t in held])
        same = np.concatenate([np.append(t.same, False) for t in held])
        data = np.concatenate([t.data for t in held])
        to = np.cumsum(np.concatenate([[0], *[np.diff(t.to) for t in held]]))
        held.clear()
        first = _join(names[lang], h)
        bucket = (first >> U(64 - buckets)).astype(np.int64)
        often = (bits[bucket >> 6] >> (bucket & 63).astype(U) & U(1)) > 0
        # How many words each suffix has, and two hashes of them.
        size, going, key, check = often.astype(np.int64), often, first, _join(h, names[lang], _STEP2)
        for k in range(1, longest):
            going = going & np.append(same[k - 1 :], np.zeros(min(k, len(h)), bool))[: len(h)] & np.append(often[k:], np.zeros(min(k, len(h)), bool))
            after = np.append(h[k:], np.zeros(min(k, len(h)), U))
            key, check = np.where(going, _join(key, after), key), np.where(going, _join(check, after, _STEP2), check)
            size += going
        at = np.flatnonzero(often)
        key, check = key[at], check[at]
        order = np.argsort(key)
        name, other = key[order], check[order]
        new = np.r_[True, name[1:] != name[:-1]][: len(name)]
        if ((other[1:] != other[:-1]) & ~new[1:]).any():
            order = np.lexsort((check, key))
            name, other = key[order], check[order]
            new = np.r_[True, (name[1:] != name[:-1]) | (other[1:] != other[:-1])]
        begin = np.flatnonzero(new)
        many = np.diff(np.r_[begin, len(name)])
        pick = at[order[begin]]
        where = np.searchsorted(heavy_at, bucket[pick])
        hot = heavy_at[np.minimum(where, len(heavy_at) - 1)] == bucket[pick] if len(heavy_at) else np.zeros(len(pick), bool)
        deal = first[pick]
        deal[hot] = mix(deal[hot] + name[begin][hot] % heavy_parts[where[hot]] + U(1))
        deal = (deal & ~U(1) | hot.astype(U)).view(np.int64)
        for i in range(0, len(pick), ROWS):
            own = pick[i : i + ROWS]
            text = pc.binary_join_element_wise(prefix.take(pa.array(lang[own])), ranges(data, to[own], to[own + size[own]]), "")
            yield pa.RecordBatch.from_arrays([pa.array(deal[i : i + ROWS]), text, pa.array(many[i : i + ROWS].astype(np.int32))], names=["_p", "_s", "_n"])

    return docs.mapInArrow(run, "_p long, _s string, _n int")


def _count(suffixes: DataFrame, longest: int, least: int) -> DataFrame:
    """(_s, _k, _f): phrases of 1 to ``longest`` words that stand ``least`` times in a partition; all of heavy first words but the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The stack: for each length the hash, text, count and heaviness of the phrase whose rows may go on.
        stack: list[tuple | None] = [None] * longest
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > ROWS:
                yield from read(pa.Table.from_batches(held), stack)
                held, n = [], 0
        if n:
            yield from read(pa.Table.from_batches(held), stack)
        for k, top in enumerate(stack):
            if top is not None and (top[2] >= least or top[3] and k + 1 < longest):
                yield rows(pa.array([top[1]], pa.string()), k, np.array([top[2]]))

    def rows(text: pa.Array, k: int, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([text, pa.array(np.full(len(f), k + 1, np.int32)), pa.array(f, pa.int64())], names=["_s", "_k", "_f"])

    def read(t: pa.Table, stack: list[tuple | None]) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        hot, many = (t.column(0).to_numpy() & 1) > 0, t.column(2).to_numpy().astype(np.int64)
        text = t.column(1).chunk(0).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        w = Words(data, offsets - offsets[0], LINE)
        h, at, size = w.hashes(), w.bounds[:-1], w.count
        prefix = h[at]
        for k in range(longest):
            has = size > k + 1
            prefix = np.where(has, _join(prefix, h[np.minimum(at + k + 1, len(h) - 1)]), U(0))
            own = np.flatnonzero(has)
            top, stack[k] = stack[k], None
            if not len(own):
                if top is not None and (top[2] >= least or top[3] and k + 1 < longest):
                    yield rows(pa.array([top[1]], pa.string()), k, np.array([top[2]]))
                continue
            name = prefix[own]
            begin = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            f = np.add.reduceat(many[own], begin)
            if top is not None:
                if top[0] == int(name[0]):
                    f[0] += top[2]
                elif top[2] >= least or top[3] and k + 1 < longest:
                    yield rows(pa.array([top[1]], pa.string()), k, np.array([top[2]]))
            lead = own[begin]
            texts = ranges(data, offsets[lead] - offsets[0], w.end[at[lead] + k + 1] + 1)
            stack[k] = (int(name[-1]), texts[-1].as_py(), int(f[-1]), bool(hot[lead[-1]]))
            keep = f >= least
            if k + 1 < longest:
                keep |= hot[lead]
            keep[-1] = False
            if keep.any():
                yield rows(texts.filter(pa.array(keep)), k, f[keep])

    ready = suffixes.repartition("_p").sortWithinPartitions(F.col("_s").desc())
    return ready.mapInArrow(run, "_s string, _k int, _f long")


def _part(s: str, begin: Column | int, size: Column | int) -> Column:
    """Words ``begin`` (from 1) on of a phrase held as text, as such a text of the same language."""
    words = F.split(s, "\n")
    return F.concat(F.element_at(words, 1), F.lit("\n"), F.array_join(F.slice(words, F.lit(begin) + 1 if isinstance(begin, int) else begin + 1, F.lit(size) if isinstance(size, int) else size), "\n"), F.lit("\n"))


def count_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """((_lang, n): words of each language; (_s, _k, _f): phrases of 1 to ``longest`` words that stand ``least`` times or more).

    ``_s`` is the language and the words, each with a line end after it.
    """
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    counted = park(_word_buckets(read, buckets).groupBy("_bucket", "_lang").agg(F.sum("_n").alias("_n")))
    words = counted.where("_bucket IS NULL").select("_lang", F.col("_n").alias("n"))
    often = counted.where(F.col("_n") >= least).where("_bucket IS NOT NULL")
    packed = often.groupBy(F.shiftright("_bucket", 6).alias("_at")).agg(F.expr("bit_or(shiftleft(1L, _bucket & 63))").alias("_bits"))
    # At most 2**BUCKETS / 64 rows of two numbers.
    got = packed.toArrow()
    bits = np.zeros(max(1, 1 << buckets >> 6), U)
    bits[got.column(0).to_numpy()] = got.column(1).to_numpy().view(U)
    total = int(words.agg(F.sum("n")).first()[0] or 0)
    most = max(1, total // (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # At most two rows for each partition of the shuffle, as heavy buckets hold more than half of its even share.
    heavy = {r["_bucket"]: -(-r["_n"] // most) for r in often.where(F.col("_n") > most).select("_bucket", "_n").collect()}
    found = _count(_suffixes(read, bits, heavy, longest, buckets), longest, least)
    return words, park(found.groupBy("_s", "_k").agg(F.sum("_f").alias("_f")).where(F.col("_f") >= least))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z; texts are split at ``. , ; : ! ?`` and line ends into pieces, those at spaces and tabs into words.
    Phrases have 2 to ``longest`` words and stand ``least`` times or more (a).  Cut after its first words, a phrase has
    parts that stand l and r times and the score floor(1000000 * a * a / (l * r)) in exact arithmetic; the lowest cut counts, of
    equal ones the first.  A phrase inside a longer one that stands in ``inside`` percent or more of its places is left out.
    n: words of the language.  Rows come by score and a, both descending, and by the phrase's bytes.

    Null languages are ``und``, null and empty texts have no words, texts of any length are read whole.  Repeated rows count
    each.  Words are told apart by 64 bits within a task, and as they are beyond.  An empty table, or one without frequent phrases, gives no rows;
    other columns are ignored.
    """
    words, grams = count_phrases(docs, lang, text, longest, least, buckets)
    phrases = grams.where("_k > 1")
    cuts = phrases.select("_s", "_k", F.col("_f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("_k") - 1)).alias("_cut"))
    cuts = cuts.select("_s", "_k", "a", "_cut", _part("_s", 1, F.col("_cut")).alias("_first"), _part("_s", F.col("_cut") + 1, F.col("_k") - F.col("_cut")).alias("_rest"))
    parts = lambda at, as_: grams.select(F.col("_s").alias(at), F.col("_f").alias(as_))
    cuts = cuts.join(parts("_first", "l"), "_first").join(parts("_rest", "r"), "_rest")
    exact = lambda c: F.col(c).cast("decimal(14,0)")
    top_, below = exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r")
    cuts = cuts.withColumn("_num", top_).withColumn("_den", below).withColumn("score", F.expr("_num div _den"))
    best = cuts.groupBy("_s", "_k", "a").agg(F.min(F.struct("score", "_cut", "l", "r")).alias("_b"))
    # Each phrase names the shorter ones inside it.
    at = F.explode(F.sequence(F.lit(1), F.col("_k") - 1)).alias("_at")
    inner = phrases.where("_k > 2").select("_s", "_k", "_f", at).select("_s", "_f", "_k", "_at", F.explode(F.sequence(F.lit(2), F.least(F.col("_k") - 1, F.col("_k") - F.col("_at") + 1))).alias("_size"))
    inner = inner.select(_part("_s", F.col("_at"), F.col("_size")).alias("_inner"), "_f").groupBy("_inner").agg(F.max("_f").alias("_over"))
    left = best.join(park(inner), F.col("_s") == F.col("_inner"), "left").where(F.col("_over").isNull() | (F.col("_over") * 100 < F.col("a") * inside))
    own = F.split("_s", "\n")
    name = F.replace(F.replace(F.substring(F.element_at(own, 1), 2, 1 << 30), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    left = left.select(name.alias("lang"), F.array_join(F.slice(own, F.lit(2), F.col("_k")), " ").alias("phrase"), "a", "_b.l", "_b.r", "_b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First in each of some parts of a language, so that no task sees more of it than PARTS * top rows.
    place = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))
    some = left.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = beside(words, words.count())
    return ranked.join(words, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
