"""Quality classifier: document evidence, and empirical Bayes over sites and their paths.

Two heads, low quality and toxic, are logistic models of style measures and of lexical evidence (words
and word beginnings that go with the label).  They are trained on a bounded sample of labelled
rows.  Every document is then scored, and its log odds are combined with the posterior rate of its
path, which shrinks to its site's, which shrinks to the whole corpus's; how strongly is fitted from the
spread between sites.  Rates are grouped sums over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import NOT_LETTER, Words, _byte_values, _B, mix, powers, slices, strings
from .store import park
from .streams import distinct_pairs

#: Labelled documents that training reads at most, those whose ids hash lowest.
TRAIN_ROWS = 6000
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_Z, MOST_TERMS = 8, 5.0, 2000
HEADS = ("bad", "toxic")
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:'\"()-?"]] = True
U = np.uint64


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def style(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of measures for each text: case, punctuation, digits, repetition, lengths."""
    w = Words(data, offsets)
    n = w.count
    per_word, per_byte = np.maximum(n, 1), np.maximum(np.diff(w.offsets), 1)
    upper = (data >= 0x41) & (data <= 0x5A)
    letter = ~NOT_LETTER[data]
    digit = (data >= 0x30) & (data <= 0x39)
    odd = ~(letter | digit | _COMMON[data]) & (data > 0x20)
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[w.bounds[:-1][w.bounds[:-1] < len(h)]] = False
    has = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=has[1:])
    plain = has[w.end] == has[w.start]
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], float)
    out = [
        _sums(upper, w.offsets) / np.maximum(_sums(letter, w.offsets), 1),
        np.minimum(_sums(odd, w.offsets) / per_word, 3),
        np.minimum(_sums(_COMMON[data], w.offsets) / per_word, 3),
        _sums(digit, w.offsets) / per_byte,
        np.log1p(distinct) / np.log1p(per_word),
        distinct / per_word,
        _sums(again, w.bounds) / per_word,
        _sums(plain, w.bounds) / per_word,
        np.minimum((per_byte - n) / per_word, 30),
        np.log1p(n),
    ]
    return np.stack(out, axis=1)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, words by row) of lower-cased letter runs and their beginnings."""
    w = Words(data, offsets, NOT_LETTER, fold=True)
    row = np.repeat(np.arange(len(offsets) - 1), w.count)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_byte_values(True)[data] * powers(_B, len(data)), out=total[1:])
    back = powers(pow(_B, -1, 1 << 64), len(data) + 1)
    hashes, rows = [w.hashes()], [row]
    for k in PREFIXES:
        long = w.end - w.start > k
        s = w.start[long]
        hashes.append(mix((total[s + k] - total[s]) * back[s] + U(k << 8 | 1)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows), w.count


@dataclass
class Head:
    """A logistic model: lexical terms with weights, then style and lexical measures with weights."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(13))
    scale: np.ndarray = field(default_factory=lambda: np.ones(13))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(14))
    rate: float = 0.0

    def measure(self, styles: np.ndarray, hashes: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Style measures and three lexical ones: odds of the distinct terms, the strongest, and how dense they are."""
        n = len(words)
        total, top, dense = np.zeros(n), np.zeros(n), np.zeros(n)
        if len(self.keys):
            maybe = np.zeros(1 << 16, bool)
            maybe[(self.keys & U(0xFFFF)).astype(np.int64)] = True
            hit = np.flatnonzero(maybe[(hashes & U(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, hashes[hit]), len(self.keys) - 1)
            true = self.keys[at] == hashes[hit]
            at, row = at[true], rows[hit][true]
            np.add.at(dense, row, self.odds[at])
            pair = np.unique(row.astype(np.int64) * len(self.keys) + at)
            row, at = pair // len(self.keys), pair % len(self.keys)
            np.add.at(total, row, self.odds[at])
            np.maximum.at(top, row, self.odds[at])
        return np.column_stack([styles, np.log1p(total), top, np.minimum(dense / np.maximum(words, 1), 3)])

    def log_odds(self, measures: np.ndarray) -> np.ndarray:
        x = np.clip((measures - self.mean) / self.scale, -8, 8)
        return np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights by Newton steps under a ridge; the last one is the constant and not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - shrink * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> dict[str, Head]:
    """The heads, from at most ``rows`` labelled documents, of rows that share an id one (with the least hash of its text); a head without examples of both kinds decides nothing.

    Labels that are null, or whose document is missing, are left out; texts that are null are empty.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("_l"), F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("int")).alias("_bad"), F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1).cast("int")).alias("_toxic"))
    marks = marks.where("_l IS NOT NULL").orderBy(F.xxhash64("_l"), "_l").limit(rows)
    met = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).join(park(marks), F.col("_id") == F.col("_l"))
    # One document for each label, so that an id with very many rows, or labels, is one example.
    one = met.groupBy("_l", "_bad", "_toxic").agg(F.min_by(F.struct("_text"), F.xxhash64("_text")).alias("_s"))
    sample = park(one.select("_bad", "_toxic", "_s._text"))

    def spell(batches):
        for b in batches:
            for i, j, data, offsets in slices(b.column(2)):
                h, r, _ = terms(data, offsets)
                row, term = distinct_pairs(r, h)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), b.column(0).take(at), b.column(1).take(at)], names=["_term", "_bad", "_toxic"])

    seen = sample.select("_bad", "_toxic", "_text").mapInArrow(spell, "_term long, _bad int, _toxic int").groupBy("_term")
    counts = seen.agg(F.count("_bad").alias("_nbad"), F.sum("_bad").alias("_sbad"), F.count("_toxic").alias("_ntoxic"), F.sum("_toxic").alias("_stoxic"))
    whole = sample.agg(F.count("_bad"), F.sum("_bad"), F.count("_toxic"), F.sum("_toxic")).first()
    heads = {}
    for k, name in enumerate(HEADS):
        n, s = float(whole[2 * k] or 0), float(whole[2 * k + 1] or 0)
        head = heads[name] = Head(rate=s / n if n else 0.0)
        if not 0 < s < n:
            continue
        p, q = F.coalesce(f"_s{name}", F.lit(0)), F.col(f"_n{name}") - F.coalesce(f"_s{name}", F.lit(0))
        odds = F.log((p + 0.5) / (s - p + 0.5)) - F.log((q + 0.5) / (n - s - q + 0.5))
        z = odds / F.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
        best = counts.where(p >= LEAST_DOCS).select("_term", odds.alias("_odds"), z.alias("_z")).where(F.col("_z") >= LEAST_Z).orderBy(F.desc("_z"), "_term").limit(MOST_TERMS).collect()
        keys = np.array([r["_term"] for r in best], np.int64).view(U)
        order = np.argsort(keys)
        head.keys, head.odds = keys[order], np.array([r["_odds"] for r in best], float)[order]

    def measure(batches):
        for b in batches:
            for i, j, data, offsets in slices(b.column(2)):
                s, t = style(data, offsets), terms(data, offsets)
                both = [pa.array(heads[h].measure(s, *t).tolist(), pa.list_(pa.float64())) for h in HEADS]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *both], names=["_bad", "_toxic", "_mbad", "_mtoxic"])

    found = sample.mapInArrow(measure, "_bad int, _toxic int, _mbad array<double>, _mtoxic array<double>").toPandas()
    for name, head in heads.items():
        part = found[found[f"_{name}"].notna()]
        if not 0 < head.rate < 1:
            continue
        x, y = np.stack(part[f"_m{name}"].to_list()), part[f"_{name}"].to_numpy(float)
        head.mean, head.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        head.weights = fit_logistic(np.clip((x - head.mean) / head.scale, -8, 8), y)
    return heads


def evidence(text: Column, heads: dict[str, Head]) -> Column:
    """Struct of the two heads' log odds for each text; null counts as empty."""

    @F.arrow_udf("bad double, toxic double")
    def judge(column: pa.Array) -> pa.Array:
        out = {h: [np.zeros(0)] for h in HEADS}
        for _, _, data, offsets in slices(strings(column)):
            s, t = style(data, offsets), terms(data, offsets)
            for name, head in heads.items():
                out[name].append(head.log_odds(head.measure(s, *t)) if 0 < head.rate < 1 else np.full(len(offsets) - 1, -30.0))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(out[h])) for h in HEADS], names=list(HEADS))

    return judge(text)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, name: str, rate: float) -> float:
    """How many documents the prior counts for: from the spread of the groups' rates beyond chance."""
    mean = F.col(f"_s{name}") / F.col("_n")
    row = groups.agg(F.sum("_n"), F.sum(F.col("_n") * (mean - rate) * (mean - rate)), F.count(F.lit(1))).first()
    n, spread, k = float(row[0] or 0), float(row[1] or 0), float(row[2] or 0)
    chance = rate * (1 - rate)
    between = (spread - (k - 1) * chance) / max(n - n / max(k, 1), 1.0)
    return float(np.clip(chance / between - 1 if between > 0 else 1e4, 10, 1e4))


def posteriors(scored: DataFrame, site: str, path: str) -> DataFrame:
    """(_site, _path, and for each head the rates of site and path): shrunk from path to site to corpus.

    With them come the sums and strengths that :func:`without` needs.  ``scored`` has _e, the heads' log odds.  Documents are summed by (site, path) before anything else,
    so a site with a third of all rows is one row per task.
    """
    odds = {h: 1 / (1 + F.exp(-F.col(f"_e.{h}"))) for h in HEADS}
    paths = park(scored.groupBy(F.col(site).alias("_site"), F.col(path).alias("_path")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(odds[h]).alias(f"_s{h}") for h in HEADS]))
    sites = park(paths.groupBy("_site").agg(*[F.sum(c).alias(c) for c in ("_n", *[f"_s{h}" for h in HEADS])]))
    all_ = sites.agg(F.sum("_n"), *[F.sum(f"_s{h}") for h in HEADS]).first()
    out = paths.join(sites.select(F.col("_site").alias("_host"), F.col("_n").alias("_hn"), *[F.col(f"_s{h}").alias(f"_hs{h}") for h in HEADS]), F.col("_site").eqNullSafe(F.col("_host")))
    cols = []
    for i, h in enumerate(HEADS):
        rate = float(np.clip((all_[i + 1] or 0) / (all_[0] or 1), 1e-6, 1 - 1e-6))
        top, low = _strength(sites, h, rate), _strength(paths, h, rate)
        host = (F.col(f"_hs{h}") + top * rate) / (F.col("_hn") + top)
        cols += [host.alias(f"_site_{h}"), ((F.col(f"_s{h}") + low * host) / (F.col("_n") + low)).alias(f"_path_{h}")]
        cols += [f"_s{h}", f"_hs{h}", F.lit(rate).alias(f"_rate_{h}"), F.lit(top).alias(f"_top_{h}"), F.lit(low).alias(f"_low_{h}")]
    return out.select("_site", "_path", "_n", "_hn", *cols)


def without(own: Column, h: str) -> Column:
    """The rate of a document's path by all other documents: its own evidence, a probability, must not count twice."""
    top, low = F.col(f"_top_{h}"), F.col(f"_low_{h}")
    host = (F.col(f"_hs{h}") - own + top * F.col(f"_rate_{h}")) / (F.col("_hn") - 1 + top)
    return F.greatest(F.lit(1e-9), (F.col(f"_s{h}") - own + low * host) / (F.col("_n") - 1 + low))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", path: str = "lang", columns: list[str] | None = None, threshold: float = 0.5, train_on: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """The given ``columns`` of every document (default: id, site, path), then its scores and ``kept``.

    p_bad and p_toxic are posteriors of low quality and toxicity, evidence_* the document's own log odds,
    site_* and path_* the shrunk rates; a document's prior is its path's rate by all other documents; a document is kept if both posteriors are below ``threshold``.
    Null and empty texts are judged by their measures like any other.  Null sites and paths are sites and
    paths of their own.  Repeated rows are judged alike; an empty table gives no rows; without labels of
    both kinds a head decides nothing.  Other columns are ignored, or carried where ``columns`` names them.
    """
    heads = train(docs if train_on is None else train_on, labels, id_col, text, rows)
    names = list(dict.fromkeys(columns or [id_col, site, path]))
    need = [c for c in dict.fromkeys([site, path]) if c not in names]
    scored = park(docs.select(*names, *need, evidence(F.col(text).cast("string"), heads).alias("_e")))
    # Parked, the rates have a known size: few sites are broadcast, so texts stay where they are; many are merged.
    rates = park(posteriors(scored, site, path))
    joined = scored.join(rates, F.col(site).eqNullSafe(F.col("_site")) & F.col(path).eqNullSafe(F.col("_path")))
    cols = []
    for h in HEADS:
        base = float(np.clip(heads[h].rate, 1e-6, 1 - 1e-6))
        others = without(1 / (1 + F.exp(-F.col(f"_e.{h}"))), h)
        shift = _logit(others) - float(np.log(base / (1 - base)))
        cols.append(F.round(1 / (1 + F.exp(-(F.col(f"_e.{h}") + shift))), 6).alias(f"p_{h}"))
    judged = joined.select(*names, *cols, *[F.round(F.col(f"_e.{h}"), 6).alias(f"evidence_{h}") for h in HEADS], *[F.round(F.col(f"_{k}_{h}"), 6).alias(f"{k}_{h}") for h in HEADS for k in ("site", "path")])
    return judged.withColumn("kept", (F.col("p_bad") < threshold) & (F.col("p_toxic") < threshold))
