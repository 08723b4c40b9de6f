"""License scans, collocations and centroids against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, collocations, licenses

CLASH = {"_id": 1, "_text": "x", "_raw": 2, "_n": 3, "_s": "no", "lang_": 4, "rank": 5, "cluster": 6, "score": 7, "n": 8, "_vec": 9, "template": 1, "_lang": "z", "_doc": 3}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- centroids ----------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    names = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    at = [v for _, _, v in names[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in out:
        sums[c] += d
    return sorted(str((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest())) for i, c, d in out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(v) for c, v in CLASH.items()})


@pytest.mark.parametrize("n", [300, 5])
def test_centroids(spark, n):
    rng = np.random.default_rng(n)
    middle = rng.normal(size=(6, 64))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=64) * 0.2]) for i in range(n)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[0][1]), (n + 1, None), (n + 2, []), (n + 3, [1.0] * 63), (n + 4, [float("nan")] + [0.0] * 63), (n + 5, [None] + [0.0] * 63), (n + 6, [float("inf")] * 64), (n + 7, [0.0] * 64)]
    got = centroids.cluster_vectors(vectors(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_clusters(rows)


def test_centroids_of_nothing(spark):
    assert centroids.cluster_vectors(vectors(spark, [(1, [0.5])])).count() == 0
    only = centroids.cluster_vectors(vectors(spark, [(None, [0.5] * 64)])).collect()
    assert [tuple(r) for r in only] == [(None, None, None, None, None, None)]
    far = centroids.cluster_vectors(vectors(spark, [(1, [1e30] * 64), (2, [-1e30] * 64)])).collect()
    assert sorted(r["distance"] for r in far) == [0, 0]


@pytest.mark.parametrize("size", [1, 1000, 1 << 27])
def test_screening_measures_few_and_loses_none(size):
    """Norms differ by segment, so most centroids are ruled out by their bounds; ties go to the smaller number."""
    rng = np.random.default_rng(size)
    at = np.concatenate([rng.normal(size=(7, 64)) * rng.choice([0.05, 1], size=(7, 8)).repeat(8, axis=1), np.zeros((1, 64))])
    at = np.clip(np.floor(at * size), -size, size).astype(np.int64)
    at = np.concatenate([at, at[:2]])
    x = np.clip(at[rng.integers(0, 8, 3000)] + np.floor(rng.normal(size=(3000, 64)) * size * 0.05), -size, size).astype(np.int32)
    own, far, tried = centroids.nearest(x, centroids.segment_norms(x, 8), at, 8)
    true = ((x[:, None, :].astype(np.int64) - at[None]) ** 2).sum(axis=2)
    assert (far == true.min(axis=1)).all() and (own == true.argmin(axis=1)).all()
    if size > 1:
        assert tried < 0.6 * len(x) * len(at)


# --- collocations -------------------------------------------------------------------------------


def plain_collocations(rows, longest=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in held.items():
        longer = [b for (other, *v), b in held.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= inside * a for b in longer):
            continue
        score, _, left, right = min((10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((score, a, " ".join(w), left, right))
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        for i, (score, a, phrase, left, right) in enumerate(found[:top]):
            yield lang, i + 1, phrase, a, left, right, n[lang], score


def some_texts(n, seed):
    """Few words, so that phrases repeat; one word holds a third of all places."""
    rng = random.Random(seed)
    words = ["The", "the", "a\x01", "a", "a\x00b", "é", "É", "x|y", "%0a", "zu", "b", "c", "d", "日本", "\x1f"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", ";", " ?"]
    return [(rng.choice(["en", "en", "en", None, "und", "", "a\nb%0A"]), "".join(("the" if rng.random() < 0.33 else rng.choice(words)) + rng.choice(ends) for _ in range(rng.choice([0, 1, 2, 30, 90])))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "buckets", "top", "least"), [(3, 24, 2000, 10), (4, 3, 20, 6)])
def test_collocations(spark, longest, buckets, top, least):
    rows = [*some_texts(300, longest), (None, None), ("en", ""), ("fr", "nur einmal")]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(v) for c, v in CLASH.items() if c not in ("lang",)})
    got = collocations.collocations(docs, longest=longest, buckets=buckets, top=top, least=least).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows, longest, least, top=top))


def test_counts_over_many_suffixes(spark):
    """More suffixes than a partition reads in one go, and phrases that go on from one part to the next."""
    rng = random.Random(1)
    rows = [("en", " ".join("w" if rng.random() < 0.4 else f"w{rng.randrange(1, 4000)}" for _ in range(9000))) for _ in range(30)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    got = collocations.collocations(docs, least=4, top=300).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows, least=4, top=300))


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "once only")], "lang string, text string")
    assert collocations.collocations(docs).count() == collocations.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits():
    a, left, right = 3 * 10**12, 5 * 10**12, 7 * 10**12
    assert 10**6 * a * a > 1 << 63 and len(str(10**6 * (10**14 - 1) ** 2)) <= 38
    assert 10**6 * a * a // (left * right) == 257_142


# --- licenses -----------------------------------------------------------------------------------


def word_list(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def plain_base(text):
    w, places, labels = word_list(text), [], set()
    for t in licenses.PHRASES:
        p = t.text.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        labels |= {t.label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def plain_labels(text, templates=licenses.TEMPLATES, least=licenses.LEAST, gram=licenses.GRAM):
    """Labels and score by trying every diagonal of every template."""
    w, labels, score = word_list(text), set(), 0.0
    for t in templates:
        p = t.text.split()
        voted = {d: {i for i in range(len(p) - gram + 1) if 0 <= d + i and w[d + i : d + i + gram] == p[i : i + gram]} for d in range(-len(p), len(w))}
        spans, last = [], None
        for d in sorted(d for d, v in voted.items() if v):
            if last is None or d - last > licenses.slack_of(t):
                spans.append([])
            spans[-1].append(d)
            last = d
        for span in spans:
            if len(set().union(*(voted[d] for d in span))) >= licenses.votes_needed(t, least):
                share = len({i for d in span for i in range(len(p)) if 0 <= d + i < len(w) and w[d + i] == p[i]}) / len(p)
                if share >= (1 if t.phrase else least) - 1e-9:
                    labels.add(t.label)
                    score = max(score, share)
    return ",".join(sorted(labels)), round(score, 6)


def license_texts(seed=5):
    rng = random.Random(seed)
    out = ["", None, "!!", "mit license", "Under the MIT-License. UNDER the mit license under the mit license", "cc by nc by nc cc-by-nc", "Apache License, Version 2.0", "xunder the mit license", "under\x00the\x7fmit license²"]
    filler = ["the", "software", "work", "is", "under", "license", "é", "of", "x1"]
    for _ in range(60):
        t = rng.choice(licenses.TEMPLATES)
        w = t.text.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            i = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[i : i + (kind < 2)] = [rng.choice(filler)] if kind else []
        around = [rng.choice(filler) for _ in range(rng.choice([0, 5, 40]))]
        text = rng.choice([" ", ", ", "\n"]).join([*around, *w, *around[::-1]] * rng.choice([1, 1, 2]))
        out.append(text.upper().replace("É", "é") if rng.random() < 0.3 else text)
    return out


def test_license_scan(spark):
    rows = [(i, t) for i, t in enumerate(license_texts())] + [(3, "mit license"), (None, "under the mit license"), (None, "under the mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASH.items()})
    got = licenses.scan_licenses(docs).collect()
    want = [(i, *plain_base(t), *plain_labels(t)) for i, t in rows]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert sum(bool(x[-2]) for x in want) > 40 and sum(0 < x[-1] < 1 for x in want) > 8


def test_license_spans(spark):
    notice = licenses.NOTICES[0].text.split()
    text = "Some code.\n\n(c) 2020. " + " ".join([*notice[:10], "very", *notice[10:]]).upper() + ". Under the MIT License; cc by nc"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "nothing here"), (None, "cc by nc")], "doc_id long, text string")
    got = licenses.license_spans(docs).collect()
    # Four of the five words of "released under the mit license" are there, too.
    assert Counter((r["doc_id"], r["label"], r["share"]) for r in got) == Counter({(1, "mit", 1.0): 2, (1, "mit", 0.8): 1, (1, "cc-by-nc", 1.0): 1, (None, "cc-by-nc", 1.0): 1})
    one = next(r for r in got if not r["phrase"] and r["share"] == 1)
    assert (one["first"], one["last"], one["share"]) == (4, 4 + len(notice), 1.0)
    assert one["passage"] == " ".join([*notice[:10], "very", *notice[10:]]).upper()


def test_long_and_empty_license_tables(spark):
    text = "word " * 150_000 + "under the mit license " * 2000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = licenses.scan_licenses(docs).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (158_000, 2000, 150_000, 150_000 + 4 * 1999)
    assert licenses.scan_licenses(docs.limit(0)).count() == licenses.license_spans(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="3 words"):
        licenses.scan_licenses(docs, templates=(licenses.Template("x", "two words"),))
