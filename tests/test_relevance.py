"""Ranks of a whole list of queries against the engine's own search and plain numpy."""

import numpy as np

from tessera import queries as registered
from tessera.engine import Engine
from tessera.functions.encoders import hash_projection
from tessera.operators import batch, postings, relevance, vector_search
from tessera.plans.query import parse


def test_search_ranks_are_the_engines(spark):
    """Exact before loose, ties, letters in either case, short and repeated terms, more hits than the limit, no hit at all."""
    rows = [(i, f"row {i} {'moca ' * (i % 4)}Network aa aaaa", f"n{i}", "s", i % 5) for i in range(30)]
    rows += [(40, "the moca network\nof two", "moca", "s", 9), (41, "network MOCA of", "x", "s", 1), (42, "moca network of two", "y", "s", 1), (43, "", "", "s", 0)]
    corpus = spark.createDataFrame(rows, "id long, text string, name string, source string, mtime long").repartition(3)
    items = {1: "moca Network", 2: "network\nof two", 3: "of", 4: "moca", 5: "zzz none", 6: "aa aaaa", 7: "moca moca network of", 8: "network aaaa", 9: "row 7"}
    index = postings.open_index(postings.build(corpus))
    for limit in (120, 5):
        got = {r["item"]: r["rank"] for r in relevance.search_ranks(corpus, index, {k: parse(t) for k, t in items.items()}, items, limit).collect()}
        want = {}
        for k, t in items.items():
            hits = Engine(corpus).search(t, limit).select("pos", "id").collect()
            text = {r[0]: r[1] for r in rows}
            want[k] = min((h["pos"] for h in hits if t in text[h["id"]]), default=None)
        assert got == want


def test_registered_queries_rank_every_item(spark, sf):
    """All 40 items count, and documents that hold an item's text are ranked: 26 pairs at this scale."""
    row = registered.eval_search_metrics(spark, sf).first()
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pairs = [(k, d) for k, t in items.items() for d, x in docs.items() if t in x]
    assert len(pairs) == 26
    assert row["queries"] == len(items) == 40 and row["hit1"] > 0 and row["hit5"] == len({k for k, _ in pairs})
    v = registered.vectors(spark, sf).collect()
    ids, x = np.array([r["id"] for r in v]), np.array([r["vec"] for r in v], np.float64)
    got = {r["item_id"]: r for r in registered.eval_vector_ranks(spark, sf).collect()}
    assert sorted(got) == sorted(items)
    for k, t in items.items():
        s = np.round((x * hash_projection([t])[0]).sum(axis=1), 9)
        order = np.lexsort((ids, -s))
        place = next((i for i, j in enumerate(order) if (k, ids[j]) in set(pairs)), None)
        r = got[k]
        assert r["rank"] == (None if place is None else place + 1)
        assert np.allclose([r["best"], r["tenth"]], s[order[[0, 9]]], atol=2e-9) and (place is None) == (r["score"] is None)
        assert place is None or abs(r["score"] - s[order[place]]) < 2e-9


def test_many_hybrid_searches_are_the_engines(spark):
    """Every query's fused hits, scores and badges, with text, images and meaning, as the engine gives them one by one."""
    rng = np.random.default_rng(3)
    rows = [(i, f"row {i} {'moca ' * (i % 4)}Network aa aaaa", f"n{i}", "s", i % 5) for i in range(40)]
    corpus = spark.createDataFrame(rows, "id long, text string, name string, source string, mtime long").repartition(3)
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    base = rng.normal(size=16)
    vecs = [(i, "s", i % 5, unit(base + rng.normal(size=16) * 0.25) if i % 9 else unit(base)) for i in range(40)]
    vectors = spark.createDataFrame(vecs, "id long, source string, mtime long, vec array<float>").repartition(4)
    items = {1: "moca Network", 2: "row 7", 3: "aa", 4: "zzz none", 5: "network aaaa"}
    asked = {k: unit(base + rng.normal(size=16) * 0.1) for k in items}
    index = postings.open_index(postings.build(corpus))
    text = batch.text_hits(corpus, index, {k: parse(t) for k, t in items.items()}, 12)
    look = batch.vector_hits(vectors, asked, 12, *vector_search.TEXT_TO_IMAGE)
    mean = batch.vector_hits(vectors, asked, 12, *vector_search.MEANING)
    got = {}
    for r in batch.hybrid_hits(text, mean, look, 12).orderBy("pos").collect():
        got.setdefault(r["item"], []).append(tuple(r)[1:])
    for k, t in items.items():
        encode = lambda texts: np.array([asked[k] for _ in texts])  # noqa: B023, E731
        engine = Engine(corpus, vectors, vectors, encode, encode)
        want = engine.search(t, 12).select("pos", "id", "block", "score", "matched_text", "visual_score", "meaning_score").collect()
        assert got.get(k, []) == [tuple(r) for r in want], t


def test_long_lists_read_texts(spark, monkeypatch):
    """Texts give what postings give: counts, frequencies, ranks and holders; nothing of them is shuffled."""
    rows = [(i, f"row {i} {'moca ' * (i % 4)}Network aa aaaa", f"n{i}", "s", i % 5) for i in range(30)] + [(40, "the moca network\nof two", None, "s", 9), (41, None, "network of", "s", 1), (42, "", "", "s", 0)]
    corpus = spark.createDataFrame(rows, "id long, text string, name string, source string, mtime long").repartition(3)
    index = postings.open_index(postings.build(corpus))
    terms = ["moca", "network", "aa aaaa", "aaa", "row 7", "zzz"]
    items = {1: "moca Network", 2: "network\nof two", 3: "of", 4: "aa aaaa", 5: "Network aa"}
    parsed = {k: parse(t) for k, t in items.items()}
    made = lambda: ({tuple(r["counts"]) + (r["id"], r["length"]) for r in postings.term_counts(index, terms, postings.scanned(corpus, terms)).collect()}, postings.document_frequencies(index, terms, postings.scanned(corpus, terms)), sorted(relevance.search_ranks(corpus, index, parsed, items).collect()), sorted(relevance.holders(corpus, index, items).collect()))
    kept = made()
    assert len(kept[0]) == 32 and len(kept[3]) == 22 + 1 + 30 + 30
    monkeypatch.setattr(postings, "MANY", 0)
    assert made() == kept
    plan = postings.term_counts(index, terms, postings.scanned(corpus.coalesce(1), terms))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Sort" not in plan
