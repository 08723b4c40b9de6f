"""What a task holds at once doesn't grow with files, batches, rows of a block or terms."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.operators import postings, vector_search
from tessera.sources.snapshots import Snapshots
from tests.test_segments import rows


class Held:
    """Stands for a DataFrame; keeps the function of its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def peak_mb(made) -> float:
    tracemalloc.start()
    try:
        for _ in made:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch(texts: list[str]) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([len(t) for t in texts], pa.int32()), pa.array(texts), pa.array(["n"] * n)], names=["id", "length", "_text", "_name"])


def test_checksums_hold_no_file(spark, tmp_path):
    """Files may be longer than what a task may read whole."""
    name = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(name, "100")
    try:
        store = Snapshots(spark, str(tmp_path / "index"))
        store.commit(images=rows(spark, 50))
        assert store.damaged() == []
    finally:
        spark.conf.unset(name)
    assert all(len(known) == 3 for files in store.state["tables"]["images"][0]["files"].values() for known in files.values())


def test_pointers_of_version_6_are_checked(spark, tmp_path):
    """Files that were written with a checksum of all their bytes are still checked by it."""
    store = Snapshots(spark, str(tmp_path / "index"))
    store.commit(images=rows(spark, 9))
    segment = store.state["tables"]["images"][0]
    segment["files"] = store._sums(list(segment["files"]), whole=True)
    assert store.damaged() == []
    next(iter(segment["files"][segment["rows"]].values()))[1] ^= 1
    assert len(store.damaged()) == 1


def test_long_texts_of_a_batch(spark):
    """A batch of 60 MB is taken some rows at a time, and a block of 2 M characters needs little more than its sorted trigrams."""
    one = batch(["".join(chr(97 + (i * j) % 23) for j in range(30_000)) for i in range(1, 101)] * 20)
    assert peak_mb(postings._gathered(iter([one]))) < 20
    held = next(postings._gathered(iter([one])))
    assert peak_mb(postings._block(held) for _ in range(1)) < 110


def test_many_terms_in_short_rows(spark):
    """3,000 terms and 16,000 rows of a block are not one table of counts."""
    terms = [f"w{i}x" for i in range(3000)]
    texts = [f"w{i % 3500}x w{i % 7}x" for i in range(16_000)]
    held = Held()
    seen = {}

    def emit(seq, ids, length, counts):
        for r, t in zip(*np.nonzero(counts), strict=True):
            seen[int(ids[r]), int(t)] = int(counts[r, t])
        return iter(())

    postings._answered(None, terms, emit, "", held)
    assert peak_mb(held.run(iter([batch(texts)]))) < 120
    want = {}
    for i, t in enumerate(texts):
        for w in t.split():
            if int(w[1:-1]) < 3000:
                want[i, int(w[1:-1])] = want.get((i, int(w[1:-1])), 0) + 1
    assert seen == want


def test_trigrams_of_large_alphabets(spark):
    """Where characters and places don't fit one number, trigrams are the same."""
    text = "".join(chr(0x4E00 + (i * i) % 40_009) for i in range(70_000))
    got = postings._line([(1, 5, text, "ab"), (0, 5, "x😀y", "")])
    want = {}
    for at, t in ((0, "x😀y"), (3, text)):
        for i in range(len(t) - 2):
            want.setdefault(postings._code(t[i : i + 3]), []).append(at + i)
    assert got.names.tolist() == sorted(want)
    assert {int(c): got.at[i:j].tolist() for c, i, j in zip(got.names, got.lead, got.lead[1:], strict=False)} == want


def test_many_queries_on_a_batch_of_vectors(spark):
    """10,000 vectors are scored against 200 queries some rows at a time."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(10_000, 8)) + 2
    x /= np.linalg.norm(x, axis=1)[:, None]
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64()))], names=["id", "vec"])
    held = Held()
    vector_search.best_rows(held, x[:200], 20, 0.2)
    out = []
    assert peak_mb(out.append(b) for b in held.run(iter([whole]))) < 60
    ids = out[0].column("id").to_numpy().reshape(200, 20)
    score = vector_search.dots(x, x[:200])
    assert all((ids[i] == np.lexsort((np.arange(10_000), -score[:, i]))[:20]).all() for i in range(200))
