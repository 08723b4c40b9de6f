"""Arrow batches that stay small where rows are whole texts."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Bytes after which a batch of texts ends.  Spark's 64 MB stand twice on both sides of a task's socket, whatever a block of texts needs.
BYTES = 4 << 20

_lock = threading.Lock()
#: For each session how many threads are in :func:`small_batches`, and its setting before the first of them.
_held: dict[str, list] = {}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BYTES holds for plans that are run meanwhile; the last thread to leave restores what was set before."""
    name, key = "spark.sql.execution.arrow.maxBytesPerBatch", spark._jsparkSession.sessionUUID()
    with _lock:
        held = _held.setdefault(key, [0, spark.conf.get(name)])
        held[0] += 1
        spark.conf.set(name, BYTES)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(name, held[1])
                del _held[key]
