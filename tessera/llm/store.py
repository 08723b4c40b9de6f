"""Tables written to the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Here(threading.local):
    def __init__(self):
        self.parked: list[str] = []


#: Folders parked by this thread and not swept yet.
_here = _Here()


#: Folders of local applications that named none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a folder of its own; on a cluster it is an error, as
    executors would not see one of the driver's.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-shared-"))
    return found


#: Rows in an Arrow batch while a table is parked, and bytes that a Parquet writer gathers: both per task.
ARROW_ROWS, GROUP_BYTES = 1024, 16 << 20


_lock = threading.Lock()
#: For each session how many tables are being written, and its batch size before the first of them.
_writing: dict[str, list] = {}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """ARROW_ROWS holds while any thread parks; the last to leave restores what was set before."""
    name, key = "spark.sql.execution.arrow.maxRecordsPerBatch", spark._jsparkSession.sessionUUID()
    with _lock:
        held = _writing.setdefault(key, [0, spark.conf.get(name)])
        held[0] += 1
        spark.conf.set(name, ARROW_ROWS)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(name, held[1])
                del _writing[key]


#: Rows of some numbers that may be broadcast: a few dozen megabytes as a hash table.
SMALL = 200_000


def beside(df: DataFrame, most: int) -> DataFrame:
    """A narrow table of at most ``most`` rows, ready to be joined: broadcast where that bound is small, else parked.

    Parked, it meets the other side in a plain shuffle, whose skewed partitions Spark can split; an
    aggregation in the same stage as the join would forbid that.
    """
    return F.broadcast(df) if most <= SMALL else park(df)


def park(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The files go when they are swept, at the latest when the application ends.  Later jobs read them instead of repeating the work, so a
    lost executor costs a re-read, and values such as partition numbers stay what they were.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parked-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.option("compression", codec).option("parquet.block.size", GROUP_BYTES).parquet(path)
    _here.parked.append(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def parked() -> int:
    """A mark for :func:`sweep`."""
    return len(_here.parked)


def sweep(spark: SparkSession, since: int) -> None:
    """Delete what was parked after the mark, but for the last table: the caller's result, which must not be lazy."""
    own = _here.parked
    gone, own[since:] = own[since:-1], own[max(since, len(own) - 1) :]
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
