"""Statistics that follow the index: a stream over what its commits say they added and took away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FEED = "seq long, source string, n long"


def feed(spark: SparkSession, root: str) -> DataFrame:
    """The commits of the index at ``root`` as a stream: images that a source gained (or lost, below 0)."""
    return spark.readStream.schema(FEED).json(f"{root.rstrip('/')}/feed")


def running_stats(changes: DataFrame) -> DataFrame:
    """(source, n): what :func:`tessera.operators.reporting.stats_by_source` counts, kept up to date by a stateful sum."""
    return changes.groupBy("source").agg(F.sum("n").alias("n"))


def follow(spark: SparkSession, root: str, act: Callable[[dict[str, int]], None], checkpoint: str, once: bool = False, look: float = 1.0) -> StreamingQuery:
    """Call ``act`` with the sources whose number of images changed and the numbers they have now; sources that are empty have 0."""
    writer = running_stats(feed(spark, root)).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda df, _: act({r["source"]: r["n"] for r in df.collect()}))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(look * 1000)} milliseconds")).start()
