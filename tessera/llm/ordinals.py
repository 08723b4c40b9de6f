"""Running sums over a total order, without a window over the whole table.

Two passes: the table is range-partitioned and parked with its partition number; the totals of the
partitions (one row each) give every partition its base; windows run inside one partition only.  Native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import park


def running(df: DataFrame, order: list[Column], value: str, out: str, group: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order``, in its ``group`` if given.

    ``order`` should tell rows apart; rows that are equal in it must be interchangeable.  Null groups are
    a group.  A group may hold any share of the rows: it is spread over the range partitions.
    """
    keys = [] if group is None else [F.col(group).asc_nulls_last()]
    spread = df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id())
    parked = park(spread)
    same = [] if group is None else [group]
    totals = parked.groupBy("_pid", *same).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*(same or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("_pid").alias("_bpid"), *[F.col(g).alias("_bgroup") for g in same], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    on = F.col("_pid") == F.col("_bpid")
    if same:
        on = on & F.col(group).eqNullSafe(F.col("_bgroup"))
    inside = Window.partitionBy("_pid", *same).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, on).withColumn(out, F.col("_base") + F.col("_inside")).drop("_pid", "_bpid", "_bgroup", "_base", "_inside")

