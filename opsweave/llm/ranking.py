"""Ranks within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from opsweave.llm.common import stash

#: ``monotonically_increasing_id`` has the partition above these bits.
_ROW_BITS = 33


def ranked(df: DataFrame, group: str, order: list[str], label: str, at: str = "at", n: str = "n") -> DataFrame:
    """``df`` with the rank ``at`` (from 0) of each row in its group by ``order`` (nulls first) and the group's
    size ``n``; written down.  Rows that agree in all of these take ranks in any order.  ``group`` has no nulls.

    Rows are range-partitioned by group and order, so a hot group spreads over many partitions; what a window
    sees of it is one count for each partition.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = tied.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()), label)
    part = F.shiftright("_row", _ROW_BITS).cast("int")
    counts = rows.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.count("*").alias("_count"), F.min("_row").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    offsets = counts.select(
        "_group", "_part", (F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_count").over(whole).alias(n)
    )
    joined = rows.join(offsets, (F.col(group) == F.col("_group")) & (part == F.col("_part")))
    return joined.withColumn(at, F.col("_row") + F.col("_shift")).drop("_row", "_group", "_part", "_shift")
