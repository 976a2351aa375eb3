"""Windows over series of any length: rows of one series spread over many tasks.

A window partitioned by the series alone is one task for each series.  Here rows are numbered by way of time
buckets (the rows before a bucket are a prefix sum over one count for each bucket), and dealt into tiles of
``TILE`` consecutive rows.  Rows near a tile's edge go to the neighbouring tile as well (its halo), so a frame
of bounded reach sees in its tile what it would see in the whole series; halo rows are dropped after the window.
What has no bounded reach is carried from tile to tile as one value for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

#: Rows of a tile; the most that a frame may reach on either side.
TILE = 4096
#: Seconds of a bucket in which rows are numbered.
BUCKET_SECONDS = 86_400
#: Columns that the functions here add: series, row number from 1, rows of the series, tile, whether the row is the
#: tile's own.
SERIES, ROW, SIZE, OF, OWN = "_series", "_row", "_size", "_tile", "_own"


def series_of(by: str | list[str]) -> Column:
    """The series as one value in which nulls are equal."""
    return F.struct(*([by] if isinstance(by, str) else by))


def numbered(df: DataFrame, by: str | list[str], ts: str = "ts", tie: tuple[str, ...] = (), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds ``_series``, ``_row``, the number, from 1, of each row in its series by time and then ``tie``, and ``_size``.

    A null time comes first.  ``ts`` may be a struct that begins with the time and goes on with ties.
    """
    kind = df.schema[ts].dataType
    time = F.col(f"{ts}.{kind.fields[0].name}") if isinstance(kind, T.StructType) else F.col(ts)
    bucket = F.coalesce(F.floor(F.unix_micros(time.cast("timestamp")) / (bucket_seconds * 1_000_000)), F.lit(-(1 << 62)))
    rows = df.withColumns({SERIES: series_of(by), "_bucket": bucket})
    counts = rows.groupBy(SERIES, "_bucket").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(SERIES).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    total = F.sum("_count").over(Window.partitionBy(SERIES))
    offsets = counts.select(SERIES, "_bucket", total.alias(SIZE), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(SERIES, "_bucket").orderBy(ts, *tie))
    # Rows are sorted by series and bucket already; the counts of many short series are too many to broadcast.
    return rows.withColumn("_inside", inside).join(offsets.hint("merge"), [SERIES, "_bucket"]).withColumn(ROW, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def dealt(rows: DataFrame, before: int = 0, after: int = 0, tile: int | None = None) -> DataFrame:
    """Adds ``_tile`` and ``_own`` to numbered rows, with the halo of ``before`` and ``after`` rows as further rows."""
    tile = tile or TILE
    if max(before, after) > tile:
        raise ValueError("a frame reaches further than a tile")
    at = F.col(ROW) - 1
    own = F.floor(at / tile)
    place = at % tile
    copies = F.array_compact(F.array(own, F.when(place >= tile - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    return rows.withColumn("_home", own).withColumn(OF, F.explode(copies)).withColumn(OWN, F.col(OF) == F.col("_home")).drop("_home")


def in_tile() -> WindowSpec:
    """The window of a tile's rows, halo included, in the order of the series."""
    return Window.partitionBy(SERIES, OF).orderBy(ROW)


def windowed(df: DataFrame, by: str | list[str], columns: Callable[[WindowSpec], list[dict[str, Column]]], before: int = 0, after: int = 0, ts: str = "ts", tie: tuple[str, ...] = (), tile: int | None = None, keep_row: bool = False) -> DataFrame:
    """``df`` with columns over frames that reach at most ``before`` and ``after`` rows, step after step."""
    rows = dealt(numbered(df, by, ts, tie), before, after, tile)
    for step in columns(in_tile()):
        rows = rows.withColumns(step)
    own = rows.where(OWN).drop(SERIES, OF, OWN)
    return own if keep_row else own.drop(ROW, SIZE)


def carry(rows: DataFrame, value: Column, name: str, later: bool = False, tile: int | None = None) -> DataFrame:
    """(_series, _tile, name): the last non-null ``value`` (struct fields may be null) before each tile of numbered
    rows, or with ``later`` the first one after it; one row a tile goes through the window."""
    at = F.floor((F.col(ROW) - 1) / (tile or TILE))
    best = F.min_by if later else F.max_by
    ends = rows.groupBy(SERIES, at.alias(OF)).agg(best(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.col(ROW))).alias("_end"))
    order = Window.partitionBy(SERIES).orderBy(F.desc(OF) if later else F.asc(OF)).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(SERIES, OF, F.last("_end", ignorenulls=True).over(order).alias(name))
