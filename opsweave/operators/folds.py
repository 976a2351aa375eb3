"""Greedy folds over series by pointer jumping: which rows a chain of pointers from the first row reaches.

A fold such as a cooldown accepts a row, passes over what is too near, and goes on from the next one.  Every row's
next one is a search in time, independent of what is accepted.  Inside a tile of bounded size the pointers are
followed at once to the first row beyond it; these exits, few for each tile, are then doubled (1, 2, 4, ... tiles at a
jump) until all tiles that the chain enters are known; each tile marks its accepted rows from there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.operators import tiles
from opsweave.operators.tiles import BUCKET_SECONDS, OF, ROW, SERIES, SIZE
from opsweave.sources.shared import written

NEXT, ANCHOR = "_next", "_anchor"
#: How rows of all series meet: their files are so small, of repeating values, that Spark would broadcast millions of them.
SORTED = "merge"
#: Doubled jumps: more tiles than 2 ** 60 there are not.
MOST_ROUNDS = 60


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def first_from(rows: DataFrame, since: Column, ts: str = "ts", bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds ``_next`` to numbered rows: the number of the first later row of the series at or after ``since``
    (microseconds), one more than its size where there is none.

    Rows and searches are sorted together in buckets of time; one count a bucket goes through a window by series.
    """
    width = bucket_seconds * 1_000_000
    marks = rows.select(SERIES, micros(ts).alias("_at"), F.lit(1).alias("_is"), F.lit(None).cast("long").alias("_of"))
    asked = rows.select(SERIES, since.alias("_at"), F.lit(0).alias("_is"), F.col(ROW).alias("_of"))
    both = marks.unionByName(asked).withColumn("_bucket", F.floor(F.col("_at") / width))
    counts = both.groupBy(SERIES, "_bucket").agg(F.sum("_is").alias("_count"))
    earlier = Window.partitionBy(SERIES).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = counts.select(SERIES, "_bucket", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    so_far = Window.partitionBy(SERIES, "_bucket").orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_inside", F.sum("_is").over(so_far)).where("_is = 0")
    found = inside.join(offsets.hint(SORTED), [SERIES, "_bucket"]).select(SERIES, F.col("_of").alias(ROW), (F.col("_before") + F.col("_inside") + 1).alias(NEXT))
    return rows.join(found.hint(SORTED), [SERIES, ROW]).withColumn(NEXT, F.greatest(NEXT, F.col(ROW) + 1))


def next_change(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name`` to numbered rows: the number of the next row whose ``value`` is not that of the row before it."""
    order = tiles.in_tile()
    changed = F.when((F.col(ROW) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(order)), F.col(ROW))
    marked = tiles.dealt(rows, before=1).withColumn("_changed", changed).where(tiles.OWN).drop(tiles.OWN)
    after = Window.partitionBy(SERIES, OF).orderBy(F.desc(ROW)).rowsBetween(Window.unboundedPreceding, -1)
    later = tiles.carry(marked.drop(OF), F.col("_changed"), "_later", later=True)
    here = marked.withColumn("_here", F.last("_changed", ignorenulls=True).over(after)).join(later.hint(SORTED), [SERIES, OF])
    return here.withColumn(name, F.coalesce("_here", "_later", F.col(SIZE) + 1)).drop(OF, "_changed", "_here", "_later")


def exits(rows: DataFrame) -> DataFrame:
    """(_series, _row, _exit) of numbered rows with ``_next``: the first row beyond its tile that a row's chain reaches."""

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by(ROW)
        at, to = group[ROW].to_numpy(), group[NEXT].to_numpy().copy()
        first, end = int(at[0]), int(at[-1])
        for k in range(len(at) - 1, -1, -1):
            if to[k] <= end:
                to[k] = to[to[k] - first]
        return pa.table({SERIES: group[SERIES], ROW: at, "_exit": to})

    dealt = rows.withColumn(OF, F.floor((F.col(ROW) - 1) / tiles.TILE)).select(SERIES, OF, ROW, NEXT)
    kind = rows.schema[SERIES].dataType.simpleString()
    return dealt.groupBy(SERIES, OF).applyInArrow(follow, f"{SERIES} {kind}, {ROW} long, _exit long")


def entered(rows: DataFrame) -> DataFrame:
    """(_series, _tile, _entry): the tiles that the chain from row 1 enters, and where.  A series of one tile has no jumps."""
    out = written(exits(rows.where(F.col(SIZE) > tiles.TILE)), "exits")
    sizes = rows.select(SERIES, SIZE).distinct()
    places = out.select(SERIES, F.col("_exit").alias("_row")).distinct().unionByName(sizes.where(F.col(SIZE) > tiles.TILE).select(SERIES, F.lit(1).cast("long").alias("_row"))).distinct()
    jump = written(places.join(out.hint(SORTED), [SERIES, ROW]).join(sizes.hint(SORTED), SERIES).where(F.col("_exit") <= F.col(SIZE)).select(SERIES, F.col(ROW).alias("_from"), F.col("_exit").alias("_to")), "jumps")
    reached = sizes.select(SERIES, F.lit(1).cast("long").alias("_entry"))
    for _ in range(MOST_ROUNDS):
        if jump.isEmpty():
            break
        further = reached.join(jump.hint(SORTED), (reached[SERIES] == jump[SERIES]) & (F.col("_entry") == F.col("_from"))).select(reached[SERIES], F.col("_to").alias("_entry"))
        reached = written(reached.unionByName(further), "entries")
        second = jump.select(F.col(SERIES).alias("_s"), F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
        jump = written(jump.join(second.hint(SORTED), (F.col(SERIES) == F.col("_s")) & (F.col("_to") == F.col("_mid"))).select(SERIES, "_from", F.col("_end").alias("_to")), "jumps")
    else:
        raise RuntimeError("the chain did not end")
    return reached.select(SERIES, F.floor((F.col("_entry") - 1) / tiles.TILE).alias(OF), "_entry")


def accepted(rows: DataFrame) -> DataFrame:
    """Adds ``_anchor`` to numbered rows with ``_next``: whether the chain from the series' first row reaches the row."""
    rows = written(rows, "rows")
    starts = entered(rows)

    def mark(group: pa.Table) -> pa.Table:
        group = group.sort_by(ROW)
        at, to = group[ROW].to_numpy(), group[NEXT].to_numpy()
        first, end = int(at[0]), int(at[-1])
        hit = np.zeros(len(at), bool)
        now = group["_entry"][0].as_py()
        while now is not None and now <= end:
            hit[now - first] = True
            now = int(to[now - first])
        return pa.table({SERIES: group[SERIES], ROW: at, ANCHOR: hit})

    dealt = rows.withColumn(OF, F.floor((F.col(ROW) - 1) / tiles.TILE)).select(SERIES, OF, ROW, NEXT).join(starts.hint(SORTED), [SERIES, OF])
    kind = rows.schema[SERIES].dataType.simpleString()
    marks = dealt.groupBy(SERIES, OF).applyInArrow(mark, f"{SERIES} {kind}, {ROW} long, {ANCHOR} boolean")
    return rows.join(marks.where(ANCHOR).hint(SORTED), [SERIES, ROW], "left").withColumn(ANCHOR, F.coalesce(ANCHOR, F.lit(False)))


def anchor_of(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name`` to rows with ``_anchor``: the number of the last accepted row up to each row."""
    marked = rows.withColumn("_own_anchor", F.when(F.col(ANCHOR), F.col(ROW))).withColumn(OF, F.floor((F.col(ROW) - 1) / tiles.TILE))
    before = tiles.carry(marked.drop(OF), F.col("_own_anchor"), "_earlier")
    here = F.last("_own_anchor", ignorenulls=True).over(tiles.in_tile().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_here", here).join(before.hint(SORTED), [SERIES, OF]).withColumn(name, F.coalesce("_here", "_earlier")).drop(OF, "_here", "_earlier", "_own_anchor")
