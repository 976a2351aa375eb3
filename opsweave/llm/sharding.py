"""Sharding by sampled splitters.

Keys are sampled in proportion to record size, quantiles of the sample are the splitters of many
small ranges, and the exact size of every range is counted.  Overfull ranges are subdivided by
sampling inside them; consecutive ranges then fill the shards evenly.  Records too large for that
(more than a ``1 / LARGE_SHARE`` of a shard; there are at most ``shards * LARGE_SHARE`` of them) are
dealt first, largest to the emptiest shard, and the ranges fill what is left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from opsweave.llm.common import stash

SHARDS = 40
#: Bytes that every record takes beside its text.
OVERHEAD = 16
#: Sampled keys for each range, and ranges for each shard.
SAMPLES_A_RANGE = 20
RANGES_A_SHARD = 64
LARGE_SHARE = 32
#: A range with more than this many times its share of bytes is overfull.
OVERFULL = 2.0


def _records(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, size, text_crc32, tie): ``tie`` orders records of one id, so that even rows which
    repeat id and text can be cut apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every record, law ``bytes``.

    A record's size is its text's UTF-8 bytes (none for null) plus ``OVERHEAD``.  Records are ordered
    by id (null first), those of one id in any order.  Slots count from 0 within each shard.  An empty table gives no rows.
    """
    spark = df.sparkSession
    records = stash(_records(df, id_col, text), "records").withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    total = records.agg(F.sum("size")).first()[0] or 0
    target = max(1.0, total / shards)
    large_at = max(1, int(target / LARGE_SHARE))
    # Sizes above a fixed share of a shard: fewer than shards * LARGE_SHARE rows exist.
    large = [tuple(r) for r in records.where(F.col("size") > large_at).select("k", "tie", "size", "text_crc32", "doc_id").collect()]
    small = records.where(F.col("size") <= large_at)
    loads, dealt = _deal(large, shards)

    splitters = _splitters(small, shards, target)
    ranged = small.withColumn("range", _range_column(spark, splitters)("k", "tie"))
    sizes = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    places = _fill(sizes, loads, target, shards)
    slots = {}
    filled = [0] * shards
    rows = []
    for key in sorted(sizes):
        to = places[key]
        rows.append((key, to, filled[to]))
        filled[to] += sizes[key][1]
    plan = spark.createDataFrame(rows, "range int, shard int, first_slot long")
    inside = Window.partitionBy("range").orderBy("k", "tie")
    light = (
        ranged.join(F.broadcast(plan), "range")  # one row for each range, whose number is a parameter
        .withColumn("slot", F.col("first_slot") + F.row_number().over(inside) - 1)
        .select("doc_id", "size", "text_crc32", "shard", "slot")
    )
    heavy_rows = []
    for (_, _, size, crc, doc), to in zip(large, dealt):
        heavy_rows.append((doc, size, crc, to, filled[to]))
        filled[to] += 1
    heavy = spark.createDataFrame(heavy_rows, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return light.unionByName(heavy).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _deal(large: list[tuple], shards: int) -> tuple[list[int], list[int]]:
    """Largest record first, each to the emptiest shard: loads of the shards, shard of each record."""
    large.sort(key=lambda x: (-x[2], x[0], x[1]))
    heap = [(0, s) for s in range(shards)]
    dealt = []
    for record in large:
        load, to = heapq.heappop(heap)
        dealt.append(to)
        heapq.heappush(heap, (load + record[2], to))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])], dealt


def _splitters(small: DataFrame, shards: int, target: float) -> list[tuple[int, int]]:
    """Ascending (key, tie) splitters such that no range is overfull, but for rows of one key and tie."""
    wanted = shards * RANGES_A_SHARD
    weight = small.agg(F.sum("size")).first()[0] or 0
    if not weight:
        return []
    chance = min(1.0, wanted * SAMPLES_A_RANGE / weight)
    found = _quantiles(_sample(small, chance, 0), wanted)
    share = weight / wanted
    round_ = 0
    while True:
        ranged = small.withColumn("range", _range_column(small.sparkSession, found)("k", "tie"))
        # A range of one key and tie cannot be cut further.
        heavy = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), (F.min(F.struct("k", "tie")) == F.max(F.struct("k", "tie"))).alias("one"))
        over = [r["range"] for r in heavy.where((F.col("bytes") > OVERFULL * share) & ~F.col("one")).collect()]  # at most one row a range
        if not over:
            return found
        # Sampled ever more densely, in the end by every key, so that each round cuts what is overfull.
        round_ += 1
        more = _sample(ranged.where(F.col("range").isin(over)), min(1.0, chance * 4**round_), round_)
        found = sorted(set(found) | set(_quantiles(more, wanted)))


def _sample(df: DataFrame, chance: float, seed: int) -> list[tuple[int, int]]:
    """About SAMPLES_A_RANGE keys for each range, drawn with a chance in proportion to size."""
    draw = (F.xxhash64(F.col("tie"), F.lit(seed)).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    picked = df.where(draw < F.least(F.lit(1.0), F.col("size") * F.lit(chance)))
    return sorted((r["k"], r["tie"]) for r in picked.select("k", "tie").collect())


def _quantiles(keys: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    if not keys:
        return []
    at = np.unique(np.linspace(0, len(keys), min(ranges, len(keys)) + 1, dtype=int)[1:-1])
    return sorted({keys[i] for i in at})


def _range_column(spark, splitters: list[tuple[int, int]]):
    """Column function (key, tie) -> number of splitters at or below it."""
    shared = spark.sparkContext.broadcast((np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64)))

    def find(k: pa.Array, tie: pa.Array) -> pa.Array:
        keys, ties = shared.value
        a, b = k.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(keys, a, "left"), np.searchsorted(keys, a, "right")
        out = high.astype(np.int32)
        for i in np.flatnonzero(high > low):  # splitters with this very key: the tie decides
            out[i] = low[i] + np.searchsorted(ties[low[i] : high[i]], b[i], "right")
        return pa.array(out, pa.int32())

    return F.arrow_udf(find, "int")


def _fill(sizes: dict[int, tuple[int, int]], loads: list[int], target: float, shards: int) -> dict[int, int]:
    """Shard of each range: consecutive ranges fill the room that each shard has left."""
    room = [max(0.0, target - load) for load in loads]
    total = sum(b for b, _ in sizes.values())
    scale = total / sum(room) if sum(room) else 0.0
    ends = np.cumsum([r * scale for r in room]) if scale else np.linspace(total / shards, total, shards)
    placed, done = {}, 0
    for key in sorted(sizes):
        middle = done + sizes[key][0] / 2
        placed[key] = int(min(shards - 1, np.searchsorted(ends, middle)))
        done += sizes[key][0]
    return placed
