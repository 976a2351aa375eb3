"""Best-fit packing of documents into token sequences, planned over the histogram of lengths.

The driver sees one count for each length (at most ``capacity`` rows) and plans best-fit on
counts.  A plan row says: of the pieces of this length, those ranked from ``rank_start`` on go
to consecutive sequences from ``sequence_start`` on, at ``offset``.  Pieces take their slots by
a join on their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from opsweave.llm.bpe import VOCABULARY, encoder
from opsweave.llm.common import bytes_of, leave, stash

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that a task ranks.
ROWS_A_BUCKET = 100_000


def cut(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with ``END_ID`` after them,
    cut every ``capacity`` ids."""

    @leave("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder("index", vocabulary)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, ids in enumerate(worker.encode(bytes_of(batch.column(1)))):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[start * 4 : (start + capacity) * 4]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank_start, n, sequence_start, offset) rows."""
    plan = []
    room: list[int] = []  # the sizes of free room that some sequence has, ascending
    having: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first sequence, how many)
    opened = 0

    def put(size: int, run: tuple[int, int]) -> None:
        if size not in having:
            bisect.insort(room, size)
            having[size] = []
        having[size].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(room, length)
            if at == len(room):
                fresh = -(-left // (capacity // length))
                put(capacity, (opened, fresh))
                opened += fresh
                at = bisect.bisect_left(room, length)
            size = room[at]
            first, many = having[size].pop()
            used = min(many, left)
            if many > used:
                having[size].append((first + used, many - used))
            elif not having[size]:
                del having[size]
                room.pop(at)
            plan.append((length, rank, used, first, capacity - size))
            if size > length:
                put(size - length, (first, used))
            rank += used
            left -= used
    return plan


def rank_within(df: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    """Adds ``rank``, gapless from 0 within ``key``: a count for each (key, bucket) summed over the
    buckets before, plus the row's number in its bucket, so that a frequent key spreads out."""
    buckets = max(8, rows // ROWS_A_BUCKET)
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy(key, "_bucket").count().select(key, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (
        spread.withColumn("_nth", F.row_number().over(inside))
        .join(bases, [key, "_bucket"])
        .withColumn("rank", F.col("_base") + F.col("_nth") - 1)
        .drop("_bucket", "_base", "_nth")
    )


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    Null and empty texts are pieces of one id; repeated rows are packed as often as they occur; an
    empty table gives no pieces.  Other columns are ignored.
    """
    spark = df.sparkSession
    pieces = stash(cut(df, id_col, text, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    plan = spark.createDataFrame(best_fit(histogram, capacity), "_length long, rank_start long, n long, sequence_start long, offset long")
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], sum(histogram.values()))
    inside = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("rank_start")) & (F.col("rank") < F.col("rank_start") + F.col("n"))
    # The plan follows from at most `capacity` counts and not from the documents behind them.
    return ranked.join(F.broadcast(plan), inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_start") + F.col("rank") - F.col("rank_start")).alias("sequence_id"), "offset"
    )
