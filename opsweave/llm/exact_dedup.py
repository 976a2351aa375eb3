"""Exact dedup by two-pass Bloom filtering.

Pass one fills a Bloom filter pair (slots hit once, slots hit again) over the hashes of all
rows; pass two asks for every row whether its slots were all hit again.  Only rows that may
repeat shuffle on their full SHA-256; all others pass straight through.  The filter is sized
from the row count up to ``max_filter_bits``; beyond that bound more unique rows shuffle, and
the result stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from opsweave.llm.common import ascii_lower, by_number, bytes_of, leave, stash

#: Slots of one filter segment: segments are merged apart from each other.
SEGMENT = 1 << 16
BITS_PER_ROW = 16
PROBES = 3
#: 2**28 bits are 32 MB, the most that is collected and broadcast.
MAX_FILTER_BITS = 1 << 28


def with_text_sha256(df: DataFrame, text: str = "text", out: str = "text_sha256") -> DataFrame:
    """Adds the SHA-256 (lowercase hex) of the text with A-Z lower-cased; null counts as empty."""

    @leave("exact_dedup")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([hashlib.sha256(ascii_lower(x or b"")).hexdigest() for x in bytes_of(column)], pa.string())

    return df.withColumn(out, F.arrow_udf(digest, T.StringType())(F.col(text).cast("string")))


def _slots(hexes: list[str], n_bits: int) -> np.ndarray:
    """``PROBES`` slots for each hash, shape (rows, PROBES), by double hashing."""
    raw = np.frombuffer(bytes.fromhex("".join(h[:32] for h in hexes)), ">u8").reshape(-1, 2).astype(np.uint64)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (raw[:, :1] + steps * (raw[:, 1:] | np.uint64(1))) & np.uint64(n_bits - 1)


def _seen_again(df: DataFrame, sha: str, n_bits: int) -> np.ndarray:
    """The merged filter: bit i is set if at least two rows hit slot i.  ``n_bits / 8`` bytes."""
    schema = "segment int, once binary, again binary"

    @leave("exact_dedup")
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition keeps one byte for each slot that it touches, by segment.
        touched: dict[int, np.ndarray] = {}
        for batch in batches:
            hexes = batch.column(0).to_pylist()
            if not hexes:
                continue
            rows = np.sort(_slots(hexes, n_bits), axis=1)
            fresh = np.ones(rows.shape, bool)
            fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]  # a row hits a slot once
            slots, hits = np.unique(rows[fresh], return_counts=True)
            where, bounds = np.unique(slots >> np.uint64(16), return_index=True)
            for k, part, n in zip(where.tolist(), np.split(slots, bounds[1:]), np.split(hits, bounds[1:])):
                counts = touched.setdefault(k, np.zeros(SEGMENT, np.uint8))
                at = (part & np.uint64(SEGMENT - 1)).astype(np.int64)
                counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)
        for k, counts in touched.items():
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([k], pa.int32()), "once": [_squeeze(counts > 0)], "again": [_squeeze(counts > 1)]}
            )

    @leave("exact_dedup")
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        once = again = np.zeros(SEGMENT // 8, np.uint8)
        for a, b in zip(group["once"].to_pylist(), group["again"].to_pylist()):
            a, b = _spread(a), _spread(b)
            again = again | b | (once & a)
            once = once | a
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": [again.tobytes()]})

    parts = df.select(sha).mapInArrow(fill, schema)
    merged = parts.groupBy("segment").applyInArrow(merge, "segment int, bits binary")
    bits = np.zeros(n_bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most MAX_FILTER_BITS / 8 bytes in all
        bits[row.segment * (SEGMENT // 8) : (row.segment + 1) * (SEGMENT // 8)] = np.frombuffer(row.bits, np.uint8)
    return bits


def _squeeze(flags: np.ndarray) -> bytes:
    """A segment as set positions when few are set, else as a bitmap."""
    at = np.flatnonzero(flags)
    return b"p" + at.astype("<u2").tobytes() if len(at) < SEGMENT // 16 else b"b" + np.packbits(flags, bitorder="little").tobytes()


def _spread(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1)
    flags = np.zeros(SEGMENT, bool)
    flags[np.frombuffer(data, "<u2", offset=1)] = True
    return np.packbits(flags, bitorder="little")


def filter_bits(rows: int, max_filter_bits: int = MAX_FILTER_BITS) -> int:
    """Power of two with ``BITS_PER_ROW`` slots a row, within [SEGMENT, max_filter_bits]."""
    return max(SEGMENT, min(max_filter_bits, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))


def candidate_filter(hashes: DataFrame, sha: str = "text_sha256", max_filter_bits: int = MAX_FILTER_BITS) -> Callable[[list[str]], np.ndarray]:
    """Pass one over ``hashes``; gives the function of pass two, which runs in tasks and is false only
    for hashes that a single row has."""
    n_bits = filter_bits(hashes.count(), max_filter_bits)
    shared = hashes.sparkSession.sparkContext.broadcast(_seen_again(hashes, sha, n_bits))

    def may_repeat(hexes: list[str]) -> np.ndarray:
        if not hexes:
            return np.zeros(0, bool)
        slots = _slots(hexes, n_bits)
        hit = (shared.value[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1
        return hit.all(axis=1)

    return may_repeat


def candidate_flag(may_repeat: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """Pass two as a function of a column of hashes."""

    @leave("exact_dedup")
    def probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(may_repeat(column.to_pylist()), pa.bool_())

    return F.arrow_udf(probe, T.BooleanType())


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``df``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty.  Of equal
    texts the row with the largest id stays (a null id counts as the smallest).  Rows that repeat
    both id and text are one group of which a single row is kept.  An empty table gives none.
    """
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    hashes = stash(with_text_sha256(named).drop("text"), "hashes")
    may_repeat = candidate_flag(candidate_filter(hashes, max_filter_bits=max_filter_bits))
    flagged = hashes.withColumn("may_repeat", may_repeat("text_sha256"))
    alone = flagged.where(~F.col("may_repeat")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    again = flagged.where("may_repeat")
    # One row for each hash and id first: ties are settled there, and hot hashes shrink map-side.
    rows = again.withColumn("nth", F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id")))
    # Written down, so that the join below has a shuffle on either side and Spark can split a hot hash.
    groups = stash(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    marked = rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )
    return alone.unionByName(marked)


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever their names: of equal texts the row with
    the largest id (null is the smallest), once where rows repeat id and text.  A null text counts as
    empty; an empty table stays empty."""
    sha, flag, found, names = "sha", "may_repeat", "found", df.columns
    df, (id_col, text) = by_number(df, id_col, text)
    hashes = stash(with_text_sha256(df.select(F.col(id_col).alias("_k_id"), text), text, "_k_sha").select("_k_id", "_k_sha"), "hashes")
    may_repeat = candidate_filter(hashes, "_k_sha", max_filter_bits)

    @leave("exact_dedup")
    def hash_and_probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Both in one function: two in a row would take two Python workers for each task.
        for column in batches:
            hexes = [hashlib.sha256(ascii_lower(x or b"")).hexdigest() for x in bytes_of(column)]
            yield pa.StructArray.from_arrays([pa.array(hexes, pa.string()), pa.array(may_repeat(hexes), pa.bool_())], ["sha", "again"])

    keepers = hashes.where(candidate_flag(may_repeat)("_k_sha")).groupBy("_k_sha").agg(F.max("_k_id").alias("_k_id"))
    # Not deterministic, as far as Spark knows: else the filters on its result are pushed down as calls of their own.
    probe = F.arrow_udf(hash_and_probe, "sha string, again boolean").asNondeterministic()
    probed = df.withColumn(found, probe(F.col(text).cast("string")))
    flagged = probed.withColumns({sha: F.col(f"{found}.sha"), flag: F.col(f"{found}.again")})
    # Hash and id together are the key, so that a large group of copies spreads out.
    again = flagged.where(flag).join(keepers, (F.col(sha) == F.col("_k_sha")) & F.col(id_col).eqNullSafe(F.col("_k_id")), "left_semi")
    again = again.dropDuplicates([sha, id_col])  # rows that repeat id and text: the hash stands for the text
    return flagged.where(~F.col(flag)).unionByName(again).select(*df.columns).toDF(*names)
