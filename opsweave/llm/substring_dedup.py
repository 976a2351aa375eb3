"""Substring dedup: every window of ``width`` words that starts earlier elsewhere is removed.

Rabin-Karp hashes of all windows are counted in Spark.  Documents are dealt into chunks by a hash
of id and text; one shuffle of the texts serves all three passes over them.

1. A chunk sends the distinct fingerprints of its windows (a few bytes each, sorted, without
   places) to buckets, which say which of them other chunks have too.
2. Only windows whose fingerprint occurs twice are sent on, with the full hash, 32 bits of a second
   one, document and start; buckets find the earliest window of each pair of hashes and name the others.
3. Windows of a chunk then merge into maximal removal intervals of words.

A chunk sends at most 2 ** BUCKET_BITS rows in each pass while buckets have room, and never more
rows than windows: what is sent grows in proportion to the text.  Among n windows about
n**2 / 2**97 pairs of unlike windows share both hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsweave.llm.common import bytes_of, leave, pack_sorted, pack_uint, unpack_sorted, unpack_uint, width_of, words_of
from opsweave.llm.rolling import SECOND_BASE, letters_of, roll

WIDTH = 20
#: Bytes of text that a chunk has on average, and bytes of text that give one window, about.
CHUNK_BYTES = 4 << 20
BYTES_A_WINDOW = 6
#: Leading bits that name a bucket, so long as a bucket has at most BUCKET_WINDOWS windows.
BUCKET_BITS = 12
FEW_WINDOWS = 1 << 18
BUCKET_WINDOWS = 1 << 21

_SIGN = np.uint64(1 << 63)


def bucket_bits(total_bytes: int) -> int:
    """Leading hash bits that name a bucket."""
    windows = max(1, total_bytes / BYTES_A_WINDOW)
    return max(3, min(BUCKET_BITS, int(np.ceil(np.log2(windows / FEW_WINDOWS)))), int(np.ceil(np.log2(windows / BUCKET_WINDOWS))))


def fingerprint_bits(total_bytes: int) -> int:
    """Bits of a fingerprint: one window in about a hundred has that of an unlike one."""
    return min(64, max(16, int(total_bytes / BYTES_A_WINDOW).bit_length() + 7))


def _bytes_at(data: pa.ChunkedArray) -> list[bytes]:
    return data.cast(pa.large_binary()).to_pylist()


class _Chunk:
    """The distinct documents of a chunk by (id, fingerprint of the text), null ids first."""

    def __init__(self, ids: list[int | None], prints: list[int], texts: list[bytes | None]):
        self.keys = [(i is not None, i or 0, p) for i, p in zip(ids, prints)]
        bodies = dict(zip(self.keys, texts))
        self.docs = sorted(bodies)
        self.words = [words_of(bodies[d]) for d in self.docs]

    def hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all windows, number of the first window of each document and of the end)."""
        self.letters = [letters_of(w) for w in self.words]
        found = [roll(x, width) for x in self.letters]
        return np.concatenate([np.zeros(0, np.uint64), *found]), np.cumsum([0, *map(len, found)])


def _by_bucket(ordered: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of ascending values."""
    if len(ordered):
        buckets, begins = np.unique(ordered >> np.uint64(shift), return_index=True)
        yield from zip(buckets.tolist(), begins.tolist(), [*begins[1:].tolist(), len(ordered)])


def _repeated(key: tuple, group: pa.Table) -> pa.Table:
    """For each chunk of a bucket, one bit for each of its fingerprints: another chunk has it too."""
    prints = [unpack_sorted(x) for x in group["prints"].to_pylist()]
    everything = np.concatenate(prints)
    order = np.argsort(everything, kind="stable")
    ordered = everything[order]
    same = np.zeros(len(ordered) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(ordered), bool)
    shared[order[same[1:] | same[:-1]]] = True
    parts = np.split(shared, np.cumsum([len(x) for x in prints])[:-1])
    some = [i for i, part in enumerate(parts) if part.any()]
    return pa.table({"chunk": group["chunk"].take(pa.array(some, pa.int64())), "bucket": pa.array([key[0].as_py()] * len(some), pa.int64()), "flags": pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary())})


def _pack_places(valid: np.ndarray, codes: np.ndarray, starts: np.ndarray, docs: np.ndarray, second: np.ndarray) -> list[bytes]:
    """Columns of windows: whether the id is there, id, start, document of the chunk, second hash."""
    low = codes.min() if len(codes) else np.uint64(0)
    columns = (codes - low, starts, docs)
    widths = [width_of(np.asarray(c, np.uint64)) for c in columns]
    body = [bytes(widths), int(low).to_bytes(8, "little"), *(pack_uint(np.asarray(c), w) for c, w in zip(columns, widths))]
    return [np.packbits(valid).tobytes(), b"".join(body), second.astype("<u4").tobytes()]


def _unpack_places(n: int, valid: bytes, body: bytes, second: bytes) -> list[np.ndarray]:
    widths, low, at, columns = body[:3], np.frombuffer(body, "<u8", 1, 3)[0], 11, []
    for w in widths:
        columns.append(unpack_uint(body[at : at + n * w], w))
        at += n * w
    return [np.unpackbits(np.frombuffer(valid, np.uint8), count=n).astype(bool), columns[0] + low, columns[1].astype(np.int64), columns[2].astype(np.int64), np.frombuffer(second, "<u4")]


def _later(key: tuple, group: pa.Table) -> pa.Table:
    """(document, start) by chunk of a bucket's windows that are not the earliest of their hashes."""
    if key[0].as_py() < 0:  # what a chunk keeps for itself passes through
        return pa.table({"chunk": group["chunk"], "docs": group["places"], "starts": group["second"]})
    chunks = group["chunk"].to_pylist()
    hashes = [unpack_sorted(x) for x in group["hashes"].to_pylist()]
    rows = [_unpack_places(len(h), *x) for h, *x in zip(hashes, *(group[c].to_pylist() for c in ("valid", "places", "second")))]
    valid, codes, starts, docs, second = (np.concatenate(c) for c in zip(*rows))
    row = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
    first = np.concatenate(hashes)
    del hashes, rows
    order = np.lexsort((starts, codes, valid, second, first))
    head = np.ones(len(order), bool)
    head[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    lead = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(order))))
    later = np.sort(order[(codes[order] != codes[lead]) | (valid[order] != valid[lead]) | (starts[order] > starts[lead])])
    out = []
    for i in np.unique(row[later]).tolist():
        a, b = np.searchsorted(row[later], [i, i + 1])
        out.append((chunks[i], docs[later[a:b]].astype("<u4").tobytes(), starts[later[a:b]].astype("<u4").tobytes()))
    columns = list(zip(*out)) or [[], [], []]
    return pa.table({"chunk": pa.array(columns[0], pa.int64()), "docs": pa.array(columns[1], pa.binary()), "starts": pa.array(columns[2], pa.binary())})


def _merge_intervals(starts: np.ndarray, width: int) -> np.ndarray:
    """[begin, end) word pairs, flat, covered by the windows with these starts."""
    starts = np.unique(starts)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + width)
    begins, ends = starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + width
    return np.stack([begins, ends], axis=1).ravel()


def _by_chunk(rows: DataFrame, width: int, finish: Callable, schema: str) -> DataFrame:
    """``finish(group, words of each row, spans of each row)`` for the rows of every chunk, where
    ``rows`` has columns _id, _text, _print and _chunk, and spans are None where nothing goes."""
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks, bits, print_bits = max(1, total // CHUNK_BYTES), bucket_bits(total), fingerprint_bits(total)
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_print", F.monotonically_increasing_id()), F.lit(chunks)))

    def chunk_of(group: pa.Table) -> _Chunk:
        return _Chunk(group["_id"].to_pylist(), group["_print"].to_pylist(), _bytes_at(group["_text"]))

    @leave("substring_dedup")
    def send_prints(key: tuple, group: pa.Table) -> pa.Table:
        hashes, _ = chunk_of(group).hashes(width)
        prints = np.unique(hashes >> np.uint64(64 - print_bits))
        out = [(bucket, pack_sorted(prints[a:b])) for bucket, a, b in _by_bucket(prints, print_bits - bits)]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "prints": pa.array([x[1] for x in out], pa.binary())})

    @leave("substring_dedup")
    def send_windows(key: tuple, group: pa.Table, flags: pa.Table) -> pa.Table:
        chunk, number = chunk_of(group), key[0].as_py()
        hashes, firsts = chunk.hashes(width)
        prints, which, counts = np.unique(hashes >> np.uint64(64 - print_bits), return_inverse=True, return_counts=True)
        twice = counts > 1
        places = {bucket: (a, b) for bucket, a, b in _by_bucket(prints, print_bits - bits)}
        for bucket, packed in zip(flags["bucket"].to_pylist(), flags["flags"].to_pylist()):
            a, b = places[bucket]
            twice[a:b] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
        taken = np.flatnonzero(twice[which])
        del prints, which, counts, twice
        first = hashes[taken]
        doc = np.searchsorted(firsts, taken, "right") - 1
        start = taken - firsts[doc]
        second = np.zeros(len(taken), np.uint32)
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
            second[a:b] = roll(chunk.letters[doc[a]], width, SECOND_BASE)[start[a:b]] >> np.uint64(32)
        valid = np.array([d[0] for d in chunk.docs], bool)[doc]
        codes = np.array([d[1] for d in chunk.docs], np.int64).view(np.uint64)[doc] ^ _SIGN
        # Of windows that are alike in the chunk the earliest goes; the others stay behind as repeats.
        order = np.lexsort((start, codes, valid, second, first))
        head = np.ones(len(order), bool)
        head[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        lead = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(order))))
        local = order[(codes[order] != codes[lead]) | (valid[order] != valid[lead]) | (start[order] > start[lead])]
        out: list[tuple] = []
        if len(local):
            out.append((-1 - number, b"", b"", doc[local].astype("<u4").tobytes(), start[local].astype("<u4").tobytes()))
        sent = order[head]
        for bucket, a, b in _by_bucket(first[sent], 64 - bits):
            at = sent[a:b]
            valid_, places_, second_ = _pack_places(valid[at], codes[at], start[at], doc[at], second[at])
            out.append((bucket, pack_sorted(first[at]), valid_, places_, second_))
        columns = list(zip(*out)) or [[]] * 5
        return pa.table(
            {"bucket": pa.array(columns[0], pa.int64()), "chunk": pa.array([number] * len(out), pa.int64())}
            | {name: pa.array(c, pa.binary()) for name, c in zip(("hashes", "valid", "places", "second"), columns[1:])}
        )

    @leave("substring_dedup")
    def settle_chunk(key: tuple, group: pa.Table, later: pa.Table) -> pa.Table:
        chunk = chunk_of(group)
        gone: dict[tuple, np.ndarray] = {}
        if len(later):
            doc, start = (np.frombuffer(b"".join(later[c].to_pylist()), "<u4").astype(np.int64) for c in ("docs", "starts"))
            order = np.argsort(doc, kind="stable")
            doc, start = doc[order], start[order]
            cuts = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
                gone[chunk.docs[doc[a]]] = _merge_intervals(start[a:b], width)
        words = dict(zip(chunk.docs, chunk.words))
        return finish(group, [words[k] for k in chunk.keys], [gone.get(k) for k in chunk.keys])

    prints = rows.groupBy("_chunk").applyInArrow(send_prints, "bucket long, chunk long, prints binary")
    flags = prints.groupBy("bucket").applyInArrow(leave("substring_dedup")(_repeated), "chunk long, bucket long, flags binary")
    sent = rows.groupBy("_chunk").cogroup(flags.groupBy("chunk")).applyInArrow(send_windows, "bucket long, chunk long, hashes binary, valid binary, places binary, second binary")
    later = sent.groupBy("bucket").applyInArrow(leave("substring_dedup")(_later), "chunk long, docs binary, starts binary")
    return rows.groupBy("_chunk").cogroup(later.groupBy("chunk")).applyInArrow(settle_chunk, schema)


def _rows(df: DataFrame, id_col: str, text: str, *others: str) -> DataFrame:
    body = F.col(text).cast("string")
    return df.select(F.col(id_col).cast("long").alias("_id"), body.alias("_text"), F.xxhash64(body).alias("_print"), *(F.col(f"`{c}`").alias(f"_other{k}") for k, c in enumerate(others)))


def removal_intervals(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, text_print, spans): for documents that lose words, the ascending [begin, end) word
    numbers to remove as one flat array.  ``text_print`` is ``xxhash64`` of the text.

    A window counts as repeated when its words also start at a smaller id (null is the smallest),
    or at an earlier word of the same id.  Rows that repeat id and text count as one document and
    give one row each; null and empty texts, and an empty table, give none.
    """

    def finish(group: pa.Table, words: list, spans: list) -> pa.Table:
        some = [i for i, s in enumerate(spans) if s is not None]
        at = pa.array(some, pa.int64())
        return pa.table({"doc_id": group["_id"].take(at), "text_print": group["_print"].take(at), "spans": pa.array([spans[i].tolist() for i in some], pa.list_(pa.int32()))})

    return _by_chunk(_rows(df, id_col, text), width, finish, "doc_id long, text_print long, spans array<int>")


def _kept(words: list, spans: np.ndarray) -> list:
    """The words outside of the spans."""
    out, at = [], 0
    for begin, end in spans.reshape(-1, 2).tolist():
        out += words[at:begin]
        at = end
    return out + words[at:]


def digest_removals(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row, repeated ones too; a null or empty
    text has no words, and an empty table gives no rows."""

    def finish(group: pa.Table, words: list, spans: list) -> pa.Table:
        kept = [w if s is None else _kept(w, s) for w, s in zip(words, spans)]
        return pa.table(
            {
                "doc_id": group["_id"],
                "n_words": pa.array(map(len, words), pa.int64()),
                "n_removed": pa.array([len(w) - len(k) for w, k in zip(words, kept)], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string()),
            }
        )

    return _by_chunk(_rows(df, id_col, text), width, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_GAP = re.compile(rb"([\x20\x09-\x0D]+)")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with the repeated words, and the white space before them, cut out of its texts.

    All rows and columns stay, repeated rows too; a text that loses nothing stays as it is, null
    included; an empty table stays empty.  Columns must be of types that Spark hands to Arrow.
    """
    text_at = df.columns.index(text)

    def finish(group: pa.Table, words: list, spans: list) -> pa.Table:
        columns = {c: group[f"_other{k}"] for k, c in enumerate(others)}
        out = []
        for body, gone in zip(_bytes_at(group["_text"]), spans):
            if gone is not None:
                parts = _GAP.split(body.strip())
                body = b"".join(_kept([gap + word for gap, word in zip([b"", *parts[1::2]], parts[::2])], gone)).strip()
            out.append(body)
        columns[body_name] = pa.array([None if x is None else x.decode() for x in out], pa.string())
        return pa.table({c: columns[c] for c in names})

    # Columns are known by number on the way, so that no name clashes.
    named = df.toDF(*(f"c{k}" for k in range(len(df.columns)))).withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    names, body_name = named.columns, f"c{text_at}"
    others = [c for c in names if c != body_name]
    rows = _rows(named, f"c{df.columns.index(id_col)}", body_name, *others)
    cut = _by_chunk(rows, width, finish, named.schema)
    return cut.select(*(F.col(f"c{k}").alias(n) if k == text_at else F.col(f"c{k}").cast(df.schema[k].dataType).alias(n) for k, n in enumerate(df.columns)))
