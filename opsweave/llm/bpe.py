"""Byte-pair encoding and decoding with a public word-level vocabulary.

New words are encoded many at a time: a pair occurrence index holds the mergeable pairs at all
positions of the batch, each word's ranks are applied in ascending order, those of all words in
the same rounds, and the neighbouring pairs are updated in the index.  Encodings of words are kept
in a bounded cache.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from opsweave.llm.common import CACHES, bytes_of, leave, release

VOCABULARY = "word_bpe_49k.json"
#: Words that a cache holds besides those of the last batch.
CACHE_WORDS = 400_000
#: Bytes of text whose words are numbered together.
BATCH_BYTES = 4 << 20
#: New words that are merged together.
WORDS_TOGETHER = 1 << 14
#: Bytes of a word beyond which it is encoded by itself.
LONG_WORD = 64
#: Bits of a slot's number in the hash table of pairs, five slots for each pair of the vocabulary.
SLOT_BITS = 18

# Fixed value of the vocabulary's file: its split pattern; here a line feed, which no part has, stands by itself.
SPLIT = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@functools.cache
def _newer() -> frozenset[str]:
    """Characters that ``regex`` knows and Python's Unicode tables do not: for them only the library
    itself says what is a letter and what its small form is."""
    points = [c for c in [*range(0x32400), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    known = regex.compile(r"\P{Cn}")
    return frozenset(chr(c) for c in points if known.match(chr(c)))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


class PairIndexEncoder:
    """Encodes batches of words with the merges of a vocabulary file.

    ``encode_words`` gives the ids of each word as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"]
        letters = byte_alphabet()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + suffix] for c in letters], np.int32)
        pairs = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in model["merges"]], np.int64)
        #: By rank, then for no rank: what the pair becomes.
        self.merged = np.array([*(vocabulary[a + b] for a, b in model["merges"]), -1], np.int32)
        #: Pairs as one integer, and the lowest rank of each.
        self.pairs, first = np.unique(pairs, return_index=True)
        self.ranks = first.astype(np.int32)
        self.no_rank = len(pairs)
        self._fill()
        # The lowest rank that each token takes part in.  A merge whose result takes part in one of lower rank is taken
        # once at a time, since that one goes first.
        lowest = np.full(1 << 20, self.no_rank, np.int32)
        np.minimum.at(lowest, self.pairs >> 20, self.ranks)
        np.minimum.at(lowest, self.pairs & (1 << 20) - 1, self.ranks)
        self._long: tuple[dict, dict] | None = None
        self.singly = np.append(lowest[self.merged[:-1]] < np.arange(self.no_rank), False)

    def _fill(self) -> None:
        """The hash table that ``_ranks_of`` looks into: a pair lies in its slot or in the ones after it, which are taken."""
        self.slots = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot_ranks = np.full(1 << SLOT_BITS, self.no_rank, np.int32)
        left, at = np.arange(len(self.pairs)), _slot(self.pairs)
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            placed = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[placed]] = self.pairs[left[placed]]
            self.slot_ranks[at[placed]] = self.ranks[left[placed]]
            left, at = np.delete(left, placed), (np.delete(at, placed) + 1) % len(self.slots)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left.astype(np.int64) << 20 | right
        at = _slot(pairs)
        held = self.slots[at]
        ranks = np.where(held == pairs, self.slot_ranks[at], np.int32(self.no_rank))
        further = np.flatnonzero((held != pairs) & (held >= 0))
        at = at[further]
        while len(further):
            at = at + 1 & len(self.slots) - 1
            held, wanted = self.slots[at], pairs[further]
            same = held == wanted
            ranks[further[same]] = self.slot_ranks[at[same]]
            on = ~same & (held >= 0)
            further, at = further[on], at[on]
        return ranks

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        data = [word.encode() for word in words]
        short = self._encode_short([word for word in data if len(word) <= LONG_WORD])
        if len(short) == len(data):
            return short
        found = iter(short)
        return [next(found) if len(word) <= LONG_WORD else self._encode_long(word) for word in data]

    def _start(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of all words, a number for the word of each, and the rank of each with its follower."""
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = self.last[raw[ends]]
        ranks = np.full(len(raw), self.no_rank, np.int32)
        ranks[:-1] = self._ranks_of(symbols[:-1], symbols[1:])
        ranks[ends] = self.no_rank
        return symbols, np.repeat(np.arange(len(data)), lengths), ranks

    def _encode_short(self, data: list[bytes]) -> list[bytes]:
        """All words together.  The index is an array of the rank of the pair at each position; in each round every word
        takes its lowest one, at all positions that have it, and the pairs beside these are looked up again."""
        symbols, word, ranks = self._start(data)
        size = len(symbols)
        # The followers and forerunners within the words; none is `size`, a place of its own.
        after = np.arange(1, size + 1)
        before = np.arange(-1, size)
        borders = np.flatnonzero(word[1:] != word[:-1])
        after[borders] = size
        before[borders + 1] = size
        before[:1] = size
        after[-1:] = size
        symbols, ranks = np.append(symbols, -1), np.append(ranks, np.int32(self.no_rank))
        while len(live := np.flatnonzero(ranks < self.no_rank)):
            found, owner = ranks[live], word[live]
            firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(found, firsts)
            take = found == np.repeat(lowest, np.diff(firsts, append=len(live)))
            at, rank = live[take], found[take]
            # Of overlapping ones (aaa) every other one is taken, from the left.
            follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
            keep = np.ones(len(at), bool)
            if follows.any():
                place = np.arange(len(at))
                keep = (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0
            if (single := self.singly[rank]).any():
                of = word[at]
                keep &= ~single | np.concatenate([[True], of[1:] != of[:-1]])
            at, rank = at[keep], rank[keep]
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone] = self.merged[rank], -1
            ranks[gone] = self.no_rank
            after[at] = beyond
            before[beyond] = at
            previous = before[at]
            changed = np.concatenate([at[beyond < size], previous[previous < size]])
            ranks[at] = self.no_rank
            ranks[changed] = self._ranks_of(symbols[changed], symbols[after[changed]])
        kept = np.flatnonzero(symbols[:-1] >= 0)
        ids = symbols[kept].astype("<u4").tobytes()
        bounds = (4 * np.searchsorted(word[kept], np.arange(len(data) + 1))).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def _encode_long(self, data: bytes) -> bytes:
        """One long word: its index maps each rank to the positions, and ranks are applied in ascending order."""
        start, _, found_ranks = self._start([data])
        symbols = start.tolist()
        end = len(symbols)
        after = [*range(1, end), -1]
        before = [*range(-1, end - 1)]
        index: dict[int, list[int]] = {}
        for at, rank in enumerate(found_ranks.tolist()):
            if rank < self.no_rank:
                index.setdefault(rank, []).append(at)
        active = list(index)
        heapq.heapify(active)
        ranks, sources = self._pairs_long()
        while active:
            rank = heapq.heappop(active)
            if rank not in index:
                continue
            pair, merged = sources[rank]
            positions = sorted(index.pop(rank))
            for k, at in enumerate(positions):
                following = after[at]
                if following < 0 or symbols[at] < 0 or symbols[at] << 20 | symbols[following] != pair:
                    continue  # another merge has taken one of the two
                symbols[at], symbols[following] = merged, -1
                beyond = after[at] = after[following]
                lowest = rank
                if beyond >= 0:
                    before[beyond] = at
                    if (found := ranks.get(merged << 20 | symbols[beyond])) is not None:
                        if found not in index:
                            heapq.heappush(active, found)
                        index.setdefault(found, []).append(at)
                        lowest = min(lowest, found)
                if (previous := before[at]) >= 0 and (found := ranks.get(symbols[previous] << 20 | merged)) is not None:
                    if found not in index:
                        heapq.heappush(active, found)
                    index.setdefault(found, []).append(previous)
                    lowest = min(lowest, found)
                if lowest < rank:  # a pair of lower rank came up: it goes first, the rest wait
                    index.setdefault(rank, []).extend(positions[k + 1 :])
                    heapq.heappush(active, rank)
                    break
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    def _pairs_long(self) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
        """(pair -> rank, rank -> pair and what it becomes), made when the first long word comes."""
        if self._long is None:
            pairs, ranks = self.pairs.tolist(), self.ranks.tolist()
            self._long = dict(zip(pairs, ranks)), {r: (p, m) for p, r, m in zip(pairs, ranks, self.merged[self.ranks].tolist())}
        return self._long


@functools.cache
def _library(path: str) -> Tokenizer:
    """The library's tokenizer; what reading its file took goes back to the machine."""
    found = Tokenizer.from_file(path)
    release()
    return found


class LibraryEncoder:
    """The same interface over the tokenizers library: its model encodes one split word a call."""

    def __init__(self, path: str):
        library = _library(path)
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.model = library.model
        self.letters = dict(enumerate(byte_alphabet()))

    def encode_words(self, words: list[str]) -> list[bytes]:
        as_letters = (word.encode().decode("latin-1").translate(self.letters) for word in words)
        return [array("I", [token.id for token in self.model.tokenize(word)]).tobytes() for word in as_letters]


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.large_binary())


class IdCache:
    """Ids of words as Arrow arrays: ``now`` has the words and ``ids`` theirs.  Once there are more than ``limit``,
    only those of the last call stay."""

    def __init__(self, limit: int):
        self.limit = limit
        self.now = self.ids = _binary([])

    def ids_of(self, words: pa.Array, work_out: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of distinct words; ``work_out`` gives those of words that are not held."""
        at = pc.index_in(words, value_set=self.now)
        places = pc.fill_null(at, 0).to_numpy().copy()
        if at.null_count:
            absent = at.is_null()
            fresh = words.filter(absent)
            places[absent.to_numpy(zero_copy_only=False)] = len(self.now) + np.arange(len(fresh))
            self.now, self.ids = pa.concat_arrays([self.now, fresh]), pa.concat_arrays([self.ids, work_out(fresh)])
        found = self.ids.take(pa.array(places))
        if len(self.now) > self.limit:
            self.now, self.ids = words, found
        return found


def _numbered(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The distinct words, and the number of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary.view(pa.large_binary()), coded.indices


def _joined(ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """Joins rows up to each of ``ends``."""
    _, offsets, data = ids.buffers()
    bounds = np.frombuffer(offsets, np.int64)[np.append(0, ends)] if len(ids) else np.zeros(len(ends) + 1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), data])


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, by way of cached words.

    No match of the split pattern spans white space, so a text is the sequence of its
    white-space-separated parts, and each distinct part is encoded once.  Arrow splits and numbers
    them; only distinct parts pass through Python, and their ids take the place of the numbers.
    """

    def __init__(self, words: PairIndexEncoder | LibraryEncoder, path: str):
        self.words = words
        self.path = path
        self.bytes_of_letters = {letter: i for i, letter in enumerate(byte_alphabet())}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, words.special)) + ")")
        self.fixed = {piece: array("I", [i]).tobytes() for piece, i in words.special.items()} | {"\n": b""}
        self.parts = IdCache(CACHE_WORDS)
        self.pieces = IdCache(CACHE_WORDS)

    def _split(self, text: str) -> list[str]:
        """The pieces of parts with a line feed between one and the next, which stays between their pieces."""
        if self.specials.search(text) or not text.isascii() and not _newer().isdisjoint(set(text)):
            found: list[str] = []
            for part in text.split("\n"):
                found += ["\n", *self._split_rare(part)]
            return found[1:]
        return self._pieces(text)

    @staticmethod
    def _pieces(text: str) -> list[str]:
        # A capital sigma becomes a plain one wherever it stands, as in the library.
        return SPLIT.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _split_rare(self, part: str) -> list[str]:
        found = []
        for span in self.specials.split(part):
            if span in self.words.special:
                found.append(span)
            elif _newer().isdisjoint(span):
                found += self._pieces(span) if span else []
            else:
                library = _library(self.path)
                letters = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(span))
                found += [bytes(map(self.bytes_of_letters.__getitem__, piece)).decode() for piece, _ in letters]
        return found

    def _ids_of_parts(self, parts: pa.Array) -> pa.Array:
        split = pa.array(self._split(b"\n".join(parts.to_numpy(zero_copy_only=False)).decode()), pa.large_string())
        pieces, numbers = _numbered(split)
        borders = np.flatnonzero(pc.equal(split, "\n").to_numpy(zero_copy_only=False))
        return _joined(self.pieces.ids_of(pieces, self._ids_of_pieces).take(numbers), np.append(borders, len(split)))

    def _ids_of_pieces(self, pieces: pa.Array) -> pa.Array:
        words = pieces.view(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        found = []
        for first in range(0, len(words), WORDS_TOGETHER):
            some = words[first : first + WORDS_TOGETHER]
            new = iter(self.words.encode_words([word for word in some if word not in self.fixed]))
            found.append(_binary([self.fixed[word] if word in self.fixed else next(new) for word in some]))
        return pa.concat_arrays(found)

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        batch: list[bytes | None] = []
        held = 0
        for text in texts:
            batch.append(text)
            held += len(text or b"")
            if held > BATCH_BYTES:
                yield from self._flush(batch)
                batch, held = [], 0
        yield from self._flush(batch)

    def _flush(self, batch: list[bytes | None]) -> Iterator[bytes]:
        # Arrow has an empty part at either end of a text that begins or ends with white space; it has no ids.
        split = pc.ascii_split_whitespace(_binary(batch).view(pa.large_string()))
        parts, numbers = _numbered(split.flatten())
        ends = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())
        yield from _joined(self.parts.ids_of(parts, self._ids_of_parts).take(numbers), ends).to_numpy(zero_copy_only=False)


@functools.cache
def _pair_index(path: str) -> PairIndexEncoder:
    """The vocabulary's arrays, some 5 MB, which a worker keeps from task to task; words are dropped."""
    return PairIndexEncoder(path)


@functools.cache
def encoder(kind: str, vocabulary: str = VOCABULARY) -> TextEncoder:
    """One encoder for each Python worker, with its caches."""
    path = public_tokenizers.path(vocabulary)
    found = TextEncoder({"index": _pair_index, "library": LibraryEncoder}[kind](path), path)
    release()
    return found


CACHES += [encoder.cache_clear, _library.cache_clear]


@functools.cache
def _tokens(vocabulary: str) -> dict[int, str]:
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        spec = json.load(file)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def decode_bytes(ids: bytes, vocabulary: str = VOCABULARY) -> str:
    """The text of ids given as little-endian unsigned 32-bit integers: their tokens joined by
    one space, as the library does for a file without a decoder."""
    return " ".join(map(_tokens(vocabulary).__getitem__, memoryview(ids).cast("I")))


def encode_column(df: DataFrame, text: str = "text", out: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``out``, the ids of each text as an array of ints.

    Null texts count as empty and give an empty array; an empty table gives an empty table.
    """

    @leave("bpe")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker = encoder("index", vocabulary)
        for column in batches:
            yield pa.array([list(memoryview(x).cast("I")) for x in worker.encode(bytes_of(column))], pa.list_(pa.int32()))

    return df.withColumn(out, F.arrow_udf(run, "array<int>")(F.col(text).cast("string")))


def decode_column(df: DataFrame, ids: str = "token_ids", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``out``, the decoded text of an array of ids; null counts as no ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _tokens(vocabulary)
        for column in batches:
            yield pa.array([" ".join([tokens[i] for i in x or []]) for x in column.to_pylist()], pa.string())

    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(ids)))


def round_trip(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row.

    Encodes and decodes in one pass, one row in, one row out: repeated rows stay repeated, null
    texts count as empty, and a null id stays null.
    """

    @leave("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder("index", vocabulary)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in worker.encode(bytes_of(batch.column(1))):
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decode_bytes(ids, vocabulary).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
