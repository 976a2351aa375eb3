"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, the share of
tokens that are single bytes, and the entropy of its tokens; a second one, made for many languages,
gives its own characters per token.  A text is kept while all four lie inside the band of its script.
Each word is encoded by itself (pieces never cross white space), so the encodings of words are cached.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F

from opsweave.llm.common import CACHES, WordCache, bytes_of, leave, release
from opsweave.llm.rolling import window_hashes

VOCABULARY = "piece_bpe_32k.model"
SECOND_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words in each generation of the cache.
CACHE_WORDS = 100_000
BATCH_BYTES = 1 << 20
REPEAT_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a kept text's measures must lie in; ``least_second`` is for the second vocabulary."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    least_second: float


#: Rejection bands by script.  Entropy counts against that of all-different tokens.  Where the first
#: vocabulary knows few letters of a script, and so falls back on bytes, the second one tells more.
BANDS = {
    "latin": Band(1.45, 9.0, 0.08, 0.42, 1.45),
    "vietnamese": Band(0.8, 6.0, 0.30, 0.42, 1.2),
    "greek": Band(0.8, 6.0, 0.30, 0.35, 0.8),
    "cyrillic": Band(1.1, 7.0, 0.10, 0.40, 1.1),
    "hebrew": Band(0.6, 6.0, 0.50, 0.30, 0.6),
    "arabic": Band(0.6, 6.0, 0.50, 0.30, 0.7),
    "indic": Band(0.4, 4.0, 0.50, 0.15, 0.35),
    "southeast": Band(0.4, 4.0, 0.60, 0.15, 0.30),
    "georgian": Band(0.4, 5.0, 0.50, 0.15, 0.25),
    "ethiopic": Band(0.25, 4.0, 0.98, 0.15, 0.25),
    "kana": Band(0.4, 3.0, 0.60, 0.35, 0.45),
    "han": Band(0.3, 3.0, 0.80, 0.30, 0.40),
    "hangul": Band(0.3, 3.0, 0.90, 0.25, 0.40),
    "other": Band(0.2, 12.0, 1.00, 0.10, 0.15),
}
SCRIPTS = tuple(BANDS)
# Fixed values of Unicode: first and last code point of runs of letters, and their script.
_RUNS = (
    (0x41, 0x5A, "latin"),
    (0x61, 0x7A, "latin"),
    (0xC0, 0x24F, "latin"),
    (0x370, 0x3FF, "greek"),
    (0x400, 0x52F, "cyrillic"),
    (0x530, 0x58F, "other"),
    (0x590, 0x5FF, "hebrew"),
    (0x600, 0x7BF, "arabic"),
    (0x8A0, 0x8FF, "arabic"),
    (0x900, 0xDFF, "indic"),
    (0xE00, 0xEFF, "southeast"),
    (0xF00, 0xFFF, "other"),
    (0x1000, 0x109F, "southeast"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"),
    (0x1200, 0x139F, "ethiopic"),
    (0x13A0, 0x177F, "other"),
    (0x1780, 0x17FF, "southeast"),
    (0x1800, 0x18AF, "other"),
    (0x1C80, 0x1C8F, "cyrillic"),
    (0x1C90, 0x1CBF, "georgian"),
    (0x1E00, 0x1EFF, "vietnamese"),
    (0x1F00, 0x1FFF, "greek"),
    (0x2D00, 0x2D2F, "georgian"),
    (0x2D80, 0x2DDF, "ethiopic"),
    (0x3041, 0x30FF, "kana"),
    (0x3130, 0x318F, "hangul"),
    (0x31F0, 0x31FF, "kana"),
    (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"),
    (0xA640, 0xA69F, "cyrillic"),
    (0xA720, 0xA7FF, "latin"),
    (0xAB00, 0xAB2F, "ethiopic"),
    (0xAC00, 0xD7FF, "hangul"),
    (0xF900, 0xFAFF, "han"),
    (0xFB50, 0xFDFF, "arabic"),
    (0xFE70, 0xFEFE, "arabic"),
    (0x10000, 0x1FFFF, "other"),
    (0x20000, 0x323AF, "han"),
)
#: Bounds between the runs and what lies before each; 0: no letters.
_BOUNDS = np.array([x for first, last, _ in _RUNS for x in (first, last + 1)])
_KIND = np.array([0, *(x for _, _, name in _RUNS for x in (1 + SCRIPTS.index(name), 0))])


class WordPieces:
    """Ids of words as packed 16-bit integers, and their number of tokens in the second vocabulary, cached."""

    def __init__(self, path: str, second: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(second, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.second = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = self.pieces.vocab_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.known = WordCache(CACHE_WORDS)

    def learn(self, words: set[bytes]) -> None:
        new = self.known.missing(words)
        texts = [w.decode() for w in new]
        for word, text, ids in zip(new, texts, self.pieces.encode(texts, num_threads=1)):
            # A word stands behind a space in the second vocabulary.
            self.known.now[word] = array("H", ids).tobytes(), len(self.second.encode_ordinary(" " + text))

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """(ids, number of tokens in the second vocabulary) of a text's words."""
        found = list(map(self.known.now.__getitem__, words))
        return np.frombuffer(b"".join([x[0] for x in found]), "<u2"), sum([x[1] for x in found])


@functools.cache
def word_pieces(vocabulary: str, second: str) -> WordPieces:
    found = WordPieces(public_tokenizers.path(vocabulary), public_tokenizers.path(second))
    release()
    return found


CACHES.append(word_pieces.cache_clear)


def script_of(text: bytes) -> str:
    """The script with the most letters, by their code points; Latin text with many letters of Vietnamese
    counts as that."""
    points, many = np.unique(np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
    letters = np.bincount(_KIND[np.searchsorted(_BOUNDS, points, "right")], weights=many, minlength=len(SCRIPTS) + 1)[1:]
    # Japanese text is known by its kana, however many Han characters stand between them.
    if letters[SCRIPTS.index("kana")] * 5 > letters[SCRIPTS.index("han")] > 0:
        letters[SCRIPTS.index("kana")] += letters[SCRIPTS.index("han")]
    if letters[SCRIPTS.index("vietnamese")] * 12 > letters[SCRIPTS.index("latin")] > 0:
        letters[SCRIPTS.index("vietnamese")] += letters[SCRIPTS.index("latin")]
    return SCRIPTS[int(letters.argmax())] if letters.any() else "other"


def fertility(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """(characters per token, share of byte tokens, entropy against that of all-different tokens)."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1] / n
    most = np.log2(min(n, len(is_byte))) if n > 1 else 1.0
    return chars / n, float(is_byte[ids].mean()), float(-(counts * np.log2(counts)).sum() / most)


def repeated_words(words: list[bytes], width: int = REPEAT_WORDS) -> int:
    """Words covered by windows of ``width`` words that the text has at least twice."""
    hashes = window_hashes(words, width)
    if len(hashes) < 2:
        return 0
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    flags = counts[which] > 1
    if not flags.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(flags)] += flags
    edges[width : width + len(flags)] -= flags
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


_MEASURES = (
    ("n_words", "long"),
    ("word_chars", "long"),
    ("n_symbols", "long"),
    ("n_dup_lines", "long"),
    ("n_repeat_words", "long"),
    ("base_failed", "boolean"),
    ("kept", "boolean"),
    ("script", "string"),
    ("chars_per_token", "double"),
    ("byte_share", "double"),
    ("token_entropy", "double"),
    ("second_chars_per_token", "double"),
)


def _measure(text: bytes, words: list[bytes], pieces: WordPieces, bands: dict[str, Band]) -> tuple:
    byte_counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(words)
    # Code points are the bytes that continue none; white space is no part of a word.
    chars = int(byte_counts[:0x80].sum() + byte_counts[0xC0:].sum() - byte_counts[9:14].sum() - byte_counts[32])
    symbols = int(byte_counts[np.frombuffer(SYMBOLS, np.uint8)].sum())
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    script = script_of(text)
    ids, second = pieces.ids(words)
    per_token, share, entropy = fertility(ids, chars, pieces.is_byte)
    per_second = chars / second if second else 0.0
    band = bands[script]
    inside = band.least_chars <= per_token <= band.most_chars and share <= band.most_bytes and entropy >= band.least_entropy and per_second >= band.least_second
    return n, chars, symbols, duplicate_lines(text), repeats, failed, not failed and inside, script, per_token, share, entropy, per_second


def quality_rules(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, bands: dict[str, Band] | None = None, second: str = SECOND_VOCABULARY) -> DataFrame:
    """(doc_id, the measures, base_failed, kept) for every row.

    A null or empty text has no words and fails.  Repeated rows are measured alike; other columns
    are ignored; an empty table gives no rows.
    """
    limits = bands or BANDS

    @leave("fertility")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(vocabulary, second)
        for batch in batches:
            rows: list[tuple] = []
            held: list[tuple[bytes, list[bytes]]] = []
            size = 0

            def flush() -> None:
                pieces.learn(set().union(*[w for _, w in held]))
                rows.extend(_measure(t, w, pieces, limits) for t, w in held)
                held.clear()

            for body in bytes_of(batch.column(1)):
                held.append((body or b"", (body or b"").split()))
                size += len(body or b"")
                if size > BATCH_BYTES:
                    flush()
                    size = 0
            flush()
            columns = list(zip(*rows)) if rows else [[]] * len(_MEASURES)
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, _MEASURES))], ["doc_id", *(n for n, _ in _MEASURES)])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k in _MEASURES))
