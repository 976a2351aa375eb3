"""Rabin-Karp hashes of word windows, vectorised over a whole text.

The letters of the polynomial are words, each by a 64-bit digest.  Bytes as letters would not do: the polynomial is
modulo 2**64, where words can be made (Thue-Morse words and their complements) whose hashes agree for every odd
multiplier.  Words of random-looking digests have no such structure in a window of a few dozen.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Odd multiplier of the polynomial, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Multiplier of a second polynomial, for those who check a match of the first.
SECOND_BASE = 0xD1B54A32D192ED03
#: Words longer than this are digested by SHA-256 first, behind a tab that no word has.
LONG_WORD = 240

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept and doubled as needed."""
    table = _powers.setdefault(base, np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
        _powers[base] = table
    return table[:n]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def letters_of(words: list[bytes]) -> np.ndarray:
    """The digest of each word."""
    if words and max(map(len, words)) > LONG_WORD:
        words = [b"\t" + hashlib.sha256(w).digest() if len(w) > LONG_WORD else w for w in words]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def roll(letters: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """The hash of each window of ``width`` consecutive letters, in order of start."""
    n = len(letters) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * _power(base, len(letters)), out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * _power(pow(base, -1, 1 << 64), n))


def window_hashes(words: list[bytes], width: int, base: int = BASE) -> np.ndarray:
    """The hash of each window of ``width`` consecutive words, in order of start."""
    return roll(letters_of(words), width, base) if len(words) >= width else np.zeros(0, np.uint64)
