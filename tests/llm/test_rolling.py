"""Window hashes tell windows apart that a polynomial over bytes does not, in all operators that use them."""

import hashlib

import brute
import numpy as np
import pytest
from conftest import rows

from opsweave.llm import fertility, jaccard, rolling, substring_dedup


def thue_morse(n, letters=b"ab"):
    """The word of ``n`` letters, a power of two, and its complement."""
    bits = np.array([bin(i).count("1") & 1 for i in range(n)])
    a = np.frombuffer(letters, np.uint8)
    return a[bits].tobytes(), a[1 - bits].tobytes()


PAIRS = [thue_morse(n) for n in (64, 128, 256, 512, 1024, 2048, 4096, 8192)]


@pytest.mark.parametrize("base", [rolling.BASE, rolling.SECOND_BASE])
def test_made_words(base):
    around = [f"w{i}".encode() for i in range(19)]
    hashes = [int(rolling.window_hashes([*around[:9], w, *around[9:]], 20, base)[0]) for pair in PAIRS for w in pair]
    assert len(set(hashes)) == len(hashes)


@pytest.mark.parametrize("base", [rolling.BASE, rolling.SECOND_BASE])
def test_orders_of_words(base):
    """All windows of two words, in the order of Thue-Morse words and in any other."""
    seen = {int(rolling.window_hashes([b"ab"[(k >> i) & 1 :][:1] for i in range(16)], 16, base)[0]) for k in range(1 << 16)}
    assert len(seen) == 1 << 16


def test_windows_do_not_hang_on_their_place():
    words = [hashlib.sha256(bytes([i % 7])).hexdigest().encode() for i in range(300)]
    hashes = rolling.window_hashes(words, 20)
    assert len(hashes) == 281 and all(len(set(hashes[k::7].tolist())) == 1 for k in range(7)) and len(set(hashes.tolist())) == 7


def made_documents():
    around = [f"w{i}" for i in range(19)]
    texts = []
    for pair in PAIRS:
        for word in pair:
            texts.append(" ".join([*around[:9], word.decode(), *around[9:]]))
    short = [" ".join([w.decode()] + ["x"] * 4) for w in PAIRS[4]]
    twice = [" ".join([w.decode() for w in PAIRS[5]] + ["y"] * 6 + [w.decode() for w in PAIRS[5][::-1]] + ["y"] * 6)]
    return list(enumerate(texts + short + twice))


def test_operators_on_made_words(spark):
    docs = made_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substring_dedup.digest_removals(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(docs)
    assert rows(jaccard.similar_components(frame), "doc_id", "n_shingles", "component_id") == brute.jaccard_components(docs)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(fertility.quality_rules(frame), *columns) == brute.quality_base(docs)
