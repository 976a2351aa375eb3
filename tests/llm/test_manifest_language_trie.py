"""Merkle manifest, language by compression and conversation trie against plain versions."""

import random
import zlib

import brute
import numpy as np
import pytest

from opsweave.llm import conversation_trie, merkle, registry, zstd_language

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r))


def many_languages():
    rows = [(i, f"Text {i}", f"l{i % 150}" if i % 7 else None, None, i) for i in range(400)]
    return rows + [(None, None, None, None, None)] * 3 + [(5, "Text 5", "l5", "x", 5)] * 2 + [(9, "W " * 60_000, "", "s", 1), (10, "", "é", "s", None)]


@pytest.mark.parametrize("height, top_nodes", [(3, 4096), (1, 10), (2, 1)])
def test_manifest(spark, documents, height, top_nodes):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in ([tuple(r) for r in documents.select(*columns).collect()], many_languages(), [(4, "A", "en", None, 1)]):
        docs = spark.createDataFrame([(*r, "x", 0) for r in rows], DOCS + ", tree string, at int").repartition(3)
        found = merkle.manifest(docs, height, top_nodes).collect()
        assert in_order(found) == in_order(brute.manifest(rows))


def test_manifest_of_nothing(spark, empty_docs):
    found = merkle.manifest(empty_docs)
    assert found.count() == 0 and found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_only_changed_texts_fail(spark, documents, data_dir):
    rows = registry.QUERIES["op11_merkle_manifest"](spark, data_dir).join(documents.select("doc_id", "text"), "doc_id").collect()
    assert len({r.root for r in rows}) == 1
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in r.text or "")
        assert r.verified == (not changed) == (r.folded_root == r.root)


def odd_turns():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), -3, -25, 10**12]:
        for t in range(rng.randrange(1, 6)):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", None, "a"]), rng.choice(["x y", None, "", "hello　w z", "x y", "W " * 30_000])))
    rows += [(None, 1, "u", "t"), (7, 1, "u", "t"), (7, 1, "u", "t")]
    return rows + [(3, 100 + i, "user", "w " * 3) for i in range(300)] + [(1000 + 7 * i, t, "user", f"common {t}") for i in range(80) for t in range(3)]


@pytest.mark.parametrize("heavy_nodes, least_heavy, shard_rows", [(4096, 32, 1 << 16), (20, 1, 5), (4096, 2, 50)])
def test_trie(spark, data_dir, heavy_nodes, least_heavy, shard_rows):
    given = spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    for rows in (list(map(tuple, given)), odd_turns(), [(60, 1, None, None)]):
        turns = spark.createDataFrame([(*r, b"k", 1) for r in rows], TURNS + ", key binary, depth int").repartition(4)
        found = conversation_trie.prefix_trie(turns, heavy_nodes, least_heavy, shard_rows).collect()
        assert in_order(found) == in_order(brute.trie(rows))


def test_trie_of_nothing(spark):
    found = conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect()
    assert in_order(found) == in_order(brute.trie([]))


def test_louds():
    bits = conversation_trie.louds(np.array([2, 0, 3, 0, 0, 0]))
    assert bits.tolist() == [1, 1, 0, 0, 1, 1, 1, 0, 0, 0, 0]
    assert conversation_trie.parents(bits).tolist() == [0, 0, 2, 2, 2]


def test_languages_held_out(spark, data_dir, documents):
    found = {r.doc_id: r for r in registry.QUERIES["op12_zstd_language"](spark, data_dir).collect()}
    known = {r.doc_id: r.lang for r in documents.collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert set(found) == set(known) and {i for i in found if found[i].held_out} == set(held)
    assert sum(found[i].lang_pred == known[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.rejected == (r.score < 0.5) for r in found.values())


def test_language_sizes(spark, documents):
    """Predictions against sums of sizes, block by block, of plain compressors."""
    dictionaries = zstd_language.fit(documents)
    assert list(dictionaries)[0] == "en" and all(0 < len(d) <= zstd_language.DICTIONARY_BYTES for d in dictionaries.values())
    models, names = zstd_language.compressors(list(dictionaries.values())), list(dictionaries)
    rows = documents.select("doc_id", zstd_language.letters(documents.text).alias("plain")).limit(40).collect()
    found = {r.doc_id: r for r in zstd_language.predict(documents, dictionaries).collect()}
    for r in rows:
        data = r.plain.encode()
        sizes = [sum(len(m.compress(data[k : k + 512])) for k in range(0, len(data), 512)) for m in models]
        assert found[r.doc_id].lang_pred == names[int(np.argmin(sizes))]
        best, second = sorted(sizes)[:2]
        assert found[r.doc_id].score == pytest.approx((second / best - 1) / (second / best - 1 + 0.02))


def test_odd_languages(spark, odd_docs, empty_docs, documents):
    dictionaries = zstd_language.fit(documents)
    found = {r.doc_id: r for r in zstd_language.predict(odd_docs, dictionaries).collect()}
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        assert (found[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    strange = spark.createDataFrame([(None, "the and of"), (1, "12 ++ ²½"), (2, "é"), (2, "é")], "doc_id long, text string")
    rows = zstd_language.predict(strange, dictionaries).collect()
    assert [(r.held_out, r.lang_pred == "und") for r in rows] == [(True, False), (zlib.crc32(b"1") % 5 == 0, True)] + [(zlib.crc32(b"2") % 5 == 0, False)] * 2
    assert zstd_language.identify(empty_docs).count() == 0
    assert {r.lang_pred for r in zstd_language.identify(odd_docs).collect()} == {"und"}  # no language to learn
    one = zstd_language.predict(odd_docs, {"xx": b"some words"}).collect()
    assert {r.lang_pred for r in one} == {"und", "xx"} and {r.score for r in one} == {0.0, 1.0}
