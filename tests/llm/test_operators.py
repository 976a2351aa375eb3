"""The training-data operators against plain versions of themselves."""

import hashlib
import zlib

import brute
import pytest
from conftest import SCHEMA, pairs, rows

from opsweave.llm import bpe, exact_dedup, fertility, jaccard, licenses, line_quality, packing, sharding, substring_dedup


@pytest.fixture(params=["documents", "odd_docs", "empty_docs"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_exact_dedup(docs):
    assert rows(exact_dedup.mark_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact_dedup(pairs(docs))


def test_exact_dedup_keeps_rows_whole(docs):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, _, keep, _ in brute.exact_dedup(pairs(docs)) if keep}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_exact_dedup_with_a_full_filter(documents):
    """A filter far too small sends every row through the shuffle, and changes nothing."""
    small = exact_dedup.mark_duplicates(documents, max_filter_bits=1 << 16)
    assert rows(small, "doc_id", "keep_id", "group_size", "kept") == {x[:4] for x in brute.exact_dedup(pairs(documents))}


def test_substring_dedup(docs):
    assert rows(substring_dedup.digest_removals(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(pairs(docs))


def test_substring_dedup_in_small_chunks(documents, monkeypatch):
    """Many chunks and buckets give what one gives."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(substring_dedup, "FEW_WINDOWS", 2_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 4_000)
    assert rows(substring_dedup.digest_removals(documents), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(pairs(documents))


def test_substring_dedup_cuts_text(docs):
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    want = {d: s for d, _, _, s in brute.substring_dedup(pairs(docs))}
    got = {d: hashlib.sha256(" ".join(brute.WORD.findall(t or "")).encode()).hexdigest() for d, t in pairs(cut)}
    assert got == want


def test_bpe_as_the_library(docs):
    assert rows(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.bpe(pairs(docs))


def test_bpe_columns_go_round(odd_docs):
    tokens = brute.library()
    both = bpe.decode_column(bpe.encode_column(odd_docs)).select("text", "token_ids", "decoded").collect()
    for r in both:
        ids = tokens.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == tokens.decode(ids, skip_special_tokens=False)


def test_jaccard_components(docs):
    assert rows(jaccard.similar_components(docs), "doc_id", "n_shingles", "component_id") == brute.jaccard_components(pairs(docs))


def test_jaccard_in_parts(spark, monkeypatch):
    """A group dealt into parts is joined across them."""
    import random

    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    data = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(200)] = f"x{rng.randrange(50)}"
        data.append((k * 7 % 1000, " ".join(words), None, None, None))
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 40)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    assert rows(jaccard.similar_components(df), "doc_id", "n_shingles", "component_id") == brute.jaccard_components(pairs(df))


def test_jaccard_keeps_one_of_each(docs):
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute.jaccard_components(pairs(docs))}


def test_license_base(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    want = brute.license_base(pairs(docs))
    assert {d: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for d, r in got.items()} == want
    for r in got.values():
        labels, base = r.labels.split(",") if r.labels else [], r.base_labels.split(",") if r.base_labels else []
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r.score <= 1


def test_license_suppression(spark):
    text = "Licensed under the Apache License, Version 2.0 and SPDX-License-Identifier: BSD-3-Clause"
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    labels = found.labels.split(",")
    assert "apache-2.0" in labels and "bsd-3" in labels
    assert "bsd" not in labels  # inside of the longer identifier
    assert found.score == 1.0


def test_packing(docs):
    got = packing.pack(docs).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(brute.pieces(pairs(docs)))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= max(-(-total // 2048) * 1.03 + 1, sum(r.length > 1024 for r in got))


def test_best_fit_over_counts():
    plan = packing.best_fit({2048: 3, 1500: 4, 500: 6, 48: 10, 1: 5})
    used = {}
    for length, rank, n, first, offset in plan:
        for k in range(n):
            used.setdefault(first + k, []).append((offset, length))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(p[2] for p in plan) == 28


def test_sharding(docs):
    source = pairs(docs)
    got = sharding.shard(docs).collect()
    want = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in source)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))


def test_sharding_near_equal(spark):
    rows_ = [(i % 70_000 if i % 3 else 5, "x" * (i % 97), None, None, None) for i in range(40_000)]
    got = sharding.shard(spark.createDataFrame(rows_, SCHEMA)).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 40 and max(sizes) <= 1.05 * sum(sizes) / 40


def test_quality_rules(docs):
    got = fertility.quality_rules(docs)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == brute.quality_base(pairs(docs))
    assert got.where("kept and base_failed").count() == 0


def test_quality_rules_reject_noise(spark):
    """Clean prose stays in several languages; strings of random letters go."""
    import random

    rng = random.Random(5)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzQXZJ0123456789") for _ in range(30)) for _ in range(60))
    clean = "The committee met on Thursday to discuss the new budget for the city library and its three branches across town."
    german = "Die Sitzung begann am Morgen und dauerte bis zum Abend, weil viele Fragen zum Haushalt der Stadt noch offen waren und alle reden wollten."
    vietnamese = "Cuộc họp bắt đầu vào buổi sáng và kéo dài đến tối vì nhiều câu hỏi về ngân sách của thành phố vẫn còn bỏ ngỏ và mọi người đều muốn phát biểu."
    hindi = "बैठक सुबह शुरू हुई और शाम तक चली क्योंकि शहर के बजट के बारे में कई सवाल अभी भी खुले थे और सभी लोग बोलना चाहते थे ।"
    found = fertility.quality_rules(spark.createDataFrame([(1, clean), (2, german), (3, noise), (4, vietnamese), (5, hindi)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in found} == {1: True, 2: True, 3: False, 4: True, 5: True}
    assert {r.doc_id: r.script for r in found} == {1: "latin", 2: "latin", 3: "latin", 4: "vietnamese", 5: "indic"}


def test_scripts():
    texts = {"ภาษาไทย": "southeast", "ქართული": "georgian", "አማርኛ": "ethiopic", "日本語の文章です": "kana", "中文文本": "han", "한국어": "hangul", "русский": "cyrillic", "ελληνικά": "greek", "العربية": "arabic", "1234 !?": "other", "": "other"}
    assert {t: fertility.script_of(t.encode()) for t in texts} == texts


def test_classifier_handles_odd_input(docs, spark, data_dir):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    got = line_quality.predict(docs, labels)
    found = got.collect()
    assert sorted(r.doc_id for r in found) == sorted(d for d, _ in pairs(docs))
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_classifier_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = line_quality.predict(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    held = got.where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.85


def test_nulls_in_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, None), (None, None)], "doc_id long, text string")
    marked = exact_dedup.mark_duplicates(df).collect()
    assert len(marked) == 6 and sum(r.kept for r in marked) == 2
    for result in (substring_dedup.digest_removals(df), bpe.round_trip(df), jaccard.similar_components(df), licenses.scan(df), packing.pack(df), sharding.shard(df), fertility.quality_rules(df)):
        assert result.count() == 6


def license_samples(pattern):
    """Texts of a rule's pattern that have each of its alternatives once at least."""
    import random
    from re import _parser

    def one(parsed, rng):
        text = ""
        for kind, value in parsed:
            name = str(kind)
            if name == "LITERAL":
                text += chr(value)
            elif name == "IN":
                text += "7" if str(value[0][0]) == "CATEGORY" else chr(rng.choice([x for k, v in value for x in (v if str(k) == "RANGE" else (v,))]))
            elif name == "SUBPATTERN":
                text += one(value[3], rng)
            elif name == "BRANCH":
                text += one(rng.choice(value[1]), rng)
            else:
                assert name == "MAX_REPEAT"
                text += "".join(one(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 1))))
        return text

    return {one(_parser.parse(pattern), random.Random(seed)) for seed in range(12)}


def all_license_labels(words):
    """Labels of all rules' matches, tried without gate or keywords, that lie in none as good or better."""
    import re

    plain, found = f" {words} ", []
    for r in licenses.rules():
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", plain):
            found.append((m.start(), -m.end(), r.priority, r.label))
    found.sort()
    return {x[3] for i, x in enumerate(found) if not any(y[2] <= x[2] and y[1] <= x[1] for y in found[:i])}


def test_license_rules_alone(spark):
    """A text that only one rule's words make up is found, however the words are parted."""
    samples = sorted({s for r in licenses.rules() for s in license_samples(r.pattern)} | {"apache 2 0", "mpl 2 0", "epl 2 0", "eupl 1 2", "released under the bsd", "licensed under the intel"})
    texts = [*samples, *(s.replace(" ", "_-").title() for s in samples)]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in found}
    base = {r.doc_id: set(filter(None, r.base_labels.split(","))) for r in found}
    wrong = [(texts[i], got[i]) for i in got if got[i] != all_license_labels(samples[i % len(samples)]) | base[i] or not got[i]]
    assert len(got) == len(texts) and wrong == []


def test_license_bodies(spark):
    """Texts of licenses are known without the license's name."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the \"Software\"), to deal\n in the Software without restriction, including without limitation the rights"
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n Neither the name of the Example Labs nor the names of its contributors may be used to endorse or promote products derived from this software"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    zero = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    texts = [mit, bsd, gpl, isc, zero, "he was released from duty by the general", None, "x " * 200_000]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in found}
    assert got[0] == {"mit"} and got[1] == {"bsd", "bsd-3"} and {"gpl", "gpl-3"} <= got[2] and got[3] == {"isc"} and got[4] == {"0bsd"}
    assert got[5] == got[6] == got[7] == set()
    assert {r.doc_id: r.score for r in found}[0] == 0.98


def test_bpe_of_every_character():
    """Both encoders give the library's ids for each code point, alone and between letters."""
    tokens = brute.library()
    points = [chr(c) for c in [*range(0x32400), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFD] if not 0xD800 <= c < 0xE000]
    for form in ("{}", "a{}b"):
        texts = [form.format(c) for c in points]
        want = [brute.ids_bytes(e.ids) for e in tokens.encode_batch(texts, add_special_tokens=False)]
        for kind in ("library", "index"):
            assert list(bpe.encoder(kind).encode([t.encode() for t in texts])) == want


def test_marginals_by_enumeration():
    """Forward-backward gives what summing over all label paths gives."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    crf = line_quality.LineCrf(np.zeros(1), np.ones(1), np.zeros(1), rng.normal(size=(2, 2)))
    scores = [rng.normal(size=n) for n in (1, 5, 3, 8)]
    found, pairs = crf.marginals(scores)
    want_pairs = np.zeros((2, 2))
    for got, own in zip(found, scores):
        weights, good = 0.0, np.zeros(len(own))
        moved = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=len(own)):
            w = np.exp(sum(own[i] for i, s in enumerate(path) if s) + sum(crf.moves[a, b] for a, b in zip(path, path[1:])))
            weights += w
            good += w * np.array(path)
            for a, b in zip(path, path[1:]):
                moved[a, b] += w
        want_pairs += moved / weights
        assert np.allclose(got, good / weights)
    assert np.allclose(pairs, want_pairs)


def test_classifier_fits_on_whole_documents(spark, monkeypatch):
    """Long labelled documents count to their last line; those over the bound of lines are passed over."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    good, bad = "A calm sentence about the garden and its paths.\n", "## $$$ !!! click|here|now ***\n"
    data = [(i, (good if i % 2 else bad) * (400 if i == ids[0] else 3)) for i in ids] + [(ids[1], "again")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (ids[2], None)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(line_quality, "fit", lambda owns, sizes, truth: seen.append((len(owns), max(map(len, owns)))))
    line_quality.train(docs, labels)
    line_quality.train(docs, labels, sample_lines=1000)
    assert seen[0] == (60, 401) and seen[1] == (60, 401)
    line_quality.train(docs, labels, sample_lines=300)
    assert seen[2] == (59, 4)


def test_keep_good(docs, spark, data_dir):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    kept = line_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in line_quality.predict(docs, labels).where("predicted = 1").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want
