"""The five stages of the corpus pipeline against plain versions, on the small tables and odd texts."""

import re

import brute
import corpus_pipeline
from conftest import odd_texts, pairs

from opsweave.llm import line_quality, substring_dedup

GAP = re.compile(r"([\x20\x09-\x0D]+)")


def cut(docs, width=20):
    """Texts without the words of windows that start earlier elsewhere, white space before them included."""
    first = {}
    words = {d: brute.WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), (d, i))
    out = []
    for d, text in docs:
        gone = [False] * len(words[d])
        for i in range(len(words[d]) - width + 1):
            if first[tuple(words[d][i : i + width])] != (d, i):
                gone[i : i + width] = [True] * width
        if any(gone):
            parts = GAP.split(text.strip(" \t\n\v\f\r"))
            text = "".join(gap + word for gap, word, g in zip(["", *parts[1::2]], parts[::2], gone) if not g).strip(" \t\n\v\f\r")
        out.append((d, text))
    return out


def test_stages_against_plain_versions(spark, documents, data_dir, tmp_path):
    odd = spark.createDataFrame([(10**9 + i * 3, t, None, "s", None) for i, t in enumerate(odd_texts())], documents.schema)
    documents.unionByName(odd).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = {r.doc_id for r in line_quality.predict(docs, labels).where("predicted = 1").collect()}
    left = [(d, t) for d, t in pairs(docs) if d in kept]
    stays = {d for d, _, _, keep, _ in brute.exact_dedup(left) if keep}
    left = [(d, t) for d, t in left if d in stays]
    stays = {c for _, _, c in brute.jaccard_components(left)}
    left = cut([(d, t) for d, t in left if d in stays])

    got = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == brute.pieces(left)


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark, data_dir):
    """Columns whose names the operators use themselves come through every stage."""
    rows = [(1, "One calm sentence about the garden.", "a", "b"), (2, "Another calm sentence about the river.", "c", "d"), (None, None, "e", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _chunk string, _dropped string")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        kept = stage(spark, docs, data_dir)
        assert kept.columns == docs.columns and kept.count() == 3, name
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and {tuple(r) for r in cut.collect()} == set(rows)
