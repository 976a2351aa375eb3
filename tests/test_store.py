"""Upserts into stored documents, vectors and postings."""

import os

from opsweave.operators import store as S

SCHEMA = "content string, metadata string, embedding array<double>"


def rows_of(spark, folder):
    return {name: sorted(map(str, (r.asDict() for r in S.load(spark, folder, name).collect()))) for name in S.TABLES}


def files_of(folder):
    return {os.path.join(at, f) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet")}


def test_upsert_is_a_fresh_build(spark, tmp_path):
    old = [(f"alpha beta w{i}", "m1", [float(i), 1.0]) for i in range(60)] + [("same words", "m1", None)]
    new = [("alpha beta w3", "m2", [9.0, 9.0]), ("gamma delta", "m1", [1.0, 2.0]), ("gamma delta", "m0", [5.0, 5.0]), (None, "m", None), ("", "m", None), ("same words", "m2", [0.5, 0.5])]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    S.build(spark.createDataFrame(old, SCHEMA), a, 8)
    S.upsert(spark.createDataFrame(new, SCHEMA), a, 8)
    S.build(spark.createDataFrame([r for r in old if r[0] not in {n[0] for n in new}] + new, SCHEMA), b, 8)
    once = rows_of(spark, a)
    assert once == rows_of(spark, b) and len(once["documents"]) == 63 and len(once["vectors"]) == 62
    # Again, and nothing changes.
    S.upsert(spark.createDataFrame(new, SCHEMA), a, 8)
    assert rows_of(spark, a) == once
    S.upsert(spark.createDataFrame([], SCHEMA), a, 8)
    assert rows_of(spark, a) == once


def test_untouched_buckets_stay(spark, tmp_path):
    folder = str(tmp_path / "c")
    S.build(spark.createDataFrame([(f"word{i}", "m", [1.0]) for i in range(200)], SCHEMA), folder, 16)
    before = files_of(folder)
    S.upsert(spark.createDataFrame([("one more", "m", [1.0])], SCHEMA), folder, 16)
    changed = {os.path.basename(os.path.dirname(f)) for f in before ^ files_of(folder)}
    assert len(changed) == 1 and len(rows_of(spark, folder)["documents"]) == 201


def test_a_bound_on_terms(spark, tmp_path):
    folder = str(tmp_path / "d")
    S.build(spark.createDataFrame([("a1 b1 c1 d1", "m", None)], SCHEMA), folder, 4, most=2)
    S.upsert(spark.createDataFrame([("e1 f1 g1", "m", None)], SCHEMA), folder, 4, most=2)
    assert S.load(spark, folder, "postings").count() == 4
