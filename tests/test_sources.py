"""Readers on files, log fetching, models that are kept, and late rows of a stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from opsweave.operators import hierarchy as H, logs, models as M
from opsweave.sources import tables as T


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_metric_csv(spark, tmp_path):
    path = write(tmp_path / "m.csv", "timestamp,metric,value\n2024-01-01T00:00:00,cpu,1.5\n2024-01-01T01:00:00,cpu,x\n")
    assert [(r.metric, r.value) for r in T.read_metric_csv(spark, path).orderBy("timestamp").collect()] == [("cpu", 1.5), ("cpu", None)]


def test_range_matrix(spark, tmp_path):
    path = write(tmp_path / "m.json", '{"metric":{"__name__":"up","pod":"a"},"values":[["1704067200","1"],["1704067260","NaN?"]]}\n')
    rows = T.read_range_matrix(spark, path).orderBy("ts").collect()
    assert [(r.metric, r.labels, r.value) for r in rows] == [("up", {"pod": "a"}, 1.0), ("up", {"pod": "a"}, 0.0)]


def test_inventory(spark, tmp_path):
    path = write(tmp_path / "p.json", '{"metadata":{"name":"a","namespace":"n"},"status":{"phase":"Running"},"other":1}\n')
    assert T.read_inventory(spark, path).select("metadata.name", "status.phase").first() == ("a", "Running")


def test_documents_and_logs(spark, tmp_path):
    write(tmp_path / "kb" / "a.md", "# A\ntext")
    write(tmp_path / "kb" / "sub" / "b.txt", "b")
    write(tmp_path / "kb" / "blank.md", "  \n")
    write(tmp_path / "kb" / "c.bin", "c")
    write(tmp_path / "kb" / "big.txt", "x" * 100)
    got = T.read_documents(spark, str(tmp_path / "kb"), max_bytes=50).collect()
    assert sorted(r.content for r in got) == ["# A\ntext", "b"]
    lines = T.read_logs(spark, write(tmp_path / "l" / "x.log", "one\r\ntwo\n")).collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "one"), (2, "two"), (3, "")]


def test_log_fetching(spark):
    lines = spark.createDataFrame([("p", "c", i, "x" * 9) for i in range(10)], "pod string, container string, line_no int, line string")
    assert logs.within_bytes(lines, 35).count() == 3
    states = spark.createDataFrame([("p", "c2", "waiting", "ImagePullBackOff", "no image"), ("p", "c3", "none", None, None), ("p", "c", "running", None, None)], "pod string, container string, state string, reason string, message string")
    got = {r.line for r in logs.with_markers(lines, states).where("container <> 'c'").collect()}
    assert got == {"[c2] ImagePullBackOff: no image", "[c3] never ran"}
    timed = lines.withColumn("ts", F.when(F.col("line_no") > 2, F.timestamp_seconds("line_no")))
    assert logs.since(timed, F.timestamp_seconds(F.lit(8))).count() == 5


def test_models_are_kept(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("target"), F.timestamp_seconds("id").alias("ts"))
    model = M.fit_model(rows, ["x"])
    M.save_model(model, str(tmp_path), "qps")
    kind, again = M.load_model(str(tmp_path), "cpu", probe=rows.limit(1))
    assert kind == "qps" and abs(again.transform(rows).where("x = 10").first().prediction - 21) < 1e-6
    with pytest.raises(LookupError):
        M.load_model(str(tmp_path / "none"), "cpu")
    assert M.importances(model, ["x"])["x"] > 0
    folds = M.forward_folds(rows, 3)
    for train, test in folds:
        assert train.agg(F.max("ts")).first()[0] < test.agg(F.min("ts")).first()[0]
    assert M.select_model(rows, ["x"], ("ols", "ridge"), 3)[0][0] == "ols"


def test_leaders(spark):
    """Clusters by their first vectors, against a plain pass over each bucket."""
    import numpy as np

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(4, 8))
    vectors = [(i, (centers[i % 4] + 0.15 * rng.normal(size=8)).tolist()) for i in range(120)]
    df = spark.createDataFrame(vectors, "doc_id long, embedding array<double>").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    buckets = {r.doc_id: r.bucket for r in df.collect()}
    want, state = {}, {}
    for i, v in vectors:
        v, held = np.array(v), state.setdefault(buckets[i], [])
        scores = [float(c @ v / np.linalg.norm(c) / np.linalg.norm(v)) for c, _ in held]
        best = int(np.argmax(scores)) if scores else -1
        if best >= 0 and scores[best] > 0.75 and held[best][1] < 20:
            c, n = held[best]
            held[best] = (c + (v - c) / (n + 1), n + 1)
        else:
            best = len(held)
            held.append((v, 1))
        want[i] = (buckets[i], best)
    got = {r.doc_id: (r.bucket, r.cluster) for r in H.leader_clusters(df, 3).collect()}
    assert got == want


def test_pseudo_embedding(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "t string").select(H.pseudo_embedding(F.col("t"), 20).alias("v")).collect()
    assert all(len(r.v) == 20 and all(-1 <= x <= 1 for x in r.v) for r in rows)
    assert any(rows[0].v) and not any(rows[1].v) and not any(rows[2].v)


def test_late_rows_are_left_out(spark, tmp_path):
    """Files come one by one: a row older than the watermark opens no window any more, one within it does."""
    schema = "metric string, ts timestamp, value double"
    at = lambda *a: datetime.datetime(2024, 1, 1, *a)
    parts = [[("m", at(0, 0), 1.0)], [("m", at(2, 0), 2.0)], [("m", at(2, 1), 2.0)], [("m", at(0, 0, 30), 100.0), ("m", at(1, 55), 4.0)], [("m", at(5, 0), 8.0)]]
    source = tmp_path / "in"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*"))
    sums = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute").alias("w")).agg(F.sum("value").alias("total"))
    query = sums.select("w.start", "total").writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.start, r.total) for r in spark.table("late_rows").collect()}
    assert {(at(0, 0), 1.0), (at(1, 55), 4.0)} <= got and not any(total >= 100 for _, total in got)
