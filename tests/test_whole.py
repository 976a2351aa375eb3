"""Registered queries read the whole of their input: no prefix, no newest rows, no source left out."""

import __spark_entry__ as E

QUERIES = E.queries()


def test_late_words_meet(spark, tmp_path):
    """A word after 60 characters of the query and after 80 tokens of the document is a match."""
    rows = [(50, "x" * 70 + " needle"), (7, " ".join(f"w{i}" for i in range(90)) + " needle")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["lexical_search"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.doc_id, r.score) for r in found} == {(50, 50, 1.0), (50, 7, 0.5)}


# ---- inspection: all events ----


def test_every_risky_event_is_a_finding(spark):
    from opsweave.operators import inspection

    events = spark.range(250).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "'OOMKilled' AS reason", "'Pod' AS kind", "'p' AS name", "'m' AS message")
    assert inspection.high_risk_events({"events": events}).count() == 250
    assert inspection.high_risk_events({"events": events}, cap=100).count() == 100


# ---- timeline: events, error lines and anomalous series ----


def test_timeline_conditions(spark, tmp_path):
    """An error line enters, an info line does not; a series with a peak enters, a flat one does not."""
    values = [("view", 1.0)] * 20 + [("click", 1.0 + i % 2) for i in range(19)] + [("click", 5000.0)]
    events = [(i, f"2024-01-02 {i % 20:02d}:00:00", kind, 1, value, '{"k": 1}') for i, (kind, value) in enumerate(values)]
    df = spark.createDataFrame(events, "event_id long, ts string, event_type string, user_id long, value double, props string")
    df.withColumn("ts", df.ts.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(22, "all well", "a"), (23, "broken", "a")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.type, r.description, str(r.ts)) for r in QUERIES["timeline_topk"](spark, str(tmp_path)).collect()]
    assert found == [("log", "[pod-23] ERROR broken", "2024-01-01 00:23:00"), ("metric", "click", "2024-01-02 19:00:00")]


# ---- log entries: whole traces ----


def test_long_trace_is_whole(spark):
    from opsweave.operators import logs

    lines = ["ValueError: broken", *(f"  at frame{i}" for i in range(60)), "next"]
    df = logs.parse_lines(spark.createDataFrame([("p", "c", i, line) for i, line in enumerate(lines)], "pod string, container string, line_no int, line string"))
    found = {r.line: (r.n_stack, r.stack) for r in logs.fold_entries(df).collect()}
    assert found == {"ValueError: broken": (60, "\n".join(lines[1:61])), "next": (0, "")}
    assert logs.fold_entries(df, most_stack=20).first().n_stack == 20
