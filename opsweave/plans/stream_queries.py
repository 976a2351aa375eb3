"""Streaming queries, run to the end of their tables.

Results of windows come in complete mode, so that rows which a live watermark would still hold back
are there too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.plans.catalog import query
from opsweave.streaming import metrics, stateful


def _samples(spark, d):
    return metrics.read_stream(spark, f"{d}/events.parquet").select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp"), "value", "user_id", "event_id")


def _all(stream, mode="append"):
    """All rows, with times as the tables have them: without a zone."""
    found = metrics.run_available(stream, mode)
    return found.withColumns({n: F.col(n).cast("timestamp_ntz") for n, kind in found.dtypes if kind == "timestamp"})


@query("stream_tumbling", "SELECT event_type AS metric, date_trunc('minute', ts) AS ts, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return _all(metrics.tumbling_means(_samples(spark, d)), "complete").withColumn("value", F.round("value", 6))


@query(
    "stream_sliding",
    "WITH w AS (SELECT event_type AS metric, unnest([date_trunc('minute', ts) - to_minutes(i) FOR i IN range(5)]) AS ts FROM events) SELECT metric, ts, count(*) AS n FROM w GROUP BY 1, 2",
)
def stream_sliding(spark, d):
    return _all(metrics.sliding_rates(_samples(spark, d)), "complete")


@query(
    "stream_sessions",
    """WITH g AS (SELECT event_type AS metric, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY metric ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
    SELECT metric, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY metric, nr""",
)
def stream_sessions(spark, d):
    return _all(metrics.sessions(_samples(spark, d)), "complete")


@query("stream_first_of_each", "SELECT DISTINCT event_type AS metric, user_id FROM events")
def stream_first_of_each(spark, d):
    # Over a bounded table a watermark of its whole length keeps every key.
    return _all(metrics.first_of_each(_samples(spark, d), ["metric", "user_id"], "10000 days")).select("metric", "user_id")


@query(
    "stream_cooldown",
    """WITH RECURSIVE a AS (SELECT user_id AS series, ts, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i FROM events WHERE value > 50),
    f AS (SELECT series, ts, action, i, ts AS last, true AS ok FROM a WHERE i = 1
      UNION ALL SELECT a.series, a.ts, a.action, a.i, CASE WHEN a.ts >= f.last + INTERVAL 6 HOUR THEN a.ts ELSE f.last END, a.ts >= f.last + INTERVAL 6 HOUR FROM f JOIN a ON a.series = f.series AND a.i = f.i + 1)
    SELECT series, ts, action FROM f WHERE ok""",
)
def stream_cooldown(spark, d):
    rows = _samples(spark, d).where("value > 50").select(F.col("user_id").alias("series"), "ts", F.col("metric").alias("action"))
    return _all(stateful.cooldown(rows, 6 * 3600))
