"""Queries of diagnosis, statistics, models and generators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsweave.functions import logtext, quantity as Q
from opsweave.operators import anomaly, cluster_events as ev, diagnosis as D, inspection, listings, logs, models as M, rca, series, statistics as S
from opsweave.plans.catalog import ORACLE_SQL, query
from opsweave.plans.cluster_queries import _E, _FINDINGS, _LEVELS, _events, _lines, _tables
from opsweave.sources import generators as G, ranges, tables as T
from opsweave.sources.shared import shared_dir, written

_H = f"WITH {T.HOURLY_SQL}"

# ---- statistics ----

_POINTS = _H + ", pts AS (SELECT metric, ts, value, CASE WHEN extract(hour FROM ts) % 7 = 0 THEN 0.0 ELSE 0.5 + extract(hour FROM ts) / 48.0 END::DOUBLE AS confidence FROM hourly), o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts) AS i, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY metric) AS n FROM pts)"
_QUANT = (
    _POINTS
    + """, h AS (SELECT metric, avg(value) FILTER (i <= n // 2) AS a, avg(value) FILTER (i > n // 2) AS b, max(value) FILTER (r = n // 2) AS median FROM o GROUP BY metric),
    cc AS (SELECT metric, confidence, row_number() OVER (PARTITION BY metric ORDER BY ts) AS i, count(*) OVER (PARTITION BY metric) AS n FROM pts WHERE confidence > 0),
    ch AS (SELECT metric, max(n) AS n, avg(confidence) FILTER (i <= n // 2) AS a, avg(confidence) FILTER (i > n // 2) AS b FROM cc GROUP BY metric),
    ct AS (SELECT metric, CASE WHEN n < 2 THEN 'insufficient_data' WHEN b > a + 0.05 THEN 'increasing' WHEN b < a - 0.05 THEN 'decreasing' ELSE 'stable' END AS confidence_trend FROM ch),
    s AS (SELECT metric, count(*) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean, avg(confidence) FILTER (confidence > 0) AS mean_confidence, min(confidence) FILTER (confidence > 0) AS least_confidence FROM pts GROUP BY metric),
    q AS (SELECT s.*, median, confidence_trend, CASE WHEN b > a THEN 'increasing' WHEN b < a THEN 'decreasing' WHEN a IS NOT NULL THEN 'stable' END AS direction, CASE WHEN a > 0 THEN (b - a) / a * 100 WHEN a IS NOT NULL THEN 0.0 END AS change_percent FROM s JOIN h USING (metric) LEFT JOIN ct USING (metric))"""
)
_QROUND = ("low", "high", "mean", "mean_confidence", "least_confidence", "median", "change_percent")


def _points(spark, d):
    hour = F.hour("ts")
    return T.hourly(spark, d).withColumn("confidence", F.when(hour % 7 == 0, 0.0).otherwise(0.5 + hour / 48.0))


@query("quantitative_metrics", _QUANT + " SELECT metric, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _QROUND) + ", confidence_trend, direction FROM q")
def quantitative_metrics(spark, d):
    return S.quantitative(_points(spark, d)).withColumns({c: F.round(c, 6) for c in _QROUND})


@query(
    "dimension_stats",
    _QUANT
    + " SELECT count(*) AS dimensions, CAST(sum(n) AS BIGINT) AS points, round(sum(mean_confidence * n) / sum(n), 6) AS mean_confidence, count(*) FILTER (direction = 'increasing') AS increasing, count(*) FILTER (direction = 'decreasing') AS decreasing, count(*) FILTER (direction = 'stable') AS stable FROM q",
)
def dimension_stats(spark, d):
    return S.across_dimensions(S.quantitative(_points(spark, d))).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "number_stats",
    """WITH v AS (SELECT l_returnflag AS flag, l_quantity AS value FROM lineitem), c AS (SELECT flag, value, count(*) AS k FROM v GROUP BY ALL), m AS (SELECT flag, min(value) AS first_mode, count(*) AS n_modes FROM c WHERE k = (SELECT max(k) FROM c x WHERE x.flag = c.flag) GROUP BY flag)
    SELECT flag, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 4) AS std, any_value(first_mode) AS first_mode, any_value(n_modes) AS n_modes FROM v JOIN m USING (flag) GROUP BY flag""",
)
def number_stats(spark, d):
    return S.numbers(T.read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("value")), "flag")


@query(
    "latency_percentiles",
    """WITH l AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value) AS r FROM events QUALIFY r <= 1000),
    p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM l)
    SELECT event_type, max(n) AS n, max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95, max(value) FILTER (i = floor(n * 0.99)) AS p99 FROM p GROUP BY event_type""",
)
def latency_percentiles(spark, d):
    return S.nearest_ranks(T.read_table(spark, d, "events").select("event_type", "ts", "value"), "event_type")


_CACHE = "WITH c AS (SELECT event_type AS cache_type, value > 20 AS hit, value / 100 AS seconds FROM events), r AS (SELECT cache_type, count(*) AS requests, count(*) FILTER (hit) AS hits, avg(seconds) AS m FROM c GROUP BY 1), x AS (SELECT cache_type, requests, hits, round(100.0 * hits / requests, 2) AS hit_rate, round(hits * m, 2) AS saved_seconds, CASE WHEN 100.0 * hits / requests >= 80 THEN 'A' WHEN 100.0 * hits / requests >= 60 THEN 'B' WHEN 100.0 * hits / requests >= 40 THEN 'C' ELSE 'D' END AS grade FROM r)"


def _cache(spark, d):
    return S.cache_rates(T.read_table(spark, d, "events").select(F.col("event_type").alias("cache_type"), (F.col("value") > 20).alias("hit"), (F.col("value") / 100).alias("seconds")))


@query("cache_rollup", _CACHE + " SELECT * FROM x")
def cache_rollup(spark, d):
    return _cache(spark, d)


@query("cache_effect", _CACHE + " SELECT round(sum(saved_seconds), 2) AS saved_seconds, CASE WHEN sum(saved_seconds) > 300 THEN 'high' WHEN sum(saved_seconds) > 60 THEN 'medium' ELSE 'low' END AS effect FROM x")
def cache_effect(spark, d):
    return S.effectiveness(_cache(spark, d)).withColumn("saved_seconds", F.round("saved_seconds", 2))


@query(
    "risk_bands",
    "WITH a AS (SELECT 'u' || CAST(user_id % 20 AS VARCHAR) AS target, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' ELSE 'low' END AS impact FROM events), r AS (SELECT target, count(*) AS total, count(*) FILTER (impact IN ('high', 'critical')) AS severe FROM a GROUP BY 1) SELECT *, round(least(1.0, 2.0 * severe / total), 6) AS score, CASE WHEN severe > 2 THEN 'high' WHEN severe > 0 THEN 'medium' ELSE 'low' END AS band, CASE WHEN severe > 2 THEN 'increasing' ELSE 'stable' END AS trend FROM r",
)
def risk_bands(spark, d):
    impact = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").otherwise("low")
    rows = T.read_table(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("target"), impact.alias("impact"))
    return S.risk(rows, "target").withColumn("score", F.round("score", 6))


@query(
    "data_quality",
    """WITH c AS (SELECT c_custkey, count(o_orderkey) AS n, avg(o_totalprice) / 200000 AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
    q AS (SELECT c_custkey, 0.8 + CASE WHEN n >= 48 THEN 0.1 WHEN n > 0 AND n < 12 THEN -0.2 ELSE 0 END AS history, 0.8 + CASE WHEN n >= 24 THEN 0.1 ELSE 0 END + CASE WHEN m > 0.8 THEN 0.1 ELSE 0 END AS forecast, CASE WHEN n % 2 = 0 THEN 0.8 ELSE 0.5 END AS ai, n, m FROM c),
    w AS (SELECT *, least(1.0, greatest(0.0, 0.3 * history + 0.5 * forecast + 0.2 * ai)) AS overall FROM q)
    SELECT c_custkey, round(history::DOUBLE, 6) AS history, round(forecast::DOUBLE, 6) AS forecast, round(ai::DOUBLE, 6) AS ai, round(overall::DOUBLE, 6) AS overall, CASE WHEN overall > 0.9 THEN 'excellent' WHEN overall > 0.7 THEN 'good' WHEN overall > 0.5 THEN 'fair' ELSE 'poor' END AS assessment,
      round(least(1.0, greatest(0.0, 0.8 + CASE WHEN n >= 24 THEN 0.1 WHEN n < 12 THEN -0.1 ELSE 0 END + CASE WHEN m > 0.8 THEN 0.1 WHEN coalesce(m, 0) < 0.6 THEN -0.1 ELSE 0 END))::DOUBLE, 6) AS report FROM w""",
)
def data_quality(spark, d):
    orders = T.read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 200000).alias("m"))
    rows = T.read_table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    q = S.data_quality(F.col("n"), F.col("n"), F.col("m"), F.col("n") % 2 == 0)
    return rows.select("c_custkey", *[(c if k == "assessment" else F.round(c, 6)).alias(k) for k, c in q.items()], F.round(S.report_quality(F.col("n"), F.col("m")), 6).alias("report"))


@query("corpus_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS chars")
def corpus_counts(spark, d):
    docs = T.read_table(spark, d, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"))
    return docs.crossJoin(T.read_table(spark, d, "embeddings").agg(F.count("*").alias("vectors"))).select("documents", "vectors", "sources", "chars")  # one row each


@query("expired_sessions", "SELECT user_id AS session, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 24 HOUR")
def expired_sessions(spark, d):
    rows = T.read_table(spark, d, "events").select(F.col("user_id").alias("session"), "ts")
    return S.expired(rows, F.to_timestamp_ntz(F.lit("2024-01-31 12:00:00")))


@query(
    "loop_detection",
    "WITH a AS (SELECT user_id AS session, event_id AS seq, event_type AS action, count(*) OVER w AS n, min(event_type) OVER w AS lo, max(event_type) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)) SELECT session, seq, action FROM a WHERE n >= 3 AND lo = hi",
)
def loop_detection(spark, d):
    return S.looping(T.read_table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("action")))


@query(
    "action_plan",
    rf"""WITH {T.MARKDOWN_SQL}, ln AS (SELECT doc_id AS plan, unnest(range(len(string_split(text, chr(10))))) AS line_no, trim(unnest(string_split(text, chr(10)))) AS t FROM md),
    n AS (SELECT plan, line_no, t, regexp_matches(t, '^([1-5]\.|##|\*\*)') AS h FROM ln WHERE t <> ''), a AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY plan ORDER BY line_no) AS action FROM n),
    g AS (SELECT plan, action, max(t) FILTER (h) AS title, coalesce(list(trim(regexp_replace(t, '^[-•*]', '')) ORDER BY line_no) FILTER (NOT h), []) AS details FROM a WHERE action BETWEEN 1 AND 5 GROUP BY ALL)
    SELECT plan, CAST(action AS BIGINT) AS action, title, len(details) AS n_details, CASE WHEN regexp_matches(lower(title || ' ' || array_to_string(details, ' ')), '紧急|立即|critical|urgent|即时|高风险') THEN 'high' ELSE 'medium' END AS priority FROM g""",
)
def action_plan(spark, d):
    lines = T.markdown_docs(spark, d).select(F.col("doc_id").alias("plan"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return S.action_plan(lines).select("plan", "action", "title", F.size("details").alias("n_details"), "priority")


# ---- functions of rows ----


@query(
    "request_bounds",
    "SELECT o_orderkey, coalesce(o_custkey BETWEEN 1 AND 168, false) AS hours_ok, coalesce(o_totalprice BETWEEN 0 AND 100000, false) AS qps_ok, coalesce((o_orderkey % 12) / 10.0 BETWEEN 0.1 AND 0.9, false) AS target_ok, (o_orderdate < TIMESTAMP '1996-01-01' AND date_diff('second', o_orderdate, TIMESTAMP '1996-01-01') / 60 <= 2000000) AS range_ok FROM orders",
)
def request_bounds(spark, d):
    end = F.to_timestamp(F.lit("1996-01-01"))
    orders = T.read_table(spark, d, "orders")
    return orders.select(
        "o_orderkey",
        Q.valid_request("hours", F.col("o_custkey")).alias("hours_ok"),
        Q.valid_request("qps", F.col("o_totalprice")).alias("qps_ok"),
        Q.valid_request("target_utilization", (F.col("o_orderkey") % 12) / 10).alias("target_ok"),
        Q.valid_range(F.col("o_orderdate").cast("timestamp"), end, end, 2_000_000).alias("range_ok"),
    )


@query("clean_input", "SELECT doc_id, substr(regexp_replace(text, '[<>&\"'']', '', 'g'), 1, 1000) AS clean FROM documents")
def clean_input(spark, d):
    return T.read_table(spark, d, "documents").select("doc_id", Q.sanitised(F.col("text")).alias("clean"))


@query(
    "duration_format",
    "WITH s AS (SELECT o_orderkey, CAST(o_orderkey * 3 + 1 AS DOUBLE) AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.1f秒', s) WHEN s < 3600 THEN printf('%.1f分钟', s / 60) ELSE printf('%.1f小时', s / 3600) END AS duration FROM s",
)
def duration_format(spark, d):
    return T.read_table(spark, d, "orders").select("o_orderkey", Q.duration((F.col("o_orderkey") * 3 + 1).cast("double")).alias("duration"))


@query("label_format", "SELECT event_id, 'pod:pod-' || CAST(user_id % 5 AS VARCHAR) || '|zone:z' || CAST(user_id % 3 AS VARCHAR) AS label FROM events")
def label_format(spark, d):
    label = lambda name, start, n: (F.lit(name), F.concat(F.lit(start), (F.col("user_id") % n).cast("string")))
    return T.read_table(spark, d, "events").select("event_id", Q.label_text(F.create_map(*label("zone", "z", 3), *label("pod", "pod-", 5))).alias("label"))


@query("iso_times", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 8 HOUR END END AS at FROM events")
def iso_times(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).otherwise(F.concat(text, F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+08:00")))
    return T.read_table(spark, d, "events").select("event_id", Q.iso_time(stamp).cast("timestamp_ntz").alias("at"))


@query("log_times", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def log_times(spark, d):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z level=info started"))
    return T.read_table(spark, d, "events").select("event_id", logtext.log_time(line).cast("timestamp_ntz").alias("at"))


@query(
    "cost_functions",
    """SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE greatest(0.02 * p_size + 0.005 * p_retailprice + 0.0001 * 100 + 0.04 * (p_partkey % 4), 0.1) END, 6) AS cost,
    round(CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE (p_retailprice * 24 - p_size % 5 * 1000) / (p_size % 5 * 1000) * 100 END, 6) AS roi,
    CASE WHEN p_size % 9 <= 1 AND p_size % 20 <= 2 THEN 'small' WHEN p_size % 9 <= 2 AND p_size % 20 <= 4 THEN 'medium' WHEN p_size % 9 <= 4 AND p_size % 20 <= 8 THEN 'large' ELSE 'xlarge' END AS instance FROM part""",
)
def cost_functions(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    cost = Q.current_cost(F.when(size % 3 == 0, price), size, price, F.lit(100.0), F.col("p_partkey") % 4)
    return T.read_table(spark, d, "part").select("p_partkey", F.round(cost, 6).alias("cost"), F.round(Q.return_on(size % 5 * 1000.0, price, F.lit(24)), 6).alias("roi"), Q.instance_type(size % 9, size % 20).alias("instance"))


# ---- series ----


@query(
    "counter_increase",
    "WITH s AS (SELECT event_type AS metric, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events), i AS (SELECT metric, CASE WHEN b IS NULL THEN 0.0 WHEN value < b THEN value ELSE value - b END AS step FROM s) SELECT metric, round(sum(step), 4) AS increase FROM i GROUP BY metric",
)
def counter_increase(spark, d):
    rows = T.read_table(spark, d, "events").select(F.col("event_type").alias("metric"), F.struct("ts", "event_id").alias("ts"), "value")
    return series.counter_increase(rows).withColumn("increase", F.round("increase", 4))


@query("sum_by_label", "SELECT event_type AS metric, 'pod-' || CAST(user_id % 5 AS VARCHAR) AS pod, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def sum_by_label(spark, d):
    out = series.sum_by(T.samples(spark, d), ["pod"])
    return out.select("metric", "pod", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"))


@query("instant_vector", "SELECT event_type AS metric, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def instant_vector(spark, d):
    rows = T.read_table(spark, d, "events").select(F.col("event_type").alias("metric"), "ts", "value", "event_id")
    return series.instant(rows, F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")), tie="event_id")


@query("metric_metadata", "SELECT event_type AS metric, arg_min(props, event_id) AS help FROM events GROUP BY 1")
def metric_metadata(spark, d):
    rows = T.read_table(spark, d, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("seq"), F.col("props").alias("help"))
    return series.first_metadata(rows)


@query(
    "serving_defaults",
    "SELECT c_custkey, round(c_acctbal * 0.95, 6) AS lag_1, round(c_acctbal * 0.9, 6) AS lag_24, round(c_acctbal * 0.85, 6) AS lag_168 FROM customer",
)
def serving_defaults(spark, d):
    return T.read_table(spark, d, "customer").select("c_custkey", *[F.round(c, 6).alias(n) for n, c in series.lags_without_history(F.col("c_acctbal")).items()])


@query("history_slope", _H + ", n AS (SELECT metric, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY ts) - 1 AS DOUBLE) AS i FROM hourly) SELECT metric, round(regr_slope(value, i), 9) AS slope FROM n GROUP BY metric")
def history_slope(spark, d):
    return series.history_slope(T.hourly(spark, d)).withColumn("slope", F.round("slope", 9))


@query(
    "minute_features",
    "SELECT event_id, CAST(extract(minute FROM ts) AS INT) AS minute, CAST(extract(month FROM ts) AS INT) AS month, extract(day FROM ts) = 1 AS is_month_start, strftime(ts, '%m%d') IN ('0101', '0501', '1001') AS is_holiday FROM events",
)
def minute_features(spark, d):
    f = series.minute_features(F.col("ts"))
    return T.read_table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in f.items()])


# ---- models ----

_NEXT = _H + """, nx AS (SELECT *, lead(value) OVER (PARTITION BY metric ORDER BY ts) AS target FROM hourly QUALIFY target IS NOT NULL),
    sp AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts) <= floor(count(*) OVER (PARTITION BY metric) * 0.8) AS is_train FROM nx),
    ft AS (SELECT metric, regr_slope(target, value) AS slope, regr_intercept(target, value) AS intercept FROM sp WHERE is_train GROUP BY metric)"""


def _fitted(spark, d):
    return M.chronological(M.with_next(T.hourly(spark, d)))


@query(
    "model_metrics",
    _NEXT
    + ", er AS (SELECT metric, slope, intercept, target, target - intercept - slope * value AS e FROM sp JOIN ft USING (metric) WHERE NOT is_train) SELECT metric, count(*) AS n, round(any_value(slope), 9) AS slope, round(any_value(intercept), 6) AS intercept, round(1 - sum(e * e) / (var_pop(target) * count(*)), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM er GROUP BY metric",
)
def model_metrics(spark, d):
    out = M.line_metrics(_fitted(spark, d))
    return out.select("metric", "n", F.round("slope", 9).alias("slope"), *[F.round(c, 6).alias(c) for c in ("intercept", "r2", "rmse", "mae")])


@query(
    "recursive_forecast",
    _NEXT.replace("WITH", "WITH RECURSIVE", 1)
    + ", la AS (SELECT metric, arg_max(value, ts) AS last FROM hourly GROUP BY 1), fc AS (SELECT metric, slope, intercept, 0 AS step, last AS value FROM ft JOIN la USING (metric) UNION ALL SELECT metric, slope, intercept, step + 1, greatest(0.0, least(1e9, intercept + slope * value)) FROM fc WHERE step < 24) SELECT metric, step, round(value, 6) AS value, round(greatest(0.5, 1.0 - 0.01 * step)::DOUBLE, 6) AS confidence FROM fc WHERE step > 0",
)
def recursive_forecast(spark, d):
    lines = M.line_metrics(_fitted(spark, d)).select("metric", "slope", "intercept")
    last = T.hourly(spark, d).groupBy("metric").agg(F.max_by("value", "ts").alias("last"))
    return M.recursive_forecast(lines.join(last, "metric"), 24).withColumns({"value": F.round("value", 6), "confidence": F.round("confidence", 6)})


@query("horizon_points", "SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 168) * 60 WHEN 1 THEN greatest(1, (o_orderkey % 168) // 24) ELSE o_orderkey % 168 END AS INT) AS points FROM orders")
def horizon_points(spark, d):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "minute").when(F.col("o_orderkey") % 3 == 1, "day").otherwise("hour")
    return T.read_table(spark, d, "orders").select("o_orderkey", M.horizon_points(kind, F.col("o_orderkey") % 168).alias("points"))


@query("training_values", "SELECT event_id, value FROM events WHERE value > 0 AND value <= 100")
def training_values(spark, d):
    return M.usable_values(T.read_table(spark, d, "events").select("event_id", "value"), open_low=True)


@query("aligned_features", "SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(0.5 AS DOUBLE) AS hour, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer")
def aligned_features(spark, d):
    return M.aligned(T.read_table(spark, d, "customer"), {"c_acctbal": 0.0, "hour": 0.5, "c_nationkey": -1.0}, "c_custkey")


@query("model_selection")
def model_selection(spark, d):
    rows = M.with_next(series.training_features(T.hourly(spark, d)).na.fill(0.0))
    scores = M.select_model(rows, ["value", "sin_hour", "cos_hour", "mean_6"], ("ols", "ridge"), 3)
    return spark.createDataFrame(scores, "model string, rmse double")


FORECAST_FEATURES = ["value", "sin_hour", "cos_hour", "sin_day", "cos_day", "is_business_hour", "is_weekend", "lag_1", "lag_24", "lag_168", "change", "mean_6", "std_6"]
#: The kind of resource that each series stands for, and the candidate its model is; one has no model.
FORECAST_KINDS = {"qps": "ridge", "cpu": "boosted", "memory": "forest"}


def _kind():
    return F.when(F.col("metric") == "error", "qps").when(F.col("metric") == "view", "cpu").when(F.col("metric") == "click", "memory").otherwise("disk")


@query("model_forecast")
def model_forecast(spark, d):
    rows = T.hourly(spark, d)
    trained = M.with_next(series.training_features(rows).na.fill(0.0)).withColumn("kind", _kind())
    models = {kind: (M.fit_model(trained.where(F.col("kind") == kind), FORECAST_FEATURES, name), FORECAST_FEATURES) for kind, name in FORECAST_KINDS.items()}
    return M.model_forecast(M.newest_values(rows).withColumn("kind", _kind()), models, 24)


# ---- generators ----

_U = lambda key, salt: f"((('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 12))::BIGINT + 0.5) / {float(16**12)}::DOUBLE)"
_N = lambda key, salt: f"(sqrt(-2 * ln({_U(key, salt + 'a')})) * cos(2 * pi() * {_U(key, salt + 'b')}))"


@query("mock_history", "SELECT CAST(i AS INT) AS i, round(greatest(0.0, 50 + 50 * sin(2 * pi() * (i % 24) / 24) + 10 * " + _N("i", "qps42") + "), 6) AS value FROM range(168) t(i)")
def mock_history(spark, d):
    return G.mock_history(spark, "qps", 168).withColumn("value", F.round("value", 6))


_YEAR = f"""WITH b AS (SELECT i, TIMESTAMP '2024-01-01' + to_hours(i) AS ts, {list(G.HOURS)}[i % 24 + 1]::DOUBLE * {list(G.DAYS)}[(i // 24) % 7 + 1]::DOUBLE AS f, {_N('i', 'cpu42')} AS z, {_U('i', 'cpu42s')} < 0.01 AS spike FROM range(8760) t(i)),
    y AS (SELECT ts, greatest(5.0, least(95.0, 15 + 45 * f + 4 * z + CASE WHEN spike THEN 25 ELSE 0 END)) AS value FROM b)"""


@query("generated_year", _YEAR + " SELECT ts, round(value, 6) AS value, CAST(greatest(1, least(20, ceil(value / 25))) AS INT) AS instances, round(coalesce(lead(value) OVER (ORDER BY ts), avg(value) OVER ()), 6) AS target FROM y")
def generated_year(spark, d):
    return G.with_target(G.year(spark, "cpu")).withColumns({"value": F.round("value", 6), "target": F.round("target", 6)})


@query("generated_stats", _YEAR + " SELECT count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM y")
def generated_stats(spark, d):
    v = G.year(spark, "cpu")
    return v.agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query("generated_samples", "SELECT CAST(i AS INT) AS i, round(100 * " + _U("i", "memory7") + ", 6) AS value FROM range(100) t(i)")
def generated_samples(spark, d):
    return G.samples(spark, "memory").withColumn("value", F.round("value", 6))


# ---- diagnosis ----

_CAUSES = ORACLE_SQL["root_causes"]
_HIGH = "hm AS (SELECT metric AS name FROM (" + ORACLE_SQL["anomaly_composite"] + ") WHERE anomaly_score > 0.5)"


def _sources(spark, d):
    from opsweave.plans.cluster_queries import _texts

    causes = rca.root_causes(rca.match_patterns(*_texts(spark, d)))
    critical = _events(spark, d).where("severity = 'critical'")
    high = anomaly.composite_score(T.hourly(spark, d)).where("anomaly_score > 0.5").select(F.col("metric").alias("name"))
    errors = _lines(spark, d).where(F.col("level").isin("ERROR", "FATAL"))
    return causes, high, critical, errors


_FEW = "array_to_string(list_sort(list(v)), ',') FROM (SELECT DISTINCT {v} AS v FROM {t} WHERE {v} IS NOT NULL ORDER BY 1 LIMIT {n})"


@query(
    "cause_evidence",
    _LEVELS
    + _E.replace("WITH", ",", 1)
    + f""", {_HIGH}, er AS (SELECT error_type FROM p WHERE level IN ('ERROR', 'FATAL')), cr AS (SELECT * FROM n WHERE severity = 'critical'), rc AS ({_CAUSES})
    SELECT cause, CASE cause {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in D.DESCRIPTIONS.items())} END AS description, round(confidence, 6) AS confidence, (SELECT {_FEW.format(v="kind || '/' || name", t='cr', n=5)}) AS components, (SELECT {_FEW.format(v='name', t='hm', n=3)}) AS metrics,
      (SELECT {_FEW.format(v='reason', t='cr', n=3)}) AS events, (SELECT {_FEW.format(v='error_type', t='er', n=3)}) AS logs FROM rc""",
)
def cause_evidence(spark, d):
    causes, high, critical, errors = _sources(spark, d)
    out = D.explain_causes(causes, high, critical, errors)
    named = {"components": "components", "metric_evidence": "metrics", "event_evidence": "events", "log_evidence": "logs"}
    return out.select("cause", "description", F.round("confidence", 6).alias("confidence"), *[F.array_join(c, ",").alias(n) for c, n in named.items()])


@query("overall_confidence", f"WITH rc AS ({_CAUSES}) SELECT coalesce(max(confidence), 0.0) AS confidence FROM rc")
def overall_confidence(spark, d):
    return D.overall_confidence(_sources(spark, d)[0]).withColumn("confidence", F.round("confidence", 6))


_CHAIN = ORACLE_SQL["causal_chain"]
_LINKS = (
    _LEVELS
    + _E.replace("WITH", ",", 1)
    + f""", {_HIGH}, x AS (SELECT (SELECT count(*) FROM hm) AS m, (SELECT count(*) FROM n WHERE severity = 'critical') AS e, (SELECT count(*) FROM p WHERE level IN ('ERROR', 'FATAL')) AS l,
      (SELECT count(*) FROM (SELECT name FROM n WHERE severity = 'critical' INTERSECT SELECT 'obj-' || CAST(CAST(substr(pod, 5) AS BIGINT) % 70 AS VARCHAR) FROM p WHERE level IN ('ERROR', 'FATAL'))) AS sh, (SELECT max(chain) FROM ({_CHAIN})) AS ch),
    y AS (SELECT *, list_filter([CASE WHEN m > 0 THEN 'metrics' END, CASE WHEN e > 0 THEN 'events' END, CASE WHEN l > 0 THEN 'logs' END], lambda v: v IS NOT NULL) AS s FROM x),
    lk AS (SELECT 'temporal' AS kind, 0.7 + 0.1 * len(s) AS confidence, array_to_string(s, ',') AS evidence FROM y WHERE len(s) >= 2 UNION ALL SELECT 'component', 0.75, CAST(least(sh, 3) AS VARCHAR) FROM y WHERE sh > 0 UNION ALL SELECT 'causal', 0.8, ch FROM y WHERE ch IS NOT NULL
      UNION ALL SELECT 'data_insufficient', 0.1, '' FROM y WHERE len(s) = 0 AND sh = 0 AND ch IS NULL UNION ALL SELECT 'single_data_source', 0.3, s[1] FROM y WHERE len(s) = 1 AND sh = 0 AND ch IS NULL)"""
)


def _links(spark, d):
    from opsweave.plans.cluster_queries import causal_chain

    _, high, critical, errors = _sources(spark, d)
    pods = errors.select(F.concat(F.lit("obj-"), (F.substring_index("pod", "-", -1).cast("long") % 70).cast("string")).alias("name")).distinct()
    shared = critical.select("name").distinct().join(pods, "name").agg(F.count("*").alias("shared"))
    one = high.agg(F.count("*").alias("m")).crossJoin(critical.agg(F.count("*").alias("e"))).crossJoin(errors.agg(F.count("*").alias("l"))).crossJoin(shared)
    one = one.crossJoin(causal_chain(spark, d).agg(F.max("chain").alias("chain")))  # one row each
    return one.select(F.explode(D.correlations(F.col("m"), F.col("e"), F.col("l"), F.col("shared"), F.col("chain"))).alias("x")).select("x.*")


@query("source_correlations", _LINKS + " SELECT kind, round(CAST(confidence AS DOUBLE), 6) AS confidence, evidence FROM lk")
def source_correlations(spark, d):
    return _links(spark, d).withColumn("confidence", F.round("confidence", 6))


@query("correlation_causes", _LINKS + f", rc AS ({_CAUSES}) SELECT cause, round(confidence, 6) AS confidence FROM rc UNION ALL SELECT 'CORRELATION_BASED', 0.8 FROM lk WHERE kind = 'causal' AND confidence > 0.7")
def correlation_causes(spark, d):
    return D.with_correlation_cause(_sources(spark, d)[0], _links(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("confidence_bands", f"WITH rc AS ({_CAUSES}) SELECT cause, CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.3 THEN 'medium' ELSE 'low' END AS band FROM rc")
def confidence_bands(spark, d):
    return _sources(spark, d)[0].select("cause", rca.confidence_band(F.col("confidence")).alias("band"))


@query(
    "quick_diagnosis",
    f"""WITH rc AS ({_CAUSES}), tl AS ({ORACLE_SQL['timeline_topk']}), t AS (SELECT cause FROM rc ORDER BY confidence DESC, cause LIMIT 1), f AS (SELECT * FROM tl ORDER BY ts, type, description LIMIT 5)
    SELECT 'root_cause' AS kind, 'critical' AS severity, CASE cause {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in D.DESCRIPTIONS.items())} END AS description FROM t UNION ALL SELECT 'event', severity, description FROM f WHERE severity IN ('critical', 'high')""",
)
def quick_diagnosis(spark, d):
    from opsweave.plans.cluster_queries import timeline_topk

    return D.quick_diagnosis(_sources(spark, d)[0], timeline_topk(spark, d))


def _configured(spark, d):
    """Parts as deployments of one container whose settings follow from their columns."""
    p, size = F.col("p_partkey"), F.col("p_size")
    probe = lambda shift, paths: F.struct(((p + shift) % 4).cast("int").alias("failure_threshold"), ((p + shift) % 11).cast("int").alias("period_seconds"), ((p + shift) % 7).cast("int").alias("initial_delay_seconds"), F.element_at(F.array(*map(F.lit, paths)), ((p + shift) % len(paths) + 1).cast("int")).alias("path"))
    issues = F.array_compact(F.array(F.when(p % 3 == 0, "CrashLoopBackOff"), F.when(p % 4 == 0, "OOMKilled"), F.when(p % 5 == 0, "NotReady")))
    container = F.struct(
        F.lit("main").alias("name"),
        F.when(p % 2 == 0, "nginx:1.21").otherwise("app:2").alias("image"),
        F.when(size % 3 != 0, probe(0, ("/", "/health", "/healthz", "/nonexistent"))).alias("liveness"),
        F.when(size % 4 != 0, probe(1, ("/", "/health"))).alias("readiness"),
        F.concat((size * 10).cast("string"), F.lit("Mi")).alias("memory_request"),
        F.concat((size * 9).cast("string"), F.lit("m")).alias("cpu_request"),
        F.when(size % 5 != 0, F.concat((size * 8).cast("string"), F.when(size % 7 == 0, "Gi").otherwise("Mi"))).alias("memory_limit"),
    )
    return T.read_table(spark, d, "part").select(F.concat(F.lit("dep-"), p.cast("string")).alias("name"), issues.alias("issues"), F.array(container).alias("containers"))


def _probe_sql(kind: str, has: str, shift: int, paths: tuple, bad: str) -> str:
    k = f"(p_partkey + {shift})"
    return ", ".join(
        f"CASE WHEN {has} AND {test} THEN '{kind}_{name}' END"
        for name, test in (("failure_threshold", f"{k} % 4 < 2"), ("period", f"{k} % 11 < 5"), ("initial_delay", f"{k} % 7 < 5"), ("path", f"p_partkey % 2 = 0 AND {list(paths)}[{k} % {len(paths)} + 1] IN {bad}"))
    )


@query(
    "misconfigurations",
    f"""WITH i AS (SELECT p_partkey, unnest(list_filter([{_probe_sql('liveness', 'p_size % 3 <> 0', 0, ('/', '/health', '/healthz', '/nonexistent'), "('/nonexistent', '/health', '/healthz')")}, {_probe_sql('readiness', 'p_size % 4 <> 0', 1, ('/', '/health'), "('/health')")},
      CASE WHEN (p_partkey % 3 = 0 AND p_size % 3 <> 0 AND p_size % 4 = 0) OR (p_partkey % 2 = 0 AND p_partkey % 5 = 0 AND p_size % 4 = 0) THEN 'readiness_missing' END, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 0 AND p_size % 3 = 0 THEN 'liveness_missing' END,
      CASE WHEN p_size * 10 > 256 THEN 'memory_request_high' END, CASE WHEN p_size * 9 > 300 THEN 'cpu_request_high' END,
      CASE WHEN p_partkey % 4 = 0 AND (p_size % 5 = 0 OR p_size % 7 = 0 OR p_size * 8 < 256) THEN 'oom_limit_low' END], lambda x: x IS NOT NULL)) AS issue FROM part)
    SELECT 'dep-' || CAST(p_partkey AS VARCHAR) AS name, 'main' AS container, issue FROM i""",
)
def misconfigurations(spark, d):
    return D.misconfigurations(_configured(spark, d))


@query("image_pull_failures", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'click') OR user_id % 10 = 0")
def image_pull_failures(spark, d):
    reason = F.when(F.col("event_type") == "purchase", "ErrImagePull").when(F.col("event_type") == "click", "ImagePullBackOff")
    message = F.when(F.col("user_id") % 10 == 0, "Back-off pulling image x").otherwise("all well")
    return D.image_pull_failures(T.read_table(spark, d, "events").select("event_id", reason.alias("reason"), message.alias("message"))).select("event_id")


@query(
    "cluster_diagnosis",
    f"""WITH {T.PODS_SQL}, {T.DEPLOYMENTS_SQL}, {T.CLUSTER_EVENTS_SQL}, pr AS (SELECT phase, coalesce((SELECT bool_and(ready) FROM containers WHERE l_orderkey = o_orderkey), true) AS ready FROM pods)
    SELECT (SELECT count(*) FILTER (s_acctbal > 0) FROM supplier) AS ready_nodes, (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FILTER (phase = 'Running' AND ready) FROM pr) AS running_pods, (SELECT count(*) FROM pr) AS pods,
      (SELECT count(*) FILTER (NOT (phase = 'Running' AND ready)) FROM pr) AS problem_pods, (SELECT count(*) FILTER (available = desired) FROM deps) AS healthy_deployments, (SELECT count(*) FROM deps) AS deployments, (SELECT count(*) FILTER (type = 'Warning') FROM k8s) AS warnings""",
)
def cluster_diagnosis(spark, d):
    ready = F.forall(F.coalesce("containers", F.array()), lambda c: c["ready"])
    pods = T.pods(spark, d).select("phase", ready.alias("ready"))
    return D.cluster_diagnosis(T.nodes(spark, d), pods, T.deployments(spark, d), _events(spark, d))


@query(
    "fix_verification",
    "WITH p AS (SELECT 'dep-' || CAST(o_custkey AS VARCHAR) AS deployment, o_orderstatus = 'O' AS ready, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS crash FROM orders), s AS (SELECT deployment, count(*) FILTER (ready) AS ready, count(*) AS total, count(*) FILTER (crash) AS c FROM p GROUP BY 1) SELECT deployment, ready, total, round(100.0 * ready / total, 6) AS percent, CASE WHEN ready = total THEN 'fixed' WHEN 100.0 * ready / total >= 50 THEN 'partial' WHEN c > 0 THEN 'crash_loop' ELSE 'waiting' END AS verdict FROM s",
)
def fix_verification(spark, d):
    status = F.col("o_orderstatus")
    pods = T.read_table(spark, d, "orders").select(F.concat(F.lit("dep-"), F.col("o_custkey").cast("string")).alias("deployment"), (status == "O").alias("ready"), ((status == "F") & (F.col("o_orderkey") % 3 == 0)).alias("crash_loop"))
    return D.fix_verification(pods).withColumn("percent", F.round("percent", 6))


@query(
    "service_details",
    "SELECT c_mktsegment AS namespace, 'svc-' || CAST(c_custkey AS VARCHAR) AS name, CAST(count(o_orderkey) AS INT) AS n_addresses FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1, 2",
)
def service_details(spark, d):
    customer, orders = T.read_table(spark, d, "customer"), T.read_table(spark, d, "orders")
    services = customer.select(F.col("c_mktsegment").alias("namespace"), F.concat(F.lit("svc-"), F.col("c_custkey").cast("string")).alias("name"))
    open_orders = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("addresses"))
    endpoints = open_orders.join(customer, open_orders.o_custkey == customer.c_custkey).select(F.col("c_mktsegment").alias("namespace"), F.concat(F.lit("svc-"), F.col("c_custkey").cast("string")).alias("name"), "addresses")
    return D.service_details(services, endpoints).select("namespace", "name", F.size("addresses").alias("n_addresses"))


@query("deployment_status", f"WITH {T.DEPLOYMENTS_SQL} SELECT *, available = desired AS healthy FROM deps")
def deployment_status(spark, d):
    return D.deployment_status(T.deployments(spark, d))


@query(
    "namespace_deployments",
    f"WITH {T.DEPLOYMENTS_SQL} SELECT namespace, count(*) AS deployments, count(*) FILTER (available = desired) AS healthy, CAST(sum(desired) AS BIGINT) AS desired, CAST(sum(available) AS BIGINT) AS available FROM deps GROUP BY 1",
)
def namespace_deployments(spark, d):
    return inspection.namespace_deployments(D.deployment_status(T.deployments(spark, d)))


_USE = "WITH u AS (SELECT 'pod-' || CAST(l_orderkey AS VARCHAR) AS name, CAST(l_quantity AS INT) / 1000.0 AS c, CAST(l_quantity AS INT) * 1048576.0 AS m FROM lineitem), s AS (SELECT name, sum(c) AS c, sum(m) AS m FROM u GROUP BY 1)"


def _usage(spark, d):
    q = F.col("l_quantity").cast("int").cast("string")
    return D.pods_usage(T.read_table(spark, d, "lineitem").select(F.concat(F.lit("pod-"), F.col("l_orderkey").cast("string")).alias("name"), F.concat(q, F.lit("m")).alias("cpu"), F.concat(q, F.lit("Mi")).alias("memory")))


@query("pod_usage", _USE + " SELECT name, round(c, 6)::DOUBLE AS cores, round(m / 1048576, 2)::DOUBLE AS megabytes FROM s")
def pod_usage(spark, d):
    return _usage(spark, d).withColumn("cores", F.round("cores", 6))


@query("topk_memory", _USE + " SELECT name, round(m / 1048576, 2)::DOUBLE AS megabytes FROM s ORDER BY m DESC, name LIMIT 20")
def topk_memory(spark, d):
    return _usage(spark, d).select("name", "megabytes").orderBy(F.col("megabytes").desc(), "name").limit(20)


@query("recent_events", "SELECT event_id FROM events ORDER BY CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END DESC, event_id DESC LIMIT 8")
def recent_events(spark, d):
    last = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    return D.recent_events(T.read_table(spark, d, "events").select("event_id", last.alias("last_seen"), (F.col("ts") - F.expr("interval 1 day")).alias("first_seen"))).select("event_id")


@query("event_times", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 1 HOUR ELSE TIMESTAMP '2024-02-01' END AS at FROM events")
def event_times(spark, d):
    kind = F.col("event_id") % 3
    at = ev.event_time(F.when(kind == 0, F.col("ts")), F.when(kind == 1, F.col("ts") - F.expr("interval 1 hour")), now=F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))
    return T.read_table(spark, d, "events").select("event_id", at.alias("at"))


@query("events_by_name", _E + " SELECT event_id, name FROM n WHERE name IN ('obj-1', 'obj-7')")
def events_by_name(spark, d):
    return ev.select_events(_events(spark, d), names=["obj-1", "obj-7"]).select("event_id", "name")


@query("report_history", "SELECT o_orderkey AS report_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def report_history(spark, d):
    return inspection.newest_reports(T.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("ts"))).select("report_id")


@query("distinct_recommendations", "SELECT p_brand || ' check' AS recommendation, min(p_partkey) AS seq FROM part GROUP BY 1 ORDER BY seq, 1 LIMIT 10")
def distinct_recommendations(spark, d):
    return inspection.distinct_recommendations(T.read_table(spark, d, "part").select(F.concat("p_brand", F.lit(" check")).alias("recommendation"), F.col("p_partkey").alias("seq")))


@query("first_lines", f"WITH {T.LOG_LINES_SQL} SELECT pod, line_no FROM log_lines QUALIFY row_number() OVER (PARTITION BY pod, container ORDER BY line_no) <= 3")
def first_lines(spark, d):
    return logs.head(T.log_lines(spark, d), 3).select("pod", "line_no")


@query(
    "log_error_groups",
    _LEVELS + " SELECT coalesce(error_type, 'unknown') AS error_type, pod || '_' || coalesce(error_type, 'unknown') AS key, count(*) AS n, arg_min(substr(line, 1, 200), line_no) AS first FROM p WHERE level IN ('ERROR', 'FATAL') GROUP BY 1, 2",
)
def log_error_groups(spark, d):
    return logs.errors_by_pod(_lines(spark, d))


# ---- units, recommendations, reports, stored ranges ----

_PAIRS = [p[:3] for p in Q.unit_pairs()] + [("length", "km", "m"), ("weight", "oz", "g"), ("time", "day", "h"), ("storage", "tb", "b"), ("speed", "m", "s")]


def _unit_sql() -> str:
    """Factors as SQL of their own form: linear ones from the table, temperatures by their formulas."""
    rows = ", ".join(f"({i}, '{a}', '{b}', '{c}', {Q.FACTORS[a][b][c]!r}::DOUBLE)" if c in Q.FACTORS.get(a, {}).get(b, {}) else f"({i}, '{a}', '{b}', '{c}', NULL)" for i, (a, b, c) in enumerate(_PAIRS))
    celsius = "CASE f WHEN 'c' THEN v WHEN 'f' THEN (v - 32) * 5 / 9 ELSE v - 273.15 END"
    return f"""WITH u(i, kind, f, t, x) AS (VALUES {rows}), p AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS v, p_partkey % {len(_PAIRS)} AS i FROM part)
    SELECT p_partkey, f AS source, t AS target, round(CASE WHEN kind <> 'temperature' THEN v * x WHEN f = t THEN v WHEN t = 'c' THEN {celsius} WHEN t = 'f' THEN ({celsius}) * 9 / 5 + 32 ELSE ({celsius}) + 273.15 END, 6) AS converted FROM p JOIN u USING (i)"""


@query("unit_rows", _unit_sql())
def unit_rows(spark, d):
    pairs = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("kind", "source", "target"), p)]) for p in _PAIRS])
    rows = T.read_table(spark, d, "part").select("p_partkey", "p_retailprice", F.element_at(pairs, (F.col("p_partkey") % len(_PAIRS) + 1).cast("int")).alias("u"))
    rows = rows.select("p_partkey", "p_retailprice", "u.*")
    return Q.convert_rows(rows, "p_retailprice", "kind", "source", "target").select("p_partkey", "source", "target", "converted")


#: Parts as findings: a recommendation by brand, high where the part is large.
def _advice(spark, d, brands: int):
    rows = T.read_table(spark, d, "part").where(F.substring("p_brand", 7, 2).cast("int") < brands)
    severity = F.when(F.col("p_size") > 40, "high").when(F.col("p_size") > 20, "medium").otherwise("low")
    return rows.select(F.col("p_partkey").alias("seq"), severity.alias("severity"), F.concat("p_brand", F.lit(" check")).alias("recommendation"))


def _advice_sql(brands: int) -> str:
    return f"""adv AS (SELECT * FROM part WHERE CAST(substr(p_brand, 7, 2) AS INT) < {brands}),
    rec AS (SELECT p_brand || ' check' AS recommendation, 0 AS k, min(p_partkey) AS seq FROM adv GROUP BY 1
      UNION ALL SELECT r, 1, s FROM (VALUES ('为核心服务启用 HPA/VPA', 0), ('配置 PDB 保障可用性', 1)) v(r, s) WHERE EXISTS (SELECT 1 FROM adv WHERE p_size > 40)),
    adviced AS (SELECT CAST(row_number() OVER (ORDER BY k, seq, recommendation) AS INT) AS place, recommendation FROM rec QUALIFY place <= 10)"""


@query("collected_recommendations", f"WITH {_advice_sql(15)} SELECT * FROM adviced")
def collected_recommendations(spark, d):
    return inspection.collected_recommendations(_advice(spark, d, 15))


@query(
    "report_markdown",
    _FINDINGS
    + f""", {_advice_sql(15)}, o AS (SELECT *, row_number() OVER (ORDER BY rule_id, substr(md5(resource), 1, 2), resource, message) AS n FROM f),
    c AS (SELECT count(*) AS t, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM f), z AS (SELECT CAST(4611686018427387904 AS BIGINT) AS z),
    r AS (SELECT rule_id, count(*) AS k, row_number() OVER (ORDER BY rule_id) AS n FROM f GROUP BY rule_id),
    a AS (SELECT 1 AS section, 0 AS n, ['# 巡检报告 r-1', '', '## 概览', '- 范围: cluster ', '- 检查数: 9，问题: ' || t || ' (H/M/L: ' || h || '/' || m || '/' || l || ')', ''] AS x FROM c
      UNION ALL SELECT 2, 0, CASE WHEN t = 0 THEN ['## 发现列表', '无显著问题'] ELSE ['## 发现列表'] END FROM c
      UNION ALL SELECT 2, n, [n || '. [' || upper(severity) || '] ' || rule_id, '   - 资源: ' || replace(resource, '/', ':'), '   - 描述: ' || message] FROM o
      UNION ALL SELECT 2, z, [''] FROM z UNION ALL SELECT 3, 0, ['## 建议'] FROM z UNION ALL SELECT 3, place, ['- ' || recommendation] FROM adviced UNION ALL SELECT 3, z, [''] FROM z
      UNION ALL SELECT 4, 0, ['## 统计'] FROM z UNION ALL SELECT 4, n, ['- ' || rule_id || ': ' || k] FROM r)
    SELECT section, n, CAST(unnest(range(len(x))) AS INT) AS part, unnest(x) AS line FROM a""",
)
def report_markdown(spark, d):
    findings = written(inspection.inspect(_tables(spark, d)), "findings")
    return inspection.report_rows(findings, inspection.collected_recommendations(_advice(spark, d, 15)), "r-1", "cluster")


@query(
    "stored_range",
    """SELECT event_type AS metric, 'pod-' || CAST(user_id % 5 AS VARCHAR) AS pod, date_trunc('minute', ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL""",
)
def stored_range(spark, d):
    path = f"{shared_dir(spark)}/opsweave-pages-{uuid.uuid4().hex}"
    ranges.write_pages(T.samples(spark, d), path)
    rows = ranges.read_pages(spark, path).withColumn("pod", F.element_at("labels", "pod"))
    return series.resample(rows, "1 minute", by=["metric", "pod"]).withColumn("value", F.round("value", 6))


# ---- listings ----


def _meta(name, namespace, annotations=None, app=None):
    none = F.lit(None)
    labels = F.create_map(F.lit("app"), app) if app is not None else none.cast("map<string,string>")
    return F.struct(name.alias("name"), namespace.alias("namespace"), none.cast("timestamp").alias("creation_timestamp"), (none.cast("map<string,string>") if annotations is None else annotations).alias("annotations"), labels.alias("labels"))


@query(
    "rollout_history",
    """SELECT o_orderpriority AS namespace, 'dep-' || CAST(o_custkey AS VARCHAR) AS deployment, CAST(o_orderkey AS INT) AS revision, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '未记录' END AS change_cause,
    'rs-' || CAST(o_orderkey AS VARCHAR) AS replica_set, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 7 END AS INT) AS replicas, CAST(o_orderkey % 2 AS INT) AS ready FROM orders WHERE o_orderkey % 4 > 0""",
)
def rollout_history(spark, d):
    # Orders as replica sets of their customer; one in four has no usable revision.
    key = F.col("o_orderkey")
    revision = F.when(key % 8 == 0, "latest").when(key % 4 > 0, key.cast("string"))
    noted = F.map_filter(F.create_map(F.lit(listings.REVISION), revision, F.lit(listings.CAUSE), F.when(key % 3 == 0, F.col("o_orderstatus"))), lambda _, v: v.isNotNull())
    name = F.concat(F.lit("rs-"), key.cast("string"))
    meta = _meta(name, F.col("o_orderpriority"), noted, F.concat(F.lit("dep-"), F.col("o_custkey").cast("string")))
    sets = T.read_table(spark, d, "orders").select(meta.alias("metadata"), F.struct(F.when(key % 5 > 0, key % 7).cast("int").alias("replicas")).alias("spec"), F.struct((key % 2).cast("int").alias("ready_replicas")).alias("status"))
    return listings.rollout_history(sets).drop("created")


@query(
    "autoscaler_list",
    "SELECT c_mktsegment AS namespace, 'hpa-' || CAST(c_custkey AS VARCHAR) AS name, 'Deployment/dep-' || CAST(c_custkey AS VARCHAR) AS target, CAST(1 AS INT) AS min, CAST(c_custkey % 9 + 1 AS INT) AS max, CAST(c_custkey % 4 AS INT) AS current, CAST(c_custkey % 5 AS INT) AS desired FROM customer",
)
def autoscaler_list(spark, d):
    key, name = F.col("c_custkey"), F.col("c_custkey").cast("string")
    target = F.struct(F.lit("apps/v1").alias("api_version"), F.lit("Deployment").alias("kind"), F.concat(F.lit("dep-"), name).alias("name"))
    spec = F.struct(target.alias("scale_target_ref"), F.lit(1).alias("min_replicas"), (key % 9 + 1).cast("int").alias("max_replicas"))
    status = F.struct((key % 4).cast("int").alias("current_replicas"), (key % 5).cast("int").alias("desired_replicas"))
    return listings.autoscalers(T.read_table(spark, d, "customer").select(_meta(F.concat(F.lit("hpa-"), name), F.col("c_mktsegment")).alias("metadata"), spec.alias("spec"), status.alias("status")))


@query(
    "quota_list",
    """WITH q AS (SELECT p_brand AS namespace, 'quota-' || CAST(p_partkey AS VARCHAR) AS name, p_partkey, CAST(p_size AS VARCHAR) AS s FROM part)
    SELECT namespace, name, 'cpu' AS resource, s AS hard, CASE WHEN p_partkey % 3 > 0 THEN s END AS used FROM q WHERE p_partkey % 2 = 0
    UNION ALL SELECT namespace, name, 'cpu', NULL, s FROM q WHERE p_partkey % 2 = 1 AND p_partkey % 3 > 0""",
)
def quota_list(spark, d):
    # Parts as quotas; every second one grants nothing, every third one uses nothing.
    key, size = F.col("p_partkey"), F.create_map(F.lit("cpu"), F.col("p_size").cast("string"))
    meta = _meta(F.concat(F.lit("quota-"), key.cast("string")), F.col("p_brand"))
    spec = F.struct(F.when(key % 2 == 0, size).alias("hard"), F.lit(None).cast("array<string>").alias("scopes"))
    rows = T.read_table(spark, d, "part").select(meta.alias("metadata"), spec.alias("spec"), F.struct(F.when(key % 3 > 0, size).alias("used")).alias("status"))
    return listings.quota_rows(listings.quotas(rows))
