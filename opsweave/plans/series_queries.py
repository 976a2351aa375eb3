"""Queries of the time series and anomaly operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import anomaly, series
from opsweave.plans.catalog import query
from opsweave.sources import tables as T

#: Hourly series of all event types, numbered within each.
_H = f"WITH {T.HOURLY_SQL}"
_W = "OVER (PARTITION BY metric ORDER BY ts)"


@query("metric_resample", "SELECT event_type AS metric, date_trunc('minute', ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def metric_resample(spark, d):
    return series.resample(T.samples(spark, d), "1 minute").withColumn("value", F.round("value", 6))


@query(
    "metric_resample_ffill",
    _H
    + """, grid AS (SELECT metric, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY metric)
    SELECT metric, ts, round(last_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS value
    FROM grid LEFT JOIN hourly USING (metric, ts)""",
)
def metric_resample_ffill(spark, d):
    return series.fill_forward(T.hourly(spark, d), "1 hour").withColumn("value", F.round("value", 6))


@query(
    "metric_groups",
    """SELECT event_type || '|pod:pod-' || CAST(user_id % 5 AS VARCHAR) AS name, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1""",
)
def metric_groups(spark, d):
    rows = T.samples(spark, d)
    name = F.concat(F.col("metric"), F.lit("|pod:"), F.element_at("labels", "pod"))
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("metric_catalogue", "SELECT DISTINCT event_type AS metric FROM events")
def metric_catalogue(spark, d):
    return T.samples(spark, d).select("metric").distinct()


@query(
    "anomaly_composite",
    _H
    + f""", steps AS (
      SELECT *, value - lag(value) {_W} AS d, avg(value) OVER (PARTITION BY metric ORDER BY ts ROWS 4 PRECEDING) AS m,
             CAST(row_number() {_W} AS DOUBLE) AS i FROM hourly),
    s AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi,
                 quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_pop(d) AS dstd, avg(abs(value)) AS am,
                 max(abs(value - m) / (m + 1e-10)) AS dev, regr_slope(value, i) AS slope, corr(value, i) AS r FROM steps GROUP BY metric),
    t AS (SELECT metric, avg(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS ratio
          FROM hourly JOIN s USING (metric) GROUP BY metric),
    u AS (SELECT *, list_filter([
             CASE WHEN std > 0 AND greatest(hi - mean, mean - lo) / std > 2 THEN least(greatest(hi - mean, mean - lo) / std / 3.0, 1.0) END,
             CASE WHEN q3 > q1 THEN least(ratio * 2, 1.0) END, least(dstd / (am + 1e-10) * 1.5, 1.0),
             CASE WHEN n > 10 AND dev > 0.5 THEN least(dev, 1.0) END], lambda x: x IS NOT NULL) AS sc FROM s JOIN t USING (metric))
    SELECT metric, n, round(CASE WHEN n < 10 THEN 0.0 ELSE greatest(0.0, least(1.0, list_max(sc) * 0.6 + list_avg(sc) * 0.4)) END, 6) AS anomaly_score,
           CASE WHEN n >= 5 AND abs(r) > 0.5 AND abs(slope / mean) > 0.1 THEN CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'stable' END AS trend,
           CASE WHEN n < 10 THEN false ELSE greatest(0.0, least(1.0, list_max(sc) * 0.6 + list_avg(sc) * 0.4)) > 0.5 END AS is_high
    FROM u""",
)
def anomaly_composite(spark, d):
    return anomaly.scored_series(T.hourly(spark, d)).withColumn("anomaly_score", F.round("anomaly_score", 6))


@query(
    "trend_ols",
    _H
    + f""", n AS (SELECT *, CAST(row_number() {_W} AS DOUBLE) AS i FROM hourly),
    f AS (SELECT metric, count(*) AS n, regr_slope(value, i) AS slope, corr(value, i) AS r, avg(value) AS mean FROM n GROUP BY metric)
    SELECT metric, n, round(slope, 9) AS slope, CASE WHEN n >= 5 AND abs(r) > 0.5 AND abs(slope / mean) > 0.1
           THEN CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'stable' END AS trend FROM f""",
)
def trend_ols(spark, d):
    return series.trend(T.hourly(spark, d)).withColumn("slope", F.round("slope", 9))


@query(
    "half_split_trend",
    _H
    + f""", n AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY metric) AS c FROM hourly),
    h AS (SELECT metric, avg(value) FILTER (i <= c // 2) AS first_half, avg(value) FILTER (i > c // 2) AS second_half FROM n GROUP BY metric)
    SELECT metric, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half,
           CASE WHEN second_half > first_half * 1.1 THEN 'increasing' WHEN second_half < first_half * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM h""",
)
def half_split_trend(spark, d):
    return series.half_split_trend(T.hourly(spark, d)).withColumns({c: F.round(c, 6) for c in ("first_half", "second_half")})


@query(
    "series_summary",
    _H
    + """ SELECT metric, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    arg_max(ts, (value, -epoch(ts))) AS peak_ts, round(stddev_pop(value) / avg(value), 6) AS cv FROM hourly GROUP BY metric""",
)
def series_summary(spark, d):
    return series.series_summary(T.hourly(spark, d)).withColumns({c: F.round(c, 6) for c in ("low", "high", "mean", "std", "cv")})


@query("lag_features", _H + f" SELECT metric, ts, round(value, 6) AS value, round(lag(value, 1) {_W}, 6) AS lag_1, round(lag(value, 24) {_W}, 6) AS lag_24, round(lag(value, 168) {_W}, 6) AS lag_168 FROM hourly")
def lag_features(spark, d):
    return series.lags(T.hourly(spark, d)).withColumns({c: F.round(c, 6) for c in ("value", "lag_1", "lag_24", "lag_168")})


@query(
    "relative_change",
    _H + f", l AS (SELECT *, lag(value) {_W} AS p FROM hourly) SELECT metric, ts, round(greatest(-10.0, least(10.0, CASE WHEN p IS NULL OR p = 0 THEN 0.0 ELSE (value - p) / p END)), 6) AS change FROM l",
)
def relative_change(spark, d):
    return series.relative_change(T.hourly(spark, d)).select("metric", "ts", F.round("change", 6).alias("change"))


_6, _24 = "OVER (PARTITION BY metric ORDER BY ts ROWS 5 PRECEDING)", "OVER (PARTITION BY metric ORDER BY ts ROWS 23 PRECEDING)"


@query(
    "rolling_stats",
    _H
    + f""" SELECT metric, ts, round(avg(value) {_6}, 8) AS mean_6, round(coalesce(stddev_samp(value) {_6}, 0.0), 8) AS std_6, round(max(value) {_6}, 8) AS max_6,
    round(min(value) {_6}, 8) AS min_6, round(avg(value) {_24}, 8) AS mean_24, round(max(value) {_24}, 8) AS max_24 FROM hourly""",
)
def rolling_stats(spark, d):
    names = ("mean_6", "std_6", "max_6", "min_6", "mean_24", "max_24")
    return series.rolling(T.hourly(spark, d)).select("metric", "ts", *[F.round(c, 8).alias(c) for c in names])


_12 = "OVER (PARTITION BY metric ORDER BY ts ROWS 11 PRECEDING)"


@query(
    "rolling_slope",
    _H
    + f""", n AS (SELECT *, CAST(row_number() {_W} AS DOUBLE) AS i FROM hourly),
    f AS (SELECT *, avg(value * i) {_12} AS vi, avg(value) {_12} AS v, avg(i) {_12} AS m, var_pop(i) {_12} AS q, stddev_pop(value) {_12} AS sd FROM n)
    SELECT metric, ts, round(greatest(-100.0, least(100.0, CASE WHEN q = 0 OR sd = 0 THEN 0.0 ELSE (vi - v * m) / q END)), 5) AS slope FROM f""",
)
def rolling_slope(spark, d):
    return series.rolling_slope(T.hourly(spark, d)).select("metric", "ts", F.round("slope", 5).alias("slope"))


@query(
    "growth_rate",
    _H
    + f""", l AS (SELECT *, lag(value, 24) {_W} AS p FROM hourly),
    b AS (SELECT *, coalesce(first_value(nullif(p, 0) IGNORE NULLS) OVER (PARTITION BY metric ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS base FROM l)
    SELECT metric, ts, round(CASE WHEN p IS NULL THEN 0.0 ELSE greatest(-5.0, least(5.0, (value - p) / base)) END, 6) AS growth FROM b""",
)
def growth_rate(spark, d):
    return series.growth_rate(T.hourly(spark, d)).select("metric", "ts", F.round("growth", 6).alias("growth"))


@query(
    "quantile_clip",
    """WITH q AS (SELECT event_type AS metric, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM events GROUP BY 1)
    SELECT event_id, round(greatest(lo - 0.1 * (hi - lo), least(hi + 0.1 * (hi - lo), value)), 6) AS value FROM events JOIN q ON event_type = metric""",
)
def quantile_clip(spark, d):
    rows = T.read_table(spark, d, "events").select("event_id", F.col("event_type").alias("metric"), "value")
    return series.clip_quantiles(rows, 0.25, 0.75, 0.1).select("event_id", F.round("value", 6).alias("value"))


@query(
    "rate_counter",
    """WITH s AS (SELECT event_id, event_type AS metric, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
    i AS (SELECT *, CASE WHEN p IS NULL THEN 0.0 WHEN value < p THEN value ELSE value - p END AS step, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM s)
    SELECT event_id, round(sum(step) OVER (PARTITION BY metric ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) / 3600.0, 6) AS rate FROM i""",
)
def rate_counter(spark, d):
    rows = T.read_table(spark, d, "events").select("event_id", F.col("event_type").alias("metric"), "ts", "value")
    return series.counter_rate(rows, 3600, tie=("event_id",)).select("event_id", F.round("rate", 6).alias("rate"))


@query(
    "metric_ratio",
    """WITH h AS (SELECT event_type AS metric, date_trunc('hour', ts) AS ts, 'pod-' || CAST(user_id % 5 AS VARCHAR) AS pod, avg(value) AS value FROM events GROUP BY 1, 2, 3)
    SELECT a.ts, a.pod, round(a.value / b.value, 6) AS ratio FROM h a JOIN h b ON a.ts = b.ts AND a.pod = b.pod WHERE a.metric = 'error' AND b.metric = 'view' AND b.value <> 0""",
)
def metric_ratio(spark, d):
    rows = T.samples(spark, d).groupBy("metric", F.date_trunc("hour", "ts").alias("ts"), F.element_at("labels", "pod").alias("pod")).agg(F.avg("value").alias("value"))
    labelled = rows.withColumn("labels", F.create_map(F.lit("pod"), F.col("pod")))
    return series.ratio_of(labelled, "error", "view", labels="labels").select("ts", F.element_at("labels", "pod").alias("pod"), F.round("ratio", 6).alias("ratio"))


@query(
    "time_features",
    """WITH e AS (SELECT event_id, ts, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday FROM events)
    SELECT event_id, hour, weekday, round(sin(2 * pi() * hour / 24), 6) AS sin_hour, round(cos(2 * pi() * hour / 24), 6) AS cos_hour,
           round(sin(2 * pi() * weekday / 7), 6) AS sin_day, round(cos(2 * pi() * weekday / 7), 6) AS cos_day,
           CAST(hour BETWEEN 9 AND 17 AND weekday < 5 AS INT) AS is_business_hour, CAST(weekday >= 5 AS INT) AS is_weekend, CAST(month(ts) AS INT) AS month,
           CAST(day(ts) = 1 AS INT) AS is_month_start, CAST(CAST(ts AS DATE) = last_day(ts) AS INT) AS is_month_end FROM e""",
)
def time_features(spark, d):
    out = series.time_features(T.read_table(spark, d, "events").select("event_id", "ts")).drop("ts")
    return out.withColumns({c: F.round(c, 6) for c in ("sin_hour", "cos_hour", "sin_day", "cos_day")})


@query(
    "features_train",
    _H
    + f""", n AS (SELECT *, lag(value) {_W} AS l1, lag(value, 24) {_W} AS l24, lag(value, 168) {_W} AS l168 FROM hourly)
    SELECT metric, ts, CAST(hour(ts) AS INT) AS hour, round(l1, 8) AS lag_1, round(l24, 8) AS lag_24, round(l168, 8) AS lag_168,
           round(greatest(-10.0, least(10.0, CASE WHEN l1 IS NULL OR l1 = 0 THEN 0.0 ELSE (value - l1) / l1 END)), 8) AS change,
           round(avg(value) {_6}, 8) AS mean_6, round(max(value) {_24}, 8) AS max_24 FROM n""",
)
def features_train(spark, d):
    out = series.training_features(T.hourly(spark, d))
    return out.select("metric", "ts", "hour", *[F.round(c, 8).alias(c) for c in ("lag_1", "lag_24", "lag_168", "change", "mean_6", "max_24")])


@query(
    "features_serve",
    _H
    + f""", g AS (SELECT metric, list(value ORDER BY ts) AS v FROM hourly GROUP BY metric), c AS (SELECT *, len(v) AS n FROM g)
    SELECT metric, round(v[-1], 5) AS last, round(CASE WHEN n >= 24 THEN v[-24] ELSE v[1] END, 5) AS lag_24, round(CASE WHEN n >= 168 THEN v[-168] ELSE v[1] END, 5) AS lag_168,
           round(CASE WHEN n >= 2 THEN (v[-1] - v[-2]) / greatest(v[-2], 1.0) ELSE 0.0 END, 5) AS change,
           round(CASE WHEN n >= 6 THEN list_avg(v[-6:]) ELSE list_avg(v) END, 5) AS mean_6, round(CASE WHEN n >= 6 THEN list_stddev_pop(v[-6:]) ELSE 0.0 END, 5) AS std_6,
           round(list_max(v[-6:]), 5) AS max_6, round(list_min(v[-6:]), 5) AS min_6, round(CASE WHEN n >= 24 THEN list_avg(v[-24:]) ELSE list_avg(v) END, 5) AS mean_24,
           round(CASE WHEN n >= 24 THEN (list_avg(v[-12:]) - list_avg(v[:12])) / greatest(list_avg(v[:12]), 1.0) ELSE 0.0 END, 5) AS growth FROM c""",
)
def features_serve(spark, d):
    out = series.serving_features(T.hourly(spark, d))
    return out.select("metric", *[F.round(c, 5).alias(c) for c in out.columns if c != "metric"])


@query(
    "tile_windows",
    """WITH r AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS a, epoch(o_orderdate)::BIGINT + 3600 * (o_orderkey % 5) + 1800 AS b FROM orders),
    t AS (SELECT o_orderkey, b, unnest(range(a, b, 3600)) AS s FROM r)
    SELECT o_orderkey, s AS window_start, least(s + 3600, b) AS window_end FROM t""",
)
def tile_windows(spark, d):
    orders = T.read_table(spark, d, "orders")
    ranges = orders.select("o_orderkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), 3600 * (F.col("o_orderkey") % 5) + 1800)).alias("end"))
    out = series.tile_range(ranges, 3600)
    return out.select("o_orderkey", F.unix_timestamp("window_start").alias("window_start"), F.unix_timestamp("window_end").alias("window_end"))


_STATS = "s AS (SELECT metric, avg(value) AS mean, stddev_samp(value) AS sd, median(value) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM hourly GROUP BY metric)"


@query("zscore_detect", _H + f", {_STATS} SELECT metric, ts, round(abs(value - mean) / sd, 6) AS score FROM hourly JOIN s USING (metric) WHERE abs(value - mean) / sd > 3.0 * (1.5 - 0.8)")
def zscore_detect(spark, d):
    return anomaly.detect_zscore(T.hourly(spark, d)).select("metric", "ts", F.round("score", 6).alias("score"))


@query(
    "iqr_detect",
    _H
    + f""", {_STATS}, p AS (SELECT metric, ts, q3 - q1 AS iqr, greatest(q1 - 1.5 * 1.2 * (q3 - q1) - value, value - q3 - 1.5 * 1.2 * (q3 - q1)) AS past FROM hourly JOIN s USING (metric))
    SELECT metric, ts, round(past / iqr, 6) AS score FROM p WHERE past > 0""",
)
def iqr_detect(spark, d):
    return anomaly.detect_iqr(T.hourly(spark, d)).select("metric", "ts", F.round("score", 6).alias("score"))


@query(
    "mad_detect",
    _H
    + f""", {_STATS}, o AS (SELECT metric, ts, value, med, abs(value - med) AS off FROM hourly JOIN s USING (metric)), m AS (SELECT metric, median(off) AS mad FROM o GROUP BY metric)
    SELECT metric, ts, round(abs(0.6745 * (value - med) / CASE WHEN mad = 0 THEN 1.0 ELSE mad END), 6) AS score FROM o JOIN m USING (metric)
    WHERE abs(0.6745 * (value - med) / CASE WHEN mad = 0 THEN 1.0 ELSE mad END) > 3.5 * (1.5 - 0.8)""",
)
def mad_detect(spark, d):
    return anomaly.detect_mad(T.hourly(spark, d)).select("metric", "ts", F.round("score", 6).alias("score"))


_DESCRIBED = (
    _H
    + f""", {_STATS}, w AS (SELECT *, value - lag(value) {_W} AS d, row_number() {_W} AS i, count(*) OVER (PARTITION BY metric) AS n, stddev_pop(value) OVER (PARTITION BY metric) AS sp,
       list(value) OVER (PARTITION BY metric ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW) AS near FROM hourly JOIN s USING (metric)),
    x AS (SELECT *, coalesce(list_median(near), value) AS expected, CAST(abs(value - mean) >= 2 * sp AS INT) AS far, avg(abs(d)) OVER (PARTITION BY metric) AS step, lead(d) {_W} AS nx FROM w),
    y AS (SELECT *, min(far) OVER (PARTITION BY metric ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS allfar,
            min(d) OVER (PARTITION BY metric ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS dmin, max(d) OVER (PARTITION BY metric ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS dmax FROM x),
    z AS (SELECT *, CASE WHEN i > 2 AND i <= n - 2 AND allfar = 1 THEN 'sustained_' WHEN i > 1 AND i < n AND (abs(d) > 3 * step OR abs(nx) > 3 * step) THEN 'sudden_'
                         WHEN i > 3 AND i <= n - 3 AND (dmin > 0 OR dmax < 0) THEN 'gradual_' ELSE '' END || CASE WHEN value > expected THEN 'spike' ELSE 'dip' END AS kind,
                 abs(value - mean) / sd AS score FROM y)"""
)
_FOUND = (
    _DESCRIBED
    + """, f AS (SELECT metric, ts, value, expected, kind, greatest(0.0, least(1.0, score / 5)) AS anomaly_score,
      (score + 10 * CASE WHEN expected <> 0 THEN abs(value - expected) / expected ELSE abs(value) END) / 2 AS b FROM z WHERE score > 3.0 * (1.5 - 0.8)),
    found AS (SELECT *, CASE WHEN b > 5 THEN 'critical' WHEN b > 3 THEN 'high' WHEN b > 1.5 THEN 'medium' ELSE 'low' END AS impact FROM f)"""
)


@query("expected_value", _DESCRIBED + " SELECT metric, ts, round(expected, 6) AS expected, kind FROM z")
def expected_value(spark, d):
    return anomaly.describe(T.hourly(spark, d)).select("metric", "ts", F.round("expected", 6).alias("expected"), "kind")


@query("anomaly_detect", _FOUND + " SELECT metric, ts, round(value, 6) AS value, round(expected, 6) AS expected, kind, impact, round(anomaly_score, 6) AS anomaly_score FROM found")
def anomaly_detect(spark, d):
    return anomaly.detect(T.hourly(spark, d)).withColumns({c: F.round(c, 6) for c in ("value", "expected", "anomaly_score")})


@query(
    "anomaly_sessions",
    _FOUND
    + f""", o AS (SELECT *, CASE WHEN lag(ts) {_W} + INTERVAL 12 HOUR >= ts THEN 0 ELSE 1 END AS o FROM found), c AS (SELECT *, sum(o) {_W} AS cl FROM o)
    SELECT metric, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(max(anomaly_score), 6) AS max_score FROM c GROUP BY metric, cl HAVING count(*) >= 2""",
)
def anomaly_sessions(spark, d):
    return anomaly.clusters(anomaly.detect(T.hourly(spark, d)), "12 hours").withColumn("max_score", F.round("max_score", 6))


@query(
    "anomaly_patterns",
    _FOUND
    + """, g AS (SELECT metric, count(*) AS n, count(*) FILTER (impact = 'critical') AS n_critical, count(*) FILTER (impact = 'high') AS n_high,
       least(1.0, sum(CASE impact WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 ELSE 1.0 END * anomaly_score) / (count(*) * 3)) AS severity,
       avg(CAST(hour(ts) BETWEEN 9 AND 17 AS INT)) AS w, avg(CAST(hour(ts) < 6 OR hour(ts) > 22 AS INT)) AS o, avg(CAST(kind = 'spike' AS INT)) AS s,
       avg(CAST(kind = 'dip' AS INT)) AS p, avg(CAST(impact IN ('high', 'critical') AS INT)) AS b FROM found GROUP BY metric)
    SELECT metric, n, n_critical, n_high, round(severity, 6) AS severity, concat_ws(',', CASE WHEN w > 0.7 THEN 'business_hours_concentration' WHEN o > 0.7 THEN 'off_hours_concentration' END,
       CASE WHEN s > 0.7 THEN 'predominantly_spikes' WHEN p > 0.7 THEN 'predominantly_dips' END, CASE WHEN b > 0.5 THEN 'high_severity_concentration' END) AS labels FROM g""",
)
def anomaly_patterns(spark, d):
    return anomaly.patterns(anomaly.detect(T.hourly(spark, d))).withColumn("severity", F.round("severity", 6))
