"""Queries of forecasts, scaling plans and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import forecast
from opsweave.plans.catalog import query
from opsweave.sources import tables as T

NOW = "2024-02-01 00:30:00"
KINDS = ("qps", "cpu", "memory", "disk")

_SERIES = "s AS (SELECT s_suppkey AS series, ['qps', 'cpu', 'memory', 'disk'][s_suppkey % 4 + 1] AS kind, CASE WHEN s_suppkey % 4 = 0 THEN abs(s_acctbal) / 8 ELSE abs(s_acctbal) / 100 END AS current FROM supplier)"
_F = (
    f"WITH {_SERIES}"
    + """, r AS (SELECT *, unnest(range(1, 49)) AS step FROM s), t AS (SELECT *, TIMESTAMP '2024-02-01 00:30:00' + to_hours(CAST(step AS BIGINT)) AS ts FROM r),
    f AS (SELECT *, CASE WHEN hour(ts) BETWEEN 9 AND 18 AND isodow(ts) < 6 THEN 1.2 WHEN hour(ts) < 6 THEN 0.6 ELSE 1.0 END::DOUBLE AS factor,
             CASE kind WHEN 'qps' THEN 0.02 WHEN 'cpu' THEN 0.01 WHEN 'memory' THEN 0.005 ELSE 0.003 END::DOUBLE AS g FROM t),
    p AS (SELECT series, kind, current, CAST(step AS INT) AS step, ts, greatest(0.0, least(CASE kind WHEN 'qps' THEN 100000.0 ELSE 100.0 END::DOUBLE, current * (1 + g * step) * factor)) AS predicted,
             greatest(0.5::DOUBLE, 0.95::DOUBLE - (step - 1) * 0.01::DOUBLE) AS confidence FROM f)"""
)
_A = (
    _F
    + """, a AS (SELECT *, CASE WHEN predicted > CASE kind WHEN 'qps' THEN 1000.0 ELSE 80.0 END THEN 'scale_up' WHEN predicted < CASE kind WHEN 'qps' THEN 200.0 ELSE 50.0 END THEN 'scale_down' ELSE 'maintain' END AS action FROM p),
    b AS (SELECT *, CASE WHEN kind = 'qps' THEN CAST(greatest(1, least(20, CASE action WHEN 'scale_up' THEN ceil(ceil(predicted / 350.0) * 1.2::DOUBLE)
            WHEN 'scale_down' THEN ceil(greatest(1.0, ceil(predicted / 350.0) * 0.8::DOUBLE)) ELSE ceil(predicted / 350.0) END)) AS INT) END AS instances FROM a)"""
)


def _forecast(spark, d):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    balance = F.abs("s_acctbal")
    series = T.read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("series"), kind.alias("kind"), F.when(F.col("s_suppkey") % 4 == 0, balance / 8).otherwise(balance / 100).alias("current"))
    return forecast.rule_forecast(series, NOW, 48, "hour")


def _plan(spark, d):
    return forecast.scaling_plan(_forecast(spark, d))


@query(
    "rule_forecast",
    _F + " SELECT series, step, ts, round(predicted, 6) AS predicted, round(confidence, 6) AS confidence, round(greatest(0.0, predicted - predicted * (1 - confidence) * 0.5), 6) AS low, round(predicted + predicted * (1 - confidence) * 0.5, 6) AS high FROM p",
)
def rule_forecast(spark, d):
    return _forecast(spark, d).select("series", "step", "ts", *[F.round(c, 6).alias(c) for c in ("predicted", "confidence", "low", "high")])


@query(
    "forecast_confidence",
    _F
    + """ SELECT series, step, round(greatest(0.5, 0.95 - step * 0.01::DOUBLE) * CASE WHEN current > 0 THEN greatest(0.6, 1 - abs(predicted - current) / current * 0.5) ELSE 0.8 END
      * CASE kind WHEN 'qps' THEN 0.9 WHEN 'cpu' THEN 0.85 WHEN 'memory' THEN 0.95 ELSE 0.98 END, 6) AS confidence FROM p""",
)
def forecast_confidence(spark, d):
    level = forecast.confidence(F.col("predicted"), F.col("current"), F.col("kind"), F.col("step"))
    return _forecast(spark, d).select("series", "step", F.round(level, 6).alias("confidence"))


@query(
    "scaling_plan",
    _A
    + """, u AS (SELECT *, CASE action WHEN 'scale_up' THEN predicted * 1.5 WHEN 'scale_down' THEN predicted * CASE kind WHEN 'disk' THEN 0.8 ELSE 0.7 END ELSE predicted END AS x FROM b)
    SELECT series, step, action, instances, round(CASE kind WHEN 'cpu' THEN CASE WHEN x > 80 THEN 4.0 * (x / 60) WHEN x < 30 THEN greatest(1.0, 4.0 * (x / 60)) ELSE 4.0 END
      WHEN 'memory' THEN CASE WHEN x > 85 THEN 8.0 * (x / 70) WHEN x < 40 THEN greatest(2.0, 8.0 * (x / 70)) ELSE 8.0 END
      WHEN 'disk' THEN CASE WHEN x > 90 THEN 100.0 * (x / 75) WHEN x < 50 THEN greatest(50.0, 100.0 * (x / 75)) ELSE 100.0 END END, 6) AS resource,
      round(CASE action WHEN 'scale_up' THEN least(1.0, confidence * 1.1) WHEN 'scale_down' THEN confidence * 0.9 ELSE confidence END, 6) AS plan_confidence,
      round(CASE action WHEN 'scale_up' THEN CASE WHEN instances IS NOT NULL THEN 20.0 + (instances - 1) * 5 ELSE 30.0 END WHEN 'scale_down' THEN CASE WHEN instances IS NOT NULL THEN -10.0 - 10.0 / greatest(1, instances) ELSE -20.0 END ELSE 0.0 END::DOUBLE, 6) AS cost_change FROM u""",
)
def scaling_plan(spark, d):
    return _plan(spark, d).select("series", "step", "action", "instances", *[F.round(c, 6).alias(c) for c in ("resource", "plan_confidence", "cost_change")])


@query(
    "scaling_reasons",
    _A
    + """ SELECT series, step, CASE action WHEN 'scale_up' THEN CASE kind WHEN 'qps' THEN 'QPS预测值(' || format('{:.0f}', predicted) || ')超过阈值，建议扩容至' || instances || '个实例' ELSE upper(kind) || '利用率预测值(' || format('{:.1f}', predicted) || '%)过高，建议增加资源' END
      WHEN 'scale_down' THEN CASE kind WHEN 'qps' THEN 'QPS预测值(' || format('{:.0f}', predicted) || ')低于阈值，可以缩容至' || instances || '个实例' ELSE upper(kind) || '利用率预测值(' || format('{:.1f}', predicted) || '%)较低，可以减少资源节省成本' END
      ELSE upper(kind) || '预测值(' || format('{:.1f}', predicted) || ')在正常范围内，维持当前配置' END AS reason FROM b""",
)
def scaling_reasons(spark, d):
    text = forecast.reason(F.col("action"), F.col("kind"), F.col("predicted"), F.col("instances"))
    return _plan(spark, d).select("series", "step", text.alias("reason"))


# Cooldown of 90 minutes over hourly points: every second action of a run is accepted, by recursion.
_C = (
    _A.replace("WITH s AS", "WITH RECURSIVE s AS", 1)
    + """, o AS (SELECT series, ts, action, instances, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM b WHERE action <> 'maintain'),
    k AS (SELECT series, i, ts, ts AS last, true AS ok, action, instances FROM o WHERE i = 1
      UNION ALL SELECT o.series, o.i, o.ts, CASE WHEN o.ts - k.last >= INTERVAL 90 MINUTE THEN o.ts ELSE k.last END, o.ts - k.last >= INTERVAL 90 MINUTE, o.action, o.instances FROM k JOIN o ON o.series = k.series AND o.i = k.i + 1)"""
)


@query("cooldown_fold", _C + " SELECT series, ts, action, instances FROM k WHERE ok")
def cooldown_fold(spark, d):
    return forecast.apply_cooldown(_plan(spark, d), "series", 90)


_M = (
    _C
    + """, q AS (SELECT series, ts, action, instances, row_number() OVER (PARTITION BY series ORDER BY ts) AS j FROM k WHERE ok),
    m AS (SELECT series, j, ts, action, instances, ts AS anchor, j AS root FROM q WHERE j = 1
      UNION ALL SELECT q.series, q.j, q.ts, q.action, q.instances, CASE WHEN q.action = m.action AND q.ts - m.anchor <= INTERVAL 5 HOUR THEN m.anchor ELSE q.ts END,
        CASE WHEN q.action = m.action AND q.ts - m.anchor <= INTERVAL 5 HOUR THEN m.root ELSE q.j END FROM m JOIN q ON q.series = m.series AND q.j = m.j + 1),
    rec AS (SELECT series, min(ts) AS ts, any_value(action) AS action, max(instances) AS instances FROM m GROUP BY series, root)"""
)


def _recs(spark, d):
    return forecast.merge_recommendations(forecast.apply_cooldown(_plan(spark, d), "series", 90), "series", 5 * 3600)


@query("recommendation_merge", _M + " SELECT series, ts, action, instances FROM rec")
def recommendation_merge(spark, d):
    return _recs(spark, d)


_J = (
    _M
    + """, j AS (SELECT p.series, p.ts, p.predicted, (SELECT min((rec.ts, rec.action, rec.instances)) FROM rec WHERE rec.series = p.series AND abs(epoch(rec.ts) - epoch(p.ts)) <= 3600) AS r FROM p),
    x AS (SELECT p.series, p.ts, min(rec.ts) AS rec_ts FROM p LEFT JOIN rec ON rec.series = p.series AND abs(epoch(rec.ts) - epoch(p.ts)) <= 3600 GROUP BY 1, 2),
    y AS (SELECT x.*, rec.action, rec.instances FROM x LEFT JOIN rec ON rec.series = x.series AND rec.ts = x.rec_ts)"""
).replace(
    """j AS (SELECT p.series, p.ts, p.predicted, (SELECT min((rec.ts, rec.action, rec.instances)) FROM rec WHERE rec.series = p.series AND abs(epoch(rec.ts) - epoch(p.ts)) <= 3600) AS r FROM p),
    """,
    "",
)


def _matched(spark, d):
    return forecast.first_match(_forecast(spark, d).select("series", "ts", "predicted"), _recs(spark, d), "series", 3600)


@query("asof_first_match", _J + " SELECT series, ts, rec_ts, action, instances FROM y")
def asof_first_match(spark, d):
    return _matched(spark, d).select("series", "ts", "rec_ts", "action", "instances")


@query(
    "cost_trend",
    _J
    + """, c AS (SELECT *, CASE action WHEN 'scale_up' THEN CASE WHEN instances > 0 THEN 0.5 * (1 + 0.2 * instances) ELSE 0.5 * 1.3 END WHEN 'scale_down' THEN CASE WHEN instances > 0 THEN 0.5 * (0.7 + 0.05 * instances) ELSE 0.5 * 0.7 END ELSE 0.5 END::DOUBLE AS cost,
        row_number() OVER (PARTITION BY series ORDER BY ts) AS i, count(*) OVER (PARTITION BY series) AS n FROM y),
    g AS (SELECT series, avg(cost) AS pc, arg_max(ts, (cost, -i)) AS peak_ts, arg_min(ts, (cost, i)) AS low_ts, stddev_pop(cost) / avg(cost) AS vol, avg(cost) FILTER (i <= n // 2) AS h1, avg(cost) FILTER (i > n // 2) AS h2,
        count(DISTINCT CASE WHEN action = 'scale_down' THEN rec_ts END) AS down FROM c GROUP BY series)
    SELECT series, round(pc, 6) AS predicted_cost, round(greatest(-50.0, least(50.0, (0.5 - pc) / 0.5 * 100 + least(down * 5, 30))), 6) AS savings, round(vol, 6) AS volatility,
      CASE WHEN h2 > h1 * 1.1 THEN 'increasing' WHEN h2 < h1 * 0.9 THEN 'decreasing' ELSE 'stable' END AS direction FROM g""",
)
def cost_trend(spark, d):
    out = forecast.cost_summary(_matched(spark, d), forecast.current_cost({"cost_per_hour": 0.5}), "series")
    return out.select("series", *[F.round(c, 6).alias(c) for c in ("predicted_cost", "savings", "volatility")], "direction")


@query(
    "optimisation_flags",
    _A
    + """, l AS (SELECT series, count(*) AS n, coalesce(stddev_pop(predicted) / nullif(avg(predicted), 0), 0) AS cv, avg(predicted) FILTER (hour(ts) BETWEEN 9 AND 17) AS w, avg(predicted) FILTER (hour(ts) NOT BETWEEN 9 AND 17) AS o FROM b GROUP BY series),
    e AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - row_number() OVER (PARTITION BY series, action ORDER BY ts) AS gr FROM b WHERE action <> 'maintain'),
    runs AS (SELECT series, action, gr, count(*) AS len FROM e GROUP BY ALL), totals AS (SELECT series, sum(len) AS recs, max(CASE WHEN action = 'scale_down' THEN len ELSE 0 END) AS ld, sum(CASE WHEN action = 'scale_down' THEN len ELSE 0 END) AS dn FROM runs GROUP BY series)
    SELECT series, coalesce(recs, 0) > n * 0.3 AS frequent_scaling, coalesce(ld, 0) >= 3 AS lasting_surplus, cv < 0.1 AS stable_load, cv > 0.5 AS volatile_load,
      coalesce(dn, 0) / greatest(1, coalesce(recs, 0)) > 0.3 AS spot_capacity, coalesce(n >= 24 AND abs(w - o) / greatest(w, o) > 0.3, false) AS daily_pattern FROM l LEFT JOIN totals USING (series)""",
)
def optimisation_flags(spark, d):
    return forecast.optimisation_flags(_forecast(spark, d), _plan(spark, d), "series")


@query("replica_reconcile", "SELECT s_suppkey, s_nationkey AS replicas, CASE WHEN s_suppkey % 7 >= 1 THEN CAST(s_suppkey % 7 AS INT) ELSE 1 END AS wanted FROM supplier WHERE s_nationkey IS DISTINCT FROM CASE WHEN s_suppkey % 7 >= 1 THEN s_suppkey % 7 ELSE 1 END")
def replica_reconcile(spark, d):
    rows = T.read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("replicas"), (F.col("s_suppkey") % 7).cast("int").alias("recommended"))
    return forecast.reconcile(rows).select("s_suppkey", "replicas", "wanted")
