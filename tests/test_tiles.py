"""Tiled windows and exact quantiles give what windows and percentiles over whole series give."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from opsweave.operators import anomaly, series, tiles
from opsweave.operators.quantiles import exact_quantiles

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def samples(spark):
    """A hot series of 3,000 rows over 40 days, a short one, one without a metric, one of zeros."""
    rng = random.Random(8)
    rows = [("hot", START + timedelta(minutes=19 * i + rng.randrange(9)), rng.choice([0.0, 0.0, rng.uniform(-5, 50)]) if i > 900 else 0.0) for i in range(3000)]
    rows += [("short", START + timedelta(hours=i), float(i)) for i in range(5)] + [(None, START + timedelta(days=i), float(i * i)) for i in range(40)]
    rows += [("zeros", START + timedelta(days=9 * i), 0.0) for i in range(60)]
    return spark.createDataFrame(rows, "metric string, ts timestamp, value double").repartition(5)


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Tiles far smaller than a series."""
    monkeypatch.setattr(tiles, "TILE", 200)
    monkeypatch.setattr(series, "GRID_TILE", 100)


def same(got, want, *columns):
    key = ("metric", "ts", *columns)
    plain = lambda df: sorted((str(r[0]), r[1], *(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r[2:])) for r in df.select(*key).collect())
    assert plain(got) == plain(want)


def whole():
    return Window.partitionBy("metric").orderBy("ts")


def test_numbers(samples):
    got = tiles.numbered(samples, "metric")
    same(got, samples.withColumn(tiles.ROW, F.row_number().over(whole()).cast("long")), tiles.ROW)


def test_frames(samples):
    v = F.col("value")
    same(series.lags(samples), samples.withColumns({f"lag_{n}": F.lag(v, n).over(whole()) for n in (1, 24, 168)}), "lag_1", "lag_24", "lag_168")
    day = whole().rowsBetween(-23, 0)
    want = samples.withColumns({"mean_24": F.avg(v).over(day), "max_24": F.max(v).over(day), "std_6": F.coalesce(F.stddev_samp(v).over(whole().rowsBetween(-5, 0)), F.lit(0.0))})
    same(series.rolling(samples), want, "mean_24", "max_24", "std_6")
    i = F.row_number().over(whole()).cast("double")
    last = whole().rowsBetween(-11, 0)
    want = samples.withColumn("i", i).withColumn("slope", F.when(F.stddev_pop(v).over(last) == 0, 0.0).otherwise(F.coalesce(F.regr_slope("value", "i").over(last), F.lit(0.0))))
    same(series.rolling_slope(samples), want.withColumn("slope", F.greatest(F.lit(-100.0), F.least(F.lit(100.0), "slope"))), "slope")


def test_growth_takes_a_base_from_later_tiles(samples):
    back = F.lag("value", 24).over(whole())
    base = F.first(F.nullif(F.col("_back"), F.lit(0.0)), ignorenulls=True).over(whole().rowsBetween(0, Window.unboundedFollowing))
    rate = (F.col("value") - F.col("_back")) / F.coalesce(base, F.lit(1.0))
    want = samples.withColumn("_back", back).withColumn("growth", F.when(rate.isNull(), 0.0).otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), rate))))
    same(series.growth_rate(samples), want, "growth")
    same(series.training_features(samples), want.withColumn("lag_168", F.lag("value", 168).over(whole())), "growth", "lag_168")


def test_fill_across_tiles(samples):
    """A gap of months takes its value from tiles long before."""
    rows = samples.where("metric = 'zeros' or metric = 'short'").withColumn("value", F.when(F.col("metric") == "zeros", F.dayofyear("ts").cast("double")).otherwise(F.col("value")))
    got = {(r.metric, r.ts): r.value for r in series.fill_forward(rows, "10 minutes").collect()}
    known = {}
    for r in rows.collect():
        known.setdefault(r.metric, {})[r.ts] = r.value
    assert len(got) == sum(int((max(x) - min(x)) / timedelta(minutes=10)) + 1 for x in known.values())
    for metric, points in known.items():
        at, value = min(points), None
        while at <= max(points):
            value = points.get(at, value)
            assert got[metric, at] == value
            at += timedelta(minutes=10)


def test_rates(samples):
    step = F.coalesce(F.when(F.col("value") < F.lag("value").over(whole()), F.col("value")).otherwise(F.col("value") - F.lag("value").over(whole())), F.lit(0.0))
    frame = Window.partitionBy("metric").orderBy(F.col("ts").cast("long")).rangeBetween(-7200, 0)
    want = samples.withColumn("_step", step).withColumn("rate", F.sum("_step").over(frame) / 7200.0)
    same(series.counter_rate(samples, 7200), want, "rate")


def plain_kinds(values):
    """Kinds of one series' rows, by their definition."""
    a, out = np.array(values), []
    mean, std, step, n = a.mean(), a.std(), np.abs(np.diff(a)).mean() if len(a) > 1 else 0.0, len(a)
    for i, v in enumerate(a):
        near = np.concatenate([a[max(0, i - 5) : i], a[i + 1 : i + 6]])
        expected = float(np.median(near)) if len(near) else float(v)
        prefix = ""
        if 2 <= i < n - 2 and (np.abs(a[i - 2 : i + 3] - mean) >= 2 * std).all():
            prefix = "sustained_"
        elif 0 < i < n - 1 and (abs(a[i] - a[i - 1]) > 3 * step or abs(a[i + 1] - a[i]) > 3 * step):
            prefix = "sudden_"
        elif 3 <= i < n - 3 and ((np.diff(a[i - 3 : i + 4]) > 0).all() or (np.diff(a[i - 3 : i + 4]) < 0).all()):
            prefix = "gradual_"
        out.append((round(expected, 6), prefix + ("spike" if v > expected else "dip")))
    return out


def test_kinds(spark, samples):
    rows = samples.where("metric is not null")
    got, given = {}, {}
    for r in anomaly.describe(rows).orderBy("ts").collect():
        got.setdefault(r.metric, []).append((round(r.expected, 6), r.kind))
    for r in rows.orderBy("ts").collect():
        given.setdefault(r.metric, []).append(r.value)
    assert got == {metric: plain_kinds(values) for metric, values in given.items()}


def test_runs_cross_tiles(spark):
    rng = random.Random(6)
    at, rows = START, []
    for i in range(1500):
        at += timedelta(minutes=rng.choice([10, 60, 61] if i % 400 > 300 else [5, 30]))
        rows.append(("m", at, rng.random()))
    frame = spark.createDataFrame(rows, "metric string, ts timestamp, anomaly_score double").repartition(4)
    want, run = [], [rows[0]]
    for before, now in zip(rows, [*rows[1:], ("m", START + timedelta(days=900), 0.0)]):
        if now[1] - before[1] > timedelta(hours=1):
            if len(run) > 1:
                want.append((run[0][1], run[-1][1], len(run), max(x[2] for x in run)))
            run = []
        run.append(now)
    got = anomaly.clusters(frame).orderBy("start").collect()
    assert [(r.start, r.end, r.n, r.max_score) for r in got] == want


@pytest.mark.parametrize("bins, accuracy", [(1024, 2000), (4, 10)])
def test_quantiles(spark, bins, accuracy):
    rng = random.Random(1)
    given = {"wide": [math.copysign(10.0 ** rng.uniform(-300, 300), rng.random() - 0.5) for _ in range(300)], "same": [3.5] * 700, "two": [1.0, 2.0], "one": [-0.25]}
    given["ties"] = [float(rng.randrange(5)) for _ in range(900)]
    given["near"] = [1.0 + i * 2.0**-52 for i in range(400)]
    given["all"] = [rng.gauss(0, 1) for _ in range(2500)]
    rows = [(k, v) for k, values in given.items() for v in values] + [("all", None), ("all", float("nan")), ("empty", None)]
    frame = spark.createDataFrame(rows, "metric string, value double").repartition(6)
    shares = {"low": 0.01, "q1": 0.25, "med": 0.5, "q3": 0.75, "top": 1.0}
    got = {r.metric: r for r in exact_quantiles(frame, shares, "metric", bins=bins, accuracy=accuracy).collect()}
    assert set(got) == set(given)
    for metric, values in given.items():
        ordered = sorted(values)
        for name, q in shares.items():
            at = (len(ordered) - 1) * q
            low, high = math.floor(at), math.ceil(at)
            want = ordered[low] if low == high else (high - at) * ordered[low] + (at - low) * ordered[high]
            assert got[metric][name] == pytest.approx(want, rel=1e-12, abs=0), (metric, name)


def test_no_window_holds_a_series(samples):
    """Windows over rows are partitioned by series and tile (or bucket); only those over one row a tile by the series."""
    plan = series.training_features(samples)._jdf.queryExecution().analyzed().toString()
    for line in plan.splitlines():
        if "Window [" in line and "row_number" in line or "lag(" in line:
            assert "_tile" in line or "_bucket" in line, line
