"""Forecasts by fitted models against a plain loop over the horizon."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opsweave.operators import forecast, models as M
from opsweave.plans.report_queries import FORECAST_FEATURES

START = dt.datetime(2024, 1, 5, 20, 0)
LENGTHS = {"long": 200, "day": 24, "six": 6, "two": 2, "one": 1, "none": 0}
NAMES = [*FORECAST_FEATURES, "mean_24", "max_6", "min_6", "max_24", "slope"]


def value(name, i):
    return round(40 + 30 * math.sin(i / 4) + len(name) * 3 + (i * 7919 % 13) / 2, 3)


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(30, 20, (300, len(NAMES)))
    y = x[:, 0] * 0.6 + x[:, 7] * 0.2 - x[:, 10] * 0.1 + np.where(x[:, 11] > 30, 9, -4) + rng.normal(0, 1, 300)
    return spark.createDataFrame([(*map(float, r), float(t), START + dt.timedelta(hours=i)) for i, (r, t) in enumerate(zip(x, y))], [*NAMES, "target", "ts"]).persist()


@pytest.fixture(scope="module")
def models(training):
    return {"qps": (M.fit_model(training, NAMES, "ridge"), NAMES), "cpu": (M.fit_model(training, NAMES, "forest", {"numTrees": 5}), NAMES), "memory": (M.fit_model(training, NAMES, "boosted"), NAMES)}


def plain_features(v, current, ts, slope):
    turn, n = 2 * math.pi, len(v)
    out = {"value": current, "slope": slope, "sin_hour": math.sin(turn * ts.hour / 24), "cos_hour": math.cos(turn * ts.hour / 24), "sin_day": math.sin(turn * ts.weekday() / 7)}
    out |= {"cos_day": math.cos(turn * ts.weekday() / 7), "is_business_hour": float(9 <= ts.hour <= 17 and ts.weekday() < 5), "is_weekend": float(ts.weekday() >= 5)}
    if not v:
        out |= {"lag_1": current * 0.95, "lag_24": current * 0.9, "lag_168": current * 0.85, "change": 0.05, "std_6": current * 0.1}
        return out | {k: current for k in ("mean_6", "mean_24", "max_6", "min_6", "max_24")}
    out |= {"lag_1": v[-1], "lag_24": v[-24] if n >= 24 else v[0], "lag_168": v[-168] if n >= 168 else v[0], "change": (current - v[-1]) / max(v[-1], 1) if n >= 2 else 0.0}
    return out | {"mean_6": np.mean(v[-6:]), "mean_24": np.mean(v[-24:]), "std_6": np.std(v[-6:]) if n >= 6 else 0.0, "max_6": max(v[-6:]), "min_6": min(v[-6:]), "max_24": max(v[-24:])}


def plain_loop(model, kind, v, current, slope, points, minutes, follow, moving):
    upper = {"qps": 100000, "cpu": 100, "memory": 100}[kind]
    factor = {"qps": 0.9, "cpu": 0.85, "memory": 0.95}[kind]
    scaler, last = model.stages[-2], model.stages[-1]
    out, v = [], list(v)
    for i in range(points):
        ts = START + dt.timedelta(minutes=minutes * (i + 1))
        f = plain_features(v, current, ts, slope)
        x = (np.array([f[n] for n in NAMES]) - scaler.mean.toArray()) / scaler.std.toArray()
        p = min(max(last.predict(Vectors.dense(x)), 0.0), upper)
        change = max(0.6, 1 - abs(p - current) / current * 0.5) if current > 0 else 0.8
        out.append((i + 1, ts, p, max(0.5, 0.95 - i * 0.01) * change * factor))
        current = p if follow else current
        v = [*v, p][-M.LOOK_BACK :] if moving else v
    return out


@pytest.mark.parametrize("follow,moving,granularity,hours", [(True, False, "hour", 30), (True, True, "hour", 8), (False, False, "minute", 1), (True, False, "day", 50)])
def test_as_a_plain_loop(spark, models, follow, moving, granularity, hours):
    rows = [(f"{name}-{kind}", kind, START, 55.0 + n % 7, [value(name, i) for i in range(n)][-M.LOOK_BACK :], 0.25) for name, n in LENGTHS.items() for kind in models]
    df = spark.createDataFrame(rows, "metric string, kind string, ts timestamp_ntz, current double, window array<double>, slope double")
    minutes = forecast.MINUTES[granularity]
    got = {}
    for r in M.model_forecast(df, models, hours, granularity, follow, moving).collect():
        got.setdefault(r.metric, {})[r.step] = r
    for name, kind, _, current, v, slope in rows:
        want = plain_loop(models[kind][0], kind, v, current, slope, hours * 60 // minutes, minutes, follow, moving)
        assert len(got[name]) == len(want)
        for step, ts, p, sure in want:
            r = got[name][step]
            assert r.ts == ts and r.predicted == pytest.approx(p, abs=1e-6) and r.confidence == pytest.approx(sure, abs=0.00501)
            assert r.low == pytest.approx(max(0, r.predicted - r.predicted * (1 - r.confidence) * 0.5)) and r.high >= r.low


def test_edges(spark, models):
    schema = "metric string, kind string, ts timestamp_ntz, current double, window array<double>, slope double"
    df = spark.createDataFrame([("a", "disk", START, 50.0, [50.0], 0.0), ("b", None, START, 50.0, None, 0.0), ("c", "cpu", START, 50.0, None, 0.0), ("d", "cpu", START, None, [1.0], 0.0)], schema)
    got = {}
    for r in M.model_forecast(df, models, 3).collect():
        got.setdefault(r.metric, []).append(r)
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys("abcd", 3)
    ruled = {r.step: r for r in forecast.rule_forecast(df.where("metric = 'a'").select("metric", "kind", "current"), str(START), 3).collect()}
    assert all(r.predicted == ruled[r.step].predicted and r.confidence == ruled[r.step].confidence for r in got["a"])
    assert M.model_forecast(df, models, 12, "day").count() == 0
    assert M.model_forecast(df.limit(0), models, 3).count() == 0
    assert M.model_forecast(df, {}, 3).count() == 12


def test_newest_values(spark):
    rows = [("m", START + dt.timedelta(hours=i), float(i)) for i in range(400)] + [("s", START, 1.0)]
    got = {r.metric: r for r in M.newest_values(spark.createDataFrame(rows, "metric string, ts timestamp_ntz, value double").repartition(5)).collect()}
    assert got["m"].window == [float(i) for i in range(232, 400)] and got["m"].current == 399.0 and got["m"].ts == rows[399][1]
    assert got["s"].window == [1.0]


def test_grid_search(training):
    assert len(list(M.combinations(M.GRIDS["boosted"]))) == 27 and list(M.combinations({})) == [{}]
    params, score = M.search_grid(training, NAMES, "ridge", {"regParam": (0.01, 500.0)}, 2)
    assert params == {"regParam": 0.01} and score > 0.8
    assert M.search_grid(training, NAMES, "ols", folds=2)[0] == {}
