"""Forecasts by fitted models: features with defaults, forward folds, selection, recursion, storage."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.operators import forecast, tiles

#: Candidates of a selection: name, and how to make the estimator.
GRID = {
    "ols": lambda: LinearRegression(featuresCol="scaled", labelCol="target"),
    "ridge": lambda: LinearRegression(featuresCol="scaled", labelCol="target", regParam=1.0, elasticNetParam=0.0),
    "forest": lambda: RandomForestRegressor(featuresCol="scaled", labelCol="target", numTrees=20, maxDepth=5, seed=42),
    "boosted": lambda: GBTRegressor(featuresCol="scaled", labelCol="target", maxIter=10, maxDepth=3, seed=42),
}

#: Parameters that a grid search tries: every combination of a candidate's values.
GRIDS = {
    "ridge": {"regParam": (0.01, 0.1, 1.0, 10.0)},
    "forest": {"numTrees": (50, 100, 150), "maxDepth": (10, 20, 30)},
    "boosted": {"maxIter": (50, 100, 150), "stepSize": (0.01, 0.1, 0.2), "maxDepth": (3, 5, 7)},
}
#: Values of a series that a forecast looks back on.
LOOK_BACK = 168


def usable_values(df: DataFrame, value: str = "value", low: float = 0.0, high: float = 100.0, open_low: bool = False) -> DataFrame:
    """Rows whose value is a finite number within bounds (``open_low``: above the lower one)."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.where(finite & (v > low if open_low else v >= low) & (v <= high))


def aligned(df: DataFrame, defaults: dict[str, float], *keep: str) -> DataFrame:
    """The columns of a model in its order as doubles; missing ones, nulls and NaN take their default."""
    have = set(df.columns)
    return df.select(*keep, *[(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(d))) if c in have else F.lit(float(d))).alias(c) for c, d in defaults.items()])


def chronological(df: DataFrame, by: str = "metric", ts: str = "ts", share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: the earlier ``share`` of each series."""
    order = Window.partitionBy(by).orderBy(ts)
    placed = df.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(by))})
    return placed.withColumn("is_train", F.col("_i") <= F.floor(F.col("_n") * share)).drop("_i", "_n")


def with_next(df: DataFrame, by: str = "metric", ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``target``, the series' next value; the last row of a series goes."""
    return df.withColumn("target", F.lead(value).over(Window.partitionBy(by).orderBy(ts))).where("target is not null")


def line_metrics(df: DataFrame, by: str = "metric", x: str = "value", y: str = "target") -> DataFrame:
    """(by, slope, intercept, n, r2, rmse, mae): a line fitted to the training rows of each series, measured
    on the others.  Two aggregations and a join on the series."""
    fitted = df.where("is_train").groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    rest = df.where("not is_train").join(fitted, by).withColumn("_e", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    out = rest.groupBy(by, "slope", "intercept").agg(
        F.count("*").alias("n"), (1 - F.try_divide(F.sum(F.col("_e") * F.col("_e")), F.var_pop(y) * F.count("*"))).alias("r2"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae")
    )
    return out


def recursive_forecast(models: DataFrame, steps: int, by: str = "metric", low: float = 0.0, high: float = 1e9, decay: float = 0.01, least: float = 0.5) -> DataFrame:
    """(by, step, value, confidence): each value follows from the one before by the series' line, kept within
    bounds; confidence falls with every step.  ``models`` has slope, intercept and last.

    The horizon is folded inside a row: all series go forward at once and nothing shuffles.
    """
    start = F.array(F.struct(F.lit(0).alias("step"), F.col("last").cast("double").alias("value")))

    def go(done: Column, step: Column) -> Column:
        following = F.col("intercept") + F.col("slope") * F.element_at(done, -1)["value"]
        return F.array_append(done, F.struct(step.alias("step"), F.greatest(F.lit(low), F.least(F.lit(high), following)).alias("value")))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, go)
    rows = models.select(by, F.explode(F.slice(walked, 2, steps)).alias("x")).select(by, "x.step", "x.value")
    return rows.withColumn("confidence", F.greatest(F.lit(least), 1.0 - decay * F.col("step")))


def horizon_points(granularity: Column, hours: Column) -> Column:
    """How many points a horizon has: minutes, hours, or days (one at least)."""
    return F.when(granularity == "minute", hours * 60).when(granularity == "day", F.greatest(F.lit(1), F.floor(hours / 24))).otherwise(hours).cast("int")


def _pipeline(name: str, features: list[str], params: dict | None = None) -> Pipeline:
    estimator = GRID[name]().setParams(**(params or {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), estimator])


def combinations(grid: dict[str, tuple]) -> Iterator[dict]:
    """Every choice of one value for each parameter."""
    for values in itertools.product(*grid.values()):
        yield dict(zip(grid, values))


def forward_folds(df: DataFrame, folds: int = 5, ts: str = "ts") -> list[tuple[DataFrame, DataFrame]]:
    """Expanding windows in time: fold k trains on all before its part and tests on the part.

    The cuts are quantiles of time, found in one pass; no row is numbered.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(seconds, [k / (folds + 1) for k in range(1, folds + 1)], 10_000)).first()[0]
    out = []
    for k, cut in enumerate(cuts):
        end = cuts[k + 1] if k + 1 < len(cuts) else None
        test = df.where(seconds > cut) if end is None else df.where((seconds > cut) & (seconds <= end))
        out.append((df.where(seconds <= cut), test))
    return out


def select_model(df: DataFrame, features: list[str], names: tuple[str, ...] = tuple(GRID), folds: int = 5) -> list[tuple[str, float]]:
    """(name, mean RMSE over the forward folds) of each candidate, the best first."""
    rmse = RegressionEvaluator(labelCol="target", metricName="rmse")
    parts = forward_folds(df, folds)
    scores = [(name, sum(rmse.evaluate(_pipeline(name, features).fit(train).transform(test)) for train, test in parts) / len(parts)) for name in names]
    return sorted(scores, key=lambda s: (s[1], s[0]))


def search_grid(df: DataFrame, features: list[str], name: str, grid: dict[str, tuple] | None = None, folds: int = 5) -> tuple[dict, float]:
    """(best parameters, mean R2 over the forward folds) of a candidate; of equal ones the first."""
    r2 = RegressionEvaluator(labelCol="target", metricName="r2")
    parts = [(train.persist(), test.persist()) for train, test in forward_folds(df, folds)]
    try:
        scores = [
            (sum(r2.evaluate(_pipeline(name, features, params).fit(train).transform(test)) for train, test in parts) / len(parts), params)
            for params in combinations(GRIDS.get(name, {}) if grid is None else grid)
        ]
    finally:
        for pair in parts:
            for part in pair:
                part.unpersist()
    score, params = max(scores, key=lambda s: s[0])
    return params, score


def fit_model(df: DataFrame, features: list[str], name: str = "ols", params: dict | None = None) -> PipelineModel:
    return _pipeline(name, features, params).fit(df)


def _tree(node, scaled: Callable[[int], Column]) -> Column:
    """A regression tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(scaled(split.featureIndex()) <= float(split.threshold()), _tree(node.leftChild(), scaled)).otherwise(_tree(node.rightChild(), scaled))


def as_column(model: PipelineModel, features: list[str], value: Callable[[str], Column]) -> Column:
    """The prediction of a fitted model (scaler, then line or trees) as an expression over ``value(feature)``, so that
    it can stand where a model's ``transform`` cannot: inside of a fold."""
    scaler, last = model.stages[-2], model.stages[-1]
    means, spreads = scaler.mean.toArray(), scaler.std.toArray()

    def scaled(k: int) -> Column:
        return (value(features[k]) - float(means[k])) * (1.0 / float(spreads[k]) if spreads[k] else 0.0)

    if hasattr(last, "coefficients"):
        out = F.lit(float(last.intercept))
        for k, c in enumerate(last.coefficients.toArray()):
            out = out + scaled(k) * float(c) if c else out
        return out
    trees = [_tree(t._java_obj.rootNode(), scaled) for t in last.trees]
    weights = list(last.treeWeights)
    if isinstance(last, RandomForestRegressionModel):
        weights = [w / sum(weights) for w in weights]
    return sum((t * float(w) for t, w in zip(trees[1:], weights[1:])), trees[0] * float(weights[0]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row, also inside of a fold."""
    return F.transform(F.array(value), body)[0]


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def forecast_features(window: Column, current: Column, ts: Column) -> dict[str, Column]:
    """What a model is given for one coming time: the time's own features, the current value, and those of the newest
    values (oldest first); without any, shares of the current value stand for them."""
    hour, day, n = F.hour(ts), F.weekday(ts), F.size(window)
    last, first, turn = F.try_element_at(window, F.lit(-1)), F.try_element_at(window, F.lit(1)), 2 * F.pi()

    def newest(k: int) -> Column:
        return F.slice(window, F.greatest(n - (k - 1), F.lit(1)), F.lit(k))

    def or_else(value: Column, share: float) -> Column:
        return F.when(n > 0, value).otherwise(current * share)

    spread = let(newest(6), lambda v: let(_mean(v), lambda m: F.sqrt(_mean(F.transform(v, lambda x: (x - m) * (x - m))))))
    return {
        "value": current,
        "hour": hour.cast("double"),
        "weekday": day.cast("double"),
        "month": F.month(ts).cast("double"),
        "sin_hour": F.sin(turn * hour / 24),
        "cos_hour": F.cos(turn * hour / 24),
        "sin_day": F.sin(turn * day / 7),
        "cos_day": F.cos(turn * day / 7),
        "is_business_hour": (hour.between(9, 17) & (day < 5)).cast("double"),
        "is_weekend": (day >= 5).cast("double"),
        "is_holiday": (day >= 5).cast("double"),
        "lag_1": or_else(last, 0.95),
        "lag_24": or_else(F.coalesce(F.try_element_at(window, F.lit(-24)), first), 0.9),
        "lag_168": or_else(F.coalesce(F.try_element_at(window, F.lit(-168)), first), 0.85),
        "change": F.when(n >= 2, (current - last) / F.greatest(last, F.lit(1.0))).when(n == 1, 0.0).otherwise(0.05),
        "mean_6": or_else(_mean(newest(6)), 1.0),
        "mean_24": or_else(_mean(newest(24)), 1.0),
        "std_6": F.when(n >= 6, spread).when(n > 0, 0.0).otherwise(current * 0.1),
        "max_6": or_else(F.array_max(newest(6)), 1.0),
        "min_6": or_else(F.array_min(newest(6)), 1.0),
        "max_24": or_else(F.array_max(newest(24)), 1.0),
    }


def newest_values(df: DataFrame, by: str = "metric", ts: str = "ts", value: str = "value", most: int = LOOK_BACK) -> DataFrame:
    """(by, ts, current, window): the newest time and value of each series and its ``most`` newest values, oldest first."""
    rows = tiles.numbered(df.select(F.col(by), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")), by)
    kept = rows.where(F.col(tiles.SIZE) - F.col(tiles.ROW) < most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(tiles.ROW).alias("row"), "ts", "value"))).alias("_v"))
    return kept.select(by, F.element_at("_v", -1)["ts"].alias("ts"), F.element_at("_v", -1)["value"].alias("current"), F.col("_v.value").alias("window"))


def model_forecast(series: DataFrame, models: dict[str, tuple[PipelineModel, list[str]]], hours: int = 24, granularity: str = "hour", follow: bool = True, moving: bool = False) -> DataFrame:
    """Forecasts by fitted models, each point from the one before: the columns of ``series`` but ``window``, with step,
    ts, predicted, confidence, low and high for each coming point.

    ``series`` has (kind, ts, current, window); ``models`` gives a kind its model and the features it was fitted on, other
    columns of ``series`` among them (a trend over the whole history, say).  With ``follow`` a prediction is the next
    point's current value; with ``moving`` it also enters the window, else lags and means stay those of the history.
    Kinds without a model get the rule forecast.  Values are kept within the kind's bounds; an infinite or missing
    prediction gives a null value.  Whole series go forward side by side inside their rows: nothing shuffles, and a
    row holds ``LOOK_BACK`` values and the points.
    """
    minutes = forecast.MINUTES[granularity]
    points = hours * 60 // minutes
    keys = [c for c in series.columns if c not in ("window", "ts")]
    extra = [c for c in keys if c not in ("kind", "current")]
    point = "struct<step:int,ts:timestamp_ntz,predicted:double,confidence:double>"

    def go(state: Column, step: Column) -> Column:
        ts = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), step * minutes)
        features = forecast_features(state["window"], state["current"], ts)
        features |= {c: F.col(c).cast("double") for c in extra if c not in features}

        def predicted(given: Column) -> Column:
            out = F.lit(None).cast("double")
            for kind, (model, names) in models.items():
                out = F.when(F.col("kind") == kind, as_column(model, names, lambda n: given[n])).otherwise(out)
            return forecast.clip_range(F.when(~F.isnan(out), out), F.col("kind"))

        def following(value: Column) -> Column:
            sure = F.round(forecast.confidence(value, state["current"], F.col("kind"), step - 1), 2)
            after = F.slice(F.array_append(state["window"], value), F.greatest(F.size(state["window"]) + 2 - LOOK_BACK, F.lit(1)), F.lit(LOOK_BACK)) if moving else state["window"]
            done = F.struct(step.alias("step"), ts.alias("ts"), value.alias("predicted"), sure.alias("confidence")).cast(point)
            return F.struct((value if follow else state["current"]).alias("current"), after.alias("window"), F.array_append(state["done"], done).alias("done"))

        used = {n for _, names in models.values() for n in names}
        given = F.struct(*(features[n].cast("double").alias(n) for n in sorted(used)))
        return let(given, lambda g: let(predicted(g), following))

    modelled = series.where(F.col("kind").isin(*models)) if models else series.where("false")
    out = modelled.select(*keys, F.lit(None).cast(f"array<{point}>").alias("_done")).where("false")
    if models and points:
        window = F.coalesce("window", F.array().cast("array<double>"))
        start = F.struct(F.col("current").cast("double").alias("current"), window.alias("window"), F.array().cast(f"array<{point}>").alias("done"))
        out = modelled.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(points)), start, go, lambda s: s["done"]).alias("_done"))
    out = out.select(*keys, F.explode("_done").alias("_p")).select(*keys, "_p.*")
    low, high = forecast.interval(F.col("predicted"), F.col("confidence"))
    out = out.withColumns({"low": low, "high": high})
    rest = series.where(~F.coalesce(F.col("kind").isin(*models), F.lit(False))) if models else series
    ruled = forecast.rule_points(rest.select(*keys, F.col("ts").cast("timestamp_ntz").alias("_now")), "_now", points if granularity != "minute" else min(points, 1440), granularity)
    return out.unionByName(ruled.select(out.columns))


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """What each feature adds: importances of trees, or the size of a line's scaled coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return dict(zip(features, map(float, values)))


def save_model(model: PipelineModel, folder: str, kind: str) -> None:
    model.write().overwrite().save(f"{folder}/{kind}")


def load_model(folder: str, kind: str, fallback: str = "qps", probe: DataFrame | None = None) -> tuple[str, PipelineModel]:
    """(kind, model) from a folder; ``fallback``'s where the kind has none or gives no number for ``probe``."""
    for name in dict.fromkeys((kind, fallback)):
        try:
            model = PipelineModel.load(f"{folder}/{name}")
        except Exception as error:
            if name == fallback:
                raise LookupError(f"no model of {kind} or {fallback} in {folder}") from error
            continue
        if probe is None or model.transform(probe).where(F.col("prediction").isNull() | F.isnan("prediction")).isEmpty():
            return name, model
    raise LookupError(f"no usable model of {kind} or {fallback} in {folder}")
