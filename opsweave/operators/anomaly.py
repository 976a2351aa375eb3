"""Anomaly scores, detectors, types, impact, clusters and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.operators import tiles
from opsweave.operators.quantiles import exact_quantiles
from opsweave.operators.series import BY, trend


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def composite_score(df: DataFrame, by: str = BY, least: int = 10) -> DataFrame:
    """One row a series: 0.6 of the largest and 0.4 of the mean of up to four signals: the largest
    z-score (if over 2), the share of outliers past the quartile fences, the spread of differences,
    and the largest deviation from the mean of the last five."""
    steps = tiles.windowed(df, by, lambda order: [{"_d": F.col("value") - F.lag("value").over(order), "_m": F.avg("value").over(order.rowsBetween(-4, 0))}], before=4)
    quartiles = exact_quantiles(df, {"_q1": 0.25, "_q3": 0.75}, by)
    stats = steps.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg("value").alias("_mean"),
        F.stddev_pop("value").alias("_std"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.stddev_pop("_d").alias("_dstd"),
        F.avg(F.abs("value")).alias("_abs"),
        F.max(F.abs(F.col("value") - F.col("_m")) / (F.col("_m") + 1e-10)).alias("_dev"),
    )
    iqr = F.col("_q3") - F.col("_q1")
    past = (F.col("value") < F.col("_q1") - 1.5 * iqr) | (F.col("value") > F.col("_q3") + 1.5 * iqr)
    ratio = df.join(quartiles, by).groupBy(by).agg(F.avg(past.cast("double")).alias("_ratio"))
    z = F.try_divide(F.greatest(F.col("_max") - F.col("_mean"), F.col("_mean") - F.col("_min")), F.col("_std"))
    signals = F.array_compact(
        F.array(
            F.when(z > 2, F.least(z / 3.0, F.lit(1.0))),
            F.when(iqr > 0, F.least(F.col("_ratio") * 2, F.lit(1.0))),
            F.least(F.col("_dstd") / (F.col("_abs") + 1e-10) * 1.5, F.lit(1.0)),
            F.when((F.col("n") > 10) & (F.col("_dev") > 0.5), F.least(F.col("_dev"), F.lit(1.0))),
        )
    )
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / F.size("_s")
    score = F.when(F.col("n") < least, F.lit(0.0)).otherwise(F.coalesce(_clamp(F.array_max("_s") * 0.6 + total * 0.4), F.lit(0.0)))
    return stats.join(quartiles, by).join(ratio, by).withColumn("_s", signals).select(by, "n", score.alias("anomaly_score"))


def scored_series(df: DataFrame, by: str = BY, high: float = 0.5) -> DataFrame:
    """Composite score and trend of each series, and whether it counts as anomalous."""
    return composite_score(df, by).join(trend(df, by).select(by, "trend"), by).withColumn("is_high", F.col("anomaly_score") > high)


def mad_scores(df: DataFrame, by: str = BY) -> DataFrame:
    """0.6745 (v - median) / MAD, where a MAD of 0 counts as 1."""
    off = df.join(exact_quantiles(df, {"_med": 0.5}, by), by).withColumn("_off", F.abs(F.col("value") - F.col("_med")))
    mad = exact_quantiles(off, {"_mad": 0.5}, by, "_off")
    spread = F.when(F.col("_mad") == 0, F.lit(1.0)).otherwise(F.col("_mad"))
    return off.join(mad, by).withColumn("score", F.abs(F.lit(0.6745) * (F.col("value") - F.col("_med")) / spread)).drop("_med", "_off", "_mad")


def detect_mad(df: DataFrame, sensitivity: float = 0.8, by: str = BY) -> DataFrame:
    return mad_scores(df, by).where(F.col("score") > 3.5 * (1.5 - sensitivity))


def detect_zscore(df: DataFrame, sensitivity: float = 0.8, by: str = BY) -> DataFrame:
    """Sample z-scores over 3 (1.5 - s); a series without spread falls back to MAD."""
    stats = df.groupBy(by).agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"), F.stddev_pop("value").alias("_pop"))
    joined = df.join(stats, by)
    spread = joined.where(F.col("_pop") >= 1e-10).withColumn("score", F.abs(F.col("value") - F.col("_mean")) / F.col("_std")).drop("_mean", "_std", "_pop")
    flat = joined.where(F.col("_pop") < 1e-10).select(*df.columns)
    return spread.where(F.col("score") > 3.0 * (1.5 - sensitivity)).unionByName(detect_mad(flat, sensitivity, by))


def detect_iqr(df: DataFrame, sensitivity: float = 0.8, by: str = BY) -> DataFrame:
    """Distance past the fences of width 1.5 (2 - s) in quartile distances."""
    k = 1.5 * (2 - sensitivity)
    q = exact_quantiles(df, {"_q1": 0.25, "_q3": 0.75}, by)
    iqr = F.col("_q3") - F.col("_q1")
    past = F.greatest(F.col("_q1") - k * iqr - F.col("value"), F.col("value") - F.col("_q3") - k * iqr)
    return df.join(q, by).where(past > 0).withColumn("score", F.coalesce(F.try_divide(past, iqr), F.lit(0.0))).drop("_q1", "_q3")


DETECTORS = {"zscore": detect_zscore, "iqr": detect_iqr, "mad": detect_mad, "isolation": detect_mad}


def _expected(order, reach: int) -> list[dict[str, Column]]:
    near = F.array_sort(F.concat(F.collect_list("value").over(order.rowsBetween(-reach, -1)), F.collect_list("value").over(order.rowsBetween(1, reach))))
    n = F.size("_near")
    low, high = F.try_element_at("_near", F.floor((n + 1) / 2).cast("int")), F.try_element_at("_near", (F.floor(n / 2) + 1).cast("int"))
    return [{"_near": near}, {"expected": F.when(n > 0, (low + high) / 2).otherwise(F.col("value"))}]


def expected_value(df: DataFrame, by: str = BY, reach: int = 5) -> DataFrame:
    """The median of up to ``reach`` neighbours on either side, without the row itself."""
    return tiles.windowed(df, by, lambda order: _expected(order, reach), before=reach, after=reach).drop("_near")


def describe(df: DataFrame, by: str = BY) -> DataFrame:
    """Adds expected value and kind: [sustained_|sudden_|gradual_]spike or dip, for every row."""
    v, i, n = F.col("value"), F.col(tiles.ROW), F.col(tiles.SIZE)
    whole = df.groupBy(by).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"))
    steps = tiles.windowed(df, by, lambda order: [{"_d": v - F.lag(v).over(order)}], before=1)
    stats = whole.join(steps.groupBy(by).agg(F.avg(F.abs("_d")).alias("_step")), by)

    def near(order) -> list[dict[str, Column]]:
        around, run = order.rowsBetween(-2, 2), order.rowsBetween(-2, 3)
        # The differences of a window of seven values are those of the six rows after its first.
        return [
            *_expected(order, 5),
            {"_d": v - F.lag(v).over(order), "_far": (F.abs(v - F.col("_mean")) >= 2 * F.col("_std")).cast("int")},
            {"_next": F.lead("_d").over(order), "_all_far": F.min("_far").over(around), "_d_min": F.min("_d").over(run), "_d_max": F.max("_d").over(run)},
        ]

    # A row's own difference needs the row before: three back for the run, one more for the first of them.
    base = tiles.windowed(df.join(stats, by), by, near, before=5, after=5, keep_row=True)
    sustained = (i > 2) & (i <= n - 2) & (F.col("_all_far") == 1)
    sudden = (i > 1) & (i < n) & ((F.abs("_d") > 3 * F.col("_step")) | (F.abs("_next") > 3 * F.col("_step")))
    gradual = (i > 3) & (i <= n - 3) & ((F.col("_d_min") > 0) | (F.col("_d_max") < 0))
    prefix = F.when(sustained, "sustained_").when(sudden, "sudden_").when(gradual, "gradual_").otherwise("")
    kind = F.concat(prefix, F.when(v > F.col("expected"), "spike").otherwise("dip"))
    return base.withColumn("kind", kind).select(*df.columns, "expected", "kind")


def impact(value: Column, expected: Column, score: Column) -> Column:
    """critical, high, medium or low from the raw score and the relative deviation."""
    off = F.when(expected != 0, F.abs(value - expected) / expected).otherwise(F.abs(value))
    both = (score + off * 10) / 2
    return F.when(both > 5, "critical").when(both > 3, "high").when(both > 1.5, "medium").otherwise("low")


def detect(df: DataFrame, method: str = "zscore", sensitivity: float = 0.8, by: str = BY) -> DataFrame:
    """(by, ts, value, expected, kind, impact, anomaly_score) of the rows a detector finds."""
    found = DETECTORS[method](df, sensitivity, by).select(by, "ts", "score")
    return (
        describe(df, by)
        .join(found, [by, "ts"])
        .select(by, "ts", "value", "expected", "kind", impact(F.col("value"), F.col("expected"), F.col("score")).alias("impact"), _clamp(F.col("score") / 5).alias("anomaly_score"))
    )


def clusters(anomalies: DataFrame, gap: str = "1 hour", by: str = BY) -> DataFrame:
    """Runs of at least two anomalies no more than ``gap`` apart.

    A run is named by the row that opens it: the last such row of its tile so far, or of the tiles before.
    """
    seconds = F.expr(f"interval {gap}")
    rows = tiles.numbered(anomalies, by)
    order = tiles.in_tile()
    opened = F.when(F.lag("ts").over(order) + seconds >= F.col("ts"), None).otherwise(F.col(tiles.ROW))
    marked = tiles.dealt(rows, before=1).withColumn("_opened", opened).where(tiles.OWN).drop(tiles.OWN)
    ends = tiles.carry(marked.drop(tiles.OF), F.col("_opened"), "_carried")
    here = F.last("_opened", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    named = marked.withColumn("_here", here).join(ends, [tiles.SERIES, tiles.OF]).withColumn("cluster", F.coalesce("_here", "_carried"))
    out = named.groupBy(by, "cluster").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.max("anomaly_score").alias("max_score"))
    return out.where("n >= 2").drop("cluster")


WEIGHTS = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}


def patterns(anomalies: DataFrame, by: str = BY) -> DataFrame:
    """Counts, severity score and pattern labels of each series' anomalies."""
    weight = F.lit(0.5)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("impact") == name, w).otherwise(weight)
    hour = F.hour("ts")

    def share(test: Column) -> Column:
        return F.avg(test.cast("double"))

    stats = anomalies.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("impact") == "critical").alias("n_critical"),
        F.count_if(F.col("impact") == "high").alias("n_high"),
        F.least(F.lit(1.0), F.sum(weight * F.col("anomaly_score")) / (F.count("*") * 3)).alias("severity"),
        share((hour >= 9) & (hour <= 17)).alias("_work"),
        share((hour < 6) | (hour > 22)).alias("_off"),
        share(F.col("kind") == "spike").alias("_spike"),
        share(F.col("kind") == "dip").alias("_dip"),
        share(F.col("impact").isin("high", "critical")).alias("_bad"),
    )
    labels = F.array_compact(
        F.array(
            F.when(F.col("_work") > 0.7, "business_hours_concentration").when(F.col("_off") > 0.7, "off_hours_concentration"),
            F.when(F.col("_spike") > 0.7, "predominantly_spikes").when(F.col("_dip") > 0.7, "predominantly_dips"),
            F.when(F.col("_bad") > 0.5, "high_severity_concentration"),
        )
    )
    return stats.select(by, "n", "n_critical", "n_high", "severity", F.array_join(labels, ",").alias("labels"))
