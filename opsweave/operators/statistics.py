"""Summaries: forecast statistics, plain numbers, latencies, caches, risks, data quality, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.quantity import round_places


def halves(df: DataFrame, value: str, by: str, ts: str = "ts") -> DataFrame:
    """(by, n, first, second): means of the first n // 2 rows of each series and of the others."""
    order = Window.partitionBy(by).orderBy(ts)
    numbered = df.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(by))})
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    return numbered.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(early, F.col(value))).alias("first"), F.avg(F.when(~early, F.col(value))).alias("second"))


def confidence_trend(df: DataFrame, by: str = "metric", confidence: str = "confidence", step: float = 0.05) -> DataFrame:
    """(by, confidence_trend): the later half's mean confidence against the earlier one's, 0.05 apart."""
    h = halves(df.where(F.col(confidence) > 0), confidence, by)
    name = F.when(F.col("n") < 2, "insufficient_data").when(F.col("second") > F.col("first") + step, "increasing").when(F.col("second") < F.col("first") - step, "decreasing").otherwise("stable")
    return h.select(by, name.alias("confidence_trend"))


def upper_median(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    """(by, median): the value at place n // 2 from 0, by a row number and not by collecting."""
    numbered = df.withColumns({"_i": F.row_number().over(Window.partitionBy(by).orderBy(value)) - 1, "_n": F.count("*").over(Window.partitionBy(by))})
    return numbered.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(by, F.col(value).alias("median"))


def quantitative(df: DataFrame, by: str = "metric", value: str = "value", confidence: str = "confidence") -> DataFrame:
    """One row a series: count, range, mean, upper median, confidences (zeros and nulls left out), direction
    and change of the later half."""
    real = F.when(F.col(confidence) > 0, F.col(confidence))
    base = df.groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.avg(real).alias("mean_confidence"), F.min(real).alias("least_confidence")
    )
    h = halves(df, value, by).select(by, "first", "second")
    a, b = F.col("first"), F.col("second")
    direction = F.when(b > a, "increasing").when(b < a, "decreasing").when(a.isNotNull(), "stable")
    joined = base.join(upper_median(df, by, value), by).join(h, by).join(confidence_trend(df, by, confidence), by, "left")
    return joined.withColumns({"direction": direction, "change_percent": F.when(a > 0, (b - a) / a * 100).when(a.isNotNull(), 0.0)}).drop("first", "second")


def across_dimensions(summaries: DataFrame, trend: str = "direction") -> DataFrame:
    """One row over the series of ``quantitative``: dimensions, points, mean confidence of all points, trends."""
    weight = F.when(F.col("mean_confidence").isNotNull(), F.col("n"))
    return summaries.agg(
        F.count("*").alias("dimensions"),
        F.sum("n").alias("points"),
        (F.sum(F.col("mean_confidence") * F.col("n")) / F.sum(weight)).alias("mean_confidence"),
        *[F.count_if(F.col(trend) == t).alias(t) for t in ("increasing", "decreasing", "stable")],
    )


def numbers(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    """count, sum, range, mean, median (mean of the middle two), population variance and deviation, to four
    places, and all most frequent values, ascending."""
    base = df.groupBy(by).agg(
        F.count(value).alias("n"),
        *[round_places(f(value)).alias(n) for n, f in (("total", F.sum), ("low", F.min), ("high", F.max), ("mean", F.avg), ("median", F.median), ("variance", F.var_pop), ("std", F.stddev_pop))],
    )
    counted = df.groupBy(by, value).agg(F.count("*").alias("_c"))
    most = counted.groupBy(by).agg(F.max("_c").alias("_c"))
    modes = counted.join(most, [by, "_c"]).groupBy(by).agg(F.min(value).alias("first_mode"), F.count("*").alias("n_modes"))
    return base.join(modes, by)


def nearest_ranks(df: DataFrame, by: str, value: str = "value", ts: str = "ts", last: int = 1000, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Values at places int(share * n) from 0 among the newest ``last`` of each key."""
    newest = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.col(ts).desc(), value))).where(F.col("_r") <= last)
    placed = newest.withColumns({"_i": F.row_number().over(Window.partitionBy(by).orderBy(value)) - 1, "_n": F.count("*").over(Window.partitionBy(by))})
    return placed.groupBy(by).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_i") == F.floor(F.col("_n") * s), F.col(value))).alias(f"p{int(s * 100)}") for s in shares])


def cache_rates(df: DataFrame, by: str = "cache_type") -> DataFrame:
    """(by, requests, hits, hit_rate, saved_seconds, grade) from rows with hit and seconds."""
    out = df.groupBy(by).agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.avg("seconds").alias("_mean"))
    rate = 100 * F.col("hits") / F.col("requests")
    grade = F.when(rate >= 80, "A").when(rate >= 60, "B").when(rate >= 40, "C").otherwise("D")
    return out.select(by, "requests", "hits", F.round(rate, 2).alias("hit_rate"), F.round(F.col("hits") * F.col("_mean"), 2).alias("saved_seconds"), grade.alias("grade"))


def effectiveness(rates: DataFrame) -> DataFrame:
    """One row: seconds saved by all caches, and whether that is much."""
    total = rates.agg(F.coalesce(F.sum("saved_seconds"), F.lit(0.0)).alias("saved_seconds"))
    return total.withColumn("effect", F.when(F.col("saved_seconds") > 300, "high").when(F.col("saved_seconds") > 60, "medium").otherwise("low"))


def risk(anomalies: DataFrame, by: str, impact: str = "impact") -> DataFrame:
    """(by, total, severe, score, band, trend): how many anomalies are of high or critical impact."""
    out = anomalies.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col(impact).isin("high", "critical")).alias("severe"))
    band = F.when(F.col("severe") > 2, "high").when(F.col("severe") > 0, "medium").otherwise("low")
    return out.withColumns({"score": F.least(F.lit(1.0), 2 * F.col("severe") / F.col("total")), "band": band, "trend": F.when(F.col("severe") > 2, "increasing").otherwise("stable")})


def data_quality(history: Column, points: Column, mean_confidence: Column, ai_success: Column) -> dict[str, Column]:
    """Quality of history, forecast and interpretation, the whole and its name."""
    past = 0.8 + F.when(history >= 48, 0.1).when((history > 0) & (history < 12), -0.2).otherwise(0.0)
    ahead = 0.8 + F.when(points >= 24, 0.1).otherwise(0.0) + F.when(mean_confidence > 0.8, 0.1).otherwise(0.0)
    ai = F.when(ai_success, 0.8).otherwise(0.5)
    whole = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.3 * past + 0.5 * ahead + 0.2 * ai))
    return {"history": past, "forecast": ahead, "ai": ai, "overall": whole, "assessment": F.when(whole > 0.9, "excellent").when(whole > 0.7, "good").when(whole > 0.5, "fair").otherwise("poor")}


def report_quality(points: Column, mean_confidence: Column) -> Column:
    value = 0.8 + F.when(points >= 24, 0.1).when(points < 12, -0.1).otherwise(0.0) + F.when(mean_confidence > 0.8, 0.1).when(F.coalesce(mean_confidence, F.lit(0.0)) < 0.6, -0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def expired(activity: DataFrame, now: Column, by: str = "session", ts: str = "ts", hours: int = 24) -> DataFrame:
    """(session, last): sessions without activity for longer than ``hours``."""
    last = activity.groupBy(by).agg(F.max(ts).alias("last"))
    return last.where(F.col("last") < now - F.make_dt_interval(hours=F.lit(hours)))


def looping(actions: DataFrame, by: str = "session", order: str = "seq", action: str = "action", window: int = 5, least: int = 3) -> DataFrame:
    """Rows at which the last ``window`` actions of a session, ``least`` at least, are all the same."""
    last = Window.partitionBy(by).orderBy(order).rowsBetween(1 - window, 0)
    seen = actions.withColumns({"_n": F.count("*").over(last), "_a": F.min(action).over(last), "_z": F.max(action).over(last)})
    return seen.where((F.col("_n") >= least) & (F.col("_a") == F.col("_z"))).drop("_n", "_a", "_z")


def action_plan(lines: DataFrame, by: str = "plan", order: str = "line_no", line: str = "line", most: int = 5) -> DataFrame:
    """(plan, action, title, details, priority): lines under the headers before them; the first ``most`` of a
    plan, urgent ones of high priority."""
    text = F.trim(line)
    header = F.rlike(text, F.lit(r"^(?:[1-5]\.|##|\*\*)"))
    rows = lines.where(text != "").select(by, order, text.alias("text"), header.alias("header"))
    numbered = rows.withColumn("action", F.sum(F.col("header").cast("int")).over(Window.partitionBy(by).orderBy(order))).where((F.col("action") > 0) & (F.col("action") <= most))
    detail = F.when(~F.col("header"), F.struct(order, F.trim(F.regexp_replace("text", r"^[-•*]", "")).alias("text")))
    out = numbered.groupBy(by, "action").agg(F.max(F.when(F.col("header"), F.col("text"))).alias("title"), F.transform(F.array_sort(F.collect_list(detail)), lambda x: x["text"]).alias("details"))
    # Words of urgency.
    urgent = F.rlike(F.lower(F.concat_ws(" ", "title", F.array_join("details", " "))), F.lit("紧急|立即|critical|urgent|即时|高风险"))
    return out.withColumn("priority", F.when(urgent, "high").otherwise("medium"))
