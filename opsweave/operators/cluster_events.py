"""Cluster events: normalisation, severity, filters, summaries, clusters, ranking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

# Reasons by severity.
REASONS = {
    "critical": ("OOMKilled", "Killing", "Failed", "FailedScheduling", "FailedMount", "FailedCreatePodSandBox", "NetworkNotReady", "FailedCreate"),
    "high": ("Unhealthy", "BackOff", "ImagePullBackOff", "ErrImagePull", "CrashLoopBackOff", "FailedSync", "NodeNotReady"),
    "medium": ("Pulled", "Created", "Started", "Scheduled", "SuccessfulCreate", "ScalingReplicaSet"),
}
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def severity(type_: Column, reason: Column, message: Column) -> Column:
    """By reason; else warnings by words of the message; else low."""
    low = F.lower(message)
    warning = F.when(F.rlike(low, F.lit("failed|error|timeout|killed")), "critical").when(F.rlike(low, F.lit("unhealthy|backoff|pending")), "high").otherwise("medium")
    out = F.when(type_ == "Warning", warning).otherwise("low")
    for name, reasons in REASONS.items():
        out = F.when(reason.isin(*reasons), name).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    rank = F.lit(0)
    for key, value in RANKS.items():
        rank = F.when(name == key, value).otherwise(rank)
    return rank


def normalise(df: DataFrame) -> DataFrame:
    """Defaults for missing fields; a count that is null, no number or not positive is 1."""
    count = F.col("count").cast("string").try_cast("int")
    return df.withColumns(
        {
            "type": F.coalesce("type", F.lit("Unknown")),
            "reason": F.coalesce("reason", F.lit("Unknown")),
            "message": F.coalesce("message", F.lit("")),
            "kind": F.coalesce("kind", F.lit("Unknown")),
            "name": F.coalesce("name", F.lit("Unknown")),
            "namespace": F.coalesce("namespace", F.lit("default")),
            "count": F.when(count > 0, count).otherwise(1),
            "severity": severity(F.coalesce("type", F.lit("")), F.coalesce("reason", F.lit("")), F.coalesce("message", F.lit(""))),
        }
    )


def event_time(*candidates: Column, now: Column) -> Column:
    """The first time that is there: last, first, event, creation, else ``now``."""
    return F.coalesce(*candidates, now)


def select_events(df: DataFrame, start=None, end=None, types: Iterable[str] = (), names: Iterable[str] = (), severity_is: str | None = None) -> DataFrame:
    """Both ends of the time range count; an empty set filters nothing."""
    out = df
    if start is not None and end is not None:
        out = out.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if types := list(types):
        out = out.where(F.col("type").isin(types))
    if names := list(names):
        out = out.where(F.col("name").isin(names))
    return out.where(F.col("severity") == severity_is.lower()) if severity_is else out


def severity_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(F.count("*").alias("n"))


def reason_frequency(df: DataFrame) -> DataFrame:
    """Occurrences of each reason, by the events' own counts."""
    return df.groupBy("reason").agg(F.sum("count").alias("n"))


def affected_resources(df: DataFrame) -> DataFrame:
    """Distinct names of each kind, in order; the names are made distinct before they are gathered."""
    return df.select("kind", "name").distinct().groupBy("kind").agg(F.sort_array(F.collect_list("name")).alias("names"))


def event_clusters(df: DataFrame) -> DataFrame:
    """Events of one reason and kind: how many, how far apart on average, first and last."""
    out = df.groupBy(F.concat_ws("_", "reason", "kind").alias("cluster")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    # The mean gap of sorted times is their range over their number less one.
    gap = F.try_divide((F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6, F.col("n") - 1)
    return out.withColumn("mean_gap", gap)


def frequency_spikes(df: DataFrame, least: int = 5, most_gap: float = 60.0, strict: bool = True) -> DataFrame:
    """Clusters of more than ``least`` events with a mean gap under ``most_gap`` seconds; without
    ``strict`` the count decides alone."""
    found = event_clusters(df).where(F.col("n") > least)
    return found.where(F.col("mean_gap") < most_gap) if strict else found


def ranked(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Worst first, newest first among equals."""
    out = df.orderBy(severity_rank(F.col("severity")).desc(), F.col("ts").desc(), F.col("event_id"))
    return out if limit is None else out.limit(limit)


def important(df: DataFrame, types=("Warning", "Error"), reasons=("Failed", "FailedMount", "FailedScheduling")) -> DataFrame:
    return df.where(F.col("type").isin(*types) | F.col("reason").isin(*reasons))


def newest(df: DataFrame, by: list[str], ts: str, n: int, tie: str) -> DataFrame:
    """The newest ``n`` rows of every key."""
    order = Window.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
