"""Root cause analysis: pattern matching, correlations, causal chain, timeline, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What points to a cause, in metrics, event reasons and logs, and how much it weighs.
PATTERNS = (
    ("OOM", ("container_memory_usage_bytes", "container_memory_working_set_bytes"), ("OOMKilled", "Killing"), ("out of memory", "oom", "memory exhausted"), 0.9),
    ("CPU_THROTTLING", ("container_cpu_cfs_throttled_periods_total", "container_cpu_usage_seconds_total"), ("CPUThrottling", "HighCPU"), ("cpu throttled", "high cpu usage"), 0.85),
    ("CRASH_LOOP", ("kube_pod_container_status_restarts_total",), ("CrashLoopBackOff", "BackOff", "Failed"), ("panic", "fatal error", "segmentation fault", "restarting failed container"), 0.95),
    ("NETWORK_ISSUE", ("container_network_receive_errors_total", "container_network_transmit_errors_total"), ("NetworkNotReady", "NetworkPluginNotReady"), ("connection refused", "timeout", "network unreachable"), 0.8),
    ("IMAGE_PULL", (), ("ImagePullBackOff", "ErrImagePull"), ("pull access denied", "image not found"), 0.95),
    ("RESOURCE_QUOTA", ("kube_resourcequota",), ("FailedScheduling", "InsufficientCPU", "InsufficientMemory", "FailedCreate"), ("exceeded quota", "insufficient resources", "forbidden", "quota"), 0.9),
    ("DISK_PRESSURE", ("node_filesystem_avail_bytes", "node_filesystem_size_bytes"), ("DiskPressure", "EvictedByNodeCondition"), ("no space left", "disk full"), 0.85),
)
THRESHOLDS = {"cpu": 0.8, "memory": 0.9, "disk": 0.85, "error_rate": 0.01}
#: The text column of each source that patterns look into.
SOURCES = ("metrics", "events", "logs")


def pattern_table(spark: SparkSession) -> DataFrame:
    """(seq, cause, metrics, events, logs, weight): one row a cause."""
    rows = [(i, name, list(m), list(e), list(g), w) for i, (name, m, e, g, w) in enumerate(PATTERNS)]
    return spark.createDataFrame(rows, "seq int, cause string, metrics array<string>, events array<string>, logs array<string>, weight double")


def _hits(source: DataFrame, text: str, kind: int) -> DataFrame:
    """One row: for every cause whether some text of a source contains one of its keywords.

    A constant number of flags goes through one aggregate, so no row meets another; texts are looked
    at in lower case.
    """
    flags = [F.coalesce(F.bool_or(_mentions(F.col(text), p[1 + kind])), F.lit(False)).alias(p[0]) for p in PATTERNS]
    return source.agg(*flags)


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.lower(text), F.lit(word.lower()))
    return found


def match_patterns(metrics: DataFrame, events: DataFrame, logs: DataFrame, least: float = 0.2) -> DataFrame:
    """(seq, cause, matched, confidence): sources that match over sources the pattern has, times weight.

    ``metrics``, ``events`` and ``logs`` have a string column ``text``.
    """
    out = None
    for kind, (name, source) in enumerate(zip(SOURCES, (metrics, events, logs))):
        row = _hits(source, "text", kind).select(F.explode(F.array(*[F.struct(F.lit(p[0]).alias("cause"), F.col(p[0]).cast("int").alias("hit")) for p in PATTERNS])).alias("x")).select("x.*")
        out = row if out is None else out.unionByName(row)
    spark = metrics.sparkSession
    size = sum(((F.size(c) > 0).cast("int") for c in SOURCES), F.lit(0))
    score = F.col("matched") / F.col("_n") * F.col("weight")
    # The pattern table has a fixed number of rows.
    joined = out.groupBy("cause").agg(F.sum("hit").alias("matched")).join(F.broadcast(pattern_table(spark).withColumn("_n", size)), "cause")
    return joined.withColumn("confidence", score).where(F.col("confidence") > least).select("seq", "cause", "matched", "confidence")


def root_causes(causes: DataFrame, limit: int = 3) -> DataFrame:
    """The most confident causes; equal ones in the order of the pattern table."""
    return causes.orderBy(F.col("confidence").desc(), "seq").limit(limit)


def trending(scored: DataFrame, high: float = 0.5, some: float = 0.3) -> DataFrame:
    """Series as high or trending; a high series with a trend counts as both."""
    base = scored.withColumn("is_violation", F.col("anomaly_score") > high)
    highs = base.where("is_violation").withColumn("class", F.lit("high"))
    moving = base.where(F.col("trend") != "stable").withColumn("class", F.lit("trending"))
    mild = base.where(~F.col("is_violation") & (F.col("trend") == "stable") & (F.col("anomaly_score") > some)).withColumn("class", F.lit("trending"))
    return highs.unionByName(moving).unionByName(mild).drop("is_violation")


def threshold_violations(samples: DataFrame, thresholds: dict[str, float] | None = None, name: str = "metric") -> DataFrame:
    """Series whose latest value is over the limit of a word that their name contains, a row a word."""
    latest = samples.groupBy(name).agg(F.max_by("value", "ts").alias("latest"))
    limits = F.array(*[F.struct(F.lit(k).alias("word"), F.lit(v).alias("threshold")) for k, v in (thresholds or THRESHOLDS).items()])
    rows = latest.select(name, "latest", F.explode(limits).alias("l")).select(name, "latest", "l.*")
    return rows.where(F.contains(F.lower(name), F.col("word")) & (F.col("latest") > F.col("threshold")))


def multi_source_components(parts: list[tuple[str, DataFrame]], limit: int | None = None) -> DataFrame:
    """Components that more than one source names; (component, sources).

    Each frame has a string column ``component``; unknown ones are left out.
    """
    out = None
    for source, df in parts:
        rows = df.select("component", F.lit(source).alias("source")).where(F.col("component").isNotNull() & (F.col("component") != "Unknown")).distinct()
        out = rows if out is None else out.unionByName(rows)
    found = out.groupBy("component").agg(F.sort_array(F.collect_set("source")).alias("sources")).where(F.size("sources") > 1)
    return found if limit is None else found.orderBy(F.size("sources").desc(), "component").limit(limit)


def temporal_correlation(n_metrics: Column, n_events: Column, n_errors: Column) -> Column:
    """0.7 and 0.1 for each source with findings, if two have any; else null."""
    n = (n_metrics > 0).cast("int") + (n_events > 0).cast("int") + (n_errors > 0).cast("int")
    return F.when(n >= 2, 0.7 + 0.1 * n)


def causal_chain(events: DataFrame, metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """(chain, confidence): shortage, failed scheduling, failing service; one row, if two steps hold.

    Critical ``events`` have a reason, ``metrics`` a name and score, ``logs`` are error lines.
    """
    e = events.agg(
        F.coalesce(F.bool_or(F.rlike("reason", F.lit("Insufficient(?:Memory|CPU)"))), F.lit(False)).alias("short"),
        F.coalesce(F.bool_or(F.contains("reason", F.lit("FailedScheduling"))), F.lit(False)).alias("unscheduled"),
    )
    m = metrics.agg(F.coalesce(F.bool_or(F.contains(F.lower("name"), F.lit("memory")) & (F.col("score") > 0.8)), F.lit(False)).alias("memory"))
    g = logs.agg((F.count("*") > 0).alias("failing"))
    one = e.crossJoin(m).crossJoin(g)  # one row each
    first = F.when(F.col("short"), "resource shortage").when(F.col("memory"), "memory pressure")
    chain = F.array_compact(F.array(first, F.when(first.isNotNull() & F.col("unscheduled"), "scheduling failed"), F.when(first.isNotNull() & F.col("unscheduled") & F.col("failing"), "service failing")))
    return one.select(F.array_join(chain, " -> ").alias("chain"), F.size(chain).alias("steps"), F.lit(0.8).alias("confidence")).where("steps >= 2")


def timeline(events: DataFrame, logs: DataFrame, metrics: DataFrame, limit: int = 50) -> DataFrame:
    """Critical and high events, error lines and high series by time; frames share their columns."""
    return events.unionByName(logs, allowMissingColumns=True).unionByName(metrics, allowMissingColumns=True).orderBy("ts", "type", "description").limit(limit)


def completeness(metrics: DataFrame, events: DataFrame, logs: DataFrame, wanted: int = 10) -> DataFrame:
    """One row: counts of each source, critical events, error lines, metric quality and coverage."""
    m = metrics.agg(F.count("*").alias("n_metrics"), F.coalesce(F.avg(F.least(F.col("n") / wanted, F.lit(1.0))), F.lit(0.0)).alias("metric_quality"))
    e = events.agg(F.count("*").alias("n_events"), F.count_if(F.col("severity") == "critical").alias("n_critical"))
    g = logs.agg(F.count("*").alias("n_logs"), F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("n_errors"))
    some = [(F.col(c) > 0).cast("int") for c in ("n_metrics", "n_events", "n_logs")]
    return m.crossJoin(e).crossJoin(g).withColumn("coverage", (some[0] + some[1] + some[2]) / 3)  # one row each


def confidence_band(score: Column, high: float = 0.7, some: float = 0.3) -> Column:
    return F.when(score > high, "high").when(score > some, "medium").otherwise("low")
