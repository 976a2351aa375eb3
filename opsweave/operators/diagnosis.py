"""What several sources say together: evidence of causes, correlations, misconfigurations, fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsweave.functions.quantity import cpu_cores, memory_bytes

# What a cause is called.
DESCRIPTIONS = {
    "OOM": "内存不足导致容器被终止",
    "CPU_THROTTLING": "CPU限制导致性能下降",
    "CRASH_LOOP": "应用程序持续崩溃重启",
    "NETWORK_ISSUE": "网络连接问题",
    "IMAGE_PULL": "镜像拉取失败",
    "RESOURCE_QUOTA": "资源配额不足",
    "DISK_PRESSURE": "磁盘空间不足",
}
# Reasons and words of a failed image pull.
PULL_REASONS = ("errimagepull", "imagepullbackoff")
PULL_WORDS = ("imagepullbackoff", "back-off pulling image", "failed to pull image")


def describe(cause: Column) -> Column:
    out = F.lit("未知问题")
    for name, text in DESCRIPTIONS.items():
        out = F.when(cause == name, text).otherwise(out)
    return out


def _first_few(df: DataFrame, value: Column, n: int) -> DataFrame:
    """One row: the ``n`` smallest distinct values, found without collecting all."""
    few = df.select(value.alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v").limit(n)
    return few.agg(F.sort_array(F.collect_list("v")).alias("v"))


def explain_causes(causes: DataFrame, metrics: DataFrame, events: DataFrame, logs: DataFrame) -> DataFrame:
    """Root causes with a description, at most 5 components of critical events, and 3 pieces of evidence of
    each source: high ``metrics`` (name), critical ``events`` (kind, name, reason), ``logs`` (error_type)."""
    parts = [
        _first_few(events, F.concat_ws("/", "kind", "name"), 5).withColumnRenamed("v", "components"),
        _first_few(metrics, F.col("name"), 3).withColumnRenamed("v", "metric_evidence"),
        _first_few(events, F.col("reason"), 3).withColumnRenamed("v", "event_evidence"),
        _first_few(logs, F.col("error_type"), 3).withColumnRenamed("v", "log_evidence"),
    ]
    out = causes.withColumn("description", describe(F.col("cause")))
    for part in parts:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def overall_confidence(causes: DataFrame) -> DataFrame:
    """One row: the highest confidence of all causes, 0 without any."""
    return causes.agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"))


def correlations(n_metrics: Column, n_events: Column, n_errors: Column, n_shared: Column, chain: Column) -> Column:
    """(kind, confidence, evidence) of what links the sources: temporal, component and causal links, else what
    a single source or none leaves."""
    sources = F.array_compact(F.array(F.when(n_metrics > 0, "metrics"), F.when(n_events > 0, "events"), F.when(n_errors > 0, "logs")))
    n = F.size(sources)

    def link(test: Column, kind: str, confidence: Column, evidence: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), evidence.alias("evidence")))

    found = F.array_compact(
        F.array(
            link(n >= 2, "temporal", 0.7 + 0.1 * n, F.array_join(sources, ",")),
            link(n_shared > 0, "component", F.lit(0.75), F.least(n_shared, F.lit(3)).cast("string")),
            link(chain.isNotNull(), "causal", F.lit(0.8), chain),
        )
    )
    left = F.array_compact(F.array(link(n == 0, "data_insufficient", F.lit(0.1), F.lit("")), link(n == 1, "single_data_source", F.lit(0.3), F.array_join(sources, ","))))
    return F.when(F.size(found) > 0, found).otherwise(left)


def with_correlation_cause(causes: DataFrame, links: DataFrame) -> DataFrame:
    """Causes and, where a causal link is surer than 0.7, one that rests on it."""
    extra = links.where((F.col("kind") == "causal") & (F.col("confidence") > 0.7)).select(F.lit("CORRELATION_BASED").alias("cause"), "confidence")
    return causes.select("cause", "confidence").unionByName(extra)


def quick_diagnosis(causes: DataFrame, timeline: DataFrame, events: int = 5) -> DataFrame:
    """(kind, severity, description): the surest cause, and of the first rows of a timeline the severe ones."""
    top = causes.orderBy(F.col("confidence").desc(), "cause").limit(1).select(F.lit("root_cause").alias("kind"), F.lit("critical").alias("severity"), describe(F.col("cause")).alias("description"))
    first = timeline.orderBy("ts", "type", "description").limit(events).where(F.col("severity").isin("critical", "high"))
    return top.unionByName(first.select(F.lit("event").alias("kind"), "severity", "description"))


# ---- configuration ----


def _probe(probe: Column, kind: str, delay_default: int, bad_paths: tuple[str, ...], nginx: Column) -> list[tuple[str, Column]]:
    return [
        (f"{kind}_failure_threshold", F.coalesce(probe["failure_threshold"], F.lit(3)) < 2),
        (f"{kind}_period", F.coalesce(probe["period_seconds"], F.lit(10)) < 5),
        (f"{kind}_initial_delay", F.coalesce(probe["initial_delay_seconds"], F.lit(delay_default)) < 5),
        (f"{kind}_path", nginx & probe["path"].isin(*bad_paths)),
    ]


def misconfigurations(deployments: DataFrame) -> DataFrame:
    """(name, container, issue): what is wrong with containers of deployments.

    ``deployments`` has name, ``issues`` (states of its pods) and ``containers`` of name, image, liveness and
    readiness probes, and requested memory and cpu and the memory limit as quantities.
    """
    each = deployments.select("name", "issues", F.explode("containers").alias("c"))
    c, has = F.col("c"), lambda issue: F.array_contains("issues", issue)
    nginx = F.contains(F.lower(c["image"]), F.lit("nginx"))
    memory, limit = memory_bytes(c["memory_request"]) / 2**20, memory_bytes(c["memory_limit"]) / 2**20
    crash = has("CrashLoopBackOff") & c["liveness"].isNotNull()
    tests = [
        *((n, c["liveness"].isNotNull() & t) for n, t in _probe(c["liveness"], "liveness", 10, ("/nonexistent", "/health", "/healthz"), nginx)),
        *((n, c["readiness"].isNotNull() & t) for n, t in _probe(c["readiness"], "readiness", 5, ("/health",), nginx)),
        ("readiness_missing", crash & c["readiness"].isNull() | nginx & has("NotReady") & c["readiness"].isNull()),
        ("liveness_missing", nginx & has("NotReady") & c["liveness"].isNull()),
        ("memory_request_high", F.endswith(c["memory_request"], F.lit("Mi")) & (memory > 256)),
        ("cpu_request_high", F.endswith(c["cpu_request"], F.lit("m")) & (cpu_cores(c["cpu_request"]) > 0.3)),
        ("oom_limit_low", has("OOMKilled") & F.coalesce(~F.endswith(c["memory_limit"], F.lit("Mi")) | (limit < 256), F.lit(True))),
    ]
    issues = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return each.select("name", c["name"].alias("container"), F.explode(issues).alias("issue"))


def image_pull_failures(events: DataFrame) -> DataFrame:
    """Events of a failed image pull, by reason or message."""
    reason, text = F.lower(F.coalesce("reason", F.lit(""))), F.lower(F.coalesce("message", F.lit("")))
    test = F.lit(False)
    for w in PULL_REASONS:
        test = test | F.contains(reason, F.lit(w))
    for w in PULL_WORDS:
        test = test | F.contains(text, F.lit(w))
    return events.where(test)


def cluster_diagnosis(nodes: DataFrame, pods: DataFrame, deployments: DataFrame, events: DataFrame) -> DataFrame:
    """One row: ready and all nodes, running pods, problem pods, healthy deployments, warnings.

    ``pods`` have phase and ready, ``deployments`` available and desired.
    """
    ready = F.exists("conditions", lambda c: (c["type"] == "Ready") & (c["status"] == "True"))
    fine = (F.col("phase") == "Running") & F.col("ready")
    one = nodes.agg(F.count_if(ready).alias("ready_nodes"), F.count("*").alias("nodes"))
    one = one.crossJoin(pods.agg(F.count_if(fine).alias("running_pods"), F.count("*").alias("pods"), F.count_if(~fine & (F.col("phase") != "Succeeded")).alias("problem_pods")))
    healthy = F.coalesce("available", F.lit(0)) == F.col("desired")
    one = one.crossJoin(deployments.agg(F.count_if(healthy).alias("healthy_deployments"), F.count("*").alias("deployments")))
    return one.crossJoin(events.agg(F.count_if(F.col("type") == "Warning").alias("warnings")))  # one row each


def fix_verification(pods: DataFrame, key: str = "deployment") -> DataFrame:
    """(deployment, ready, total, percent, verdict): whether a fix has worked, from pods with ready and crash_loop."""
    seen = pods.groupBy(key).agg(F.count_if("ready").alias("ready"), F.count("*").alias("total"), F.count_if("crash_loop").alias("crashing"))
    percent = 100 * F.col("ready") / F.col("total")
    verdict = F.when(F.col("ready") == F.col("total"), "fixed").when(percent >= 50, "partial").when(F.col("crashing") > 0, "crash_loop").otherwise("waiting")
    return seen.select(key, "ready", "total", percent.alias("percent"), verdict.alias("verdict"))


def service_details(services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Services with their addresses; one without endpoints has an empty list."""
    found = endpoints.select("namespace", "name", "addresses")
    joined = services.join(found, ["namespace", "name"], "left")
    return joined.withColumn("addresses", F.coalesce("addresses", F.array().cast(endpoints.schema["addresses"].dataType)))


def deployment_status(deployments: DataFrame) -> DataFrame:
    """(namespace, name, desired, available, healthy) of each deployment."""
    available = F.coalesce("available", F.lit(0))
    return deployments.select("namespace", "name", "desired", available.alias("available"), (available == F.col("desired")).alias("healthy"))


def pods_usage(usage: DataFrame) -> DataFrame:
    """(name, cores, megabytes): the sum over a pod's containers of cpu and memory quantities."""
    total = usage.groupBy("name").agg(F.sum(cpu_cores(F.col("cpu"))).alias("cores"), F.sum(memory_bytes(F.col("memory"))).alias("bytes"))
    return total.select("name", "cores", F.round(F.col("bytes") / 2**20, 2).alias("megabytes"))


def recent_events(events: DataFrame, n: int = 8) -> DataFrame:
    """The newest events by the last time, else the first time, that they were seen."""
    return events.orderBy(F.coalesce("last_seen", "first_seen").desc(), F.col("event_id").desc()).limit(n)
