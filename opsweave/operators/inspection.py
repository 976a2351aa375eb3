"""Health inspection: rules are functions of the inventory tables that give finding rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

Tables = dict[str, DataFrame]
FINDING = ("rule_id", "severity", "resource", "message")
SCORES = {"high": 1.0, "medium": 0.7, "low": 0.4}


def _finding(df: DataFrame, rule_id: str, severity: Column | str, resource: Column, message: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(rule_id).alias("rule_id"), level.alias("severity"), resource.alias("resource"), message.alias("message"))


def _named() -> Column:
    return F.concat_ws("/", "namespace", "name")


def pod_phase(t: Tables) -> DataFrame:
    bad = t["pods"].where(F.col("phase").isin("Pending", "Failed"))
    return _finding(bad, "health_pod_phase", F.when(F.col("phase") == "Failed", "high").otherwise("medium"), _named(), F.concat(F.lit("phase "), F.col("phase")))


def pod_restarts(t: Tables, least: int = 3) -> DataFrame:
    total = F.aggregate(F.coalesce("containers", F.array()), F.lit(0), lambda s, c: s + F.coalesce(c["restart_count"], F.lit(0)).cast("int"))
    bad = t["pods"].withColumn("_r", total).where(F.col("_r") >= least)
    return _finding(bad, "health_pod_restarts", "medium", _named(), F.concat(F.lit("restarts "), F.col("_r").cast("string")))


def service_without_endpoints(t: Tables) -> DataFrame:
    """Services with no ready address; one without an endpoints row has none."""
    ready = t["endpoints"].where(F.size("addresses") > 0).select("namespace", "name")
    bad = t["services"].join(ready, ["namespace", "name"], "left_anti")
    return _finding(bad, "health_service_no_endpoints", "high", _named(), F.lit("no ready endpoints"))


def claim_not_bound(t: Tables) -> DataFrame:
    bad = t["claims"].where(F.col("phase").isNotNull() & (F.col("phase") != "Bound"))
    return _finding(bad, "health_pvc_not_bound", "medium", _named(), F.concat(F.lit("phase "), F.col("phase")))


def _query_mentions(t: Tables, rule_id: str, severity: str, *words: str) -> DataFrame:
    test = F.col("points") > 0
    for word in words:
        test = test & F.contains("query", F.lit(word))
    return _finding(t["series"].where(test), rule_id, severity, F.lit("cluster"), F.col("query"))


def cpu_throttling(t: Tables) -> DataFrame:
    return _query_mentions(t, "perf_cpu_throttling", "low", "throttled_seconds_total")


def http_error_rate(t: Tables) -> DataFrame:
    return _query_mentions(t, "perf_http_error_rate", "medium", "http_requests_total", 'code=~"5.."')


def high_risk_events(t: Tables, cap: int | None = None) -> DataFrame:
    """Events of risky reasons, of all or of the newest ``cap``."""
    events = t["events"] if cap is None else t["events"].orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(cap)
    bad = events.where(F.rlike("reason", F.lit("OOMKill|FailedScheduling|CrashLoopBackOff")))
    return _finding(bad, "event_high_risk", "high", F.concat_ws("/", "kind", "name"), F.substring("message", 1, 200))


def node_not_ready(t: Tables) -> DataFrame:
    not_ready = F.exists("conditions", lambda c: (c["type"] == "Ready") & (F.lower(c["status"]) != "true"))
    return _finding(t["nodes"].where(not_ready), "reliability_node_not_ready", "high", F.col("name"), F.lit("node not ready"))


def privileged_containers(t: Tables) -> DataFrame:
    """Containers and init containers that run privileged, a row each."""
    named = [F.transform(F.coalesce(c, F.array()), lambda x: F.struct(x["name"].alias("name"), x["privileged"].alias("privileged"))) for c in ("containers", "init_containers") if c in t["pods"].columns]
    each = t["pods"].select("namespace", "name", F.explode(F.concat(*named)).alias("c")).where("c.privileged")
    return _finding(each, "security_privileged_container", "high", F.concat_ws("/", "namespace", "name", F.col("c.name")), F.lit("privileged"))


RULES: dict[str, Callable[[Tables], DataFrame]] = {
    "health_pod_phase": pod_phase,
    "health_pod_restarts": pod_restarts,
    "health_service_no_endpoints": service_without_endpoints,
    "health_pvc_not_bound": claim_not_bound,
    "perf_cpu_throttling": cpu_throttling,
    "perf_http_error_rate": http_error_rate,
    "event_high_risk": high_risk_events,
    "reliability_node_not_ready": node_not_ready,
    "security_privileged_container": privileged_containers,
}
PROFILES = {"basic": ("health_pod_phase", "health_pod_restarts", "event_high_risk", "perf_cpu_throttling"), "extended": tuple(RULES)}


def inspect(tables: Tables, profile: str = "extended", least_score: float = 0.0) -> DataFrame:
    """All findings of a profile's rules whose score is at least ``least_score``."""
    out = None
    for name in PROFILES[profile]:
        found = RULES[name](tables)
        out = found if out is None else out.unionByName(found)
    score = F.lit(0.0)
    for level, value in SCORES.items():
        score = F.when(F.col("severity") == level, value).otherwise(score)
    return out.withColumn("score", score).where(F.col("score") >= least_score)


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SCORES], F.count("*").alias("total"))


def report_lines(findings: DataFrame) -> DataFrame:
    """(severity, lines): a Markdown list of each severity's findings by rule, counts only."""
    counted = findings.groupBy("severity", "rule_id").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("- "), F.col("rule_id"), F.lit(": "), F.col("n").cast("string"))
    return counted.groupBy("severity").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))


def newest_reports(reports: DataFrame, keep: int = 200) -> DataFrame:
    return reports.orderBy(F.col("ts").desc(), F.col("report_id").desc()).limit(keep)


def distinct_recommendations(df: DataFrame, limit: int = 10) -> DataFrame:
    """Recommendations in the order in which they were first seen."""
    return df.groupBy("recommendation").agg(F.min("seq").alias("seq")).orderBy("seq", "recommendation").limit(limit)


# What is recommended whenever a finding is high.
GENERAL = ("为核心服务启用 HPA/VPA", "配置 PDB 保障可用性")


def collected_recommendations(df: DataFrame, limit: int = 10) -> DataFrame:
    """(place, recommendation) from (seq, severity, recommendation): each once, in the order first seen, then the
    general ones if any finding is high; the first ``limit`` of all.  Null recommendations are none."""
    seen = df.where(F.col("recommendation").isNotNull()).groupBy("recommendation").agg(F.min("seq").alias("_seq")).select(F.lit(0).alias("_part"), "_seq", "recommendation")
    high = df.agg(F.coalesce(F.max(F.col("severity") == "high"), F.lit(False)).alias("_high")).where("_high")
    general = high.select(F.lit(1).alias("_part"), F.posexplode(F.array(*map(F.lit, GENERAL))).alias("_seq", "recommendation")).withColumn("_seq", F.col("_seq").cast("long"))
    order = ("_part", "_seq", "recommendation")
    first = seen.withColumn("_seq", F.col("_seq").cast("long")).unionByName(general).orderBy(*order).limit(limit)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "recommendation")  # at most ``limit`` rows


def numbered_findings(findings: DataFrame) -> DataFrame:
    """Adds ``n``, from 1, by rule and within it by the hash of the resource, resource and message.  Rows are numbered
    in 256 buckets a rule and the counts before a bucket added, so that one rule may have most findings."""
    rows = findings.withColumn("_bucket", F.substring(F.md5(F.coalesce("resource", F.lit(""))), 1, 2))
    counts = rows.groupBy("rule_id", "_bucket").agg(F.count("*").alias("_count"))
    before = Window.orderBy("rule_id", "_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each rule and bucket
    offsets = counts.select("rule_id", "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("rule_id", "_bucket").orderBy("resource", "message"))
    numbered = rows.withColumn("_inside", inside).join(F.broadcast(offsets), ["rule_id", "_bucket"])
    return numbered.withColumn("n", F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def report_rows(findings: DataFrame, recommendations: DataFrame, report_id: str, scope: str, namespace: str = "", checks: int = len(RULES)) -> DataFrame:
    """(section, n, part, line): an inspection report in Markdown, a row a line, in the order of its first columns.

    Sections: 1 title and overview, 2 findings (numbered, with resource and message where they have one), 3
    recommendations, 4 counts by rule.  Findings and recommendations stay distributed; a report without any says so.
    """
    total = findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SCORES])
    number = lambda c: F.col(c).cast("string")
    levels = F.concat_ws("/", *[number(s) for s in SCORES])
    overview = F.concat(F.lit(f"- 检查数: {checks}，问题: "), number("total"), F.lit(" (H/M/L: "), levels, F.lit(")"))
    head = F.array(F.lit(f"# 巡检报告 {report_id}"), F.lit(""), F.lit("## 概览"), F.lit(f"- 范围: {scope} {namespace}"), overview, F.lit(""))

    def lines(df: DataFrame, section: int, n: Column, texts: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), n.cast("long").alias("n"), F.posexplode(F.array_compact(texts)).alias("part", "line"))

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    none, last = F.lit(0), (1 << 62)
    each = numbered_findings(findings)
    level = F.upper(F.coalesce("severity", F.lit("low")))
    where = F.replace("resource", F.lit("/"), F.lit(":"))
    body = F.array(text(number("n"), ". [", level, "] ", F.col("rule_id")), F.when(F.col("resource") != "", text("   - 资源: ", where)), F.when(F.col("message") != "", text("   - 描述: ", F.col("message"))))
    advised = recommendations.agg(F.count("*").alias("k"))
    by_rule = findings.groupBy("rule_id").agg(F.count("*").alias("k"))
    sections = [
        lines(total, 1, none, head),
        lines(total, 2, none, F.array(F.lit("## 发现列表"), F.when(F.col("total") == 0, "无显著问题"))),
        lines(each, 2, F.col("n"), body),
        lines(total, 2, F.lit(last), F.array(F.lit(""))),
        lines(advised, 3, none, F.array(F.lit("## 建议"), F.when(F.col("k") == 0, "- 暂无"))),
        lines(recommendations, 3, F.col("place"), F.array(text("- ", F.col("recommendation")))),
        lines(advised, 3, F.lit(last), F.array(F.lit(""))),
        lines(total, 4, none, F.array(F.lit("## 统计"))),
        lines(by_rule.withColumn("n", F.row_number().over(Window.orderBy("rule_id"))), 4, F.col("n"), F.array(text("- ", F.col("rule_id"), ": ", number("k")))),
    ]
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out


def pod_overview(pods: DataFrame) -> DataFrame:
    """(namespace, name, phase, ready ``r/t``, restarts) of each pod."""
    held = F.coalesce("containers", F.array())
    ready = F.size(F.filter(held, lambda c: c["ready"]))
    return pods.select(
        "namespace", "name", "phase", F.concat(ready.cast("string"), F.lit("/"), F.size(held).cast("string")).alias("ready"), F.aggregate(held, F.lit(0), lambda s, c: s + c["restart_count"].cast("int")).alias("restarts")
    )


def problem_pods(pods: DataFrame, most_restarts: int = 3) -> DataFrame:
    return pods.where(F.col("phase").isin("Failed", "Pending") | ((F.col("phase") == "Running") & F.exists("containers", lambda c: c["restart_count"] > most_restarts)))


def namespace_rollup(pods: DataFrame) -> DataFrame:
    return pods.groupBy("namespace").agg(F.count("*").alias("n"), *[F.count_if(F.col("phase") == p).alias(p.lower()) for p in ("Running", "Pending", "Failed")])


def health_score(nodes: DataFrame, pods: DataFrame, events: DataFrame) -> DataFrame:
    """One row: 100 less penalties for unready nodes, failed and pending pods and warnings; a band."""
    ready = F.exists("conditions", lambda c: (c["type"] == "Ready") & (F.lower(c["status"]) == "true"))
    n = nodes.agg((100 * F.avg(ready.cast("double"))).alias("node_percent"))
    p = pods.agg(F.count_if(F.col("phase") == "Failed").alias("failed"), F.count_if(F.col("phase") == "Pending").alias("pending"))
    e = events.agg(F.count_if(F.col("type").isin("Warning", "Error")).alias("warnings"))
    one = n.crossJoin(p).crossJoin(e)  # one row each
    score = (
        F.lit(100)
        - F.when(F.col("node_percent") < 70, 20).when(F.col("node_percent") < 90, 10).otherwise(0)
        - F.least(F.col("failed") * 5, F.lit(20))
        - F.when(F.col("pending") > 5, 10).otherwise(0)
        - F.when(F.col("warnings") > 10, 15).when(F.col("warnings") > 5, 10).otherwise(0)
    )
    scored = one.withColumn("score", F.greatest(score, F.lit(0)).cast("int"))
    return scored.withColumn("band", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 70, "good").when(F.col("score") >= 50, "fair").otherwise("poor"))


def namespace_deployments(status: DataFrame) -> DataFrame:
    """(namespace, deployments, healthy, desired, available) over the deployments of each namespace."""
    return status.groupBy("namespace").agg(F.count("*").alias("deployments"), F.count_if("healthy").alias("healthy"), F.sum("desired").alias("desired"), F.sum("available").alias("available"))
