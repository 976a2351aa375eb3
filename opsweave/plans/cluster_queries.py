"""Queries of events, logs, root causes and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions import logtext, quantity
from opsweave.operators import anomaly, cluster_events as ev, inspection, logs, rca
from opsweave.plans.catalog import ORACLE_SQL, query
from opsweave.plans.series_queries import _H
from opsweave.sources import tables as T

_E = f"WITH {T.CLUSTER_EVENTS_SQL}, n AS (SELECT * REPLACE (CASE WHEN TRY_CAST(count AS INT) > 0 THEN TRY_CAST(count AS INT) ELSE 1 END AS count), CASE WHEN reason IN ('OOMKilled', 'FailedScheduling') THEN 'critical' WHEN reason = 'BackOff' THEN 'high' ELSE 'medium' END AS severity FROM k8s)"


def _events(spark, d):
    return ev.normalise(T.cluster_events(spark, d))


@query("event_normalise", _E + " SELECT event_id, type, reason, kind, name, namespace, count, severity FROM n")
def event_normalise(spark, d):
    return _events(spark, d).select("event_id", "type", "reason", "kind", "name", "namespace", "count", "severity")


@query("event_time_filter", _E + " SELECT event_id, reason FROM n WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND type = 'Warning' AND severity = 'critical'")
def event_time_filter(spark, d):
    return ev.select_events(_events(spark, d), "2024-01-05 00:00:00", "2024-01-12 00:00:00", types=["Warning"], severity_is="CRITICAL").select("event_id", "reason")


@query("severity_distribution", _E + " SELECT severity, count(*) AS n FROM n GROUP BY severity")
def severity_distribution(spark, d):
    return ev.severity_distribution(_events(spark, d))


@query("reason_frequency", _E + " SELECT reason, CAST(sum(count) AS BIGINT) AS n FROM n GROUP BY reason")
def reason_frequency(spark, d):
    return ev.reason_frequency(_events(spark, d))


@query("affected_resources", _E + " SELECT kind, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM n GROUP BY kind")
def affected_resources(spark, d):
    return ev.affected_resources(_events(spark, d)).withColumn("names", F.array_join("names", ","))


@query(
    "event_clusters",
    _E + " SELECT reason || '_' || kind AS cluster, count(*) AS n, min(ts) AS first, max(ts) AS last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / nullif(count(*) - 1, 0), 4) AS mean_gap FROM n GROUP BY 1",
)
def event_clusters(spark, d):
    return ev.event_clusters(_events(spark, d)).withColumn("mean_gap", F.round("mean_gap", 4))


@query(
    "frequency_spikes",
    _E + ", c AS (SELECT reason || '_' || kind AS cluster, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1), 4) AS mean_gap FROM n GROUP BY 1 HAVING count(*) > 5) SELECT * FROM c WHERE mean_gap < 3000",
)
def frequency_spikes(spark, d):
    return ev.frequency_spikes(_events(spark, d), most_gap=3000.0).select("cluster", "n", F.round("mean_gap", 4).alias("mean_gap"))


@query("events_ranked", _E + " SELECT event_id, severity, ts FROM n ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END DESC, ts DESC, event_id LIMIT 100")
def events_ranked(spark, d):
    return ev.ranked(_events(spark, d), 100).select("event_id", "severity", "ts")


@query("important_events", _E + " SELECT event_id FROM n WHERE type IN ('Warning', 'Error') OR reason IN ('Failed', 'FailedMount', 'FailedScheduling')")
def important_events(spark, d):
    return ev.important(_events(spark, d)).select("event_id")


@query("newest_per_object", _E + " SELECT event_id, name, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS nth FROM n QUALIFY nth <= 10")
def newest_per_object(spark, d):
    return ev.newest(_events(spark, d), ["name"], "ts", 10, "event_id").select("event_id", "name", "nth")


# ---- logs ----

_LEVELS = f"""WITH {T.LOG_LINES_SQL}, lv AS (SELECT *, upper(regexp_extract(substr(line, 1, 100), '(?i)\\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\\b', 1)) AS named,
  lower(substr(line, 1, 200)) AS low FROM log_lines),
p AS (SELECT *, CASE WHEN named <> '' THEN named WHEN regexp_matches(low, 'error|exception|failed|fatal|crash|panic|died|错误|异常|失败|崩溃|死机|宕机|故障|中断') THEN 'ERROR'
  WHEN regexp_matches(low, 'warn|warning|alert|caution|警告|注意|提醒|告警') THEN 'WARN' ELSE 'INFO' END AS level,
  CASE WHEN regexp_matches(line, '(?i)(Exception|Error)(\\s+in\\s+thread\\s+"[^"]*")?\\s*:\\s*(.+)') THEN 'Java Exception' WHEN regexp_matches(line, '(?i)(\\w+Error|\\w+Exception):\\s*(.+)') THEN 'Python Exception'
       WHEN regexp_matches(line, '(?i)HTTP\\s+(\\d{{3,}})\\s*[:\\-]?\\s*(.+)') THEN 'Http Error' WHEN regexp_matches(line, '(?i)(timeout|timed?\\s+out)') THEN 'Timeout Error'
       WHEN regexp_matches(line, '(?i)panic:\\s*(.+)') THEN 'Go Panic' WHEN regexp_matches(line, '(?i)(connection|connect)(\\s+(failed|refused|reset|timeout))') THEN 'Connection Error'
       WHEN regexp_matches(line, '(?i)(out of memory|oom|memory exhausted)') THEN 'Memory Error' WHEN regexp_matches(line, '(?i)(no space left|disk full|filesystem full)') THEN 'Disk Error' END AS error_type FROM lv)"""


def _lines(spark, d):
    return logs.parse_lines(T.log_lines(spark, d))


def _timed_lines(spark, d):
    """Log lines with a time: a pod begins at a minute of the events' 30 days, by its number; a line takes a second."""
    number = F.substring_index("pod", "-", -1).cast("long")
    return _lines(spark, d).withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=(number % 43200).cast("int"), secs=F.col("line_no")))


@query("log_levels", _LEVELS + " SELECT level, coalesce(error_type, 'none') AS error_type, count(*) AS n FROM p GROUP BY 1, 2")
def log_levels(spark, d):
    return _lines(spark, d).groupBy("level", F.coalesce("error_type", F.lit("none")).alias("error_type")).agg(F.count("*").alias("n"))


@query("error_summary", _LEVELS + " SELECT coalesce(error_type, 'unknown') AS error_type, count(*) AS n, count(DISTINCT pod) AS pods FROM p WHERE level IN ('ERROR', 'FATAL') GROUP BY 1")
def error_summary(spark, d):
    return logs.error_groups(_lines(spark, d))


@query(
    "top_messages",
    _LEVELS + " SELECT substr(line, 1, 20) AS message, count(*) AS n FROM p WHERE level IN ('ERROR', 'FATAL') GROUP BY 1 ORDER BY n DESC, min((pod, container, line_no)) LIMIT 5",
)
def top_messages(spark, d):
    return logs.top_messages(_lines(spark, d), width=20)


@query("log_dedup", f"WITH {T.LOG_LINES_SQL} SELECT pod, container, min(line_no) AS line_no FROM log_lines GROUP BY pod, container, substr(line, 1, 100)")
def log_dedup(spark, d):
    return logs.drop_repeats(T.log_lines(spark, d)).select("pod", "container", "line_no")


@query(
    "log_search",
    f"WITH {T.LOG_LINES_SQL} SELECT pod, line_no + 1 AS number, CAST((length(lower(line)) - length(replace(lower(line), 'license', ''))) / 7 AS INT) AS occurrences FROM log_lines WHERE contains(lower(line), 'license')",
)
def log_search(spark, d):
    return logs.search(T.log_lines(spark, d), "License").select("pod", "number", "occurrences")


@query("log_tail", f"WITH {T.LOG_LINES_SQL} SELECT pod, line_no FROM log_lines QUALIFY row_number() OVER (PARTITION BY pod, container ORDER BY line_no DESC) <= 3")
def log_tail(spark, d):
    return logs.tail(T.log_lines(spark, d), 3).select("pod", "line_no")


# A line without white space around it cannot be indented: two beginnings and the first three patterns are left.
_STACK = r"""'^at\s+|^File\s+"|^Traceback|^goroutine'"""
_RAW_STACK = r"""(line LIKE '    at %' OR line LIKE '  File %' OR line LIKE 'Traceback%' OR line LIKE 'goroutine%' OR line LIKE chr(9) || 'at%'
    OR (line[1] IN (' ', chr(9)) AND length(trim(line, ' ' || chr(9))) > 10 AND regexp_matches(line, '\.java:|\.py:|\.go:|\(\)|\.js:|line |Line |at |File '))
    OR regexp_matches(line, '^\s*at\s+|^\s*File\s+"|^\s*Traceback'))"""


@query(
    "log_entries",
    f"""WITH {T.LOG_LINES_SQL}, s AS (SELECT *, regexp_matches(trim(line, ' ' || chr(9) || chr(10) || chr(13)), {_STACK}) AS st FROM log_lines),
    e AS (SELECT *, sum(CAST(NOT st AS INT)) OVER (PARTITION BY pod, container ORDER BY line_no) AS entry FROM s)
    SELECT pod, container, CAST(entry AS BIGINT) AS entry, min(line_no) AS line_no, arg_min(line, line_no) AS line, count(*) FILTER (st) AS n_stack, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (st), '') AS stack
    FROM e WHERE entry > 0 GROUP BY pod, container, entry""",
)
def log_entries(spark, d):
    return logs.fold_entries(_lines(spark, d)).select("pod", "container", "entry", "line_no", "line", "n_stack", "stack")


@query(
    "stack_lines",
    f"""WITH {T.LOG_LINES_SQL}, l AS (SELECT pod, line_no, CASE line_no % 4 WHEN 0 THEN '  ' ELSE '' END || line AS line FROM log_lines)
    SELECT pod, line_no FROM l WHERE {_RAW_STACK}""",
)
def stack_lines(spark, d):
    """Every fourth line is indented, as frames of a trace are."""
    lines = T.log_lines(spark, d).withColumn("line", F.concat(F.when(F.col("line_no") % 4 == 0, "  ").otherwise(""), "line"))
    return lines.where(logtext.is_stack_line(F.col("line"))).select("pod", "line_no")


@query("log_errors", _LEVELS + " SELECT pod, line_no FROM p WHERE level IN ('ERROR', 'FATAL', 'WARN', 'WARNING') OR regexp_matches(lower(line), 'error|exception|failed|fatal|crash|panic|died|错误|异常|失败|崩溃|死机|宕机|故障|中断|timeout|超时') OR error_type = 'Http Error'")
def log_errors(spark, d):
    return logs.errors_only(_lines(spark, d)).select("pod", "line_no")


# ---- root causes ----


#: Metric names that event types stand for.
METRIC_NAMES = {"error": "container_memory_usage_bytes", "view": "container_cpu_usage_seconds_total", "click": "container_network_receive_errors_total", "purchase": "node_filesystem_avail_bytes"}
_NAMED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_NAMES.items()) + " ELSE 'kube_resourcequota' END"


def _metric_name(kind):
    out = F.lit("kube_resourcequota")
    for key, name in METRIC_NAMES.items():
        out = F.when(kind == key, name).otherwise(out)
    return out


_SCORED = "sc AS (SELECT metric AS event_type, anomaly_score FROM (" + ORACLE_SQL["anomaly_composite"] + "))"


def _texts(spark, d):
    high = anomaly.composite_score(T.hourly(spark, d)).where("anomaly_score > 0.5")
    series = high.select(_metric_name(F.col("metric")).alias("text"))
    events = _events(spark, d).select(F.col("reason").alias("text"))
    return series, events, T.log_lines(spark, d).select(F.col("line").alias("text"))


@query(
    "root_causes",
    f"""WITH {T.CLUSTER_EVENTS_SQL}, {T.LOG_LINES_SQL}, {_SCORED}, mn AS (SELECT {_NAMED} AS name FROM sc WHERE anomaly_score > 0.5), pat(seq, cause, m, e, g, w) AS (VALUES
      (0, 'OOM', 'container_memory_usage_bytes|container_memory_working_set_bytes', 'oomkilled|killing', 'out of memory|oom|memory exhausted', 0.9),
      (1, 'CPU_THROTTLING', 'container_cpu_cfs_throttled_periods_total|container_cpu_usage_seconds_total', 'cputhrottling|highcpu', 'cpu throttled|high cpu usage', 0.85),
      (2, 'CRASH_LOOP', 'kube_pod_container_status_restarts_total', 'crashloopbackoff|backoff|failed', 'panic|fatal error|segmentation fault|restarting failed container', 0.95),
      (3, 'NETWORK_ISSUE', 'container_network_receive_errors_total|container_network_transmit_errors_total', 'networknotready|networkpluginnotready', 'connection refused|timeout|network unreachable', 0.8),
      (4, 'IMAGE_PULL', NULL, 'imagepullbackoff|errimagepull', 'pull access denied|image not found', 0.95),
      (5, 'RESOURCE_QUOTA', 'kube_resourcequota', 'failedscheduling|insufficientcpu|insufficientmemory|failedcreate', 'exceeded quota|insufficient resources|forbidden|quota', 0.9),
      (6, 'DISK_PRESSURE', 'node_filesystem_avail_bytes|node_filesystem_size_bytes', 'diskpressure|evictedbynodecondition', 'no space left|disk full', 0.85)),
    c AS (SELECT seq, cause, w, CASE WHEN m IS NULL THEN 2 ELSE 3 END AS n,
      (SELECT CAST(count(*) > 0 AS INT) FROM mn WHERE regexp_matches(name, m))
      + (SELECT CAST(count(*) > 0 AS INT) FROM k8s WHERE regexp_matches(lower(reason), e)) + (SELECT CAST(count(*) > 0 AS INT) FROM log_lines WHERE regexp_matches(lower(line), g)) AS matched FROM pat)
    SELECT seq, cause, CAST(matched AS BIGINT) AS matched, round(CAST(matched AS DOUBLE) / n * CAST(w AS DOUBLE), 6) AS confidence FROM c WHERE matched / n * w > 0.2 ORDER BY confidence DESC, seq LIMIT 3""",
)
def root_causes(spark, d):
    return rca.root_causes(rca.match_patterns(*_texts(spark, d))).withColumn("confidence", F.round("confidence", 6))


@query(
    "threshold_violations",
    """WITH v AS (SELECT CASE event_type WHEN 'error' THEN 'error_rate' WHEN 'view' THEN 'cpu_memory' ELSE event_type END AS metric, arg_max(value, ts) AS latest FROM events GROUP BY 1),
    t(word, threshold) AS (VALUES ('cpu', 0.8), ('memory', 0.9), ('disk', 0.85), ('error_rate', 0.01))
    SELECT metric, round(latest, 6) AS latest, word, CAST(threshold AS DOUBLE) AS threshold FROM v JOIN t ON contains(metric, word) WHERE latest > threshold""",
)
def threshold_violations(spark, d):
    name = F.when(F.col("event_type") == "error", "error_rate").when(F.col("event_type") == "view", "cpu_memory").otherwise(F.col("event_type"))
    rows = T.read_table(spark, d, "events").select(name.alias("metric"), "ts", "value")
    return rca.threshold_violations(rows).withColumn("latest", F.round("latest", 6))


@query(
    "component_multi_source",
    f"""WITH {T.CLUSTER_EVENTS_SQL}, u AS (SELECT name AS component, 'events' AS source FROM k8s WHERE type = 'Warning' UNION SELECT 'obj-' || CAST(doc_id % 70 AS VARCHAR), 'logs' FROM documents
      UNION SELECT 'obj-' || CAST(l_suppkey % 20 AS VARCHAR), 'metrics' FROM lineitem)
    SELECT component, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM u GROUP BY component HAVING count(DISTINCT source) > 1""",
)
def component_multi_source(spark, d):
    named = lambda c: F.concat(F.lit("obj-"), c.cast("string")).alias("component")
    events = _events(spark, d).where("type = 'Warning'").select(F.col("name").alias("component"))
    docs = T.read_table(spark, d, "documents").select(named(F.col("doc_id") % 70))
    lines = T.read_table(spark, d, "lineitem").select(named(F.col("l_suppkey") % 20))
    return rca.multi_source_components([("events", events), ("logs", docs), ("metrics", lines)]).withColumn("sources", F.array_join("sources", ","))


@query(
    "trending_metrics",
    f"""WITH a AS ({ORACLE_SQL["anomaly_composite"]}), t AS (SELECT metric, n, anomaly_score, trend FROM a)
    SELECT *, 'high' AS class FROM t WHERE anomaly_score > 0.5 UNION ALL SELECT *, 'trending' FROM t WHERE trend <> 'stable' UNION ALL SELECT *, 'trending' FROM t WHERE anomaly_score <= 0.5 AND trend = 'stable' AND anomaly_score > 0.3""",
)
def trending_metrics(spark, d):
    scored = anomaly.scored_series(T.hourly(spark, d)).drop("is_high")
    return rca.trending(scored).withColumn("anomaly_score", F.round("anomaly_score", 6))


@query(
    "causal_chain",
    _LEVELS
    + _E.replace("WITH", ",", 1)
    + f""", {_SCORED}, o AS (SELECT (SELECT coalesce(bool_or(regexp_matches(reason, 'Insufficient(Memory|CPU)')), false) FROM n WHERE severity = 'critical') AS s, (SELECT coalesce(bool_or(reason = 'FailedScheduling'), false) FROM n WHERE severity = 'critical') AS u,
      (SELECT count(*) > 0 FROM sc WHERE contains({_NAMED}, 'memory') AND anomaly_score > 0.8) AS m, (SELECT count(*) > 0 FROM p WHERE level IN ('ERROR', 'FATAL')) AS x)
    SELECT CASE WHEN s THEN 'resource shortage' ELSE 'memory pressure' END || ' -> scheduling failed' || CASE WHEN x THEN ' -> service failing' ELSE '' END AS chain, CASE WHEN x THEN 3 ELSE 2 END AS steps, CAST(0.8 AS DOUBLE) AS confidence FROM o WHERE (s OR m) AND u""",
)
def causal_chain(spark, d):
    critical = _events(spark, d).where("severity = 'critical'")
    metrics = anomaly.composite_score(T.hourly(spark, d)).select(_metric_name(F.col("metric")).alias("name"), F.col("anomaly_score").alias("score"))
    return rca.causal_chain(critical, metrics, _lines(spark, d).where(F.col("level").isin("ERROR", "FATAL")))


@query(
    "timeline_topk",
    _LEVELS
    + _E.replace("WITH", ",", 1)
    + """, u AS (SELECT ts, 'event' AS type, reason || ': ' || substr(message, 1, 100) AS description, severity FROM n WHERE severity IN ('critical', 'high')
       UNION ALL SELECT max(ts), 'metric', event_type, 'high' FROM events WHERE event_type IN (SELECT metric FROM ("""
    + ORACLE_SQL["anomaly_composite"]
    + """) WHERE anomaly_score > 0.6) GROUP BY event_type
       UNION ALL SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(substr(pod, 5) AS BIGINT) % 43200) + to_seconds(line_no), 'log', '[' || pod || '] ' || substr(line, 1, 100), 'high' FROM p WHERE level IN ('ERROR', 'FATAL'))
    SELECT * FROM u ORDER BY ts, type, description LIMIT 50""",
)
def timeline_topk(spark, d):
    events = _events(spark, d).where(F.col("severity").isin("critical", "high"))
    events = events.select("ts", F.lit("event").alias("type"), F.concat(F.col("reason"), F.lit(": "), F.substring("message", 1, 100)).alias("description"), "severity")
    high = anomaly.composite_score(T.hourly(spark, d)).where("anomaly_score > 0.6")
    metrics = T.samples(spark, d).groupBy("metric").agg(F.max("ts").alias("ts")).join(high, "metric", "left_semi")
    metrics = metrics.select("ts", F.lit("metric").alias("type"), F.col("metric").alias("description"), F.lit("high").alias("severity"))
    errors = _timed_lines(spark, d).where(F.col("level").isin("ERROR", "FATAL"))
    errors = errors.select("ts", F.lit("log").alias("type"), F.concat(F.lit("["), F.col("pod"), F.lit("] "), F.substring("line", 1, 100)).alias("description"), F.lit("high").alias("severity"))
    return rca.timeline(events, errors, metrics)


@query(
    "data_completeness",
    _LEVELS
    + f""", {T.CLUSTER_EVENTS_SQL}, m AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT (SELECT count(*) FROM m) AS n_metrics, (SELECT round(avg(least(n / 5000.0, 1.0)), 6) FROM m) AS metric_quality, (SELECT count(*) FROM k8s) AS n_events,
      (SELECT count(*) FROM k8s WHERE reason IN ('OOMKilled', 'FailedScheduling')) AS n_critical, (SELECT count(*) FROM p) AS n_logs,
      (SELECT count(*) FROM p WHERE level IN ('ERROR', 'FATAL')) AS n_errors, CAST(((SELECT count(*) > 0 FROM m)::INT + (SELECT count(*) > 0 FROM k8s)::INT + (SELECT count(*) > 0 FROM p)::INT) / 3.0 AS DOUBLE) AS coverage""",
)
def data_completeness(spark, d):
    metrics = T.samples(spark, d).groupBy("metric").agg(F.count("*").alias("n"))
    return rca.completeness(metrics, _events(spark, d), _lines(spark, d), 5000).withColumn("metric_quality", F.round("metric_quality", 6))


# ---- inspection ----


def _tables(spark, d):
    customer, orders = T.read_table(spark, d, "customer"), T.read_table(spark, d, "orders")
    services = customer.select(F.col("c_mktsegment").alias("namespace"), F.concat(F.lit("svc-"), F.col("c_custkey").cast("string")).alias("name"))
    # An address for every open order: customers with none have no ready endpoint.
    open_orders = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    endpoints = open_orders.join(customer, open_orders.o_custkey == customer.c_custkey).select(
        F.col("c_mktsegment").alias("namespace"), F.concat(F.lit("svc-"), F.col("c_custkey").cast("string")).alias("name"), F.array(F.col("n")).alias("addresses")
    )
    series = T.read_table(spark, d, "nation").select(
        F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("rate(container_cpu_cfs_throttled_seconds_total)#"), F.col("n_name")))
        .when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit('http_requests_total{code=~"5.."}#'), F.col("n_name")))
        .otherwise(F.col("n_name"))
        .alias("query"),
        (F.col("n_nationkey") % 2).alias("points"),
    )
    return {"pods": T.pods(spark, d), "services": services, "endpoints": endpoints, "claims": T.claims(spark, d), "nodes": T.nodes(spark, d), "events": _events(spark, d), "series": series}


_FINDINGS = f"""WITH {T.PODS_SQL}, {T.CLUSTER_EVENTS_SQL},
svc AS (SELECT c_custkey, c_mktsegment || '/svc-' || CAST(c_custkey AS VARCHAR) AS resource FROM customer),
f AS (
  SELECT 'health_pod_phase' AS rule_id, CASE phase WHEN 'Failed' THEN 'high' ELSE 'medium' END AS severity, namespace || '/' || name AS resource, 'phase ' || phase AS message FROM pods WHERE phase IN ('Failed', 'Pending')
  UNION ALL SELECT 'health_pod_restarts', 'medium', namespace || '/' || name, 'restarts ' || CAST(r AS VARCHAR) FROM (SELECT namespace, name, CAST(sum(restart_count) AS INT) AS r FROM pods JOIN containers ON o_orderkey = l_orderkey GROUP BY 1, 2) WHERE r >= 3
  UNION ALL SELECT 'health_service_no_endpoints', 'high', resource, 'no ready endpoints' FROM svc WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
  UNION ALL SELECT 'health_pvc_not_bound', 'medium', p_brand || '/pvc-' || CAST(p_partkey AS VARCHAR), 'phase ' || CASE WHEN p_size % 5 = 0 THEN 'Lost' ELSE 'Pending' END FROM part WHERE p_size % 5 IN (0, 1)
  UNION ALL SELECT 'perf_cpu_throttling', 'low', 'cluster', 'rate(container_cpu_cfs_throttled_seconds_total)#' || n_name FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey % 2 > 0
  UNION ALL SELECT 'perf_http_error_rate', 'medium', 'cluster', 'http_requests_total{{code=~"5.."}}#' || n_name FROM nation WHERE n_nationkey % 5 = 1 AND n_nationkey % 2 > 0
  UNION ALL SELECT 'event_high_risk', 'high', kind || '/' || name, substr(message, 1, 200) FROM k8s WHERE reason IN ('OOMKilled', 'FailedScheduling')
  UNION ALL SELECT 'reliability_node_not_ready', 'high', s_name, 'node not ready' FROM supplier WHERE s_acctbal <= 0
  UNION ALL SELECT 'security_privileged_container', 'high', namespace || '/' || name || '/' || container, 'privileged' FROM pods JOIN containers ON o_orderkey = l_orderkey WHERE privileged
  UNION ALL SELECT 'security_privileged_container', 'high', namespace || '/' || name || '/init', 'privileged' FROM pods WHERE o_orderkey % 20 = 0)"""


@query("inspection_rules", _FINDINGS + " SELECT *, CAST(CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END AS DOUBLE) AS score FROM f")
def inspection_rules(spark, d):
    return inspection.inspect(_tables(spark, d))


@query("inspection_basic", _FINDINGS + " SELECT rule_id, severity, resource FROM f WHERE rule_id IN ('health_pod_phase', 'health_pod_restarts', 'event_high_risk', 'perf_cpu_throttling') AND severity <> 'low'")
def inspection_basic(spark, d):
    return inspection.inspect(_tables(spark, d), "basic", 0.7).select("rule_id", "severity", "resource")


@query("inspection_summary", _FINDINGS + " SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM f")
def inspection_summary(spark, d):
    return inspection.summary(inspection.inspect(_tables(spark, d)))


@query(
    "inspection_report",
    _FINDINGS + ", c AS (SELECT severity, '- ' || rule_id || ': ' || CAST(count(*) AS VARCHAR) AS l FROM f GROUP BY severity, rule_id) SELECT severity, string_agg(l, chr(10) ORDER BY l) AS lines FROM c GROUP BY severity",
)
def inspection_report(spark, d):
    return inspection.report_lines(inspection.inspect(_tables(spark, d)))


@query("service_without_endpoints", "SELECT c_mktsegment || '/svc-' || CAST(c_custkey AS VARCHAR) AS resource FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def service_without_endpoints(spark, d):
    return inspection.service_without_endpoints(_tables(spark, d)).select("resource")


@query(
    "pod_overview",
    f"""WITH {T.PODS_SQL}, g AS (SELECT l_orderkey, count(*) FILTER (ready) AS r, count(*) AS t, CAST(sum(restart_count) AS INT) AS s FROM containers GROUP BY 1)
    SELECT namespace, name, phase, CAST(coalesce(r, 0) AS VARCHAR) || '/' || CAST(coalesce(t, 0) AS VARCHAR) AS ready, coalesce(s, 0) AS restarts FROM pods LEFT JOIN g ON o_orderkey = l_orderkey""",
)
def pod_overview(spark, d):
    return inspection.pod_overview(T.pods(spark, d))


@query(
    "problem_pods",
    f"WITH {T.PODS_SQL} SELECT name, phase FROM pods WHERE phase IN ('Failed', 'Pending') OR (phase = 'Running' AND EXISTS (SELECT 1 FROM containers WHERE l_orderkey = o_orderkey AND restart_count > 3))",
)
def problem_pods(spark, d):
    return inspection.problem_pods(T.pods(spark, d)).select("name", "phase")


@query("namespace_rollup", f"WITH {T.PODS_SQL} SELECT namespace, count(*) AS n, count(*) FILTER (phase = 'Running') AS running, count(*) FILTER (phase = 'Pending') AS pending, count(*) FILTER (phase = 'Failed') AS failed FROM pods GROUP BY 1")
def namespace_rollup(spark, d):
    return inspection.namespace_rollup(T.pods(spark, d))


@query(
    "health_score",
    f"""WITH {T.PODS_SQL}, {T.CLUSTER_EVENTS_SQL}, x AS (SELECT (SELECT round(100 * avg(CAST(s_acctbal > 0 AS INT)), 6) FROM supplier) AS node_percent, (SELECT count(*) FROM pods WHERE phase = 'Failed') AS failed,
      (SELECT count(*) FROM pods WHERE phase = 'Pending') AS pending, (SELECT count(*) FROM k8s WHERE type = 'Warning') AS warnings),
    y AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN node_percent < 70 THEN 20 WHEN node_percent < 90 THEN 10 ELSE 0 END - least(failed * 5, 20) - CASE WHEN pending > 5 THEN 10 ELSE 0 END
      - CASE WHEN warnings > 10 THEN 15 WHEN warnings > 5 THEN 10 ELSE 0 END) AS INT) AS score FROM x)
    SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS band FROM y""",
)
def health_score(spark, d):
    return inspection.health_score(T.nodes(spark, d), T.pods(spark, d), _events(spark, d)).withColumn("node_percent", F.round("node_percent", 6))


_Q = "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR) || CASE l_linenumber % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'n' WHEN 2 THEN '' ELSE 'u' END AS cpu, CAST(CAST(l_quantity AS INT) AS VARCHAR) || CASE l_linenumber % 5 WHEN 0 THEN 'Ki' WHEN 1 THEN 'Mi' WHEN 2 THEN 'Gi' WHEN 3 THEN 'k' ELSE 'x' END AS mem, CAST(l_quantity AS INT) AS q FROM lineitem"


@query(
    "quantity_parse",
    f"""WITH q AS ({_Q}) SELECT l_orderkey, l_linenumber, round(q / CASE l_linenumber % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e9 WHEN 2 THEN 1.0 ELSE 1e6 END, 12) AS cores,
    CAST(q::BIGINT * CASE l_linenumber % 5 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824::BIGINT WHEN 3 THEN 1000 ELSE 0 END AS BIGINT) AS bytes FROM q""",
)
def quantity_parse(spark, d):
    line, q = T.read_table(spark, d, "lineitem"), F.col("l_quantity").cast("int").cast("string")
    unit = F.element_at(F.array(*map(F.lit, ("m", "n", "", "u"))), F.col("l_linenumber") % 4 + 1)
    size = F.element_at(F.array(*map(F.lit, ("Ki", "Mi", "Gi", "k", "x"))), F.col("l_linenumber") % 5 + 1)
    return line.select("l_orderkey", "l_linenumber", F.round(quantity.cpu_cores(F.concat(q, unit)), 12).alias("cores"), quantity.memory_bytes(F.concat(q, size)).alias("bytes"))


@query(
    "topk_usage",
    f"WITH q AS ({_Q}) SELECT l_orderkey, round(sum(q / CASE l_linenumber % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e9 WHEN 2 THEN 1.0 ELSE 1e6 END), 6) AS cores FROM q GROUP BY 1 ORDER BY cores DESC, l_orderkey LIMIT 20",
)
def topk_usage(spark, d):
    line, q = T.read_table(spark, d, "lineitem"), F.col("l_quantity").cast("int").cast("string")
    unit = F.element_at(F.array(*map(F.lit, ("m", "n", "", "u"))), F.col("l_linenumber") % 4 + 1)
    used = line.groupBy("l_orderkey").agg(F.round(F.sum(quantity.cpu_cores(F.concat(q, unit))), 6).alias("cores"))
    return used.orderBy(F.col("cores").desc(), "l_orderkey").limit(20)


@query(
    "age_format",
    """WITH a AS (SELECT o_orderkey, o_orderkey * 977 AS s, CAST(floor(o_orderkey * 977 / 60) AS BIGINT) AS m FROM orders)
    SELECT o_orderkey, CASE WHEN m >= 1440 THEN CAST(m // 1440 AS VARCHAR) || 'd' || CAST((m // 60) % 24 AS VARCHAR) || 'h' WHEN m >= 60 THEN CAST(m // 60 AS VARCHAR) || 'h' || CAST(m % 60 AS VARCHAR) || 'm' ELSE CAST(m AS VARCHAR) || 'm' END AS age FROM a""",
)
def age_format(spark, d):
    return T.read_table(spark, d, "orders").select("o_orderkey", quantity.age(F.col("o_orderkey") * 977).alias("age"))


@query("unit_convert", "SELECT p_partkey, round(p_retailprice * 1000.0 / 0.3048, 6) AS feet, round(p_retailprice * 1073741824.0 / 1048576.0, 6) AS mb, round((p_retailprice - 32) * 5 / 9, 6) AS celsius FROM part")
def unit_convert(spark, d):
    v = F.col("p_retailprice")
    return T.read_table(spark, d, "part").select("p_partkey", quantity.convert(v, "km", "ft").alias("feet"), quantity.convert(v, "gb", "mb").alias("mb"), quantity.convert(v, "f", "c").alias("celsius"))


@query("valid_names", "SELECT c_custkey, regexp_full_match(lower(replace(c_name, '#', '-')), '[a-z0-9]([-a-z0-9]*[a-z0-9])?') AS ok, regexp_full_match(c_name, '[a-zA-Z_:][a-zA-Z0-9_:]*') AS metric_ok FROM customer")
def valid_names(spark, d):
    name = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    return T.read_table(spark, d, "customer").select("c_custkey", quantity.valid_name(name).alias("ok"), quantity.valid_metric_name(F.col("c_name")).alias("metric_ok"))


@query("log_rank", _LEVELS + " SELECT pod, line_no, level FROM p ORDER BY CASE level WHEN 'FATAL' THEN 5 WHEN 'ERROR' THEN 4 WHEN 'WARN' THEN 3 WHEN 'WARNING' THEN 3 WHEN 'INFO' THEN 2 WHEN 'DEBUG' THEN 1 WHEN 'TRACE' THEN 0 ELSE 1 END DESC, pod, line_no LIMIT 50")
def log_rank(spark, d):
    return logs.ranked(_lines(spark, d), 50).select("pod", "line_no", "level")
