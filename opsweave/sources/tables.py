"""Readers, and the operational roles that the test tables play.

``read_table`` and the format readers are what a user of the library calls; the role functions map
star-schema, event and document tables to metrics, cluster events, inventories and logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Schemas of the file formats that operators take.
METRIC_CSV = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
MATRIX_JSON = "metric map<string,string>, values array<array<string>>"
PODS_JSON = (
    "metadata struct<name:string,namespace:string>,"
    " status struct<phase:string,container_statuses:array<struct<name:string,restart_count:int,ready:boolean>>>,"
    " spec struct<containers:array<struct<name:string,security_context:struct<privileged:boolean>>>,init_containers:array<struct<name:string,security_context:struct<privileged:boolean>>>>"
)


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV of samples, with its schema given and not inferred."""
    return spark.read.schema(METRIC_CSV).csv(path, header=True)


def read_range_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Range-query results, one JSON object a series: (metric, labels, ts, value); values that are
    no numbers become 0."""
    rows = spark.read.schema(MATRIX_JSON).json(path)
    sample = rows.select("metric", F.explode("values").alias("sample"))
    return sample.select(
        F.col("metric")["__name__"].alias("metric"),
        F.map_filter("metric", lambda k, _: k != "__name__").alias("labels"),
        F.timestamp_micros((F.col("sample")[0].cast("double") * 1e6).cast("long")).alias("ts"),
        F.coalesce(F.col("sample")[1].try_cast("double"), F.lit(0.0)).alias("value"),
    )


def read_inventory(spark: SparkSession, path: str, schema: str = PODS_JSON) -> DataFrame:
    """Cluster objects, one JSON document a line; paths that a schema does not name are not read."""
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.{md,txt}", max_bytes: int = 10 << 20) -> DataFrame:
    """(source, content) of text files that are not blank and not over ``max_bytes``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    texts = files.where(F.col("length") <= max_bytes).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("content"))
    return texts.where(F.rlike("content", F.lit(r"\S")))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) of log files, lines counted from 1 within a file."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value"))
    return texts.select("source", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).select("source", (F.col("at") + 1).alias("line_no"), "line")


# ---- roles of the test tables ---------------------------------------------------------------


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, ts, value, labels): events as metric samples; a pod label comes from the user."""
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"),
        "ts",
        "value",
        F.create_map(F.lit("pod"), F.concat(F.lit("pod-"), (F.col("user_id") % 5).cast("string"))).alias("labels"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, ts, value): hourly means of each event type."""
    rows = read_table(spark, sf_dir, "events")
    return rows.groupBy(F.col("event_type").alias("metric"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))


HOURLY_SQL = "hourly AS (SELECT event_type AS metric, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"


def cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, type, reason, message, kind, name, namespace, count)."""
    kind = F.col("event_type")
    reason = (
        F.when(kind == "error", "OOMKilled").when(kind == "purchase", "BackOff").when(kind == "click", "Scheduled").when(kind == "view", "Pulled").otherwise("FailedScheduling")
    )
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.when(kind.isin("error", "purchase"), "Warning").otherwise("Normal").alias("type"),
        reason.alias("reason"),
        F.concat(F.lit("event "), kind, F.lit(" of user "), F.col("user_id").cast("string")).alias("message"),
        F.when(F.col("user_id") % 3 == 0, "Node").otherwise("Pod").alias("kind"),
        F.concat(F.lit("obj-"), (F.col("user_id") % 50).cast("string")).alias("name"),
        F.concat(F.lit("ns-"), (F.col("user_id") % 4).cast("string")).alias("namespace"),
        F.get_json_object("props", "$.k").alias("count"),
    )


CLUSTER_EVENTS_SQL = """k8s AS (
  SELECT event_id, ts, CASE WHEN event_type IN ('error', 'purchase') THEN 'Warning' ELSE 'Normal' END AS type,
         CASE event_type WHEN 'error' THEN 'OOMKilled' WHEN 'purchase' THEN 'BackOff' WHEN 'click' THEN 'Scheduled'
              WHEN 'view' THEN 'Pulled' ELSE 'FailedScheduling' END AS reason,
         'event ' || event_type || ' of user ' || CAST(user_id AS VARCHAR) AS message,
         CASE WHEN user_id % 3 = 0 THEN 'Node' ELSE 'Pod' END AS kind,
         'obj-' || CAST(user_id % 50 AS VARCHAR) AS name, 'ns-' || CAST(user_id % 4 AS VARCHAR) AS namespace,
         CAST(CAST(json_extract_string(props, '$.k') AS INT) AS VARCHAR) AS count
  FROM events)"""


LOG_PREFIXES = ("", "ERROR ", "  at ", "panic: ", "ValueError: ", "", "HTTP 503 - ", "connection refused ", "[WARN] ", "request timed out ", "out of memory ")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pod, container, line_no, line): documents as container logs, lines counted from 0.  A prefix
    by document and line makes some of them errors, warnings or stack lines."""
    docs = read_table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    prefix = F.element_at(F.array(*map(F.lit, LOG_PREFIXES)), ((F.col("doc_id") + F.col("line_no")) % len(LOG_PREFIXES) + 1).cast("int"))
    return lines.select(F.concat(F.lit("pod-"), F.col("doc_id").cast("string")).alias("pod"), F.col("source").alias("container"), "line_no", F.concat(prefix, "line").alias("line"))


LOG_LINES_SQL = f"""raw_lines AS (
  SELECT doc_id, source, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
log_lines AS (
  SELECT 'pod-' || CAST(doc_id AS VARCHAR) AS pod, source AS container, line_no, {list(LOG_PREFIXES)}[(doc_id + line_no) % {len(LOG_PREFIXES)} + 1] || line AS line FROM raw_lines)"""


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, namespace, phase, containers, init_containers): orders as pods, their lines as containers."""
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    container = F.struct(
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("name"),
        (F.col("l_linenumber") - 1).alias("restart_count"),
        (F.col("l_linestatus") == "O").alias("ready"),
        (F.col("l_returnflag") == "R").alias("privileged"),
    )
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(container)).alias("containers"))
    phase = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "P", "Pending").otherwise("Running")
    init = F.struct(F.lit("init").alias("name"), (F.col("o_orderkey") % 20 == 0).alias("privileged"))
    return orders.join(grouped, orders.o_orderkey == grouped.l_orderkey, "left").select(
        F.concat(F.lit("pod-"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("namespace"), phase.alias("phase"), "containers", F.when(F.col("o_orderkey") % 10 == 0, F.array(init)).alias("init_containers")
    )


PODS_SQL = """pods AS (
  SELECT 'pod-' || CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS namespace, o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'P' THEN 'Pending' ELSE 'Running' END AS phase FROM orders),
containers AS (
  SELECT l_orderkey, 'c' || CAST(l_linenumber AS VARCHAR) AS container, l_linenumber - 1 AS restart_count,
         l_linestatus = 'O' AS ready, l_returnflag = 'R' AS privileged FROM lineitem)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, conditions): suppliers as nodes, ready while their balance is positive."""
    ready = F.when(F.col("s_acctbal") > 0, "True").when(F.col("s_acctbal") > -500, "Unknown").otherwise("False")
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.array(F.struct(F.lit("DiskPressure").alias("type"), F.lit("False").alias("status")), F.struct(F.lit("Ready").alias("type"), ready.alias("status"))).alias("conditions")
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, namespace, phase): parts as volume claims; some have no phase."""
    phase = F.when(F.col("p_size") % 5 == 0, "Lost").when(F.col("p_size") % 5 == 1, "Pending").when(F.col("p_size") % 5 == 2, F.lit(None)).otherwise("Bound")
    return read_table(spark, sf_dir, "part").select(F.concat(F.lit("pvc-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("namespace"), phase.alias("phase"))


MARKDOWN_LINES = (
    "# Kubernetes guide {}",
    "{}",
    "- step one: kubectl get pods {}",
    "1. docker build image {}",
    "```yaml",
    "key: {}",
    "```",
    "> note on the service-mesh operator {}",
    "| name | port |",
    "|---|---|",
    "| {} | 80 |",
    "",
    "## Troubleshooting {}",
    "Error: {} failed",
    "see config.yaml and https://h.example:8080/api/v1/pods [link](http://x.example) ![img](a.png) {}",
)


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the sentences of documents as lines of markdown, each in a frame by its number."""
    lines = F.split("text", r"\n|\. ")
    frame = lambda i: F.element_at(F.array(*map(F.lit, MARKDOWN_LINES)), ((F.col("doc_id") + i) % len(MARKDOWN_LINES) + 1).cast("int"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, lambda x, i: F.replace(frame(i), F.lit("{}"), x)), "\n").alias("text"))


MARKDOWN_SQL = rf"""md AS (SELECT doc_id, array_to_string(list_transform(string_split_regex(text, '\n|\. '),
    lambda x, i: replace({list(MARKDOWN_LINES)}[(doc_id + i - 1) % {len(MARKDOWN_LINES)} + 1], '{{}}', x)), chr(10)) AS text FROM documents)"""


def vector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding, cluster, text): vectors with the text of the document of their number."""
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("cluster"))
    return vectors.join(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left")


VECTOR_DOCUMENTS_SQL = "vd AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e, label AS cluster, text FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(namespace, name, desired, available): customers as deployments, orders as replicas."""
    orders = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("desired"), F.count_if(F.col("o_orderstatus") != "F").alias("available"))
    customer = read_table(spark, sf_dir, "customer")
    return customer.join(orders, customer.c_custkey == orders.o_custkey).select(
        F.col("c_mktsegment").alias("namespace"), F.concat(F.lit("dep-"), F.col("c_custkey").cast("string")).alias("name"), "desired", "available"
    )


DEPLOYMENTS_SQL = """deps AS (SELECT c_mktsegment AS namespace, 'dep-' || CAST(c_custkey AS VARCHAR) AS name, count(*) AS desired, count(*) FILTER (o_orderstatus <> 'F') AS available
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""
