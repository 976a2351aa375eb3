"""Container logs: folding lines into entries, error filters, summaries, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.logtext import contains_error, error_type, is_stack_line, level_rank, log_level, stripped


def parse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds level, error type and whether a line, without white space around it, belongs to a stack trace."""
    text = F.col(line)
    return df.withColumns({"level": log_level(text), "error_type": error_type(text), "is_stack": is_stack_line(stripped(text))})


def fold_entries(df: DataFrame, by: tuple[str, ...] = ("pod", "container"), most_stack: int | None = None) -> DataFrame:
    """One row for each line that opens an entry, with the stack lines after it (all, or
    ``most_stack`` at most): a running count of openers numbers the entries of a container."""
    order = Window.partitionBy(*by).orderBy("line_no")
    numbered = df.withColumn("entry", F.sum((~F.col("is_stack")).cast("int")).over(order)).where("entry > 0")
    within = Window.partitionBy(*by, "entry").orderBy("line_no")
    placed = numbered.withColumn("at", F.row_number().over(within) - 1)
    if most_stack is not None:
        placed = placed.where(F.col("at") <= most_stack)
    head = F.col("at") == 0
    return placed.groupBy(*by, "entry").agg(
        F.max(F.when(head, F.col("line_no"))).alias("line_no"),
        F.max(F.when(head, F.col("line"))).alias("line"),
        F.max(F.when(head, F.col("level"))).alias("level"),
        F.max(F.when(head, F.col("error_type"))).alias("error_type"),
        F.count_if(~head).alias("n_stack"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("at", "line")))), lambda x: x["line"]), "\n").alias("stack"),
    )


def errors_only(df: DataFrame, line: str = "line") -> DataFrame:
    return df.where(F.col("level").isin("ERROR", "FATAL", "WARN", "WARNING") | contains_error(F.col(line)))


def error_groups(df: DataFrame) -> DataFrame:
    """ERROR and FATAL lines by error type: how many, and how many pods."""
    return df.where(F.col("level").isin("ERROR", "FATAL")).groupBy(F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n"), F.countDistinct("pod").alias("pods"))


def top_messages(df: DataFrame, n: int = 5, width: int = 100, order: tuple[str, ...] = ("pod", "container", "line_no")) -> DataFrame:
    """The most frequent beginnings of error lines; of equal counts, that seen first."""
    found = df.where(F.col("level").isin("ERROR", "FATAL")).groupBy(F.substring("line", 1, width).alias("message"))
    return found.agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first")).orderBy(F.col("n").desc(), "_first").limit(n).drop("_first")


def ranked(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Worst level first, then by place."""
    out = df.orderBy(level_rank(F.col("level")).desc(), "pod", "line_no")
    return out if limit is None else out.limit(limit)


def drop_repeats(df: DataFrame, width: int = 100, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """The first of lines of one pod and container with the same beginning."""
    key = F.md5(F.concat_ws(":", "pod", "container", F.substring("line", 1, width)))
    keyed = df.withColumn("_key", key)
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1").drop("_key", "_n")


def search(df: DataFrame, needle: str, ignore_case: bool = True, line: str = "line") -> DataFrame:
    """Lines that contain ``needle``, numbered from 1, with how often."""
    text: Column = F.lower(line) if ignore_case else F.col(line)
    want = needle.lower() if ignore_case else needle
    times = ((F.length(text) - F.length(F.replace(text, F.lit(want), F.lit("")))) / len(want)).cast("int")
    return df.where(F.contains(text, F.lit(want))).withColumns({"number": F.col("line_no") + 1, "occurrences": times})


def tail(df: DataFrame, n: int, by: tuple[str, ...] = ("pod", "container")) -> DataFrame:
    """The last ``n`` lines of every container."""
    order = Window.partitionBy(*by).orderBy(F.col("line_no").desc())
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def head(df: DataFrame, n: int, by: tuple[str, ...] = ("pod", "container")) -> DataFrame:
    """The first ``n`` lines of every container."""
    order = Window.partitionBy(*by).orderBy("line_no")
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def errors_by_pod(df: DataFrame, width: int = 200) -> DataFrame:
    """(error_type, key, n, first): ERROR and FATAL lines by ``pod_type``, with the beginning of the first."""
    kind = F.coalesce("error_type", F.lit("unknown"))
    found = df.where(F.col("level").isin("ERROR", "FATAL")).groupBy(kind.alias("error_type"), F.concat_ws("_", "pod", kind).alias("key"))
    return found.agg(F.count("*").alias("n"), F.min_by(F.substring("line", 1, width), "line_no").alias("first"))


def since(df: DataFrame, start: Column, ts: str = "ts") -> DataFrame:
    """Lines from a time on; those without a time stay."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= start))


def with_markers(lines: DataFrame, containers: DataFrame) -> DataFrame:
    """Lines, and for each container that waits or has never run one line that says so.

    ``containers`` has pod, container, state, reason and message.
    """
    waiting = containers.where(F.col("state") == "waiting").select("pod", "container", F.lit(0).alias("line_no"), F.concat(F.lit("["), F.col("container"), F.lit("] "), F.coalesce("reason", F.lit("")), F.lit(": "), F.coalesce("message", F.lit(""))).alias("line"))
    never = containers.where(F.col("state") == "none").select("pod", "container", F.lit(0).alias("line_no"), F.concat(F.lit("["), F.col("container"), F.lit("] never ran")).alias("line"))
    return lines.select("pod", "container", "line_no", "line").unionByName(waiting).unionByName(never)


def within_bytes(df: DataFrame, most: int, by: tuple[str, ...] = ("pod", "container")) -> DataFrame:
    """The last lines of each container that fit ``most`` bytes together, line ends counted."""
    so_far = Window.partitionBy(*by).orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_b", F.sum(F.octet_length("line") + 1).over(so_far)).where(F.col("_b") <= most).drop("_b")
