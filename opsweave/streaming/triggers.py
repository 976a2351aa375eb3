"""Periodic jobs: a trigger loop that gives each batch to a job and writes its rows exactly once.

A batch's rows lie in a folder of its own, named by its id.  The stream's checkpoint says which rows a batch has
before it runs, so a batch that is run again after a failure replaces its folder by the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"
# Minutes without a readable schedule, and the shortest period.
DEFAULT_MINUTES, LEAST_MINUTES = 30, 5


def minutes_of(cron: str | None) -> int:
    """The period of a schedule ``*/N ...``, at least ``LEAST_MINUTES``; ``DEFAULT_MINUTES`` for any other."""
    found = re.match(r"\*/(\d+)(?: |$)", cron or "")
    return max(LEAST_MINUTES, int(found[1])) if found else DEFAULT_MINUTES


def write_once(rows: DataFrame, batch_id: int, path: str) -> None:
    """Writes the rows of a batch; a second time changes nothing."""
    rows.drop(BATCH).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def every(stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, cron: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Starts ``job`` on what has arrived since the last trigger, by ``cron`` or once for all that is there now."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_once(job(batch), batch_id, path)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{minutes_of(cron)} minutes")
    return writer.start()


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that batches have written, with their batch's id."""
    return spark.read.option("basePath", path).schema(f"{schema}, {BATCH} long").parquet(f"{path}/{BATCH}=*").withColumn(BATCH, F.col(BATCH).cast("long"))
