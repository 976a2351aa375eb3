"""Structured Streaming forms of the metric and log operators.

Every function takes and returns a DataFrame, streaming or not; ``run_available`` drives one to the
end of what its source holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsweave.sources.shared import shared_dir

LATE = "10 minutes"


def read_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Parquet files as a stream, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


def tumbling_means(samples: DataFrame, width: str = "1 minute", late: str = LATE) -> DataFrame:
    """(metric, ts, value, n): means of tumbling windows; later samples than ``late`` are dropped."""
    windows = samples.withWatermark("ts", late).groupBy("metric", F.window("ts", width).alias("w"))
    return windows.agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("metric", F.col("w.start").alias("ts"), "value", "n")


def sliding_rates(samples: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = LATE) -> DataFrame:
    """(metric, ts, n): samples in each sliding window, by its start."""
    windows = samples.withWatermark("ts", late).groupBy("metric", F.window("ts", width, slide).alias("w"))
    return windows.agg(F.count("*").alias("n")).select("metric", F.col("w.start").alias("ts"), "n")


def sessions(samples: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """(metric, started, ended, n): runs of samples with no gap of ``gap`` or more."""
    windows = samples.withWatermark("ts", late).groupBy("metric", F.session_window("ts", gap).alias("w"))
    return windows.agg(F.count("*").alias("n"), F.max("ts").alias("ended")).select("metric", F.col("w.start").alias("started"), "ended", "n")


def first_of_each(rows: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first row of each key; a key is forgotten once it lies behind the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the query gives for what its source holds now, written by the stream as Parquet into
    the shared folder (complete results by way of ``foreachBatch``) and read back."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/opsweave-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/rows").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
