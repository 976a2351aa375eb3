"""A stored corpus that takes upserts: documents, vectors and postings, each dealt into folders by one bucket
function of the content's hash, so that an upsert rewrites the buckets it touches and no others.

The id of a document is the hash of its content, so a repeated upsert changes nothing, and one that was broken off is
mended by running it again.  Each table replaces its touched folders when its job commits; one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsweave.functions.text import tokens

BUCKETS = 64
#: Columns of the tables, given to the reader, since an empty table has no files to learn them from.
TABLES = {
    "documents": "doc_id string, content string, metadata string, bucket int",
    "vectors": "doc_id string, embedding array<double>, bucket int",
    "postings": "term string, doc_id string, bucket int",
}


def content_id(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def bucket_of(doc_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def entries(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, content, metadata, embedding, bucket) of rows with content, metadata and embedding: one row a content,
    that with the largest metadata; null contents go."""
    named = docs.where("content is not null").select(content_id(F.col("content")).alias("doc_id"), F.col("content").cast("string"), F.col("metadata").cast("string"), F.col("embedding").cast("array<double>"))
    newest = named.groupBy("doc_id").agg(F.max_by(F.struct("content", "metadata", "embedding"), F.struct("metadata", "embedding")).alias("x"))
    return newest.select("doc_id", "x.*", bucket_of(F.col("doc_id"), buckets).alias("bucket"))


def _parts(rows: DataFrame, most: int | None) -> dict[str, DataFrame]:
    words = tokens(F.col("content"))
    words = F.array_distinct(F.slice(words, 1, most) if most is not None else words)
    return {
        "documents": rows.select("doc_id", "content", "metadata", "bucket"),
        "vectors": rows.where("embedding is not null").select("doc_id", "embedding", "bucket"),
        "postings": rows.select(F.explode(words).alias("term"), "doc_id", "bucket"),
    }


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def build(docs: DataFrame, folder: str, buckets: int = BUCKETS, most: int | None = None) -> None:
    """Writes the three tables anew."""
    for name, rows in _parts(entries(docs, buckets), most).items():
        rows.repartition("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def upsert(docs: DataFrame, folder: str, buckets: int = BUCKETS, most: int | None = None) -> None:
    """Adds ``docs``; a content that is stored already is replaced, its postings and vector too.

    At most ``buckets`` numbers come to the driver.  The stored rows of the touched buckets are read with a filter on
    the folder, lose the ids that come anew, and are written back with the new ones.  ``buckets`` and ``most`` must
    be those of ``build``.
    """
    spark = docs.sparkSession
    rows = entries(docs, buckets).persist()
    try:
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        ids = rows.select("doc_id")
        for name, new in _parts(rows, most).items():
            stored = load(spark, folder, name).where(F.col("bucket").isin(touched)).join(ids, "doc_id", "left_anti").select(new.columns)
            _write(stored.unionByName(new).repartition("bucket", "doc_id"), f"{folder}/{name}")
    finally:
        rows.unpersist()
