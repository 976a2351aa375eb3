"""Range queries of a metrics service as a data source, and stored pages of their results.

``MetricRange`` reads a live service over HTTP: filters on ``metric`` and ``ts`` are pushed into its requests, and the
range is cut into slices that tasks fetch apart.  ``write_pages`` keeps samples in Parquet by pages of time, which
``read_pages`` prunes by time, and by metric within a page.
"""

from __future__ import annotations

import datetime
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SAMPLES = "metric string, labels map<string,string>, ts timestamp, value double"
#: Points of a series that one request asks for; services refuse more than some 11,000.
POINTS = 10_000
#: Where stored pages are cut, in hours.
PAGE_HOURS = 24
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _micros(when: datetime.datetime) -> int:
    when = when if when.tzinfo else when.replace(tzinfo=datetime.timezone.utc)
    return (when - EPOCH) // datetime.timedelta(microseconds=1)


@dataclass
class Slice(InputPartition):
    """The steps from ``first`` to ``last`` (seconds, both included) of what ``selector`` names."""

    selector: str
    first: int
    last: int


@dataclass
class MetricRange(DataSource):
    """``spark.read.format("metric_range")``: samples of a service's range queries.

    Options: ``url`` (of the service), ``start`` and ``end`` (seconds since 1970; ``end`` included), ``step`` (seconds,
    60), ``points`` (of a request), ``timeout`` (seconds, 30) and ``query`` (an expression in place of metric names).
    Steps are multiples of ``step`` since 1970, so that a pushed filter changes no sample's time.  A value that is
    no number becomes 0, a series without a name has a null metric.  A service that fails fails the task, which Spark
    repeats, rather than leave a gap in the rows.
    """

    options: dict

    @classmethod
    def name(cls) -> str:
        return "metric_range"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> MetricRangeReader:
        found = {str(k).lower(): v for k, v in self.options.items()}
        if not {"url", "start", "end"} <= set(found):
            raise ValueError("metric_range needs the options url, start and end")
        return MetricRangeReader(
            found["url"].rstrip("/"),
            int(float(found["start"]) * 1_000_000),
            int(float(found["end"]) * 1_000_000),
            int(found.get("step", 60)),
            int(found.get("points", POINTS)),
            float(found.get("timeout", 30)),
            found.get("query"),
        )


@dataclass
class MetricRangeReader(DataSourceReader):
    """Plans and fetches slices.  ``low`` and ``high`` are microseconds, both included."""

    url: str
    low: int
    high: int
    step: int
    points: int
    timeout: float
    query: str | None
    metrics: set[str] | None = field(default=None)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what a request can say; yields the rest for Spark."""
        for each in filters:
            if not self._taken(each):
                yield each

    def _taken(self, each: Filter) -> bool:
        match each:
            case EqualTo(("ts",), value):
                self.low, self.high = max(self.low, _micros(value)), min(self.high, _micros(value))
            case GreaterThanOrEqual(("ts",), value):
                self.low = max(self.low, _micros(value))
            case GreaterThan(("ts",), value):
                self.low = max(self.low, _micros(value) + 1)
            case LessThanOrEqual(("ts",), value):
                self.high = min(self.high, _micros(value))
            case LessThan(("ts",), value):
                self.high = min(self.high, _micros(value) - 1)
            case IsNotNull(("ts",)):
                pass
            case IsNotNull(("metric",)):
                return self.query is None
            case EqualTo(("metric",), value) if self.query is None:
                self._only({value})
            case In(("metric",), values) if self.query is None:
                self._only({v for v in values if v is not None})
            case _:
                return False
        return True

    def _only(self, names: set[str]) -> None:
        self.metrics = names if self.metrics is None else self.metrics & names

    def _selectors(self) -> list[str]:
        if self.query is not None:
            return [self.query]
        if self.metrics is None:
            return ['{__name__=~".+"}']
        return ["{__name__=" + json.dumps(name, ensure_ascii=False) + "}" for name in sorted(self.metrics)]

    def partitions(self) -> list[InputPartition]:
        """One slice for each metric and ``points`` steps; one without steps where nothing is asked."""
        every = self.step * 1_000_000
        first, last = -(-self.low // every) * self.step, self.high // every * self.step
        wide = self.step * self.points
        slices = [Slice(s, at, min(at + wide - self.step, last)) for at in range(first, last + 1, wide) for s in self._selectors()]
        return slices or [Slice("", 0, -1)]

    def read(self, partition: Slice) -> Iterator:
        import pyarrow as pa

        if partition.last < partition.first:
            return
        asked = urllib.parse.urlencode({"query": partition.selector, "start": partition.first, "end": partition.last, "step": self.step})
        with urllib.request.urlopen(f"{self.url}/api/v1/query_range?{asked}", timeout=self.timeout) as answer:
            body = json.load(answer)
        if body.get("status") != "success":
            raise RuntimeError(f"range query failed: {body.get('error', body.get('status'))}")
        kinds = pa.schema([("metric", pa.string()), ("labels", pa.map_(pa.string(), pa.string())), ("ts", pa.timestamp("us", tz="UTC")), ("value", pa.float64())])
        for series in body["data"]["result"]:
            labels = dict(series.get("metric") or {})
            name, samples = labels.pop("__name__", None), series.get("values") or []
            n = len(samples)
            if n:
                times = pa.array([round(float(s[0]) * 1_000_000) for s in samples], pa.int64()).cast(pa.timestamp("us", tz="UTC"))
                columns = [pa.array([name] * n, pa.string()), pa.array([list(labels.items())] * n, kinds.field("labels").type), times, pa.array([number(s[1]) for s in samples], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)


def number(value) -> float:
    """A sample's value; 0 where it is no number."""
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def read_range(spark: SparkSession, url: str, start: float, end: float, step: int = 60, **options) -> DataFrame:
    """(metric, labels, ts, value) of a live service; filters of the caller are pushed into its requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MetricRange)
    settings = {"url": url, "start": start, "end": end, "step": step, **options}
    return spark.read.format("metric_range").options(**{k: str(v) for k, v in settings.items()}).load()


def _page(ts: Column, hours: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / (hours * 3600)).cast("int")


def write_pages(samples: DataFrame, path: str, hours: int = PAGE_HOURS) -> None:
    """Stores samples in folders by page of time.  Rows are dealt by ranges of page, metric and time, so a metric that
    holds most rows fills many files; inside a file they lie by metric and time, which lets a reader skip row groups.
    A page that is written again is replaced (``partitionOverwriteMode=dynamic``), others stay.  Rows without a
    time are kept in a page of their own."""
    rows = samples.withColumn("page", _page(F.col("ts"), hours))
    dealt = rows.repartitionByRange("page", "metric", "ts").sortWithinPartitions("page", "metric", "ts")
    dealt.write.partitionBy("page").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_pages(spark: SparkSession, path: str, start: datetime.datetime | None = None, end: datetime.datetime | None = None, metrics: list[str] | None = None, hours: int = PAGE_HOURS) -> DataFrame:
    """Samples of stored pages from ``start`` up to and without ``end`` (UTC where they name no zone), of all or the
    named metrics.  Only pages of that time are listed in the scan, and metrics and times are pushed to it."""
    rows = spark.read.parquet(path)
    kind, wide = rows.schema["ts"].dataType, hours * 3600 * 1_000_000

    def moment(micros: int) -> Column:
        return F.lit(EPOCH + datetime.timedelta(microseconds=micros)).cast(kind)

    if start is not None:
        rows = rows.where((F.col("page") >= _micros(start) // wide) & (F.col("ts") >= moment(_micros(start))))
    if end is not None:
        rows = rows.where((F.col("page") <= (_micros(end) - 1) // wide) & (F.col("ts") < moment(_micros(end))))
    return (rows if metrics is None else rows.where(F.col("metric").isin(metrics))).drop("page")

