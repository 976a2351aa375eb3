"""State that ends, restarts from the checkpoint, and batches that are run twice."""

import datetime

import pytest
from pyspark.sql import functions as F

from opsweave.streaming import stateful, triggers

ACTIONS, QUERIES = "series string, ts timestamp, action string", "session_id string, ts timestamp, query string"


def at(day, hour=0, minute=0, second=0):
    return datetime.datetime(2024, 1, day, hour, minute, second)


class Feed:
    """Files that arrive one by one and a query that is restarted from its checkpoint for each."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir()

    def send(self, rows, form):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/staged{self.n}")
        for part in (self.folder / f"staged{self.n}").glob("*.parquet"):
            part.rename(self.folder / "in" / f"{self.n}-{part.name}")
        self.n += 1
        stream = form(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in")))
        query = stream.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress


def kept(progress):
    return sum(s["numRowsTotal"] for s in progress["stateOperators"])


def test_cooldown_ends_and_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, ACTIONS)
    form = lambda stream: stateful.cooldown(stream, 300, "1 minute")
    feed.send([("a", at(1, 0, 0), "up"), ("a", at(1, 0, 4), "up"), ("b", at(1, 0, 1), "down")], form)
    feed.send([("a", at(1, 0, 4, 30), "up"), ("a", at(1, 0, 5), "down"), ("b", at(1, 0, 5, 59), "down")], form)  # state of a: 0:00
    last = feed.send([("c", at(2), "up")], form)
    last = feed.send([("c", at(2, 0, 1), "up")], form)  # the watermark has passed a and b
    got = {(r.series, r.ts, r.action) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", at(1, 0, 0), "up"), ("a", at(1, 0, 5), "down"), ("b", at(1, 0, 1), "down"), ("c", at(2), "up")}
    assert kept(last) <= 4  # c alone: its time, its timer and the timer's two indexes


def test_sessions_keep_the_newest_and_end(spark, tmp_path):
    feed = Feed(spark, tmp_path, QUERIES)
    form = lambda stream: stateful.session_contexts(stream, 10, 24, "1 hour")
    feed.send([("s", at(1, 0, i), f"q{i}") for i in range(7)] + [("t", at(1, 1), None)], form)
    feed.send([("s", at(1, 2, i), f"r{i}") for i in range(6)], form)
    feed.send([("t", at(1, 20), "late but in time")], form)
    feed.send([("u", at(3, 23), "x")], form)
    feed.send([("u", at(3, 23, 1), "y")], form)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    active = {(r.session_id, r.n_queries): r for r in rows if r.status == "active"}
    assert list(active["s", 13].recent) == [f"q{i}" for i in range(3, 7)] + [f"r{i}" for i in range(6)] and active["s", 13].started == at(1)
    assert list(active["t", 2].recent) == ["", "late but in time"]
    ended = {r.session_id: r for r in rows if r.status == "ended"}
    assert set(ended) == {"s", "t"} and ended["s"].last_activity == at(1, 2, 5) and ended["t"].last_activity == at(1, 20)


def test_a_batch_again_changes_nothing(spark, tmp_path):
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "pod string, restarts long"
    calls = []

    def job(batch):
        return batch.groupBy("pod").agg(F.sum("restarts").alias("restarts"))

    def failing(batch):
        calls.append(1)
        rows = job(batch)
        if len(calls) == 2:
            triggers.write_once(rows, 1, out)  # written, and then the driver dies before the commit
            raise RuntimeError("gone")
        return rows

    def send(n):
        spark.createDataFrame([("p", n), ("q", 1)], schema).coalesce(1).write.mode("append").parquet(source)

    def run(function):
        stream = spark.readStream.schema(schema).parquet(source)
        query = triggers.every(stream, function, out, ck, available_now=True)
        query.awaitTermination()

    send(3)
    run(failing)
    send(5)
    with pytest.raises(Exception, match="gone"):
        run(failing)
    before = sorted(map(tuple, triggers.results(spark, out, schema).collect()))
    run(job)
    assert sorted(map(tuple, triggers.results(spark, out, schema).collect())) == before == [("p", 3, 0), ("p", 5, 1), ("q", 1, 0), ("q", 1, 1)]


def test_schedules():
    assert [triggers.minutes_of(x) for x in ("*/10 * * * *", "*/2 * * * *", "0 3 * * *", "*/x", None, "*/45")] == [10, 5, 30, 30, 30, 45]
