"""State with an end: cooldowns and session contexts as stateful processors, forgotten by event-time timers.

Both need the RocksDB state store, which ``with_state_store`` sets for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _renew(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer a key, at ``at_ms``."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


class Cooldown(StatefulProcessor):
    """Passes an action at least ``seconds`` after the last one passed.  State: that time, in microseconds, until
    the watermark is past the cooldown."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        before, passed = last, []
        found = pd.concat(list(rows)).sort_values(["ts", "action"])
        for at, action in zip(found["ts"], found["action"]):
            now = at.value // 1000
            if last is None or now - last >= self.seconds * 1_000_000:
                passed.append((key[0], at, action))
                last = now
        if last != before:
            self.last.update((last,))
            _renew(self.handle, last // 1000 + self.seconds * 1000)
        yield pd.DataFrame(passed, columns=["series", "ts", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["series", "ts", "action"])

    def close(self) -> None:
        pass


def cooldown(actions: DataFrame, seconds: int = 300, late: str = LATE) -> DataFrame:
    """(series, ts, action): of each series' actions, those at least ``seconds`` after the last one that passed.

    A series is forgotten once the watermark is ``seconds`` past its last passed action.
    """
    with_state_store(actions.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in actions.schema.fields}
    rows = actions.select("series", "ts", "action").withWatermark("ts", late)
    return rows.groupBy("series").transformWithStateInPandas(Cooldown(seconds), f"series {kinds['series']}, ts timestamp, action string", "append", "eventTime")


class SessionContext(StatefulProcessor):
    """A session's newest queries and counts; ends when it has been idle for ``idle_ms`` of event time."""

    COLUMNS = ["session_id", "started", "last_activity", "n_queries", "recent", "status"]
    SCHEMA = "started timestamp, last_activity timestamp, n_queries long, recent array<string>, status string"

    def __init__(self, newest: int, idle_ms: int):
        self.newest, self.idle_ms = newest, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "started long, last long, n long")
        self.recent = handle.getListState("recent", "at long, query string")

    def _row(self, key, status: str) -> pd.DataFrame:
        started, last, n = self.about.get()
        recent = [text for _, text in self.recent.get()]
        return pd.DataFrame([(key[0], pd.Timestamp(started, unit="us"), pd.Timestamp(last, unit="us"), n, recent, status)], columns=self.COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(at, text) for at, text in self.recent.get()] if self.recent.exists() else []
        started, last, n = self.about.get() if self.about.exists() else (None, None, 0)
        for batch in rows:
            times = [at.value // 1000 for at in batch["ts"]]
            held = sorted([*held, *zip(times, batch["query"])])[-self.newest :]
            n += len(times)
            started = min([*times, *([started] if started is not None else [])])
            last = max([*times, *([last] if last is not None else [])])
        self.about.update((started, last, n))
        self.recent.put(held)
        _renew(self.handle, last // 1000 + self.idle_ms)
        yield self._row(key, "active")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.about.exists():
            yield self._row(key, "ended")
            self.about.clear()
            self.recent.clear()

    def close(self) -> None:
        pass


def session_contexts(queries: DataFrame, newest: int = 10, idle_hours: float = 24, late: str = LATE) -> DataFrame:
    """(session_id, started, last_activity, n_queries, recent, status): after each batch the context of the sessions
    it touched (``active``), and once more when a session has been idle for ``idle_hours`` (``ended``).

    ``queries`` has session_id, ts, query.  State: the ``newest`` queries and three numbers a session.
    """
    with_state_store(queries.sparkSession)
    kind = queries.schema["session_id"].dataType.simpleString()
    rows = queries.select("session_id", "ts", F.coalesce("query", F.lit("")).alias("query")).withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(SessionContext(newest, int(idle_hours * 3600_000)), f"session_id {kind}, {SessionContext.SCHEMA}", "append", "eventTime")
