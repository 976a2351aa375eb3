"""Folds by pointer jumping against one pass over each series."""

import random
from datetime import datetime, timedelta

import pytest

from opsweave.operators import forecast, tiles

START = datetime(2024, 3, 1)


def in_order(rows):
    series = {}
    for r in rows:
        series.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or 0)) for k, v in series.items()}


def plain_cooldown(rows, minutes):
    out = []
    for found in in_order(r for r in rows if r[2] is not None and r[2] != "maintain").values():
        last = None
        for r in found:
            if last is None or r[1] - last >= timedelta(minutes=minutes):
                out.append(r)
                last = r[1]
    return out


def plain_merge(rows, seconds):
    out = []
    for found in in_order(rows).values():
        anchor, most = None, None
        for r in found:
            near = anchor and anchor[2] == r[2] and int(r[1].timestamp()) - int(anchor[1].timestamp()) <= seconds
            if near:
                most = max((n for n in (most, r[3]) if n is not None), default=None)
            else:
                if anchor:
                    out.append((*anchor[:3], most))
                anchor, most = r, r[3]
        out.append((*anchor[:3], most))
    return out


def drawn(n, seed):
    rng = random.Random(seed)
    rows, at = [], START
    for _ in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 30, 299, 300, 301, 900, 3600, 3601]), microseconds=rng.choice([0, 0, 500_000]))
        rows.append((rng.choice(["hot"] * 8 + ["s", None]), at, rng.choice(["scale_up"] * 5 + ["scale_down", "maintain"]), rng.choice([None, 1, 2, 3])))
    return rows + [("one", START, "scale_up", 1), ("ties", START, "scale_up", 1), ("ties", START, "scale_up", 2), ("ties", START, "scale_down", 1)]


def found(frame):
    return sorted(map(str, ((r[0], r[1], r[2], r[3]) for r in frame.collect())))


@pytest.mark.parametrize("tile, cases", [(4, [(5, 3600)]), (64, [(0, 0), (90, 5 * 86400)])])
def test_folds(spark, monkeypatch, tile, cases):
    monkeypatch.setattr(tiles, "TILE", tile)
    rows = drawn(500, tile)
    frame = spark.createDataFrame(rows, "series string, ts timestamp, action string, instances int").repartition(5)
    for minutes, seconds in cases:
        assert found(forecast.apply_cooldown(frame, "series", minutes)) == sorted(map(str, plain_cooldown(rows, minutes)))
        assert found(forecast.merge_recommendations(frame, "series", seconds)) == sorted(map(str, plain_merge(rows, seconds)))


def test_folds_of_nothing(spark):
    frame = spark.createDataFrame([(None, None, "scale_up", 1)], "series string, ts timestamp, action string, instances int")
    assert forecast.apply_cooldown(frame, "series").count() == 0 and forecast.merge_recommendations(frame, "series").count() == 0


def test_no_rows_are_broadcast(spark):
    """Their files are small, since values repeat, where the rows are millions."""
    frame = spark.createDataFrame(drawn(50, 3), "series string, ts timestamp, action string, instances int")
    for out in (forecast.apply_cooldown(frame, "series", 90), forecast.merge_recommendations(frame, "series")):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
