"""Time series operators on long frames (metric, ts, value); thresholds are keyword arguments.

Windows run over tiles of a series (``tiles``), so that one long series spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from opsweave.operators import tiles
from opsweave.operators.quantiles import exact_quantiles

BY = "metric"
#: Steps of a tile of a filled grid.
GRID_TILE = 1024


def resample(df: DataFrame, every: str = "1 minute", by: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean of each window of each series; series keep apart by ``by`` (default: metric)."""
    keys = by or [BY]
    window = F.window(ts, every)
    return df.groupBy(*keys, window.alias("_w")).agg(F.avg(value).alias(value)).select(*keys, F.col("_w.start").alias(ts), value)


def fill_forward(df: DataFrame, every: str = "1 hour", by: str = BY, ts: str = "ts", value: str = "value") -> DataFrame:
    """A row for every step (of a fixed length) between a series' first and last; gaps take the last value before.

    Only a series' own grid is generated, tile by tile; a tile's first gap takes the last value of the tiles before.
    """
    step = F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {every}"))
    ends = df.groupBy(by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).where(F.col("_a").isNotNull())
    last = F.floor((F.unix_micros("_b") - F.unix_micros("_a")) / (step * 1_000_000))
    blocks = ends.withColumn("_last", last).withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / GRID_TILE))))
    steps = F.sequence(F.col("_tile") * GRID_TILE, F.least(F.col("_last"), F.col("_tile") * GRID_TILE + GRID_TILE - 1))
    grid = blocks.withColumn("_k", F.explode(steps)).select(by, "_tile", F.timestamp_micros(F.unix_micros("_a") + F.col("_k") * step * 1_000_000).alias(ts))
    joined = grid.join(df.select(by, ts, value), [by, ts], "left")
    tile_ends = joined.groupBy(by, "_tile").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts))).alias("_end"))
    before = Window.partitionBy(by).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)  # one row a tile
    carried = tile_ends.select(by, "_tile", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(by, "_tile").orderBy(ts)
    filled = joined.withColumn(value, F.last(value, ignorenulls=True).over(inside)).join(carried, [by, "_tile"])
    return filled.select(by, ts, F.coalesce(value, "_carried").alias(value))


def tile_range(df: DataFrame, step_seconds: int, start: str = "start", end: str = "end") -> DataFrame:
    """Fixed windows over [start, end) of each row, the last one clipped."""
    a, b = F.unix_timestamp(start), F.unix_timestamp(end)
    starts = F.when(b > a, F.sequence(a, b - 1, F.lit(step_seconds))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("_s", F.explode(starts)).select(
        *[c for c in df.columns if c not in (start, end)], F.timestamp_seconds("_s").alias("window_start"), F.timestamp_seconds(F.least(F.col("_s") + step_seconds, b)).alias("window_end")
    )


def _lags(order: WindowSpec, offsets: tuple[int, ...] = (1, 24, 168)) -> dict[str, Column]:
    return {f"lag_{n}": F.lag("value", n).over(order) for n in offsets}


def lags(df: DataFrame, offsets: tuple[int, ...] = (1, 24, 168), by: str = BY) -> DataFrame:
    return tiles.windowed(df, by, lambda order: [_lags(order, offsets)], before=max(offsets))


def _change(order: WindowSpec, limit: float = 10.0) -> dict[str, Column]:
    before = F.lag("value").over(order)
    return {"change": F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(F.try_divide(F.col("value") - before, before), F.lit(0.0))))}


def relative_change(df: DataFrame, limit: float = 10.0, by: str = BY) -> DataFrame:
    """(v - previous) / previous; 0 where there is none or it is 0, within +-limit."""
    return tiles.windowed(df, by, lambda order: [_change(order, limit)], before=1)


def _rolling(order: WindowSpec) -> dict[str, Column]:
    six, day = order.rowsBetween(-5, 0), order.rowsBetween(-23, 0)
    v = F.col("value")
    return {
        "mean_6": F.avg(v).over(six),
        "std_6": F.coalesce(F.stddev_samp(v).over(six), F.lit(0.0)),
        "max_6": F.max(v).over(six),
        "min_6": F.min(v).over(six),
        "mean_24": F.avg(v).over(day),
        "max_24": F.max(v).over(day),
    }


def rolling(df: DataFrame, by: str = BY) -> DataFrame:
    """Rolling 6 (mean, sample std with 0 for one row, max, min) and 24 (mean, max)."""
    return tiles.windowed(df, by, lambda order: [_rolling(order)], before=23)


def _slope(order: WindowSpec, width: int = 12, limit: float = 100.0) -> dict[str, Column]:
    last = order.rowsBetween(1 - width, 0)
    at = F.col(tiles.ROW).cast("double")
    slope = F.when(F.stddev_pop("value").over(last) == 0, F.lit(0.0)).otherwise(F.coalesce(F.regr_slope(F.col("value"), at).over(last), F.lit(0.0)))
    return {"slope": F.greatest(F.lit(-limit), F.least(F.lit(limit), slope))}


def rolling_slope(df: DataFrame, width: int = 12, limit: float = 100.0, by: str = BY) -> DataFrame:
    """Least-squares slope over the last ``width`` rows; 0 for one row or no spread."""
    return tiles.windowed(df, by, lambda order: [_slope(order, width, limit)], before=width - 1)


def _with_growth(rows: DataFrame, numbered: DataFrame, offset: int, limit: float) -> DataFrame:
    """Adds ``growth`` to dealt rows: the base is the nearest value other than 0 from ``offset`` rows back on (which
    the last ``offset`` rows never are), in the tile or else carried from later tiles."""
    usable = F.when((F.col("value") != 0) & (F.col(tiles.ROW) <= F.col(tiles.SIZE) - offset), F.col("value"))
    from_here = Window.partitionBy(tiles.SERIES, tiles.OF).orderBy(F.desc(tiles.ROW)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_usable", F.last(usable, ignorenulls=True).over(from_here))
    order = tiles.in_tile()
    rows = rows.withColumns({"_back": F.lag("value", offset).over(order), "_base": F.lag("_usable", offset).over(order)})
    rows = rows.join(tiles.carry(numbered, usable, "_later", later=True), [tiles.SERIES, tiles.OF], "left")
    rate = (F.col("value") - F.col("_back")) / F.coalesce("_base", "_later", F.lit(1.0))
    growth = F.when(rate.isNull(), 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), rate)))
    return rows.withColumn("growth", growth).drop("_usable", "_back", "_base", "_later")


def growth_rate(df: DataFrame, offset: int = 24, limit: float = 5.0, by: str = BY) -> DataFrame:
    """(v - v[-offset]) / v[-offset], 0 before there is one; a zero base takes the next usable one, then 1."""
    rows = tiles.numbered(df, by)
    out = _with_growth(tiles.dealt(rows, before=offset), rows, offset, limit)
    return out.where(tiles.OWN).select(*df.columns, "growth")


def clip_quantiles(df: DataFrame, low: float = 0.01, high: float = 0.99, spread: float = 3.0, by: str = BY) -> DataFrame:
    """Values kept within the interpolated quantiles widened by ``spread`` times their distance."""
    bounds = exact_quantiles(df, {"_lo": low, "_hi": high}, by)
    wide = F.col("_hi") - F.col("_lo")
    clipped = F.greatest(F.col("_lo") - spread * wide, F.least(F.col("_hi") + spread * wide, F.col("value")))
    return df.join(bounds, by).withColumn("value", clipped).drop("_lo", "_hi")


def trend(df: DataFrame, by: str = BY, least: int = 5, least_r: float = 0.5, least_change: float = 0.1) -> DataFrame:
    """One row a series: increasing, decreasing or stable by a least-squares line over its order."""
    numbered = tiles.numbered(df, by).withColumn("_i", F.col(tiles.ROW).cast("double"))
    fitted = numbered.groupBy(by).agg(
        F.count("*").alias("n"), F.regr_slope("value", "_i").alias("slope"), F.corr("value", "_i").alias("r"), F.avg("value").alias("mean")
    )
    clear = (F.col("n") >= least) & (F.abs("r") > least_r) & (F.abs(F.try_divide("slope", "mean")) > least_change)
    name = F.when(clear & (F.col("slope") > 0), "increasing").when(clear, "decreasing").otherwise("stable")
    return fitted.select(by, "n", "slope", name.alias("trend"))


def half_split_trend(df: DataFrame, by: str = BY, ratio: float = 0.1) -> DataFrame:
    """Mean of the later half against that of the first n // 2 rows; one row is stable."""
    first = F.col(tiles.ROW) <= F.floor(F.col(tiles.SIZE) / 2)
    halves = tiles.numbered(df, by).groupBy(by).agg(F.avg(F.when(first, F.col("value"))).alias("first_half"), F.avg(F.when(~first, F.col("value"))).alias("second_half"))
    name = F.when(F.col("second_half") > F.col("first_half") * (1 + ratio), "increasing").when(F.col("second_half") < F.col("first_half") * (1 - ratio), "decreasing")
    return halves.withColumn("trend", F.coalesce(name, F.lit("stable")))


def series_summary(df: DataFrame, by: str = BY) -> DataFrame:
    """count, min, max, mean, population std, CV and the first time of the maximum of each series."""
    out = df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.max_by("ts", F.struct(F.col("value"), -F.unix_micros(F.col("ts").cast("timestamp")))).alias("peak_ts"),
    )
    return out.withColumn("cv", F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)))


def _increments(order: WindowSpec) -> dict[str, Column]:
    before = F.lag("value").over(order)
    return {"_step": F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)}


def counter_rate(df: DataFrame, seconds: int = 300, by: str = BY, tie: tuple[str, ...] = ()) -> DataFrame:
    """Per-second increase over the last ``seconds``; a counter that falls has started anew.

    Increments between samples only: nothing is extrapolated to the window's ends.  Stretches of four windows are
    the tiles; the last window of each is the halo of the next.
    """
    stretch = 4 * seconds
    rows = tiles.windowed(df, by, lambda order: [_increments(order)], before=1, tie=tie)
    rows = rows.withColumns({tiles.SERIES: tiles.series_of(by), "_sec": F.unix_seconds(F.col("ts").cast("timestamp"))})
    own = F.floor(F.col("_sec") / stretch)
    copies = F.array_compact(F.array(own, F.when(F.col("_sec") >= (own + 1) * stretch - seconds, own + 1)))
    rows = rows.withColumn("_home", own).withColumn(tiles.OF, F.explode(copies))
    frame = Window.partitionBy(tiles.SERIES, tiles.OF).orderBy("_sec").rangeBetween(-seconds, 0)
    rates = rows.withColumn("rate", F.sum("_step").over(frame) / F.lit(float(seconds)))
    return rates.where(F.col(tiles.OF) == F.col("_home")).drop("_step", "_sec", "_home", tiles.OF, tiles.SERIES)


def ratio_of(df: DataFrame, over: str, under: str, by: str = BY, labels: str | None = None) -> DataFrame:
    """One metric divided by another at the same time and, where samples have a map of ``labels``, with the
    same labels; rows where both exist (one shuffle, no join)."""
    keys = ["ts"] if labels is None else ["ts", F.array_sort(F.map_entries(labels)).alias(labels)]
    wide = df.where(F.col(by).isin(over, under)).groupBy(*keys).agg(
        F.max(F.when(F.col(by) == over, F.col("value"))).alias("over"), F.max(F.when(F.col(by) == under, F.col("value"))).alias("under")
    )
    out = wide.where(F.col("over").isNotNull() & F.col("under").isNotNull()).withColumn("ratio", F.try_divide("over", "under"))
    return out.select("ts", "ratio") if labels is None else out.select("ts", F.map_from_entries(labels).alias(labels), "ratio")


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour and weekday (Monday 0) with their sines and cosines, business hours, weekend, month ends."""
    hour, day = F.hour(ts), F.weekday(ts)
    turn = 2 * F.pi()
    return df.withColumns(
        {
            "hour": hour,
            "weekday": day,
            "sin_hour": F.sin(turn * hour / 24),
            "cos_hour": F.cos(turn * hour / 24),
            "sin_day": F.sin(turn * day / 7),
            "cos_day": F.cos(turn * day / 7),
            "is_business_hour": ((hour >= 9) & (hour <= 17) & (day < 5)).cast("int"),
            "is_weekend": (day >= 5).cast("int"),
            "month": F.month(ts),
            "is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
            "is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"),
        }
    )


def training_features(df: DataFrame, by: str = BY) -> DataFrame:
    """The training feature set: time features, lags, change, rolling statistics, slope and growth, all in one pass
    over the tiles."""
    numbered = tiles.numbered(time_features(df), by)
    rows = tiles.dealt(numbered, before=168)
    order = tiles.in_tile()
    rows = rows.withColumns({**_lags(order), **_change(order), **_rolling(order), **_slope(order)})
    return _with_growth(rows, numbered, 24, 5.0).where(tiles.OWN).drop(tiles.SERIES, tiles.ROW, tiles.SIZE, tiles.OF, tiles.OWN)


def serving_features(df: DataFrame, by: str = BY) -> DataFrame:
    """One row a series from its whole history: the newest value, those 24 and 168 back (else the
    first), change, 6 and 24 statistics, trend and growth, with the serving definitions."""
    i, n, v = F.col(tiles.ROW), F.col("n"), F.col("value")
    back = n - i  # 0 for the newest

    def at(place: Column) -> Column:
        return F.max(F.when(place, v))

    rows = tiles.numbered(df, by).withColumn("n", F.col(tiles.SIZE))
    six, day = back < 6, back < 24
    got = rows.groupBy(by, "n").agg(
        at(back == 0).alias("last"),
        at(back == 1).alias("_previous"),
        at(i == 1).alias("_first"),
        at(back == 23).alias("_24"),
        at(back == 167).alias("_168"),
        F.avg(F.when(six, v)).alias("_mean_6"),
        F.stddev_pop(F.when(six, v)).alias("_std_6"),
        F.max(F.when(six, v)).alias("max_6"),
        F.min(F.when(six, v)).alias("min_6"),
        F.avg(F.when(day, v)).alias("_mean_24"),
        F.avg(v).alias("_mean"),
        F.avg(F.when(back < 12, v)).alias("_late"),
        F.avg(F.when(i <= 12, v)).alias("_early"),
    )
    change = F.when(n >= 2, (F.col("last") - F.col("_previous")) / F.greatest(F.col("_previous"), F.lit(1.0))).otherwise(F.lit(0.0))
    growth = F.when(n >= 24, (F.col("_late") - F.col("_early")) / F.greatest(F.col("_early"), F.lit(1.0))).otherwise(F.lit(0.0))
    return got.select(
        by,
        "last",
        F.when(n >= 24, F.col("_24")).otherwise(F.col("_first")).alias("lag_24"),
        F.when(n >= 168, F.col("_168")).otherwise(F.col("_first")).alias("lag_168"),
        change.alias("change"),
        F.when(n >= 6, F.col("_mean_6")).otherwise(F.col("_mean")).alias("mean_6"),
        F.when(n >= 6, F.col("_std_6")).otherwise(F.lit(0.0)).alias("std_6"),
        "max_6",
        "min_6",
        F.when(n >= 24, F.col("_mean_24")).otherwise(F.col("_mean")).alias("mean_24"),
        growth.alias("growth"),
    )


def counter_increase(df: DataFrame, by: str = BY) -> DataFrame:
    """(by, increase): how much each counter has grown; one that falls has started anew."""
    rows = tiles.windowed(df, by, lambda order: [_increments(order)], before=1)
    return rows.groupBy(by).agg(F.sum("_step").alias("increase"))


def sum_by(df: DataFrame, labels: list[str], by: str = BY) -> DataFrame:
    """(by, labels..., total, mean) of samples with a map of labels."""
    keys = [F.element_at("labels", name).alias(name) for name in labels]
    return df.groupBy(by, *keys).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))


def instant(df: DataFrame, at: Column, tie: str, by: str = BY) -> DataFrame:
    """(by, ts, value): the newest sample of each series up to a time."""
    newest = F.max_by(F.struct("ts", "value"), F.struct("ts", tie))
    return df.where(F.col("ts") <= at).groupBy(by).agg(newest.alias("x")).select(by, "x.ts", "x.value")


def first_metadata(df: DataFrame, by: str = BY) -> DataFrame:
    """(by, help): the first entry of each metric by ``seq``."""
    return df.groupBy(by).agg(F.min_by("help", "seq").alias("help"))


def lags_without_history(current: Column) -> dict[str, Column]:
    """What stands for lags where there is no history: shares of the current value."""
    return {"lag_1": current * 0.95, "lag_24": current * 0.9, "lag_168": current * 0.85}


def history_slope(df: DataFrame, by: str = BY) -> DataFrame:
    """(by, slope): the least-squares slope over a series' whole history, by row."""
    numbered = tiles.numbered(df, by).withColumn("_i", (F.col(tiles.ROW) - 1).cast("double"))
    return numbered.groupBy(by).agg(F.regr_slope("value", "_i").alias("slope"))


# Month and day of holidays.
HOLIDAYS = ("0101", "0501", "1001")


def minute_features(ts: Column, holidays: tuple[str, ...] = HOLIDAYS) -> dict[str, Column]:
    """Minute, month, whether a month begins, and whether the day is one of the holidays."""
    return {"minute": F.minute(ts), "month": F.month(ts), "is_month_start": F.dayofmonth(ts) == 1, "is_holiday": F.date_format(ts, "MMdd").isin(*holidays)}
