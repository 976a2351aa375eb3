"""Generated series for trying forecasts: rows are functions of their number and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Level, swing, noise and slope of a mock history.
MOCK = {"qps": (50.0, 50.0, 10.0, 0.0), "cpu": (35.0, 15.0, 5.0, 0.0), "memory": (60.0, 0.0, 3.0, 0.0), "disk": (40.0, 0.0, 1.0, 0.1)}


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) that follows from a key and a salt, alike on every engine with MD5."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + salt))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def normal(key: Column, salt: str) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(key, salt + "a"))) * F.cos(2 * F.pi() * uniform(key, salt + "b"))


def mock_history(spark: SparkSession, kind: str, hours: int, seed: int = 42) -> DataFrame:
    """(i, value): hourly values with a daily swing, noise and drift, not below 0."""
    level, swing, noise, slope = MOCK[kind]
    i = F.col("id")
    value = level + swing * F.sin(2 * F.pi() * (i % 24) / 24) + noise * normal(i, f"{kind}{seed}") + slope * i
    return spark.range(hours).select(i.cast("int").alias("i"), F.greatest(F.lit(0.0), value).alias("value"))


# How busy the hours of a day and the days of a week are.
HOURS = (0.3, 0.25, 0.2, 0.2, 0.25, 0.35, 0.5, 0.7, 0.9, 1.0, 1.05, 1.1, 1.0, 1.05, 1.1, 1.1, 1.05, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4)
DAYS = (1.0, 1.05, 1.1, 1.05, 1.0, 0.7, 0.6)


def year(spark: SparkSession, kind: str, days: int = 365, seed: int = 42, start: str = "2024-01-01") -> DataFrame:
    """(ts, value, instances): hourly rows by the factors of hour and weekday, noise, and spikes of one hour in
    a hundred.  Memory leaks until it is cleaned up each week, disk fills until the same in each month."""
    i = F.col("id")
    ts = F.to_timestamp_ntz(F.lit(start + " 00:00:00")) + F.make_dt_interval(hours=i.cast("int"))
    factor = F.element_at(F.array(*map(F.lit, HOURS)), (i % 24 + 1).cast("int")) * F.element_at(F.array(*map(F.lit, DAYS)), (F.floor(i / 24) % 7 + 1).cast("int"))
    noise, spike = normal(i, f"{kind}{seed}"), uniform(i, f"{kind}{seed}s") < 0.01
    base = {
        "qps": 200 * factor + 10 * noise + F.when(spike, 150).otherwise(0),
        "cpu": 15 + 45 * factor + 4 * noise + F.when(spike, 25).otherwise(0),
        "memory": 35 + 15 * factor + 25 * (i % 168) / 168 + 2 * noise,
        "disk": 20 + 50 * (i % 720) / 720 + 3 * factor + noise,
    }[kind]
    low, high = {"qps": (0.0, 1e6), "cpu": (5.0, 95.0), "memory": (20.0, 90.0), "disk": (15.0, 85.0)}[kind]
    value = F.greatest(F.lit(low), F.least(F.lit(high), base))
    rows = spark.range(days * 24).select(ts.alias("ts"), value.alias("value"))
    return rows.withColumn("instances", F.greatest(F.lit(1), F.least(F.lit(20), F.ceil(F.col("value") / 25).cast("int"))))


def with_target(rows: DataFrame) -> DataFrame:
    """Adds ``target``, the next hour's value; the last row takes the mean.  One series, so one window: a year
    of hours."""
    from pyspark.sql import Window

    whole = Window.partitionBy()
    return rows.withColumn("target", F.coalesce(F.lead("value").over(Window.partitionBy(F.lit(0)).orderBy("ts")), F.avg("value").over(whole)))


def samples(spark: SparkSession, kind: str, n: int = 100, seed: int = 7) -> DataFrame:
    """(i, value): ``n`` uniform values within the range of a kind, for small tests."""
    high = {"qps": 500.0, "cpu": 100.0, "memory": 100.0, "disk": 100.0}[kind]
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (high * uniform(F.col("id"), f"{kind}{seed}")).alias("value"))
