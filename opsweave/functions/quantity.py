"""Column functions over quantities, durations and validated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cpu_cores(text: Column) -> Column:
    """``250m``, ``1500000n``, ``7u`` or plain cores; 0 for anything else."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)([num]?)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*([0-9.]+)([num]?)\s*$", 2)
    scale = F.when(unit == "n", 1e9).when(unit == "u", 1e6).when(unit == "m", 1e3).otherwise(1.0)
    return F.coalesce(number / scale, F.lit(0.0))


MEMORY_UNITS = {"Ki": 2**10, "Mi": 2**20, "Gi": 2**30, "Ti": 2**40, "k": 10**3, "M": 10**6, "G": 10**9, "T": 10**12}


def memory_bytes(text: Column) -> Column:
    """Binary and decimal suffixes or plain bytes, truncated; 0 for anything else."""
    pattern = r"^\s*([0-9.]+)(Ki|Mi|Gi|Ti|k|M|G|T)?\s*$"
    unit = F.regexp_extract(text, pattern, 2)
    scale = F.lit(1)
    for name, size in MEMORY_UNITS.items():
        scale = F.when(unit == name, F.lit(size)).otherwise(scale)
    return F.coalesce((F.regexp_extract(text, pattern, 1).try_cast("double") * scale).cast("long"), F.lit(0))


def age(seconds: Column) -> Column:
    """``XdYh``, ``XhYm`` or ``Xm``."""
    minutes = F.floor(seconds / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d"), (hours % 24).cast("string"), F.lit("h")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), (minutes % 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    )


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    return F.when(seconds < 60, F.format_string("%.1f秒", seconds)).when(seconds < 3600, F.format_string("%.1f分钟", seconds / 60)).otherwise(F.format_string("%.1f小时", seconds / 3600))


def valid_name(text: Column, most: int = 253) -> Column:
    return F.rlike(text, F.lit(r"^[a-z0-9]([-a-z0-9]*[a-z0-9])?$")) & (F.length(text) <= most)


def valid_metric_name(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^[a-zA-Z_:][a-zA-Z0-9_:]*$"))


def round_places(value: Column, places: int = 4) -> Column:
    return F.round(value, places)


def valid_namespace(text: Column) -> Column:
    return valid_name(text, 63)


def within(value: Column, low: float, high: float) -> Column:
    """Whether a number is there and within both bounds."""
    return F.coalesce(value.between(low, high), F.lit(False))


# Bounds of a forecast request's fields.
REQUEST_BOUNDS = {"hours": (1, 168), "qps": (0, 100_000), "percent": (0, 100), "target_utilization": (0.1, 0.9), "sensitivity": (0.1, 1.0), "confidence": (0, 1)}


def valid_request(field: str, value: Column) -> Column:
    return within(value, *REQUEST_BOUNDS[field])


def valid_range(start: Column, end: Column, now: Column, most_minutes: int = 1440) -> Column:
    """Whether a time range begins before its end, is no longer than allowed and not in the future."""
    length = (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60
    return F.coalesce((start < end) & (length <= most_minutes) & (end <= now), F.lit(False))


def iso_time(text: Column) -> Column:
    """A time of an ISO text, with ``Z`` or an offset; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def label_text(labels: Column) -> Column:
    """``k:v|k:v`` of a map, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws(":", e["key"], e["value"])), "|")


# Prices an hour of a core, a gigabyte of memory and of disk, and of instances.
PRICES = {"cpu": 0.02, "memory": 0.005, "disk": 0.0001, "instance": 0.04}
INSTANCES = (("small", 1, 2), ("medium", 2, 4), ("large", 4, 8), ("xlarge", 8, 16))


def current_cost(cost: Column, cpu: Column, memory: Column, disk: Column, instances: Column) -> Column:
    """The cost an hour that is given, else that of the resources, at least 0.1."""
    parts = PRICES["cpu"] * F.coalesce(cpu, F.lit(0.0)) + PRICES["memory"] * F.coalesce(memory, F.lit(0.0)) + PRICES["disk"] * F.coalesce(disk, F.lit(0.0)) + PRICES["instance"] * F.coalesce(instances, F.lit(0.0))
    return F.coalesce(cost, F.greatest(parts, F.lit(0.1)))


def return_on(investment: Column, savings: Column, hours: Column) -> Column:
    """Percent that savings an hour bring over an investment; 0 without one."""
    return F.when(investment == 0, 0.0).otherwise((savings * hours - investment) / investment * 100)


def instance_type(cpu: Column, memory: Column) -> Column:
    """The smallest kind of instance with the cores and gigabytes; the largest where none has."""
    out = F.lit(INSTANCES[-1][0])
    for name, cores, gigabytes in reversed(INSTANCES[:-1]):
        out = F.when((cpu <= cores) & (memory <= gigabytes), name).otherwise(out)
    return out


def sanitised(text: Column, most: int = 1000) -> Column:
    """Without angle brackets, ampersands and quotes, at most ``most`` characters."""
    return F.substring(F.regexp_replace(text, "[<>&\"']", ""), 1, most)


# How many base units a unit is.
LENGTH = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254}
STORAGE = {"b": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3, "tb": 1024.0**4}
TIME = {"s": 1.0, "min": 60.0, "h": 3600.0, "day": 86400.0}
WEIGHT = {"kg": 1.0, "g": 0.001, "lb": 0.453592}


def convert(value: Column, source: str, target: str) -> Column:
    """A value in another unit of its kind, rounded to six places; null for units of unlike kinds."""
    if {source, target} <= {"c", "f", "k"}:
        celsius = {"c": value, "f": (value - 32) * 5 / 9, "k": value - 273.15}[source]
        return F.round({"c": celsius, "f": celsius * 9 / 5 + 32, "k": celsius + 273.15}[target], 6)
    for units in (LENGTH, STORAGE, TIME, WEIGHT):
        if source in units and target in units:
            return F.round(value * units[source] / units[target], 6)
    return F.lit(None).cast("double")


# What one unit is in others.  Only these pairs convert, so a unit may be a target and no source.
FACTORS = {
    "length": {
        "m": {"m": 1, "cm": 100, "mm": 1000, "km": 0.001, "ft": 3.28084, "in": 39.3701, "yd": 1.09361},
        "cm": {"m": 0.01, "cm": 1, "mm": 10, "km": 0.00001, "ft": 0.0328084, "in": 0.393701, "yd": 0.0109361},
        "ft": {"m": 0.3048, "cm": 30.48, "mm": 304.8, "km": 0.0003048, "ft": 1, "in": 12, "yd": 0.333333},
    },
    "weight": {
        "kg": {"kg": 1, "g": 1000, "mg": 1000000, "lb": 2.20462, "oz": 35.274},
        "g": {"kg": 0.001, "g": 1, "mg": 1000, "lb": 0.00220462, "oz": 0.035274},
        "lb": {"kg": 0.453592, "g": 453.592, "mg": 453592, "lb": 1, "oz": 16},
    },
    "storage": {
        "b": {"b": 1, "kb": 0.0009765625, "mb": 0.000000953674, "gb": 0.000000000931323, "tb": 0.000000000000909495},
        "kb": {"b": 1024, "kb": 1, "mb": 0.0009765625, "gb": 0.000000953674, "tb": 0.000000000931323},
        "mb": {"b": 1048576, "kb": 1024, "mb": 1, "gb": 0.0009765625, "tb": 0.000000953674},
        "gb": {"b": 1073741824, "kb": 1048576, "mb": 1024, "gb": 1, "tb": 0.0009765625},
    },
    "time": {
        "s": {"s": 1, "min": 1 / 60, "h": 1 / 3600, "day": 1 / 86400, "ms": 1000, "us": 1000000},
        "min": {"s": 60, "min": 1, "h": 1 / 60, "day": 1 / 1440, "ms": 60000, "us": 60000000},
        "h": {"s": 3600, "min": 60, "h": 1, "day": 1 / 24, "ms": 3600000, "us": 3600000000},
    },
}
TEMPERATURES = ("c", "f", "k")


def unit_pairs() -> list[tuple[str, str, str, float, float, float]]:
    """(category, source, target, less, factor, plus) of every pair: (value - less) * factor + plus."""
    pairs = [(kind, a, b, 0.0, float(x), 0.0) for kind, units in FACTORS.items() for a, targets in units.items() for b, x in targets.items()]
    freezing, degree = {"c": 0.0, "f": 32.0, "k": 273.15}, {"c": 1.0, "f": 1.8, "k": 1.0}
    return pairs + [("temperature", a, b, freezing[a], degree[b] / degree[a], freezing[b]) for a in TEMPERATURES for b in TEMPERATURES]


def convert_rows(df: DataFrame, value: str, category: str, source: str, target: str) -> DataFrame:
    """Adds ``converted``, each row's value in its own target unit, rounded to six places; units in any case.  A
    pair that is not in the table, and a null, give null.  The table has some hundred rows and is broadcast."""
    table = df.sparkSession.createDataFrame(unit_pairs(), "_kind string, _from string, _to string, _less double, _factor double, _plus double")
    same = (F.col(category) == F.col("_kind")) & (F.lower(source) == F.col("_from")) & (F.lower(target) == F.col("_to"))
    joined = df.join(F.broadcast(table), same, "left")
    return joined.withColumn("converted", F.round((F.col(value).cast("double") - F.col("_less")) * F.col("_factor") + F.col("_plus"), 6)).drop("_kind", "_from", "_to", "_less", "_factor", "_plus")
