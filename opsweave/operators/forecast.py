"""Forecasts, scaling plans and costs.  ``now`` is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.operators import folds, tiles

# Fixed values by resource: growth a step, type factor of the confidence, upper bound.
GROWTH = {"qps": 0.02, "cpu": 0.01, "memory": 0.005, "disk": 0.003}
TYPE_FACTOR = {"qps": 0.9, "cpu": 0.85, "memory": 0.95, "disk": 0.98}
UPPER = {"qps": 100_000.0, "cpu": 100.0, "memory": 100.0, "disk": 100.0}
PRICE = {"cpu_cores": 0.02, "memory_gb": 0.005, "disk_gb": 0.0001, "min_instances": 0.04}
MINUTES = {"minute": 1, "hour": 60, "day": 1440}


def _by_kind(kind: Column, table: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for name, value in table.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def clip_range(value: Column, kind: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(_by_kind(kind, UPPER, float("inf")), value))


def points(hours: int, granularity: str) -> int:
    return {"minute": min(hours * 60, 1440), "hour": hours, "day": hours // 24}[granularity]


def confidence(predicted: Column, current: Column, kind: Column, step: Column) -> Column:
    """Decays a hundredth a step to 0.5, times a factor for the change and one for the kind."""
    decay = F.greatest(F.lit(0.5), 0.95 - step * 0.01)
    change = F.when(current > 0, F.greatest(F.lit(0.6), 1 - F.abs(predicted - current) / current * 0.5)).otherwise(0.8)
    return decay * change * _by_kind(kind, TYPE_FACTOR, 0.9)


def interval(value: Column, level: Column) -> tuple[Column, Column]:
    half = value * (1 - level) * 0.5
    return F.greatest(F.lit(0.0), value - half), value + half


def rule_forecast(series: DataFrame, now: str, hours: int = 24, granularity: str = "hour", sigma: float = 0.0, seed: int = 7) -> DataFrame:
    """Linear growth with a daily factor, in closed form: every series times ``points`` rows.

    ``series`` has (kind, current) and any keys; ``sigma`` is the noise as a share of the value.
    """
    return rule_points(series.withColumn("_now", F.lit(now).cast("timestamp_ntz")), "_now", points(hours, granularity), granularity, sigma, seed)


def rule_points(series: DataFrame, now: str, n: int, granularity: str, sigma: float = 0.0, seed: int = 7) -> DataFrame:
    """``rule_forecast`` for ``n`` points after the time in the column ``now``, which goes."""
    step = MINUTES[granularity]
    rows = series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))) if n > 0 else F.explode(F.array().cast("array<int>")))
    rows = rows.withColumn("ts", F.col(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("step") * step)).drop(now)
    hour, day = F.hour("ts"), F.weekday("ts")
    factor = F.when((hour >= 9) & (hour <= 18) & (day < 5), 1.2).when(hour < 6, 0.6).otherwise(1.0)
    raw = F.col("current") * (1 + _by_kind(F.col("kind"), GROWTH, 0.01) * F.col("step")) * factor
    if sigma:
        raw = raw + F.randn(seed) * F.col("current") * sigma
    value = clip_range(raw, F.col("kind"))
    rows = rows.withColumn("predicted", value).withColumn("confidence", F.greatest(F.lit(0.5), 0.95 - (F.col("step") - 1) * 0.01))
    low, high = interval(F.col("predicted"), F.col("confidence"))
    return rows.withColumns({"low": low, "high": high})


def action(value: Column, kind: Column, target: float = 0.7) -> Column:
    """scale_up, scale_down or maintain."""
    up = F.when(kind == "qps", 1000.0).otherwise(target * 100 + 10)
    down = F.when(kind == "qps", 200.0).otherwise(target * 100 - 20)
    return F.when(value > up, "scale_up").when(value < down, "scale_down").otherwise("maintain")


def target_instances(value: Column, act: Column, target: float = 0.7, least: int = 1, most: int = 20) -> Column:
    capacity = max(1.0, 500.0 * min(0.9, max(0.1, target)))
    base = F.ceil(value / capacity)
    wanted = F.when(act == "scale_up", F.ceil(base * 1.2)).when(act == "scale_down", F.ceil(F.greatest(F.lit(1.0), base * 0.8))).otherwise(base)
    return F.greatest(F.lit(least), F.least(F.lit(most), wanted)).cast("int")


def _resized(use: Column, size: float, high: float, low: float, aim: float, least: float) -> Column:
    return F.when(use > high, size * (use / aim)).when(use < low, F.greatest(F.lit(least), size * (use / aim))).otherwise(F.lit(size))


def target_resource(value: Column, act: Column, kind: Column) -> Column:
    """Cores, or GB of memory or disk; null for qps."""
    use = F.when(act == "scale_up", value * 1.5).when(act == "scale_down", value * F.when(kind == "disk", 0.8).otherwise(0.7)).otherwise(value)
    return F.when(kind == "cpu", _resized(use, 4.0, 80, 30, 60, 1.0)).when(kind == "memory", _resized(use, 8.0, 85, 40, 70, 2.0)).when(kind == "disk", _resized(use, 100.0, 90, 50, 75, 50.0))


def recommendation_confidence(level: Column, act: Column) -> Column:
    base = F.coalesce(level, F.lit(0.8))
    return F.when(act == "scale_up", F.least(F.lit(1.0), base * 1.1)).when(act == "scale_down", base * 0.9).otherwise(base)


def cost_change(act: Column, instances: Column) -> Column:
    """Estimated change of cost in percent."""
    up = F.when(instances.isNotNull(), 20.0 + (instances - 1) * 5).otherwise(30.0)
    down = F.when(instances.isNotNull(), -10.0 - 10.0 / F.greatest(F.lit(1), instances)).otherwise(-20.0)
    return F.when(act == "scale_up", up).when(act == "scale_down", down).otherwise(0.0)


def fixed(value: Column, digits: int) -> Column:
    """``value`` with no digit or one, by the double's exact value and halves to even, as C and DuckDB print it.  Java's
    format rounds the shortest decimal instead, and halves up."""
    size, scale, bits = F.abs(value), 10**digits, 58  # what 58 bits lose of a fraction is far below a half
    whole = F.floor(size)
    units = ((size - whole) * float(1 << bits)).cast("long") * scale
    number, rest, half = whole * scale + F.shiftright(units, bits), units.bitwiseAND((1 << bits) - 1), 1 << (bits - 1)
    number = number + ((rest > half) | (rest == half) & (number % 2 == 1)).cast("long")
    tail = F.concat(F.lit("."), (number % scale).cast("string")) if digits else F.lit("")
    text = F.concat(F.when(value < 0, "-").otherwise(""), ((number - number % scale) / scale).cast("long").cast("string"), tail)
    return F.when(size < float(1 << 48), text).when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def reason(act: Column, kind: Column, value: Column, instances: Column) -> Column:
    name, whole, tenth = F.upper(kind), fixed(value, 0), fixed(value, 1)
    up = F.when(kind == "qps", F.concat(name, F.lit("预测值("), whole, F.lit(")超过阈值，建议扩容至"), instances.cast("string"), F.lit("个实例"))).otherwise(F.concat(name, F.lit("利用率预测值("), tenth, F.lit("%)过高，建议增加资源")))
    down = F.when(kind == "qps", F.concat(name, F.lit("预测值("), whole, F.lit(")低于阈值，可以缩容至"), instances.cast("string"), F.lit("个实例"))).otherwise(F.concat(name, F.lit("利用率预测值("), tenth, F.lit("%)较低，可以减少资源节省成本")))
    return F.when(act == "scale_up", up).when(act == "scale_down", down).otherwise(F.concat(name, F.lit("预测值("), tenth, F.lit(")在正常范围内，维持当前配置")))


def scaling_plan(forecast: DataFrame, target: float = 0.7) -> DataFrame:
    """Every forecast point with its action, targets, confidence and cost change."""
    act, kind, value = F.col("action"), F.col("kind"), F.col("predicted")
    planned = forecast.withColumn("action", action(value, kind, target))
    instances = F.when(kind == "qps", target_instances(value, act, target))
    return planned.withColumns({"instances": instances, "resource": target_resource(value, act, kind), "plan_confidence": recommendation_confidence(F.col("confidence"), act)}).withColumn(
        "cost_change", cost_change(act, F.col("instances"))
    )


_ORDER = ("action", "instances")


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    plain = rows.where("ts is not null").select(by, F.col("ts").cast("timestamp_ntz").alias("ts"), "action", F.col("instances").cast("int").alias("instances"))
    return tiles.numbered(plain, by, tie=_ORDER)


def apply_cooldown(plan: DataFrame, by: str, minutes: float = 5.0) -> DataFrame:
    """Actions at least ``minutes`` after the last accepted one of their series; rows without time are left out.

    Each action's next possible one is a search in time; which are accepted follows by pointer jumping.
    """
    rows = _numbered(plan.where("action <> 'maintain'"), by)
    pointed = folds.first_from(rows, folds.micros("ts") + int(minutes * 60e6))
    return folds.accepted(pointed).where(folds.ANCHOR).select(by, "ts", "action", "instances")


def merge_recommendations(recs: DataFrame, by: str, seconds: int = 3600) -> DataFrame:
    """Greedy merge: following recommendations of the same action within ``seconds`` of the anchor
    join it, with the most instances of all.

    An anchor's next one is the next change of action or the first row that is too late, whichever comes first.
    """
    rows = folds.next_change(_numbered(recs, by), "action", "_change")
    late = (F.floor(folds.micros("ts") / 1_000_000) + seconds + 1) * 1_000_000
    pointed = folds.first_from(rows, late).withColumn(folds.NEXT, F.least(folds.NEXT, "_change")).drop("_change")
    joined = folds.anchor_of(folds.accepted(pointed), "_of")
    anchor = F.col(folds.ANCHOR)
    merged = joined.groupBy(tiles.SERIES, "_of").agg(
        *[F.max(F.when(anchor, F.col(c))).alias(c) for c in (by, "ts", "action")], F.max("instances").alias("instances")
    )
    return merged.select(by, "ts", "action", "instances")


def first_match(points_: DataFrame, recs: DataFrame, by: str, seconds: int = 3600) -> DataFrame:
    """For each point the first recommendation, in their order, within ``seconds``; left join.

    Both sides are cut into buckets of the join's width, and a recommendation stands in the three
    buckets around it: an equi-join on bucket, then the exact test, and no pairs far apart.
    """
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    left = points_.withColumn("_b", bucket)
    right = recs.select(by, F.col("ts").alias("rec_ts"), "action", "instances", F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_b"))
    near = F.abs(F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("rec_ts").cast("timestamp"))) <= seconds
    pairs = left.join(right, [by, "_b"], "left").withColumn("_ok", F.coalesce(near, F.lit(False)))
    best = F.min(F.when(F.col("_ok"), F.struct("rec_ts", "action", "instances")))
    return pairs.groupBy(by, "ts", *[c for c in points_.columns if c not in (by, "ts")]).agg(best.alias("_r")).select(*points_.columns, F.col("_r.rec_ts").alias("rec_ts"), F.col("_r.action").alias("action"), F.col("_r.instances").alias("instances"))


def current_cost(constraints: dict[str, float]) -> float:
    """An hour's cost: as given, else from quantities, at least 0.1."""
    if constraints.get("cost_per_hour"):
        return constraints["cost_per_hour"]
    return sum(constraints.get(k, 0) * p for k, p in PRICE.items()) or 0.1


def adjusted_cost(base: float, act: Column, instances: Column) -> Column:
    up = F.when(instances > 0, base * (1 + 0.2 * instances)).otherwise(base * 1.3)
    down = F.when(instances > 0, base * (0.7 + 0.05 * instances)).otherwise(base * 0.7)
    return F.when(act == "scale_up", up).when(act == "scale_down", down).otherwise(F.lit(base))


def cost_summary(matched: DataFrame, base: float, by: str) -> DataFrame:
    """Predicted cost, savings, first peak and low, volatility and direction of each series."""
    order = Window.partitionBy(by).orderBy("ts")
    costed = matched.withColumns({"cost": adjusted_cost(base, F.col("action"), F.col("instances")), "_i": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(by))})
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    out = costed.groupBy(by).agg(
        F.avg("cost").alias("predicted_cost"),
        F.max_by("ts", F.struct("cost", -F.col("_i"))).alias("peak_ts"),
        F.min_by("ts", F.struct("cost", "_i")).alias("low_ts"),
        (F.stddev_pop("cost") / F.avg("cost")).alias("volatility"),
        F.avg(F.when(early, F.col("cost"))).alias("_a"),
        F.avg(F.when(~early, F.col("cost"))).alias("_b"),
        F.countDistinct(F.when(F.col("action") == "scale_down", F.col("rec_ts"))).alias("_down"),
    )
    savings = (base - F.col("predicted_cost")) / base * 100 + F.least(F.col("_down") * 5, F.lit(30))
    direction = F.when(F.col("_b") > F.col("_a") * 1.1, "increasing").when(F.col("_b") < F.col("_a") * 0.9, "decreasing").otherwise("stable")
    return out.select(by, "predicted_cost", F.greatest(F.lit(-50.0), F.least(F.lit(50.0), savings)).alias("savings"), "peak_ts", "low_ts", "volatility", direction.alias("direction"))


def optimisation_flags(forecast: DataFrame, plan: DataFrame, by: str) -> DataFrame:
    """Stable or volatile load, a daily pattern, frequent scaling and lasting surplus, a row a series."""
    hour = F.hour("ts")
    load = forecast.groupBy(by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.try_divide(F.stddev_pop("predicted"), F.avg("predicted")), F.lit(0.0)).alias("cv"),
        F.avg(F.when((hour >= 9) & (hour <= 17), F.col("predicted"))).alias("_w"),
        F.avg(F.when((hour < 9) | (hour > 17), F.col("predicted"))).alias("_o"),
    )
    # Runs of one action: equal differences of two row numbers.
    every, same = Window.partitionBy(by).orderBy("ts"), Window.partitionBy(by, "action").orderBy("ts")
    acts = plan.where("action <> 'maintain'").withColumn("_g", F.row_number().over(every) - F.row_number().over(same))
    runs = acts.groupBy(by, "action", "_g").agg(F.count("*").alias("_len"))
    acted = runs.groupBy(by).agg(
        F.sum("_len").alias("_recs"), F.max(F.when(F.col("action") == "scale_down", F.col("_len")).otherwise(0)).alias("longest_down"), F.sum(F.when(F.col("action") == "scale_down", F.col("_len")).otherwise(0)).alias("_down")
    )
    out = load.join(acted, by, "left").na.fill(0, ["_recs", "longest_down", "_down"])
    return out.select(
        by,
        (F.col("_recs") > F.col("n") * 0.3).alias("frequent_scaling"),
        (F.col("longest_down") >= 3).alias("lasting_surplus"),
        (F.col("cv") < 0.1).alias("stable_load"),
        (F.col("cv") > 0.5).alias("volatile_load"),
        (F.col("_down") / F.greatest(F.lit(1), F.col("_recs")) > 0.3).alias("spot_capacity"),
        F.coalesce((F.col("n") >= 24) & (F.abs(F.col("_w") - F.col("_o")) / F.greatest("_w", "_o") > 0.3), F.lit(False)).alias("daily_pattern"),
    )


def reconcile(current: DataFrame) -> DataFrame:
    """Replica changes to make: recommended at least 1, only where it differs from what runs."""
    wanted = current.withColumn("wanted", F.when(F.col("recommended") >= 1, F.col("recommended")).otherwise(1))
    return wanted.where(~F.col("replicas").eqNullSafe(F.col("wanted")))
