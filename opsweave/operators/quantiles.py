"""Exact quantiles of series of any length, by selection in shrinking histograms.

A sketch brackets each wanted rank; every further pass counts the values of the bracket in ``BINS`` bins for each
series and rank and goes on with the bin that holds the rank, until it holds one value only.  A pass shuffles at
most ``BINS`` counts a task, series and rank; no buffer holds a series' values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opsweave.operators.tiles import SERIES, series_of
from opsweave.sources.shared import written

BINS = 1024
#: Accuracy of the sketch: its buffer has about as many entries.
ACCURACY = 2000
#: A pass shrinks a bracket to a bin; doubles leave no room for more passes than this.
MOST_PASSES = 400


def exact_quantiles(df: DataFrame, fractions: dict[str, float], by: str | list[str], value: str = "value", bins: int = BINS, accuracy: int = ACCURACY) -> DataFrame:
    """One row a series with a column for each of ``fractions``, interpolated between neighbouring ranks.

    Nulls and NaN are left out; a series without any other value has no row.
    """
    names = [by] if isinstance(by, str) else by
    rows = written(df.select(series_of(names).alias(SERIES), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")), "values")
    shares = sorted(set(fractions.values()))
    wide = sorted({min(1.0, max(0.0, q + e)) for q in shares for e in (-2 / accuracy, 2 / accuracy)})
    seen = rows.groupBy(SERIES).agg(
        F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.percentile_approx("_v", wide, accuracy).alias("near")
    )
    ranks = []
    for q in shares:
        position = (F.col("n") - 1) * q
        a, b = (wide.index(min(1.0, max(0.0, q + e))) for e in (-2 / accuracy, 2 / accuracy))
        ranks += [F.struct(end(position).cast("long").alias("rank"), F.col("near")[a].alias("lo"), F.col("near")[b].alias("hi")) for end in (F.floor, F.ceil)]
    state = seen.select(SERIES, "n", "low", "high", F.explode(F.array(*ranks)).alias("r")).select(SERIES, "n", "low", "high", "r.rank", "r.lo", "r.hi")
    # Equal ranks share one bracket: the widest.
    state = written(state.groupBy(SERIES, "n", "low", "high", "rank").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "ranks")
    for _ in range(MOST_PASSES):
        if state.where("lo < hi").isEmpty() and _:
            break
        state = written(_narrowed(rows, state, bins, first=not _), "ranks")
    else:
        raise RuntimeError("quantiles did not settle")
    found = F.map_from_entries(F.collect_list(F.struct("rank", "lo")))
    whole = state.groupBy(SERIES, "n").agg(found.alias("_at"))
    out = [F.col(f"{SERIES}.{name}").alias(name) for name in names]
    for name, q in fractions.items():
        position = (F.col("n") - 1) * q
        low, high = F.floor(position), F.ceil(position)
        a, b = F.element_at("_at", low.cast("long")), F.element_at("_at", high.cast("long"))
        out.append(F.when(low == high, a).otherwise((high - position) * a + (position - low) * b).alias(name))
    return whole.select(*out)


def _narrowed(rows: DataFrame, state: DataFrame, bins: int, first: bool) -> DataFrame:
    """Each open bracket's bin that holds its rank.  ``first``: brackets are guesses, values outside are counted too,
    and a guess that does not hold its rank becomes everything on that side."""
    open_ = state if first else state.where("lo < hi")
    joined = rows.join(open_, SERIES)
    share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: no overflow
    inside = F.when(F.col("lo") < F.col("hi"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0)
    bin_ = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), bins).otherwise(inside)
    if not first:
        joined = joined.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    keys = [SERIES, "n", "low", "high", "rank"] + ([] if first else ["below"])
    counts = joined.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("_count"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    order = Window.partitionBy(SERIES, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # bins + 2 rows at most
    before = F.coalesce(F.sum("_count").over(order), F.lit(0)) + (F.lit(0) if first else F.col("below"))
    held = counts.withColumn("_before", before).where((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_count")))
    columns = [SERIES, "n", "low", "high", "rank", "lo", "hi", F.col("_before").cast("long").alias("below")]
    narrowed = held.select(*columns)
    return narrowed if first else narrowed.unionByName(state.where("lo = hi"))
