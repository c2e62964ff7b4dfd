"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one aggregate may hold, targets that go to every executor, steps of a round's grid, and its sketch's accuracy.
MOST, BROADCAST_TARGETS, GRID, ACCURACY = 1 << 16, 100_000, 1024, 10_000


def grouped_percentiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], *others: Column) -> DataFrame:
    """One row per group with `others` (aggregates) and the exact percentiles of a value without its nulls, linear between ranks: probs maps their names to shares.

    While no group has more than MOST values, an aggregate holds them all. Else each percentile's place is narrowed down in passes over the
    rows: a sketch of the values between two bounds gives GRID steps, the steps around the wanted rank are the next bounds, and what lies
    below them is counted. As a pass leaves about a three-hundredth, the largest group tells how many are needed; at the end only
    values between the last bounds meet, equal ones as one with their number. A sketch that missed would cost memory, and not change the result.
    """
    keys = [F.col(c) for c in by]
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    if not sizes.n or sizes.n <= MOST:
        return df.groupBy(*keys).agg(*others, *[F.percentile(value, p).alias(name) for name, p in probs.items()])
    rounds = max(1, ceil(log(sizes.n / MOST) / log(300)))
    found = selected(df.select(*by, F.col(value).cast("double").alias("x_")).where("x_ IS NOT NULL"), by, list(probs.values()), rounds, sizes.groups * len(probs) <= BROADCAST_TARGETS)
    rows = df.groupBy(*keys).agg(*others) if others else df.select(*by).distinct()
    named = found.select(*[F.col(c).alias(f"{c}_of_") for c in by], *[F.col(f"v_{k}").alias(name) for k, name in enumerate(probs)])
    return rows.join(named, _same(by, "_of_"), "left").drop(*[f"{c}_of_" for c in by])


def _same(by: Sequence[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}{suffix}")) for c in by], F.lit(True))


def selected(values: DataFrame, by: Sequence[str], probs: Sequence[float], rounds: int, small: bool) -> DataFrame:
    """Columns of `by` and v_0, v_1, ... of the groups of x_, after `rounds` of narrowing. small: the targets (a row per group and share) go to every executor."""
    grid = [k / GRID for k in range(GRID + 1)]
    sketch = lambda x: F.percentile_approx(x, grid, ACCURACY)
    whole = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x_").alias("first"), F.max("x_").alias("last"), sketch(F.col("x_")).alias("steps"))
    shares = F.explode(F.array(*[F.struct(F.lit(k).alias("q"), F.lit(float(p)).alias("p")) for k, p in enumerate(probs)]))
    targets = whole.select("*", shares.alias("t")).select(*by, "n", "first", "last", "steps", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.col("t.q").alias("q"), (F.col("t.p") * (F.col("n") - 1)).alias("at"))
    k0, k1 = F.floor("at"), F.ceil("at")
    for _ in range(rounds):
        # bounds around the two ranks that a percentile lies between
        step = lambda k, more: F.col("steps")[F.least(F.greatest(F.floor((k - F.col("below")) / F.col("inside") * GRID).cast("int") + more, F.lit(0)), F.lit(GRID))]
        low = F.when((k0 < F.col("below")) | (k0 - F.col("below") < F.col("inside") / GRID * 2), F.col("first")).otherwise(step(k0, -1))
        high = F.when(k1 - F.col("below") >= F.col("inside") * (1 - 2 / GRID), F.col("last")).otherwise(step(k1, 2))
        bounds = targets.select(*[F.col(c).alias(f"{c}_of_") for c in by], "n", "q", "at", "first", "last", low.alias("lo"), high.alias("hi"))
        both = values.join(F.broadcast(bounds) if small else bounds, _same(by, "_of_"))
        inner = F.when((F.col("x_") >= F.col("lo")) & (F.col("x_") <= F.col("hi")), F.col("x_"))
        counted = both.groupBy(*by, "q", "n", "at", "first", "last", "lo", "hi").agg(F.count(F.when(F.col("x_") < F.col("lo"), 1)).alias("below"), F.count(inner).alias("inside"), sketch(inner).alias("steps"))
        # ranks outside the bounds: these are widened again
        missed_low, missed_high = k0 < F.col("below"), k1 >= F.col("below") + F.col("inside")
        targets = counted.select(*by, "q", "n", "at", "steps", F.when(missed_low, F.col("first")).otherwise(F.col("lo")).alias("first"), F.when(missed_high, F.col("last")).otherwise(F.col("hi")).alias("last"), F.when(missed_low, 0).otherwise(F.col("below")).alias("below"), F.when(missed_low | missed_high, F.col("n")).otherwise(F.col("inside")).alias("inside"))
    bounds = targets.select(*[F.col(c).alias(f"{c}_of_") for c in by], "q", "at", "first", "last")
    both = values.join(F.broadcast(bounds) if small else bounds, _same(by, "_of_")).where("x_ <= last")
    # those below the bounds are only counted
    counts = both.groupBy(*by, "q", "at", F.when(F.col("x_") >= F.col("first"), F.col("x_")).alias("x_")).agg(F.count(F.lit(1)).alias("c"))
    some = counts.groupBy(*by, "q", "at").agg(F.coalesce(F.max(F.when(F.col("x_").isNull(), F.col("c"))), F.lit(0).cast("long")).alias("below"), F.array_sort(F.collect_list(F.when(F.col("x_").isNotNull(), F.struct("x_", "c")))).alias("all"))

    def at_rank(k: Column) -> Column:
        begin = F.struct(F.col("below").alias("upto"), F.lit(None).cast("double").alias("v"))
        step = lambda s, e: F.struct((s["upto"] + e["c"]).alias("upto"), F.when((s["upto"] <= k) & (k < s["upto"] + e["c"]), e["x_"]).otherwise(s["v"]).alias("v"))
        return F.aggregate("all", begin, step)["v"]

    v0, v1 = at_rank(k0), at_rank(k1)
    picked = some.select(*by, "q", (v0 + (v1 - v0) * (F.col("at") - k0)).alias("v"))
    return picked.groupBy(*by).agg(*[F.max(F.when(F.col("q") == k, F.col("v"))).alias(f"v_{k}") for k in range(len(probs))])
