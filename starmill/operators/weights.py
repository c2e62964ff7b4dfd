"""Weights of grid points: bin widths, and priors for each axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.functions.priors import prior


def bin_boundaries(axis: DataFrame, x: str, by: Sequence[str] = (), noneg: bool = False) -> DataFrame:
    """lo and hi of the bin around each distinct value: midpoints, mirrored at the ends; noneg: a negative lowest edge is half the value."""
    w = W.partitionBy(*by).orderBy(x)
    v = axis.select(*by, x).distinct().select(*by, x, F.lag(x).over(w).alias("before"), F.lead(x).over(w).alias("after"))
    down = F.coalesce((F.col(x) - F.col("before")) / 2, (F.col("after") - F.col(x)) / 2)
    up = F.coalesce((F.col("after") - F.col(x)) / 2, (F.col(x) - F.col("before")) / 2)
    lo = F.col(x) - down
    return v.select(*by, x, F.when(F.lit(noneg) & (lo < 0), F.col(x) / 2).otherwise(lo).alias("lo"), (F.col(x) + up).alias("hi"))


def grid_weight(axis: DataFrame, x: str, by: Sequence[str] = (), log: bool = False) -> DataFrame:
    """Width of the bin around each distinct value over the mean width (log: of 10 to the bin's ends). A single value has weight 0."""
    edges = bin_boundaries(axis, x, by)
    end = lambda c: F.pow(F.lit(10.0), F.col(c)) if log else F.col(c)
    wide = edges.select(*by, x, (end("hi") - end("lo")).alias("wide"))
    return wide.select(*by, x, F.coalesce(F.col("wide") / F.avg("wide").over(W.partitionBy(*by)), F.lit(0.0)).alias("grid_weight"))


def prior_column(axis: Sequence[float], x: str, parameter: str, name: str, **how) -> Column:
    """A prior over a short axis as a lookup: axis holds its values, sorted."""
    table = prior(parameter, name, axis, **how)
    out = F.lit(None).cast("double")
    for v, p in zip(axis, table, strict=True):
        out = F.when(F.col(x) == float(v), F.lit(float(p))).otherwise(out)
    return out


def age_mass_weights(models: DataFrame, by: Sequence[str], age: str = "log_a", mass: str = "m_ini", age_prior: Column | None = None, mass_prior: Column | None = None) -> DataFrame:
    """Adds grid_weight, prior_weight and weight: the age's bin widths within `by` times the masses' within each age (a single mass has 0)."""
    ages = grid_weight(models, age, by, log=True).withColumnRenamed("grid_weight", "age_w")
    masses = grid_weight(models, mass, [*by, age]).withColumnRenamed("grid_weight", "mass_w")
    rows = models.join(ages, [*by, age]).join(masses, [*by, age, mass])
    rows = rows.withColumn("grid_weight", F.col("age_w") * F.col("mass_w")).withColumn("prior_weight", (age_prior if age_prior is not None else F.lit(1.0)) * (mass_prior if mass_prior is not None else F.lit(1.0)))
    return rows.withColumn("weight", F.col("grid_weight") * F.col("prior_weight")).drop("age_w", "mass_w")


def slice_weights(models: DataFrame, axis: str, by: Sequence[str] = (), prior_values: Column | None = None, compat: bool = False) -> DataFrame:
    """Multiplies weight by the normalised grid x prior weight of each slice of `axis` (a metallicity, a distance) and divides it by the slice's share of all weight (compat: multiplies)."""
    g = grid_weight(models, axis, by).withColumnRenamed("grid_weight", "axis_w")
    rows = models.join(g, [*by, axis]).withColumn("axis_w", F.col("axis_w") * (prior_values if prior_values is not None else F.lit(1.0)))
    share = F.sum("weight").over(W.partitionBy(*by, axis)) / F.sum("weight").over(W.partitionBy(*by))
    total = rows.select(*by, axis, "axis_w").distinct().groupBy(*by).agg(F.avg("axis_w").alias("axis_mean"))
    rows = rows.join(F.broadcast(total), list(by)) if by else rows.crossJoin(F.broadcast(total))
    factor = F.col("axis_w") / F.col("axis_mean")
    return rows.withColumn("weight", F.when(share > 0, F.col("weight") * factor * (share if compat else 1 / share)).otherwise(0.0)).drop("axis_w", "axis_mean")
