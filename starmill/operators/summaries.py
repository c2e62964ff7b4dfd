"""After a fit: probabilities of kinds of stars, depths, histograms and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.functions.columns import digitize, flux2mag
from starmill.operators.percentiles import grouped_percentiles
from starmill.operators.tables import row_ids


def star_type_prob(pdf2d: DataFrame, p1: str, p2: str, box1: tuple[float, float], box2: tuple[float, float]) -> DataFrame:
    """star_id and prob: weight of a pair's 2-D table (its parameters in either order) inside a box; null where the pair is missing."""
    here, there = (F.col("p1") == p1) & (F.col("p2") == p2), (F.col("p1") == p2) & (F.col("p2") == p1)
    a, b = F.when(here, F.col("val1")).otherwise(F.col("val2")), F.when(here, F.col("val2")).otherwise(F.col("val1"))
    inside = a.between(*box1) & b.between(*box2)
    prob = F.sum(F.when(here | there, F.when(inside, F.col("p")).otherwise(0.0)))
    return pdf2d.groupBy("star_id").agg(prob.alias("prob"))


def depth(models: DataFrame, bands: Sequence[tuple[str, str]], level: float) -> DataFrame:
    """band and depth: magnitude of the faintest model more complete than `level`; null where the level is outside the completeness met."""
    long = models.select(F.explode(F.array(*[F.struct(F.lit(f).alias("band"), F.col(f).alias("flux"), F.col(c).alias("compl")) for f, c in bands])).alias("e")).select("e.*")
    agg = long.groupBy("band").agg(F.min(F.when(F.col("compl") > level, F.col("flux"))).alias("flux"), F.min("compl").alias("lo"), F.max("compl").alias("hi"))
    return agg.select("band", F.when(F.lit(level).between(F.col("lo"), F.col("hi")), flux2mag(F.col("flux"))).alias("depth"))


def bin_number(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Even bins from lo to hi, the last closed; one value is bin 0."""
    return F.when(hi > lo, F.least(F.floor((x - lo) / ((hi - lo) / n)), F.lit(n - 1))).otherwise(0).cast("int")


def hist2d(df: DataFrame, x: Column, y: Column, n: int = 51, value: Column | None = None) -> DataFrame:
    """bx, by, n (and the mean of a value) over n x n even bins of the ranges of x and y; rows with a null are left out."""
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"), *([value.alias("v")] if value is not None else [])).where("x IS NOT NULL AND y IS NOT NULL")
    ends = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    both = rows.crossJoin(F.broadcast(ends))
    keys = [bin_number(F.col("x"), F.col("x0"), F.col("x1"), n).alias("bx"), bin_number(F.col("y"), F.col("y0"), F.col("y1"), n).alias("by")]
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *([F.avg("v").alias("mean")] if value is not None else []))


def hist1d(df: DataFrame, x: Column, n: int) -> DataFrame:
    """bin and n over n even bins of the range of x."""
    rows = df.select(x.cast("double").alias("x")).where("x IS NOT NULL")
    ends = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return rows.crossJoin(F.broadcast(ends)).groupBy(bin_number(F.col("x"), F.col("x0"), F.col("x1"), n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mag_peak(df: DataFrame, mag: str, n: int, limit: float = 90.0) -> DataFrame:
    """peak: centre of the first fullest of n even bins of the magnitudes below `limit`."""
    rows = df.where(F.col(mag) < limit).select(F.col(mag).alias("x"))
    ends = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(bin_number(F.col("x"), F.col("x0"), F.col("x1"), n).alias("bin"), "x0", "x1").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("m"), (F.col("x0") + (F.col("bin") + 0.5) * (F.col("x1") - F.col("x0")) / n).alias("peak"))).alias("e")).select(F.col("e.peak").alias("peak"), (-F.col("e.m")).alias("n"))


def hdr_levels(pdf: DataFrame, levels: Sequence[float] = (0.68, 0.95, 0.997), by: Sequence[str] = ("star_id", "p1", "p2")) -> DataFrame:
    """Density above which the most likely bins hold each share of a table's weight."""
    w = W.partitionBy(*by)
    rows = pdf.withColumn("share", F.sum("p").over(w.orderBy(F.desc("p"), "bin1", "bin2").rowsBetween(W.unboundedPreceding, 0)) / F.sum("p").over(w))
    return rows.groupBy(*by).agg(*[F.min(F.when(F.col("share") <= q, F.col("p"))).alias(f"level_{k}") for k, q in enumerate(levels)])


def faint_limit(df: DataFrame, mag: str, offset: float = 0.0) -> DataFrame:
    """90th percentile of the detected magnitudes, plus an offset."""
    return grouped_percentiles(df.where(F.col(mag) < 99), [], mag, {"p90": 0.9}, F.count(F.lit(1)).alias("n")).select((F.col("p90") + offset).alias("faint"))


def noise_curves(models: DataFrame, flux: str, bias: str, sigma: str, compl: str, every: int) -> DataFrame:
    """log flux, relative bias and sigma, completeness of every `every`-th model (by id) of positive sigma."""
    rows = row_ids(models.where(F.col(sigma) > 0), ["model_id"], "place").where(F.col("place") % every == 0)
    return rows.select("model_id", F.log10(flux).alias("log_flux"), (F.col(bias) / F.col(flux)).alias("rel_bias"), (F.col(sigma) / F.col(flux)).alias("rel_sigma"), F.col(compl).alias("compl"))


def spread(p16: str, p84: str) -> Column:
    return (F.col(p84) - F.col(p16)) / 2


def region_counts(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """region_x, region_y and rows of square regions."""
    return df.groupBy(F.floor(x / size).cast("int").alias("region_x"), F.floor(y / size).cast("int").alias("region_y")).agg(F.count(F.lit(1)).alias("n"))


def one_star(stats: DataFrame, bands: Sequence[str], quantities: Sequence[str]) -> DataFrame:
    """Long form (star_id, band, quantity, value) of columns <band>_<quantity>."""
    return stats.select("star_id", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(q).alias("quantity"), F.col(f"{b}_{q}").alias("value")) for b in bands for q in quantities])).alias("e")).select("star_id", "e.*")


def flux_hist(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """k (number of edges at or below a value) and share of all rows over 4 units of width, of rows that are few kinds apart."""
    n = df.agg(F.count(F.lit(1)).alias("all"))
    counts = df.groupBy(digitize(F.col(value), list(edges)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(n)).select("k", (F.col("n") / (F.col("all") * float(edges[1] - edges[0]))).alias("share"))


def condense_regions(df: DataFrame, region: Column, value: str) -> DataFrame:
    """region, largest, smallest and n: what a region's gathered values start and end with, and how many they are, without gathering them."""
    return df.groupBy(region.alias("region")).agg(F.max(value).alias("largest"), F.min(value).alias("smallest"), F.count(F.lit(1)).alias("n"))


def colour_magnitude(df: DataFrame, blue: str, red: str, key: str = "star_id") -> DataFrame:
    """Colour blue - red and red magnitude of the rows with positive rates in both bands."""
    good = df.where((F.col(blue) > 0) & (F.col(red) > 0))
    return good.select(key, (flux2mag(F.col(blue)) - flux2mag(F.col(red))).alias("colour"), flux2mag(F.col(red)).alias("mag"))


def positive_in_all(df: DataFrame, rates: Sequence[str], key: str = "star_id") -> DataFrame:
    """Keys of the rows with a positive rate in every band: the intersection of the bands' sets, in one pass."""
    out = df
    for r in rates:
        out = out.where(F.col(r) > 0)
    return out.select(key).distinct()
