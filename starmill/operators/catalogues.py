"""Catalogue work: cuts, dropped bands, and splitting by density, flux or size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.functions.columns import total
from starmill.operators.tables import row_ids


def cut_catalog(df: DataFrame, rates: Sequence[str], flag_filters: Sequence[str] = ()) -> DataFrame:
    """Without rows that have a rate of 0 in some bands but not in all, and without those with 0 in a named one."""
    zeros = total([F.when(F.col(r) == 0, 1).otherwise(0) for r in rates])
    out = df.where((zeros == 0) | (zeros == len(rates)))
    for f in flag_filters:
        out = out.where(F.col(f) != 0)
    return out


def mag_limits(df: DataFrame, mags: Sequence[str], bright: Sequence[float], faint: Sequence[float], least: int) -> DataFrame:
    """Rows with `least` bands or more strictly between their limits."""
    inside = total([F.when((F.col(m) > b) & (F.col(m) < f), 1).otherwise(0) for m, b, f in zip(mags, bright, faint, strict=True)])
    return df.where(inside >= least)


def color_cut(df: DataFrame, windows: dict[str, tuple[float, float]], blue: str, red: str, limit: float) -> DataFrame:
    out = df.where(F.col(blue) - F.col(red) <= limit)
    for m, (lo, hi) in windows.items():
        out = out.where(F.col(m).between(lo, hi))
    return out


def remove_bands(models: DataFrame, array: str, bands: Sequence[str], drop: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """An array column without the bands of the given names (full, or the last part of a full name where that is clear), and the bands left."""
    short = [b.split("_")[-1].lower() for b in bands]
    gone = set()
    for d in drop:
        full = [i for i, b in enumerate(bands) if b.lower() == d.lower()]
        found = full or [i for i, s in enumerate(short) if s == d.lower()]
        if len(found) != 1:
            raise ValueError(f"{d} names {len(found)} bands")
        gone.add(found[0])
    keep = [i for i in range(len(bands)) if i not in gone]
    return models.withColumn(array, F.filter(array, lambda _, i: i.isin(keep))), [bands[i] for i in keep]


def remove_band_columns(df: DataFrame, bands: Sequence[str], drop: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A catalogue without the columns of the given bands (named as in remove_bands), and the bands left. A band's columns begin with its name, full or short, and an underscore, in either case."""
    _, left = remove_bands(df.select(F.array(*[F.lit(0)] * len(bands)).alias("x")), "x", bands, drop)
    starts = tuple(f"{name}_" for b in bands if b not in left for name in (b.lower(), b.split("_")[-1].lower()))
    return df.drop(*[c for c in df.columns if c.lower().startswith(starts)]), left


def chunks(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], size: int) -> DataFrame:
    """Adds `sub`: pieces of `size` rows in an order within `by`; without `by` by ranges of the order (columns), so no task has all rows."""
    if not by:
        return row_ids(df, order, "place_of").withColumn("sub", F.floor(F.col("place_of") / size).cast("int")).drop("place_of")
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("sub", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def even_chunks(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """Adds `sub`: as few pieces of at most `most` rows as do, all of nearly one size."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    size = F.ceil(n / F.ceil(n / most))
    return df.withColumn("sub", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / size).cast("int"))


def density_bins(df: DataFrame, density: str, width: float) -> DataFrame:
    return df.withColumn("sd_bin", F.floor(F.col(density) / width).cast("int"))


def progress(stats: DataFrame, catalog: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per part: rows, fitted ones (pmax not 0), and `state`: done, resume or run."""
    done = stats.groupBy(*by).agg(F.count(F.when(F.col("pmax") != 0, 1)).alias("fitted"))
    out = catalog.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(done, list(by), "left").withColumn("fitted", F.coalesce("fitted", F.lit(0)))
    return out.withColumn("state", F.when(F.col("fitted") >= F.col("n"), "done").when(F.col("fitted") > 0, "resume").otherwise("run"))


def filter_tracks(tracks: DataFrame, order: str = "eep", first: float = 5, luminosity: str = "log_l", least: float = 0.3) -> DataFrame:
    """Without the points before the main sequence (an order below `first`) and the unphysical ones (a luminosity below `least`)."""
    return tracks.where(~((F.col(order) < first) | (F.col(luminosity) < least)))


def region_subset(df: DataFrame, windows: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside a window of each column, ends included."""
    for c, (lo, hi) in windows.items():
        df = df.where(F.col(c).between(lo, hi))
    return df


def threshold_subset(df: DataFrame, column: str, threshold: float, above: bool = True) -> DataFrame:
    """Rows whose column is above (or below) a threshold."""
    return df.where(F.col(column) > threshold if above else F.col(column) < threshold)
