"""Pruning models that no star of a catalogue can match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.operators.fit import BANDS, Bands


def ranges(stars: DataFrame, by: tuple[str, ...] = (), bands: Bands = BANDS) -> DataFrame:
    """Least and largest flux of each band (lo_k, hi_k), of each part if `by` is given."""
    return stars.groupBy(*by).agg(*[f(b).alias(f"{n}_{k}") for k, b in enumerate(bands.flux) for n, f in (("lo", F.min), ("hi", F.max))])


def overlaps(k: int, factor: float, bands: Bands = BANDS) -> Column:
    centre, reach = F.col(bands.flux[k]) + F.col(bands.bias[k]), factor * F.abs(bands.sigma[k])
    return (centre + reach >= F.col(f"lo_{k}")) & (centre - reach <= F.col(f"hi_{k}"))


def trim_models(models: DataFrame, stars: DataFrame, factor: float = 3.0, strict: bool = False, bands: Bands = BANDS) -> DataFrame:
    """Models complete in all bands whose flux + bias, within factor sigmas, meets the stars' range in each band.

    Bands count one after the other; one that would leave no model is passed over (strict: an error). Adds fullgrid_idx, the
    model_id. The ranges are one row, which goes to every executor; which bands count is told by one pass that counts the models by the bands they meet.
    """
    rows = models.where(" AND ".join(f"{c} > 0" for c in bands.complete)).crossJoin(F.broadcast(ranges(stars, bands=bands)))
    n = range(len(bands.flux))
    met = rows.groupBy(*[overlaps(k, factor, bands).alias(f"met_{k}") for k in n]).agg(F.count(F.lit(1)).alias("models")).collect()  # 2 ** bands rows at most
    for k in n:
        kept = [r for r in met if r[f"met_{k}"]]
        if kept:
            met, rows = kept, rows.where(overlaps(k, factor, bands))
        elif strict:
            raise ValueError(f"band {bands.flux[k]} leaves no model")
    return rows.select(*models.columns, F.col("model_id").alias("fullgrid_idx"))


def trim_many(models: DataFrame, stars: DataFrame, by: tuple[str, ...], factor: float = 3.0, bands: Bands = BANDS) -> DataFrame:
    """trim_models() for each part of a catalogue with one read of the models: a range join with one row per part. Bands that match nothing leave nothing."""
    parts = ranges(stars, by, bands)
    condition = overlaps(0, factor, bands)
    for k in range(1, len(bands.flux)):
        condition = condition & overlaps(k, factor, bands)
    some = models.where(" AND ".join(f"{c} > 0" for c in bands.complete))
    return some.join(parts, condition).select(*by, *models.columns, F.col("model_id").alias("fullgrid_idx"))
