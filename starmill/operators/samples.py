"""Sampling models: weighted, stratified and thinned draws, and synthetic catalogues. Every draw is fixed by its seed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.operators.tables import in_ranges, row_ids, stack
from starmill.operators.weights import bin_boundaries


def unit(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) by a hash of the keys: the same on every run, partitioning and engine (the first 13 hexadecimal digits of an MD5)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def cumulative(df: DataFrame, weight: str, order: str, rows_per_part: int = 1 << 20, by: Sequence[str] = ()) -> DataFrame:
    """Adds `below` and `upto`, the running sums of a weight before and with each row in an order (within `by`), by two levels: within ranges of the order, and over the ranges' totals."""
    w = W.partitionBy(*by, "part_of").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    placed = in_ranges(df, [*by, order], rows_per_part)
    rows = placed.withColumn("inner_sum", F.sum(weight).over(w))
    totals = placed.groupBy(*by, "part_of").agg(F.sum(weight).alias("part_sum"))
    before = totals.select(*by, "part_of", F.coalesce(F.sum("part_sum").over(W.partitionBy(*by).orderBy("part_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    out = rows.join(before if by else F.broadcast(before), [*by, "part_of"]).withColumn("upto", F.col("before") + F.col("inner_sum"))
    return out.withColumn("below", F.col("upto") - F.col(weight)).drop("inner_sum", "before", "part_of")


def offset(seed: int) -> float:
    """A number in (0, 1) for a whole draw: unit() of the seed alone."""
    return (int(md5(str(seed).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def sample_models(models: DataFrame, n: int, weight: Column, seed: int = 1) -> DataFrame:
    """n draws with replacement by weight: model columns and `draw`. Systematic over the running sums: draw k takes the model that holds (k + u) / n of the total, u by the seed; so each model knows its own draws, and no draw is joined."""
    rows = cumulative(models.withColumn("draw_w", weight.cast("double")).where("draw_w > 0"), "draw_w", "model_id")
    total = rows.agg(F.sum("draw_w").alias("t")).scalar()
    first, last = F.ceil(F.col("below") / total * n - offset(seed)), F.ceil(F.col("upto") / total * n - offset(seed)) - 1
    drawn = rows.withColumn("k0", F.greatest(first, F.lit(0))).withColumn("k1", F.least(last, F.lit(n - 1))).where("k0 <= k1")
    return drawn.select(*models.columns, F.explode(F.sequence("k0", "k1")).alias("draw"))


def observable(models: DataFrame, completeness: Sequence[str], bands: int, least: float = 0.0, flux_limit: tuple[str, float] | None = None) -> DataFrame:
    """Models whose completeness is above `least` in that many bands or more, and whose flux in a band reaches a limit (flux column, least flux)."""
    seen = sum((F.when(F.col(c) > least, 1).otherwise(0) for c in completeness), F.lit(0)) >= bands
    return models.where(seen if flux_limit is None else seen & (F.col(flux_limit[0]) >= flux_limit[1]))


def simulated(models: DataFrame, n: int, completeness: Sequence[str], bands: int = 1, weight: str | None = "weight", of_band: str | None = None, least: float = 0.0, flux_limit: tuple[str, float] | None = None, seed: int = 1) -> DataFrame:
    """n draws with replacement from the observable models: by weight times completeness (the largest of all bands, or that of one), or evenly without a weight."""
    some = observable(models, completeness, bands, least, flux_limit)
    if weight is None:
        return draw_per_group(some, [], n, 1, seed).drop("realization")
    compl = F.col(of_band) if of_band else F.greatest(*completeness) if len(completeness) > 1 else F.col(completeness[0])
    return sample_models(some, n, F.col(weight) * compl, seed)


def simulated_grids(grids: Sequence[DataFrame], n: int, completeness: Sequence[str], seed: int = 1, **how: object) -> DataFrame:
    """One catalogue from several grids that share n draws evenly (rounded up): those of each with its place as `grid`, each by a seed of its own."""
    each = -(-n // len(grids))
    return stack([simulated(models, each, completeness, seed=seed + 1000 * k, **how).withColumn("grid", F.lit(k)) for k, models in enumerate(grids)])


def synthetic_catalog(drawn: DataFrame, fluxes: Sequence[str], bias: Sequence[str], sigma: Sequence[str], seed: int = 1) -> DataFrame:
    """Observed fluxes of draws: normal around flux + bias by |sigma| (Box-Muller on hashes), and magnitudes, 99.999 where the flux isn't positive."""
    out = drawn
    for k, (f, b, s) in enumerate(zip(fluxes, bias, sigma, strict=True)):
        z = F.sqrt(-2 * F.log(unit(seed + 2 * k, "model_id", "draw"))) * F.cos(2 * F.pi() * unit(seed + 2 * k + 1, "model_id", "draw"))
        out = out.withColumn(f"obs_{k}", F.col(f) + F.col(b) + F.abs(F.col(s)) * z)
        out = out.withColumn(f"mag_{k}", F.when(F.col(f"obs_{k}") > 0, -2.5 * F.log10(f"obs_{k}")).otherwise(99.999))
    return out


def mass_formed(models: DataFrame, age: str, mass: str, mass_mean: float) -> DataFrame:
    """Per age: prior 1 times the linear width of its bin, as shares, and the stars of mean mass in one unit of formed mass."""
    ages = bin_boundaries(models, age).select(age, (F.pow(F.lit(10.0), "hi") - F.pow(F.lit(10.0), "lo")).alias("years"))
    living = models.groupBy(age).agg(F.min(mass).alias("min_mass"), F.max(mass).alias("max_mass"))
    out = ages.join(living, age).withColumn("share", F.col("years") / F.sum("years").over(W.partitionBy()))
    return out.withColumn("stars", F.col("share") / mass_mean)


def imf_points(least: float, largest: float, imf: Callable[[np.ndarray], np.ndarray], points: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Masses evenly spaced in their logarithm, and the initial mass function there."""
    masses = np.logspace(np.log10(least), np.log10(largest), points)
    return masses, np.asarray(imf(masses), float)


def stars_per_age(models: DataFrame, age: str, mass: str, imf: Callable[[np.ndarray], np.ndarray], age_prior: Callable[[np.ndarray], np.ndarray] | None = None, points: int = 100) -> DataFrame:
    """Per age: min_mass, max_mass, the living share of the stars that were formed (the initial mass function over the masses that the age still has,
    over that of all masses), formed (prior times years, the mass formed), mass (what is left of it) and stars, its number of stars of mean mass.

    The initial mass function is summed by trapezoids over `points` masses, of which an age has those within its own ends. age_prior: of
    the ages (logarithms), per year; 1 where none is given.
    """
    ends = models.agg(F.min(mass).alias("lo"), F.max(mass).alias("hi")).first()
    m, p = imf_points(ends.lo, ends.hi, imf, points)
    area = lambda y: (y[1:] + y[:-1]) / 2 * np.diff(m)
    total = float(area(p).sum())
    mean = float(area(m * p).sum()) / total
    pieces = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(x)).alias("x")) for a, b, x in zip(m[:-1], m[1:], area(p), strict=True)])
    living = models.groupBy(age).agg(F.min(mass).alias("min_mass"), F.max(mass).alias("max_mass"))
    # the ends of the masses are powers of their own logarithms, so an age's end may miss its point by rounding
    inside = lambda e: (e["a"] >= F.col("min_mass") * (1 - 1e-12)) & (e["b"] <= F.col("max_mass") * (1 + 1e-12))
    share = F.aggregate(F.filter(pieces, inside), F.lit(0.0), lambda s, e: s + e["x"]) / total
    ages = bin_boundaries(models, age).select(age, (F.pow(F.lit(10.0), "hi") - F.pow(F.lit(10.0), "lo")).alias("years"))
    out = ages.join(living, age).withColumn("living", share)
    if age_prior is None:
        out = out.withColumn("formed", F.col("years"))
    else:
        values = np.array([r[0] for r in ages.select(age).orderBy(age).collect()], float)  # an axis of the grid
        known = F.map_from_arrays(F.array(*[F.lit(float(v)) for v in values]), F.array(*[F.lit(float(v)) for v in np.asarray(age_prior(values), float)]))
        out = out.withColumn("formed", F.col("years") * F.element_at(known, F.col(age).cast("double")))
    return out.withColumn("mass", F.col("formed") * F.col("living")).withColumn("stars", F.rint(F.col("mass") / mean).cast("long"))


def stratified_sample(models: DataFrame, by: str, numbers: DataFrame, weight: Column, seed: int = 1, rows_per_part: int = 1 << 20) -> DataFrame:
    """Draws with replacement by weight within each stratum: model columns and `draw`, 0 up to the stratum's number.

    numbers: `by` and stars, a row per stratum. Systematic over the stratum's own running sums, from a place by the seed and the stratum, so each model
    knows its draws and a stratum may be of any size. A stratum without weight has none.
    """
    rows = cumulative(models.withColumn("draw_w", weight.cast("double")).where("draw_w > 0"), "draw_w", "model_id", rows_per_part, [by])
    strata = rows.groupBy(by).agg(F.sum("draw_w").alias("all_w")).join(numbers.select(by, F.col("stars").alias("all_n")), by)
    rows = rows.join(strata, by)
    at = lambda c: F.ceil(F.col(c) / F.col("all_w") * F.col("all_n") - unit(seed, by))
    drawn = rows.withColumn("k0", F.greatest(at("below"), F.lit(0))).withColumn("k1", F.least(at("upto") - 1, F.col("all_n") - 1)).where("k0 <= k1")
    return drawn.select(*models.columns, F.explode(F.sequence("k0", "k1")).alias("draw"))


def thin(drawn: DataFrame, completeness: Column, seed: int = 1) -> DataFrame:
    """Draws that are kept with the probability of their completeness."""
    return drawn.where(unit(seed, "model_id", "draw") <= completeness)


def pick_per_group(models: DataFrame, by: Sequence[str], n: int, repeat: int = 1, seed: int = 1) -> DataFrame:
    """n models of each group by a seeded order, each `repeat` times; a group of fewer gives all."""
    order = W.partitionBy(*by).orderBy(unit(seed, "model_id"), "model_id")
    picked = models.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")
    return picked.withColumn("realization", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))


def draw_per_group(models: DataFrame, by: Sequence[str], n: int, repeat: int = 1, seed: int = 1, rows_per_part: int = 1 << 20) -> DataFrame:
    """n draws with replacement from each group, evenly: model columns, `draw` (0 to n - 1) and `realization` (0 to repeat - 1).

    A group's models have places from 0 in the order of model_id, numbered by ranges; each draw hashes to a place, and both meet there. Without `by` all models are one group.
    """
    placed = row_ids(models, [*by, "model_id"], "place_of", rows_per_part)
    groups = placed.groupBy(*by).agg(F.min("place_of").alias("first_of"), F.count(F.lit(1)).alias("size_of")).where("size_of > 0")
    draws = groups.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("draw", (F.col("first_of") + F.floor(unit(seed, *by, "draw") * F.col("size_of"))).alias("place_of"))
    picked = placed.join(draws, "place_of").drop("place_of")
    return picked.withColumn("realization", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))


def pick_by_flux_bins(models: DataFrame, mags: Sequence[str], bins: int, least: int, seed: int = 1) -> DataFrame:
    """Models that fill every (band, bin) of even magnitude bins with `least` models, or all there are: the first of each bin in a seeded order, once each."""
    ends = models.agg(*[f(m).alias(f"{n}_{k}") for k, m in enumerate(mags) for n, f in (("lo", F.min), ("hi", F.max))])
    cells = F.array(*[F.struct(F.lit(k).alias("band"), F.least(F.floor((F.col(m) - F.col(f"lo_{k}")) / ((F.col(f"hi_{k}") - F.col(f"lo_{k}")) / bins)), F.lit(bins - 1)).alias("bin")) for k, m in enumerate(mags)])
    rows = models.crossJoin(F.broadcast(ends)).select("model_id", F.explode(cells).alias("c")).select("model_id", "c.*")
    order = W.partitionBy("band", "bin").orderBy(unit(seed, "model_id"), "model_id")
    chosen = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= least).select("model_id").distinct()
    return models.join(chosen, "model_id", "left_semi")


def supplement(models: DataFrame, used: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n further models that are not used yet, by a seeded order."""
    return models.join(used.select("model_id").distinct(), "model_id", "left_anti").orderBy(unit(seed, "model_id"), "model_id").limit(n)


def within_cuts(limits: dict[str, tuple[float, float]], colours: dict[str, Sequence[tuple[str, float]]] | None = None) -> Column:
    """Magnitudes between their bright and faint limits, and first minus second at most the limit of a colour; a colour counts only where its first band has limits."""
    cuts = [F.col(m).between(*ends) for m, ends in limits.items()]
    cuts += [F.col(m) - F.col(other) <= most for m, some in (colours or {}).items() if m in limits for other, most in some]
    return total_and(cuts)


def total_and(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def supplement_draws(models: DataFrame, used: DataFrame, n: int, cuts: Column | None = None, seed: int = 1) -> DataFrame:
    """n draws with replacement from the models that are not used yet and lie within the cuts (see within_cuts): model columns and `draw`."""
    free = models.join(used.select("model_id").distinct(), "model_id", "left_anti")
    return draw_per_group(free if cuts is None else free.where(cuts), [], n, 1, seed).drop("realization")


def positions_near(stars: DataFrame, n_per: int, r0: float, r1: float, box: tuple[float, float, float, float], seed: int = 1) -> DataFrame:
    """n_per positions around each star (star_id, x, y), in an annulus from r0 to r1 of even density, inside the box (x0, x1, y0, y1)."""
    rows = stars.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_per - 1))))
    r = F.sqrt(r0 * r0 + (r1 * r1 - r0 * r0) * unit(seed, "star_id", "k"))
    a = 2 * F.pi() * unit(seed + 1, "star_id", "k")
    out = rows.select("star_id", "k", (F.col("x") + r * F.cos(a)).alias("x"), (F.col("y") + r * F.sin(a)).alias("y"))
    return out.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))


def clipped(polygon: list[tuple[float, float]], corners: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """A convex polygon's part within another one, both counter-clockwise: it is cut along each side of the other in turn."""
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in polygon]
        kept = []
        for (p, q), (s, t) in zip(zip(polygon, [*polygon[1:], *polygon[:1]], strict=True), zip(side, [*side[1:], *side[:1]], strict=True), strict=True):
            if s >= 0:
                kept.append(p)
            if s * t < 0:
                kept.append((p[0] + (q[0] - p[0]) * (s / (s - t)), p[1] + (q[1] - p[1]) * (s / (s - t))))
        polygon = kept
    return polygon


def triangles(tiles: DataFrame, corners: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Triangles of each tile's part within a convex polygon: bin, i_ra, i_dec, k, their corners and area. A tile outside has none."""
    schema = "bin int, i_ra long, i_dec long, k int, ax double, ay double, bx double, by double, cx double, cy double, area double"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f.itertuples(index=False):
                box = [(t.min_ra, t.min_dec), (t.max_ra, t.min_dec), (t.max_ra, t.max_dec), (t.min_ra, t.max_dec)]
                shape = clipped(box, corners) if corners else box
                for k, ((bx, by), (cx, cy)) in enumerate(zip(shape[1:-1], shape[2:], strict=True)):
                    (ax, ay) = shape[0]
                    out.append((t.bin, t.i_ra, t.i_dec, k, ax, ay, bx, by, cx, cy, ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return tiles.select("bin", "i_ra", "i_dec", "min_ra", "max_ra", "min_dec", "max_dec").mapInPandas(cut, schema).where("area > 0")


def positions_in_tiles(models: DataFrame, tiles: DataFrame, realize: int, seed: int = 1, corners: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Each model `realize` times in each bin of a density map, at an evenly drawn place of the bin's tiles: model_id, realization, bin, ra, decl.

    corners: a convex polygon (counter-clockwise; the catalogue's box, a region, a filter's hull) that all places have to lie in. Each tile's part of it is cut into
    triangles, and a draw finds its triangle by its share of the bin's area, so the first place is right and no draw is lost. A bin without area has no rows.

    The shares of a bin are cut into as many even cells as it has triangles, and triangles and draws meet in the cells.
    """
    order = W.partitionBy("bin").orderBy("i_ra", "i_dec", "k").rowsBetween(W.unboundedPreceding, 0)
    shapes = triangles(tiles, corners)
    bins = shapes.groupBy("bin").agg(F.sum("area").alias("all_area"), F.count(F.lit(1)).alias("cells"))
    shapes = shapes.withColumn("upto", F.sum("area").over(order)).join(bins, "bin")
    last = F.row_number().over(W.partitionBy("bin").orderBy(F.desc("i_ra"), F.desc("i_dec"), F.desc("k"))) == 1
    shapes = shapes.withColumn("hi", F.when(last, 1.0).otherwise(F.col("upto") / F.col("all_area"))).withColumn("lo", F.coalesce(F.lag("hi").over(W.partitionBy("bin").orderBy("i_ra", "i_dec", "k")), F.lit(0.0)))
    cell = lambda x: F.least(F.floor(x * F.col("cells")), F.col("cells") - 1)
    shapes = shapes.where("lo < hi").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    rows = models.select("model_id", F.explode(F.sequence(F.lit(0), F.lit(realize - 1))).alias("realization")).join(bins.select("bin", "cells"), F.lit(True))
    keys = ["model_id", "realization", "bin"]
    rows = rows.withColumn("u", unit(seed, *keys)).withColumn("cell", cell(F.col("u")))
    found = rows.drop("cells").join(shapes.drop("cells"), ["bin", "cell"]).where("lo <= u AND u < hi")
    s, t = unit(seed + 1, *keys), unit(seed + 2, *keys)
    found = found.withColumns({"s": F.when(s + t > 1, 1 - s).otherwise(s), "t": F.when(s + t > 1, 1 - t).otherwise(t)})
    return found.select(*keys, *[(F.col(f"a{c}") + F.col("s") * (F.col(f"b{c}") - F.col(f"a{c}")) + F.col("t") * (F.col(f"c{c}") - F.col(f"a{c}"))).alias(name) for c, name in (("x", "ra"), ("y", "decl"))])
