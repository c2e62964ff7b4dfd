"""Positions: searches, matches, tiles, polygons and density maps."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, cos, radians

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.functions.columns import digitize, sphdist
from starmill.operators.fit import Alike
from starmill.operators.percentiles import grouped_percentiles
from starmill.operators.tables import row_ids


def zone_search(df: DataFrame, ra0: float, ra1: float, dec0: float, dec1: float, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """Rows in a box, ends included; ra0 > ra1 goes through 0."""
    east = F.col(ra).between(ra0, ra1) if ra0 <= ra1 else (F.col(ra) >= ra0) | (F.col(ra) <= ra1)
    return df.where(east & F.col(dec).between(dec0, dec1))


def cone_search(df: DataFrame, ra0: float, dec0: float, r: float, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """Rows within r degrees, with `separation`; the declination band goes to the scan."""
    near = df.where(F.col(dec).between(dec0 - r, dec0 + r))
    return near.withColumn("separation", sphdist(F.col(ra), F.col(dec), F.lit(ra0), F.lit(dec0))).where(F.col("separation") <= r)


def cells(df: DataFrame, size: float, ra: str, dec: str, around: bool) -> DataFrame:
    """Adds the sky cell (band, cell) of a row, or of it and its neighbours: bands of `size` degrees of declination cut into cells at least as wide."""
    band = F.floor(F.col(dec) / size)
    bands = F.explode(F.sequence(band - 1, band + 1)) if around else band
    rows = df.withColumn("band", bands)
    edge = F.least(F.greatest(F.abs(F.col("band") * size), F.abs((F.col("band") + 1) * size)), F.lit(89.999999))
    n = F.greatest(F.floor(360 * F.cos(F.radians(edge)) / size), F.lit(1))
    at = F.floor(F.pmod(F.col(ra), F.lit(360.0)) * n / 360)
    if not around:
        return rows.withColumn("cell", at.cast("long"))
    return rows.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.pmod((at + k).cast("long"), n.cast("long")) for k in (-1, 0, 1)]))))


def pairs_within(left: DataFrame, right: DataFrame, r: float, left_id: str, right_id: str, ra: str = "ra", dec: str = "decl", keep: Sequence[str] = (), own: Sequence[str] = ()) -> DataFrame:
    """left_id, right_id, separation (and columns `keep` of the right side, `own` of the left one) of all pairs less than r degrees apart: an equi-join on sky cells."""
    a = cells(left.select(F.col(left_id).alias("left_id"), F.col(ra).alias("a_ra"), F.col(dec).alias("a_dec"), *own), r, "a_ra", "a_dec", True)
    b = cells(right.select(F.col(right_id).alias("right_id"), F.col(ra).alias("b_ra"), F.col(dec).alias("b_dec"), *keep), r, "b_ra", "b_dec", False)
    both = a.join(b, ["band", "cell"]).withColumn("separation", sphdist(F.col("a_ra"), F.col("a_dec"), F.col("b_ra"), F.col("b_dec")))
    return both.where(F.col("separation") < r).select("left_id", "right_id", "separation", *keep, *own)


def best_within(left: DataFrame, right: DataFrame, r: float, left_id: str, right_id: str, ra: str, dec: str, order: Column, keep: Sequence[str] = ()) -> DataFrame:
    """left_id, right_id, separation and keep of the pair of least `order` (of the separation and keep) of each left row that has one, the smaller right_id on ties.

    Left rows of one place are matched once, and of right rows of one place (and keep) the smallest id stands for all. A first pass over the pairs finds each row's least order, by
    a number that a hash aggregate holds; a second one takes the pairs that have it. So no pairs are sorted, and none go to disk.
    """
    alike = Alike(left.select(F.col(left_id).alias("star_id"), F.col(ra).alias("ra"), F.col(dec).alias("decl")), ("ra", "decl"))
    there = right.groupBy(F.col(ra).alias("ra"), F.col(dec).alias("decl"), *keep).agg(F.min(right_id).alias("right_id"))
    least = pairs_within(alike.leaders, there, r, "star_id", "right_id", keep=keep).groupBy("left_id").agg(F.min(order).alias("least"))
    again = alike.leaders.join(least.withColumnRenamed("left_id", "star_id"), "star_id")
    best = pairs_within(again, there, r, "star_id", "right_id", keep=keep, own=["least"]).where(order == F.col("least"))
    best = best.groupBy(F.col("left_id").alias("star_id")).agg(F.min(F.struct("right_id", "separation", *keep)).alias("n"))
    return alike.of_all(best).select(F.col("star_id").alias("left_id"), "n.*")


def nearest_match(left: DataFrame, right: DataFrame, r: float, left_id: str, right_id: str, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """The nearest row of the right side within r degrees (the smaller id on ties); null where there is none."""
    near = best_within(left, right, r, left_id, right_id, ra, dec, F.col("separation"))
    return left.select(F.col(left_id).alias("left_id")).join(near, "left_id", "left").select("left_id", "right_id", "separation")


def brightest_within(left: DataFrame, right: DataFrame, r: float, left_id: str, right_id: str, flux: str, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """The brightest row of the right side less than r degrees away (the smaller id on ties); null where there is none. Rows without a flux take no part."""
    lit = right.select(right_id, ra, dec, F.col(flux).alias("flux")).where("flux IS NOT NULL")
    # of one place only the brightest can be it
    lit = lit.join(lit.groupBy(ra, dec).agg(F.max("flux").alias("flux")), [ra, dec, "flux"], "left_semi")
    best = best_within(left, lit, r, left_id, right_id, ra, dec, -F.col("flux"), ["flux"])
    return left.select(F.col(left_id).alias("left_id")).join(best, "left_id", "left").select("left_id", "right_id", "flux", "separation")


def tile_index(x: Column, edges: Sequence[float]) -> Column:
    """Number of the tile that holds x; beyond the ends the tile at the end. Even edges are found by arithmetic."""
    n, width = len(edges) - 1, (edges[-1] - edges[0]) / (len(edges) - 1)
    return F.greatest(F.least(F.floor((x - float(edges[0])) / width), F.lit(n - 1)), F.lit(0)).cast("int")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the least; points on an edge are no corners."""
    p = sorted(set(map(tuple, points)))
    if len(p) < 3:
        return np.array(p)

    def half(ps: list) -> list:
        out: list = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hull_of(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y of the hull's corners: of each partition first, then of those corners."""

    def work(frames):  # noqa: ANN001, ANN202
        held = np.zeros((0, 2))
        for f in frames:
            held = convex_hull(np.r_[held.reshape(-1, 2), f.to_numpy(float)])
        if len(held):
            yield pd.DataFrame(held.reshape(-1, 2), columns=["x", "y"])

    some = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return some.mapInPandas(work, "x double, y double").repartition(1).mapInPandas(work, "x double, y double")


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over a polygon's corners."""
    odd = F.lit(False)
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y0 != y1:
            odd = odd != (((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0))
    return odd


def map_shape(ra0: float, ra1: float, dec0: float, dec1: float, pixel: float) -> tuple[int, int]:
    """Tiles of `pixel` degrees over a box, along RA by the cosine of its mid declination."""
    return max(1, ceil((ra1 - ra0) * cos(radians((dec0 + dec1) / 2)) / pixel)), max(1, ceil((dec1 - dec0) / pixel))


def clipped_area(box: tuple[float, float, float, float], corners: np.ndarray) -> float:
    """Area of the part of a box (x0, x1, y0, y1) inside a convex polygon with counter-clockwise corners: the box is cut along each side."""
    x0, x1, y0, y1 = box
    shape = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, 0), strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in shape]
        cut = []
        for k, (p, d) in enumerate(zip(shape, side, strict=True)):
            q, e = shape[k - 1], side[k - 1]
            if (d >= 0) != (e >= 0):
                t = e / (e - d)
                cut.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d >= 0:
                cut.append(p)
        shape = cut
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(shape, [*shape[1:], *shape[:1]], strict=True))) / 2


def overlap_fraction(tiles: DataFrame, corners: Sequence[tuple[float, float]]) -> DataFrame:
    """Adds `overlap`: the share of a tile (min_ra, max_ra, min_dec, max_dec) inside a hull, by its counter-clockwise corners."""
    hull = np.asarray(corners, float)

    def share(x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series) -> pd.Series:
        boxes = zip(x0, x1, y0, y1, strict=True)
        return pd.Series([clipped_area(b, hull) / ((b[1] - b[0]) * (b[3] - b[2])) for b in boxes], dtype=float)

    return tiles.withColumn("overlap", F.pandas_udf(share, "double")("min_ra", "max_ra", "min_dec", "max_dec"))


def source_density(df: DataFrame, ra_edges: Sequence[float], dec_edges: Sequence[float], condition: Column | None = None, ra: str = "ra", dec: str = "decl", hull: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """i_ra, i_dec, n, value (rows per square degree) and edges of every tile, empty ones too.

    hull: counter-clockwise corners of the catalogue's hull. A tile's area is then the part inside; tiles with half of their area or less there have the value 0.
    """
    spark = df.sparkSession
    n_ra, n_dec = len(ra_edges) - 1, len(dec_edges) - 1
    step_ra, step_dec = (ra_edges[-1] - ra_edges[0]) / n_ra, (dec_edges[-1] - dec_edges[0]) / n_dec
    some = df if condition is None else df.where(condition)
    counts = some.groupBy(tile_index(F.col(ra), ra_edges).alias("i_ra"), tile_index(F.col(dec), dec_edges).alias("i_dec")).agg(F.count(F.lit(1)).alias("n"))
    tiles = spark.range(n_ra * n_dec).select((F.col("id") % n_ra).cast("int").alias("i_ra"), F.floor(F.col("id") / n_ra).cast("int").alias("i_dec"))
    tiles = tiles.select("*", (F.col("i_ra") * step_ra + ra_edges[0]).alias("min_ra"), ((F.col("i_ra") + 1) * step_ra + ra_edges[0]).alias("max_ra"), (F.col("i_dec") * step_dec + dec_edges[0]).alias("min_dec"), ((F.col("i_dec") + 1) * step_dec + dec_edges[0]).alias("max_dec"))
    area = step_dec * step_ra * F.cos(F.radians((F.col("min_dec") + F.col("max_dec")) / 2))
    found = (tiles if hull is None else overlap_fraction(tiles, hull)).join(counts, ["i_ra", "i_dec"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("value", F.col("n") / area if hull is None else F.when(F.col("overlap") > 0.5, F.col("n") / (area * F.col("overlap"))).otherwise(0.0))


def onto_rows(df: DataFrame, tiles: DataFrame, value: str, ra_edges: Sequence[float], dec_edges: Sequence[float], ra: str = "ra", dec: str = "decl") -> DataFrame:
    """The rows with the value of the tile that holds them."""
    at = df.withColumn("i_ra", tile_index(F.col(ra), ra_edges)).withColumn("i_dec", tile_index(F.col(dec), dec_edges))
    return at.join(tiles.select("i_ra", "i_dec", value), ["i_ra", "i_dec"], "left").drop("i_ra", "i_dec")


def bin_density_map(tiles: DataFrame, n: int, mode: str = "linear") -> DataFrame:
    """Adds `bin`, 0 to n - 1, of the tile values: n even bins from 1 % of the range below the least to 1 % above the largest, by log10 for mode log."""
    v = F.log10("value") if mode == "log" else F.col("value")
    some = tiles.where("value > 0") if mode == "log" else tiles
    ends = some.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo, width = F.col("lo") - 0.01 * (F.col("hi") - F.col("lo")), 1.02 * (F.col("hi") - F.col("lo")) / n
    rows = some.crossJoin(F.broadcast(ends))
    return rows.withColumn("bin", F.when(width > 0, F.floor((v - lo) / width)).otherwise(0).cast("int")).drop("lo", "hi")


def aperture_background(stars: DataFrame, pixels: DataFrame, r: float, width: float, star_id: str = "star_id") -> DataFrame:
    """star_id and background: the mean of the pixels (x, y, v) between r and r + width of each star (x, y) that lie within r of no star."""
    far = r + width
    cell = lambda c: F.floor(F.col(c) / far)
    s = stars.select(F.col(star_id).alias("star_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx"), cell("y").alias("y0"))
    s = s.select("star_id", "sx", "sy", "cx", F.explode(F.sequence(F.col("y0") - 1, F.col("y0") + 1)).alias("cy"))
    both = pixels.select("x", "y", "v", cell("x").alias("cx"), cell("y").alias("cy")).join(s, ["cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).where(F.col("d") <= far)
    masked = both.where(F.col("d") <= r).select("x", "y").distinct()
    return both.where(F.col("d") > r).join(masked, ["x", "y"], "left_anti").groupBy("star_id").agg(F.avg("v").alias("background"), F.count(F.lit(1)).alias("n_pixels"))


def tile_median(rows: DataFrame, value: str, ra_edges: Sequence[float], dec_edges: Sequence[float], ra: str = "ra", dec: str = "decl") -> DataFrame:
    """Median of a value and count of rows in each tile that has some."""
    placed = rows.select(tile_index(F.col(ra), ra_edges).alias("i_ra"), tile_index(F.col(dec), dec_edges).alias("i_dec"), F.col(value).alias("value"))
    return grouped_percentiles(placed, ["i_ra", "i_dec"], "value", {"median": 0.5}, F.count(F.lit(1)).alias("n")).select("i_ra", "i_dec", "median", "n")


def background_map(stars: DataFrame, pixels: DataFrame, r: float, width: float, ra_edges: Sequence[float], dec_edges: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Of stars (star_id, ra, decl, x, y): the median of their aperture backgrounds and their number per tile, and the stars with their own and their tile's background."""
    own = stars.join(aperture_background(stars, pixels, r, width).select("star_id", "background"), "star_id")
    tiles = tile_median(own, "background", ra_edges, dec_edges)
    return tiles, onto_rows(own, tiles, "median", ra_edges, dec_edges)


def regions_of(points: DataFrame, regions: DataFrame, cell: float, x: str = "ra", y: str = "decl", keep: Sequence[str] = ("star_id",)) -> DataFrame:
    """Pairs of points and the polygons that hold them: the points' columns in keep, and region_id.

    regions: region_id and corners, an array of (x, y) of a simple polygon, convex or not, in either direction; regions may overlap. A polygon goes to the cells (`cell` wide) that its box covers, a point to
    its own, and they meet there; so a table of regions may have any number of rows. Inside is where a ray to larger x crosses an odd number of sides. Points without a place are in none.
    Where places have two points or more on average (counted first), each place is looked up once. Only points inside a polygon's box meet its sides.
    """
    session = points.sparkSession
    tasks = 4 * max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    counts = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(x, y)).alias("places")).first()
    if counts.n >= 2 * max(counts.places, 1):
        at = [F.col(x).alias("x_of_place"), F.col(y).alias("y_of_place")]
        found = regions_of(points.select(*at).distinct(), regions, cell, "x_of_place", "y_of_place", ("x_of_place", "y_of_place"))
        sides = [df.repartition(tasks, "x_of_place", "y_of_place") for df in (points.select(*keep, *at), found)]
        return sides[0].join(sides[1], ["x_of_place", "y_of_place"]).select(*keep, "region_id")
    sides = F.expr("transform(corners, (p, i) -> struct(p.x AS x1, p.y AS y1, corners[(i + 1) % size(corners)].x AS x2, corners[(i + 1) % size(corners)].y AS y2))")
    ends = ["lo_x", "hi_x", "lo_y", "hi_y"]
    around = [F.expr(f"{f}(transform(corners, p -> CAST(p.{c} AS DOUBLE))) AS {n}_{c}") for c in "xy" for n, f in (("lo", "array_min"), ("hi", "array_max"))]
    box = regions.select("region_id", sides.alias("sides"), *around, *[F.expr(f"CAST(floor({f}(transform(corners, p -> p.{c})) / {cell!r}D) AS BIGINT)").alias(f"{f}_{c}") for c in "xy" for f in ("array_min", "array_max")])
    cover = box.select("region_id", "sides", *ends, F.explode(F.sequence("array_min_x", "array_max_x")).alias("cell_x"), "array_min_y", "array_max_y")
    cover = cover.select("region_id", "sides", *ends, "cell_x", F.explode(F.sequence("array_min_y", "array_max_y")).alias("cell_y"))
    placed = points.select(*keep, F.col(x).alias("at_x"), F.col(y).alias("at_y"), *[F.floor(F.col(c) / cell).alias(f"cell_{n}") for c, n in ((x, "x"), (y, "y"))])
    crossed = F.expr("size(filter(sides, s -> (s.y1 > at_y) <> (s.y2 > at_y) AND at_x < (s.x2 - s.x1) * (at_y - s.y1) / (s.y2 - s.y1) + s.x1)) % 2 = 1")
    # a little room, as the crossings are rounded
    near = F.expr("at_y >= lo_y AND at_y <= hi_y AND at_x >= lo_x - 1e-9D * (1 + abs(lo_x)) AND at_x <= hi_x + 1e-9D * (1 + abs(hi_x))")
    # few bytes meet for much work, so the number of tasks isn't left to their size
    placed, cover = (df.repartition(tasks, "cell_x", "cell_y") for df in (placed, cover))
    return placed.join(cover, ["cell_x", "cell_y"]).where(near).where(crossed).select(*keep, "region_id")


def bin_by_width(tiles: DataFrame, width: float) -> DataFrame:
    """Adds `bin`, from 1: steps of `width` from the least tile value; a value at the end of the last step is one further."""
    low = tiles.agg(F.min("value").alias("lo"))
    return tiles.crossJoin(F.broadcast(low)).withColumn("bin", (F.floor((F.col("value") - F.col("lo")) / width) + 1).cast("int")).drop("lo")


def bin_by_edges(tiles: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Adds `bin`: the number of edges at or below the tile's value, so 0 lies below all of them."""
    return tiles.withColumn("bin", digitize(F.col("value"), edges).cast("int"))


def bin_per_tile(tiles: DataFrame) -> DataFrame:
    """Adds `bin`: each tile is one, numbered from 0 in the order of its indices."""
    return row_ids(tiles, ["i_ra", "i_dec"], "bin").withColumn("bin", F.col("bin").cast("int"))


def inside_hull(x: Column, y: Column, corners: Sequence[tuple[float, float]], margin: float = 0.0) -> Column:
    """Whether a point lies in a convex polygon (counter-clockwise corners) and further than `margin` from each of its sides."""
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        inside = inside & (((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length >= margin)
    return inside


def largest_separation(df: DataFrame, by: Sequence[str], ra: str = "ra", dec: str = "decl") -> DataFrame:
    """Box of the positions of each part."""
    return df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in (ra, dec) for n, f in (("min", F.min), ("max", F.max))])


def first_in_order(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("place = 1").drop("place")


def nearest_rounded(left: DataFrame, right: DataFrame, r: float, digits: int = 9) -> DataFrame:
    """nearest_match() of star_id with separations that differ by less than a rounding step taken as ties."""
    best = best_within(left, right, r, "star_id", "star_id", "ra", "decl", F.round("separation", digits))
    return left.select(F.col("star_id").alias("left_id")).join(best, "left_id", "left").select("left_id", "right_id", F.round("separation", digits).alias("separation"))


def inside_box(df: DataFrame, margin_ra: float, margin_dec: float, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """Rows further than the margins from the edges of the catalogue's box."""
    box = df.agg(*[f(c).alias(f"{n}_{c}_of_box") for c in (ra, dec) for n, f in (("min", F.min), ("max", F.max))])
    inside = [F.col(c).between(F.col(f"min_{c}_of_box") + m, F.col(f"max_{c}_of_box") - m) for c, m in ((ra, margin_ra), (dec, margin_dec))]
    return df.crossJoin(F.broadcast(box)).where(inside[0] & inside[1]).select(*df.columns)
