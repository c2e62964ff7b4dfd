"""Queries of positions, density maps and catalogues."""

import numpy as np
from pyspark.sql import functions as F

from starmill.operators import catalogues as K
from starmill.operators import samples, sky
from starmill.plans.fixtures import unit_sql
from starmill.plans.registry import query

SEP = "degrees(2*asin(sqrt(power(sin(radians(b.decl-a.decl)/2),2)+cos(radians(a.decl))*cos(radians(b.decl))*power(sin(radians(b.ra-a.ra)/2),2))))"
RA, DEC = [80 + 0.0101 * k for k in range(6)], [-69 + 0.0101 * k for k in range(5)]


def tile(x: str, edges: list) -> str:
    n, w = len(edges) - 1, (edges[-1] - edges[0]) / (len(edges) - 1)
    return f"CAST(greatest(least(floor(({x}-({edges[0]!r}e0))/{w!r}e0),{n - 1}),0) AS INT)"


@query("p18_zone_search", "star_id", "SELECT star_id FROM fx_stars WHERE ra BETWEEN 80.01e0 AND 80.0505e0 AND decl BETWEEN -68.9905e0 AND -68.97e0")
def _zone(v):
    return sky.zone_search(v("fx_stars"), 80.01, 80.0505, -68.9905, -68.97)


@query("p19_cone_search", "star_id ~separation", "SELECT * FROM (SELECT star_id, degrees(2*asin(sqrt(power(sin(radians(-68.98e0-decl)/2),2)+cos(radians(decl))*cos(radians(-68.98e0))*power(sin(radians(80.05e0-ra)/2),2)))) AS separation FROM fx_stars) WHERE separation<=0.0151e0", 9)
def _cone(v):
    return sky.cone_search(v("fx_stars"), 80.05, -68.98, 0.0151)


@query("j6_nearest_match", "left_id right_id ~separation", f"WITH p AS (SELECT a.star_id AS l, b.star_id AS r, {SEP} AS s FROM fx_stars a JOIN fx_catalog b ON abs(a.decl-b.decl)<0.003e0 WHERE {SEP}<0.0021e0), m AS (SELECT l, min(row(round(s,9), r)) AS e FROM p GROUP BY l) SELECT star_id AS left_id, e[2] AS right_id, e[1] AS separation FROM fx_stars LEFT JOIN m ON l=star_id", 8)
def _nearest(v):
    return sky.nearest_rounded(v("fx_stars"), v("fx_catalog"), 0.0021)


@query("j7_radius_brightest", "left_id ~flux", f"WITH p AS (SELECT a.star_id AS l, b.f475w_rate AS f FROM fx_stars a JOIN fx_catalog b ON abs(a.decl-b.decl)<0.003e0 WHERE {SEP}<0.0021e0) SELECT star_id AS left_id, max(f) AS flux FROM fx_stars LEFT JOIN p ON l=star_id GROUP BY star_id")
def _brightest(v):
    return sky.brightest_within(v("fx_stars"), v("fx_catalog"), 0.0021, "star_id", "star_id", "f475w_rate")


@query("j9_tile_for_position", "star_id #i_ra #i_dec", f"SELECT star_id, {tile('ra+0.00005e0', RA)} AS i_ra, {tile('decl+0.00005e0', DEC)} AS i_dec FROM fx_stars")
def _tile(v):
    return v("fx_stars").select("star_id", sky.tile_index(F.col("ra") + 0.00005, RA).alias("i_ra"), sky.tile_index(F.col("decl") + 0.00005, DEC).alias("i_dec"))


STAR_SHAPES = "SELECT s_suppkey AS region_id, 80e0+0.0011e0*(s_suppkey % 97) AS cx, -69e0+0.0023e0*(s_suppkey % 41) AS cy, 0.004e0+0.0003e0*(s_suppkey % 17) AS r FROM supplier"


@query("j11_points_in_regions", "star_id #region_id", f"""WITH g AS ({STAR_SHAPES}), k AS (SELECT g.*, i, cx+r*(CASE WHEN i%2=0 THEN 1e0 ELSE 0.45e0 END)*cos(pi()*i/5) AS x, cy+r*(CASE WHEN i%2=0 THEN 1e0 ELSE 0.45e0 END)*sin(pi()*i/5) AS y FROM g, range(10) t(i)),
e AS (SELECT a.region_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM k a JOIN k b ON b.region_id=a.region_id AND b.i=(a.i+1)%10) SELECT star_id, region_id FROM fx_catalog p JOIN e ON (y1>p.decl)<>(y2>p.decl) AND p.ra<(x2-x1)*(p.decl-y1)/(y2-y1)+x1 GROUP BY star_id, region_id HAVING count(*)%2=1""")
def _regions(v):
    corner = "named_struct('x', cx + r * CASE WHEN i % 2 = 0 THEN 1e0 ELSE 0.45e0 END * cos(pi() * i / 5), 'y', cy + r * CASE WHEN i % 2 = 0 THEN 1e0 ELSE 0.45e0 END * sin(pi() * i / 5))"
    shapes = v("supplier").selectExpr("s_suppkey AS region_id", "80e0+0.0011e0*(s_suppkey % 97) AS cx", "-69e0+0.0023e0*(s_suppkey % 41) AS cy", "0.004e0+0.0003e0*(s_suppkey % 17) AS r").selectExpr("region_id", f"transform(sequence(0, 9), i -> {corner}) AS corners")
    return sky.regions_of(v("fx_catalog"), shapes, 0.005)


@query("j11_points_in_polygon", "star_id", "SELECT star_id FROM fx_stars WHERE ra>80.0105e0 AND ra<80.0705e0 AND decl>-68.9955e0 AND decl<-68.9745e0")
def _polygon(v):
    box = [(80.0105, -68.9955), (80.0705, -68.9955), (80.0705, -68.9745), (80.0105, -68.9745)]
    return v("fx_stars").where(sky.in_polygon(F.col("ra"), F.col("decl"), box)).select("star_id")


@query("b14_convex_hull", "~x ~y", "WITH p AS (SELECT DISTINCT f0 AS x, CAST(star_id % 17 AS DOUBLE) AS y FROM fx_stars), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), s AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON (a.x, a.y) <> (b.x, b.y)), c AS (SELECT ax, ay, bx, b_y FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE (bx-ax)*(y-ay)-(b_y-ay)*(x-ax) < 0 OR ((bx-ax)*(y-ay)-(b_y-ay)*(x-ax) = 0 AND (x-ax)*(x-bx)+(y-ay)*(y-b_y) > 0))) SELECT DISTINCT ax AS x, ay AS y FROM c")
def _hull(v):
    return sky.hull_of(v("fx_stars").select("f0", (F.col("star_id") % 17).cast("double").alias("y")), "f0", "y")


@query("a22_source_density", "#i_ra #i_dec #n ~value", f"WITH t AS (SELECT i.i AS i_ra, j.j AS i_dec FROM range(5) i(i), range(4) j(j)), c AS (SELECT {tile('ra+0.00005e0', RA)} AS i_ra, {tile('decl+0.00005e0', DEC)} AS i_dec, count(*) AS n FROM fx_stars WHERE f0>14 GROUP BY ALL) SELECT t.i_ra, t.i_dec, coalesce(n,0) AS n, coalesce(n,0)/(0.0101e0*0.0101e0*cos(radians(-69e0+0.0101e0*(t.i_dec+0.5e0)))) AS value FROM t LEFT JOIN c USING (i_ra, i_dec)", 3)
def _density(v):
    stars = v("fx_stars").withColumns({"ra": F.col("ra") + 0.00005, "decl": F.col("decl") + 0.00005})
    return sky.source_density(stars, RA, DEC, F.col("f0") > 14)


HULL = [(80.0043, -68.9957), (80.0457, -68.9957), (80.0457, -68.9637), (80.0043, -68.9637)]
SHARE = "(greatest(0e0, least(80e0+0.0101e0*(t.i_ra+1), 80.0457e0)-greatest(80e0+0.0101e0*t.i_ra, 80.0043e0))*greatest(0e0, least(-69e0+0.0101e0*(t.i_dec+1), -68.9637e0)-greatest(-69e0+0.0101e0*t.i_dec, -68.9957e0))/(0.0101e0*0.0101e0))"


@query("a22_hull_density", "#i_ra #i_dec #n ~overlap ~value", f"WITH t AS (SELECT i.i AS i_ra, j.j AS i_dec FROM range(5) i(i), range(4) j(j)), c AS (SELECT {tile('ra+0.00005e0', RA)} AS i_ra, {tile('decl+0.00005e0', DEC)} AS i_dec, count(*) AS n FROM fx_stars GROUP BY ALL) SELECT t.i_ra, t.i_dec, coalesce(n,0) AS n, {SHARE} AS overlap, CASE WHEN {SHARE}>0.5e0 THEN coalesce(n,0)/(0.0101e0*0.0101e0*cos(radians(-69e0+0.0101e0*(t.i_dec+0.5e0)))*{SHARE})/3600 ELSE 0 END AS value FROM t LEFT JOIN c USING (i_ra, i_dec)", 3)
def _hull_density(v):
    stars = v("fx_stars").withColumns({"ra": F.col("ra") + 0.00005, "decl": F.col("decl") + 0.00005})
    return sky.source_density(stars, RA, DEC, hull=HULL).withColumn("value", F.col("value") / 3600)  # per square minute


APERTURE = "s AS (SELECT star_id, CAST(star_id*7 % 100 AS DOUBLE) AS sx, CAST(star_id*13 % 90 AS DOUBLE) AS sy FROM fx_stars), p AS (SELECT model_id % 100 + 0.25e0 AS x, CAST(floor(model_id/100e0) AS DOUBLE)*4+0.5e0 AS y, f0 AS v FROM fx_models), b AS (SELECT star_id, x, y, v, sqrt(power(x-sx,2)+power(y-sy,2)) AS d FROM s, p WHERE abs(x-sx)<=6 AND abs(y-sy)<=6), g AS (SELECT star_id, avg(v) AS background FROM b WHERE d>2 AND d<=6 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.x=b.x AND c.y=b.y AND c.d<=2) GROUP BY star_id)"


@query("a23_background_on_stars", "star_id ~background ~median", f"WITH {APERTURE}, o AS (SELECT star_id, background, {tile('ra+0.00005e0', RA)} AS i_ra, {tile('decl+0.00005e0', DEC)} AS i_dec FROM g JOIN fx_stars USING (star_id)) SELECT star_id, background, median(background) OVER (PARTITION BY i_ra, i_dec) AS median FROM o")
def _background_back(v):
    stars = v("fx_stars").selectExpr("star_id", "ra+0.00005e0 AS ra", "decl+0.00005e0 AS decl", "CAST(star_id*7 % 100 AS DOUBLE) AS x", "CAST(star_id*13 % 90 AS DOUBLE) AS y")
    pixels = v("fx_models").selectExpr("model_id % 100 + 0.25e0 AS x", "CAST(floor(model_id/100e0) AS DOUBLE)*4+0.5e0 AS y", "f0 AS v")
    return sky.background_map(stars, pixels, 2.0, 4.0, RA, DEC)[1]


@query("a23_background_map", "#i_ra #i_dec ~median #n", f"SELECT {tile('ra+0.00005e0', RA)} AS i_ra, {tile('decl+0.00005e0', DEC)} AS i_dec, median(f0) AS median, count(*) AS n FROM fx_stars GROUP BY ALL")
def _background(v):
    stars = v("fx_stars").withColumns({"ra": F.col("ra") + 0.00005, "decl": F.col("decl") + 0.00005})
    return sky.tile_median(stars, "f0", RA, DEC)


@query("a24_bin_density_map", "#nation #bin", "WITH t AS (SELECT s_nationkey AS nation, count(*)*1e0 AS value FROM supplier GROUP BY ALL), e AS (SELECT min(value) AS lo, max(value) AS hi FROM t) SELECT nation, CASE WHEN hi>lo THEN CAST(floor((value-(lo-0.01e0*(hi-lo)))/(1.02e0*(hi-lo)/4)) AS INT) ELSE 0 END AS bin FROM t, e")
def _map_bins(v):
    tiles = v("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return sky.bin_density_map(tiles, 4)


@query("j19_aperture_background", "star_id ~background #n_pixels", "WITH s AS (SELECT star_id, CAST(star_id*7 % 100 AS DOUBLE) AS sx, CAST(star_id*13 % 90 AS DOUBLE) AS sy FROM fx_stars), p AS (SELECT p_partkey % 100 + 0.25e0 AS x, CAST(floor(p_partkey/100e0) AS DOUBLE)*4+0.5e0 AS y, f0 AS v FROM part JOIN fx_models ON model_id=p_partkey), b AS (SELECT star_id, x, y, v, sqrt(power(x-sx,2)+power(y-sy,2)) AS d FROM s, p WHERE abs(x-sx)<=6 AND abs(y-sy)<=6) SELECT star_id, avg(v) AS background, count(*) AS n_pixels FROM b WHERE d>2 AND d<=6 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.x=b.x AND c.y=b.y AND c.d<=2) GROUP BY star_id")
def _aperture(v):
    stars = v("fx_stars").selectExpr("star_id", "CAST(star_id*7 % 100 AS DOUBLE) AS x", "CAST(star_id*13 % 90 AS DOUBLE) AS y")
    pixels = v("fx_models").selectExpr("model_id % 100 + 0.25e0 AS x", "CAST(floor(model_id/100e0) AS DOUBLE)*4+0.5e0 AS y", "f0 AS v")
    return sky.aperture_background(stars, pixels, 2.0, 4.0)


@query("p11_cut_catalog", "star_id", "SELECT star_id FROM fx_catalog WHERE (f475w_rate<>0 AND f814w_rate<>0) OR (f475w_rate=0 AND f814w_rate=0)")
def _cut(v):
    return K.cut_catalog(v("fx_catalog"), ["f475w_rate", "f814w_rate"])


@query("p12_cut_asts", "star_id", "SELECT star_id FROM fx_catalog WHERE f475w_rate<>0 AND f814w_rate<>0 AND ra BETWEEN 80.02e0 AND 80.0701e0 AND decl BETWEEN -68.99e0 AND -68.95e0")
def _cut_asts(v):
    kept = K.cut_catalog(v("fx_catalog"), ["f475w_rate", "f814w_rate"], ["f475w_rate", "f814w_rate"])
    return kept.where(sky.in_polygon(F.col("ra"), F.col("decl"), [(80.01999, -68.99001), (80.07011, -68.99001), (80.07011, -68.94999), (80.01999, -68.94999)]))


@query("p13_mag_limits", "model_id", "SELECT model_id FROM fx_models WHERE (CASE WHEN f0>12 AND f0<20 THEN 1 ELSE 0 END)+(CASE WHEN f1>9 AND f1<15 THEN 1 ELSE 0 END)+(CASE WHEN f2>7 AND f2<11 THEN 1 ELSE 0 END)>=2")
def _limits(v):
    return K.mag_limits(v("fx_models"), ["f0", "f1", "f2"], [12, 9, 7], [20, 15, 11], 2)


@query("p14_color_cut", "model_id", "SELECT model_id FROM fx_models WHERE f0-f1<=3.7e0 AND f0 BETWEEN 12 AND 20.05e0")
def _color(v):
    return K.color_cut(v("fx_models"), {"f0": (12, 20.05)}, "f0", "f1", 3.7)


TILES = f"WITH v AS (SELECT {tile('ra+0.00005e0', RA)} AS i_ra, {tile('decl+0.00005e0', DEC)} AS i_dec, count(*)*1e0 AS value FROM fx_stars GROUP BY ALL)"


def counted_tiles(v):
    stars = v("fx_stars").withColumns({"ra": F.col("ra") + 0.00005, "decl": F.col("decl") + 0.00005})
    return sky.tile_median(stars, "f0", RA, DEC).select("i_ra", "i_dec", F.col("n").cast("double").alias("value"))


@query("a24_bins_by_width", "#i_ra #i_dec #bin", f"{TILES} SELECT i_ra, i_dec, CAST(floor((value-(SELECT min(value) FROM v))/1.7e0) AS INT)+1 AS bin FROM v")
def _width_bins(v):
    return sky.bin_by_width(counted_tiles(v), 1.7)


@query("a24_bins_by_edges", "#i_ra #i_dec #bin", f"{TILES} SELECT i_ra, i_dec, CASE WHEN value<2 THEN 0 WHEN value<5 THEN 1 WHEN value<9.5e0 THEN 2 ELSE 3 END AS bin FROM v")
def _edge_bins(v):
    return sky.bin_by_edges(counted_tiles(v), [2.0, 5.0, 9.5])


@query("a24_bin_per_tile", "#i_ra #i_dec #bin", f"{TILES} SELECT i_ra, i_dec, row_number() OVER (ORDER BY i_ra, i_dec)-1 AS bin FROM v")
def _tile_bins(v):
    return sky.bin_per_tile(counted_tiles(v))


@query("p15_filter_tracks", "track_row", "SELECT track_row FROM fx_tracks WHERE NOT (eep<5 OR log_l<0.3e0)")
def _filter(v):
    return K.filter_tracks(v("fx_tracks"))


@query("p17_remove_columns", "star_id ~f814w_rate #n", "SELECT star_id, f814w_rate, 4 AS n FROM fx_catalog")
def _band_columns(v):
    rows, left = K.remove_band_columns(v("fx_catalog"), ["HST_ACS_WFC_F475W", "HST_ACS_WFC_F814W"], ["f475w"])
    return rows.select("star_id", "f814w_rate", F.lit(len(rows.columns)).alias("n"))


@query("p17_remove_filters", "model_id ~first ~last #n", "SELECT model_id, f0 AS first, f2 AS last, 2 AS n FROM fx_models")
def _bands(v):
    rows, _ = K.remove_bands(v("fx_models").select("model_id", F.array("f0", "f1", "f2").alias("sed")), "sed", ["HST_WFC3_F275W", "HST_ACS_WFC_F475W", "HST_ACS_WFC_F814W"], ["f475w"])
    return rows.select("model_id", F.get("sed", F.lit(0)).alias("first"), F.element_at("sed", -1).alias("last"), F.size("sed").alias("n"))


@query("p22_erode_boundary", "star_id", "WITH b AS (SELECT min(ra)+0.0095e0 AS x0, max(ra)-0.0095e0 AS x1, min(decl)+0.0045e0 AS y0, max(decl)-0.0045e0 AS y1 FROM fx_stars) SELECT star_id FROM fx_stars, b WHERE ra BETWEEN x0 AND x1 AND decl BETWEEN y0 AND y1")
def _erode(v):
    return sky.inside_box(v("fx_stars"), 0.0095, 0.0045)


CORNERS = [(80.003, -68.997), (80.061, -68.991), (80.037, -68.961)]
SIDES = " AND ".join(f"(({bx - ax!r}e0)*(decl-({ay!r}e0))-({by - ay!r}e0)*(ra-({ax!r}e0)))/{((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5!r}e0>=0.0023e0" for (ax, ay), (bx, by) in zip(CORNERS, [*CORNERS[1:], CORNERS[0]], strict=True))


@query("p22_erode_hull", "star_id", f"SELECT star_id FROM fx_stars WHERE {SIDES}")
def _erode_hull(v):
    return v("fx_stars").where(sky.inside_hull(F.col("ra"), F.col("decl"), CORNERS, 0.0023)).select("star_id")


@query("p23_threshold_subset", "star_id", "SELECT star_id FROM fx_stars WHERE f0 BETWEEN 14 AND 20 AND f1>12")
def _window(v):
    return K.threshold_subset(K.region_subset(v("fx_stars"), {"f0": (14, 20)}), "f1", 12)


@query("w12_split_by_density", "star_id #sd_bin #sub", "WITH b AS (SELECT *, CAST(floor(f2/3e0) AS INT) AS sd_bin FROM fx_stars), r AS (SELECT *, row_number() OVER (PARTITION BY sd_bin ORDER BY f0, star_id) AS rn, count(*) OVER (PARTITION BY sd_bin) AS n FROM b) SELECT star_id, sd_bin, floor((rn-1)/ceil(n/ceil(n/7e0))) AS sub FROM r")
def _split(v):
    return K.even_chunks(K.density_bins(v("fx_stars"), "f2", 3.0), ["sd_bin"], ["f0", "star_id"], 7)


@query("w13_subdivide_by_density", "star_id #sd_bin #sub", "WITH b AS (SELECT *, CAST(floor(f2/2e0) AS INT) AS sd_bin FROM fx_stars) SELECT star_id, sd_bin, floor((row_number() OVER (PARTITION BY sd_bin ORDER BY f0, star_id)-1)/6e0) AS sub FROM b")
def _subdivide(v):
    return K.chunks(K.density_bins(v("fx_stars"), "f2", 2.0), ["sd_bin"], ["f0", "star_id"], 6)


@query("w14_split_simulated", "star_id #sub", "SELECT star_id, floor((row_number() OVER (ORDER BY f0, star_id)-1)/9e0) AS sub FROM fx_stars")
def _simulated(v):
    return K.chunks(v("fx_stars"), [], ["f0", "star_id"], 9)


@query("w15_split_asts", "star_id #sub", "SELECT star_id, floor((row_number() OVER (ORDER BY star_id)-1)/11e0) AS sub FROM fx_stars")
def _asts(v):
    return K.chunks(v("fx_stars"), [], ["star_id"], 11)


@query("a41_region_counts", "#region_x #region_y #n", "SELECT floor((ra-79.9995e0)/0.025e0) AS region_x, floor((decl+69.0005e0)/0.02e0) AS region_y, count(*) AS n FROM fx_stars GROUP BY ALL")
def _regions(v):
    from starmill.operators.summaries import region_counts

    return region_counts(v("fx_stars").withColumns({"x": (F.col("ra") - 79.9995) / 0.025, "y": (F.col("decl") + 69.0005) / 0.02}), F.col("x"), F.col("y"), 1.0)


@query("a45_fit_progress", "part #n #fitted state", "WITH c AS (SELECT star_id % 4 AS part, count(*) AS n, count(*) FILTER (WHERE star_id % 4=0 OR (star_id % 4=1 AND star_id % 3=0)) AS fitted FROM fx_stars GROUP BY ALL) SELECT part, n, fitted, CASE WHEN fitted>=n THEN 'done' WHEN fitted>0 THEN 'resume' ELSE 'run' END AS state FROM c")
def _progress(v):
    stars = v("fx_stars").withColumn("part", F.col("star_id") % 4)
    done = stars.where("part = 0 OR (part = 1 AND star_id % 3 = 0)").withColumn("pmax", F.lit(-1.0))
    return K.progress(done, stars, ["part"])


@query("w16_cumulative", "model_id ~below ~upto", "SELECT model_id, sum(weight) OVER w - weight AS below, sum(weight) OVER w AS upto FROM fx_models WINDOW w AS (ORDER BY model_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _cumulative(v):
    return samples.cumulative(v("fx_models"), "weight", "model_id", 300)


def drawn_sql(weight: str) -> str:
    """samples.sample_models() of 500 in SQL: a common table `drawn`."""
    u = f"{samples.offset(1)!r}e0"
    return f"""m AS (SELECT fx_models.model_id, {weight} AS w FROM fx_models JOIN fx_noise ON fx_noise.model_id=fx_models.model_id WHERE {weight}>0), c AS (SELECT *, sum(w) OVER (ORDER BY model_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(w) OVER () AS t FROM m),
r AS (SELECT model_id, CAST(greatest(ceil((upto-w)/t*500-{u}), 0) AS BIGINT) AS k0, CAST(least(ceil(upto/t*500-{u})-1, 499) AS BIGINT) AS k1 FROM c), drawn AS (SELECT model_id, unnest(range(k0, k1+1)) AS draw FROM r WHERE k0<=k1)"""


@query("s1_sample_models", "model_id #draw", f"WITH {drawn_sql('weight*c0*c1*c2')} SELECT model_id, draw FROM drawn")
def _s1(v):
    rows = v("fx_models").join(v("fx_noise"), "model_id")
    return samples.sample_models(rows, 500, F.col("weight") * F.col("c0") * F.col("c1") * F.col("c2"))


def normal_sql(seed: int) -> str:
    return f"sqrt(-2e0*ln({unit_sql(seed, 'model_id', 'draw')}))*cos(2e0*pi()*{unit_sql(seed + 1, 'model_id', 'draw')})"


@query("s1_observable_draws", "model_id #draw #grid", f"""WITH {drawn_sql('weight*greatest(c0, c1, c2)').replace('WHERE weight', 'WHERE (CAST(c0>0.75e0 AS INT)+CAST(c1>0.75e0 AS INT)+CAST(c2>0.75e0 AS INT))>=2 AND f1>=12e0 AND weight')},
p AS (SELECT fx_models.model_id, row_number() OVER (ORDER BY fx_models.model_id)-1 AS place, count(*) OVER () AS n FROM fx_models JOIN fx_noise ON fx_noise.model_id=fx_models.model_id WHERE (CAST(c0>0.75e0 AS INT)+CAST(c1>0.75e0 AS INT)+CAST(c2>0.75e0 AS INT))>=2 AND f1>=12e0),
e AS (SELECT draw, floor({unit_sql(7, 'draw')}*n) AS place FROM (SELECT DISTINCT n FROM p), range(200) r(draw)) SELECT model_id, draw, 0 AS grid FROM drawn UNION ALL SELECT model_id, draw, 1 FROM e JOIN p ON p.place=e.place""")
def _observable(v):
    rows, compl = v("fx_models").join(v("fx_noise"), "model_id"), ["c0", "c1", "c2"]
    limits = {"bands": 2, "least": 0.75, "flux_limit": ("f1", 12.0)}
    weighted = samples.simulated(rows, 500, compl, **limits).withColumn("grid", F.lit(0))
    even = samples.simulated(rows, 200, compl, weight=None, seed=7, **limits).withColumn("grid", F.lit(1))
    return weighted.select("model_id", "draw", "grid").unionByName(even.select("model_id", "draw", "grid"))


@query("s2_several_grids", "model_id #draw #grid", f"""WITH {drawn_sql('weight*greatest(c0, c1, c2)').replace('WHERE weight', 'WHERE fx_models.model_id % 2=0 AND c0>0 AND weight')},
{drawn_sql('weight*greatest(c0, c1, c2)').replace('WHERE weight', 'WHERE fx_models.model_id % 2=1 AND c0>0 AND weight').replace(repr(samples.offset(1)), repr(samples.offset(1001))).replace('m AS (', 'm2 AS (').replace('c AS (', 'c2_ AS (').replace('FROM m)', 'FROM m2)').replace('r AS (', 'r2 AS (').replace('FROM c)', 'FROM c2_)').replace('drawn AS (', 'drawn2 AS (').replace('FROM r WHERE', 'FROM r2 WHERE')}
SELECT model_id, draw, 0 AS grid FROM drawn UNION ALL SELECT model_id, draw, 1 FROM drawn2""")
def _several(v):
    rows = v("fx_models").join(v("fx_noise"), "model_id").where("c0 > 0")
    return samples.simulated_grids([rows.where("model_id % 2 = 0"), rows.where("model_id % 2 = 1")], 999, ["c0", "c1", "c2"])


@query("s2_synthetic_catalog", "model_id #draw ~obs_0 ~mag_0 ~obs_2", f"WITH {drawn_sql('weight*c0')}, o AS (SELECT d.model_id, draw, f0+b0+abs(e0)*{normal_sql(1).replace('model_id', 'd.model_id')} AS obs_0, f2+b2+abs(e2)*{normal_sql(5).replace('model_id', 'd.model_id')} AS obs_2 FROM drawn d JOIN fx_models m ON m.model_id=d.model_id JOIN fx_noise n ON n.model_id=d.model_id) SELECT *, CASE WHEN obs_0>0 THEN -2.5e0*log10(obs_0) ELSE 99.999e0 END AS mag_0 FROM o")
def _s2(v):
    rows = v("fx_models").join(v("fx_noise"), "model_id")
    drawn = samples.sample_models(rows, 500, F.col("weight") * F.col("c0"))
    return samples.synthetic_catalog(drawn, ["f0", "f1", "f2"], ["b0", "b1", "b2"], ["e0", "e1", "e2"])


@query("s3_thinned_sample", "model_id #draw", f"WITH {drawn_sql('weight')} SELECT d.model_id, draw FROM drawn d JOIN fx_noise n ON n.model_id=d.model_id WHERE {unit_sql(1, 'd.model_id', 'draw')}<=c0*c1*c2")
def _s3(v):
    rows = v("fx_models").join(v("fx_noise"), "model_id")
    return samples.thin(samples.sample_models(rows, 500, F.col("weight")), F.col("c0") * F.col("c1") * F.col("c2"))


@query("s4_pick_models", "~log_a #n", "WITH a AS (SELECT log_a, count(*) AS n FROM fx_models WHERE f0<20 GROUP BY log_a) SELECT log_a, least(n, 5)*3 AS n FROM a")
def _s4(v):
    return samples.pick_per_group(v("fx_models").where("f0 < 20"), ["log_a"], 5, 3).groupBy("log_a").agg(F.count(F.lit(1)).alias("n"))


#: Young ages get more stars per year than old ones (an exponential law), and a Salpeter law of the masses, not its means in bins.
AGE_PRIOR, AGE_SQL = (lambda a: np.exp(-(10.0 ** (a - 9)))), "exp(-power(10e0, log_a-9e0))"
SALPETER, SALPETER_SQL = (lambda m: m**-2.35), "power({m}, -2.35e0)"
STARS_SQL = f"""fm AS (SELECT * FROM fx_models WHERE m_ini<=20.5e0-3e0*(log_a-6e0)), e AS (SELECT min(m_ini) AS lo, max(m_ini) AS hi FROM fm), i AS (SELECT k, power(10e0, log10(lo)+(log10(hi)-log10(lo))/99e0*k) AS m FROM e, range(100) r(k)), j AS (SELECT *, {SALPETER_SQL.format(m='m')} AS p FROM i),
t AS (SELECT m AS a, lead(m) OVER (ORDER BY k) AS b, (p+lead(p) OVER (ORDER BY k))/2*(lead(m) OVER (ORDER BY k)-m) AS x, (m*p+lead(m*p) OVER (ORDER BY k))/2*(lead(m) OVER (ORDER BY k)-m) AS mx FROM j), z AS (SELECT sum(x) AS total, sum(mx)/sum(x) AS mean FROM t WHERE b IS NOT NULL),
g AS (SELECT log_a, min(m_ini) AS min_mass, max(m_ini) AS max_mass FROM fm GROUP BY log_a), y AS (SELECT *, lag(log_a) OVER (ORDER BY log_a) AS l, lead(log_a) OVER (ORDER BY log_a) AS u FROM g),
w AS (SELECT *, power(10e0, log_a+coalesce((u-log_a)/2, (log_a-l)/2))-power(10e0, log_a-coalesce((log_a-l)/2, (u-log_a)/2)) AS years FROM y), q AS (SELECT w.*, coalesce((SELECT sum(x) FROM t WHERE a>=min_mass*(1-1e-12) AND b<=max_mass*(1+1e-12)), 0)/total AS living, years*{AGE_SQL}*3e-6 AS formed, mean FROM w, z),
n AS (SELECT log_a, min_mass, max_mass, living, formed, formed*living AS mass, CAST(round_even(formed*living/mean, 0) AS BIGINT) AS stars FROM q)"""


def living_models(v):
    """Old ages have lost their massive stars."""
    return v("fx_models").where("m_ini <= 20.5e0 - 3e0 * (log_a - 6e0)")


def stars_of_ages(models):
    return samples.stars_per_age(models, "log_a", "m_ini", SALPETER, lambda a: 3e-6 * AGE_PRIOR(a))


@query("a43_stars_formed", "~log_a ~min_mass ~max_mass ~living ~formed ~mass #stars", f"WITH {STARS_SQL} SELECT * FROM n")
def _stars_formed(v):
    return stars_of_ages(living_models(v))


@query("s3_stratified_sample", "model_id ~log_a #draw", f"""WITH {STARS_SQL}, m AS (SELECT model_id, fm.log_a, weight AS w, stars, sum(weight) OVER (PARTITION BY fm.log_a) AS total, sum(weight) OVER (PARTITION BY fm.log_a ORDER BY model_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM fm JOIN n ON n.log_a=fm.log_a),
r AS (SELECT *, CAST(greatest(ceil((upto-w)/total*stars-{unit_sql(1, 'log_a')}), 0) AS BIGINT) AS k0, CAST(least(ceil(upto/total*stars-{unit_sql(1, 'log_a')})-1, stars-1) AS BIGINT) AS k1 FROM m), d AS (SELECT model_id, log_a, unnest(range(k0, k1+1)) AS draw FROM r WHERE k0<=k1)
SELECT d.* FROM d JOIN fx_noise ON fx_noise.model_id=d.model_id WHERE {unit_sql(2, 'd.model_id', 'draw')}<=greatest(c0, c1, c2)""")
def _stratified(v):
    drawn = samples.stratified_sample(living_models(v), "log_a", stars_of_ages(living_models(v)), F.col("weight"), rows_per_part=300)
    return samples.thin(drawn.join(v("fx_noise"), "model_id"), F.greatest("c0", "c1", "c2"), 2)


@query("s4_draws_per_age", "model_id ~log_a #draw #realization", f"""WITH m AS (SELECT model_id, log_a, row_number() OVER (PARTITION BY log_a ORDER BY model_id)-1 AS place, count(*) OVER (PARTITION BY log_a) AS n FROM fx_models WHERE f0<20),
g AS (SELECT DISTINCT log_a, n FROM m), d AS (SELECT log_a, n, draw, floor({unit_sql(1, 'log_a', 'draw')}*n) AS place FROM g, range(70) r(draw)) SELECT model_id, m.log_a, draw, realization FROM d JOIN m ON m.log_a=d.log_a AND m.place=d.place, range(3) r(realization)""")
def _draws(v):
    return samples.draw_per_group(v("fx_models").where("f0 < 20"), ["log_a"], 70, 3, rows_per_part=300)


BINNED = " UNION ALL ".join(f"SELECT model_id, {k} AS band, least(floor((f{k}-lo)/((hi-lo)/10)), 9) AS bin FROM fx_models, (SELECT min(f{k}) AS lo, max(f{k}) AS hi FROM fx_models)" for k in range(3))


@query("s5_flux_bin_models", "model_id", f"WITH b AS ({BINNED}), r AS (SELECT model_id, row_number() OVER (PARTITION BY band, bin ORDER BY {unit_sql(1, 'model_id')}, model_id) AS place FROM b) SELECT DISTINCT model_id FROM r WHERE place<=3")
def _s5(v):
    return samples.pick_by_flux_bins(v("fx_models"), ["f0", "f1", "f2"], 10, 3)


@query("s6_supplement", "#n #used", "SELECT least(40, count(*)) AS n, 0 AS used FROM fx_models WHERE model_id NOT IN (SELECT star_id FROM fx_stars)")
def _s6(v):
    more = samples.supplement(v("fx_models"), v("fx_stars").selectExpr("star_id AS model_id"), 40)
    both = more.join(v("fx_stars").selectExpr("star_id AS model_id", "1 AS hit"), "model_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("used"))


@query("s6_supplement_draws", "model_id #draw ~m0", f"""WITH a AS (SELECT model_id, 30e0-2.5e0*log10(f0) AS m0, 30e0-2.5e0*log10(f1) AS m1, 30e0-2.5e0*log10(f2) AS m2 FROM fx_models WHERE model_id NOT IN (SELECT star_id FROM fx_stars)),
c AS (SELECT *, row_number() OVER (ORDER BY model_id)-1 AS place, count(*) OVER () AS n FROM a WHERE m0 BETWEEN 26e0 AND 27.2e0 AND m1 BETWEEN 26e0 AND 28e0 AND m0-m1<=-0.15e0), d AS (SELECT draw, floor({unit_sql(1, 'draw')}*n) AS place FROM (SELECT DISTINCT n FROM c), range(400) r(draw)) SELECT model_id, draw, m0 FROM d JOIN c ON c.place=d.place""")
def _supplement_draws(v):
    mags = v("fx_models").select("model_id", *[(30 - 2.5 * F.log10(f"f{k}")).alias(f"m{k}") for k in range(3)])
    cuts = samples.within_cuts({"m0": (26.0, 27.2), "m1": (26.0, 28.0)}, {"m0": [("m1", -0.15)], "m2": [("m0", -9.0)]})
    return samples.supplement_draws(mags, v("fx_stars").selectExpr("star_id AS model_id"), 400, cuts)


@query("j20_positions_near_catalog", "star_id #k ~x ~y", f"WITH k AS (SELECT star_id, ra, decl, k FROM fx_stars, range(4) r(k)), p AS (SELECT star_id, k, ra, decl, sqrt(0.001e0*0.001e0+(0.002e0*0.002e0-0.001e0*0.001e0)*{unit_sql(1, 'star_id', 'k')}) AS r, 2e0*pi()*{unit_sql(2, 'star_id', 'k')} AS a FROM k) SELECT * FROM (SELECT star_id, k, ra+r*cos(a) AS x, decl+r*sin(a) AS y FROM p) WHERE x BETWEEN 80e0 AND 80.1e0 AND y BETWEEN -69e0 AND -68.96e0", 9)
def _j20(v):
    return samples.positions_near(v("fx_stars").selectExpr("star_id", "ra AS x", "decl AS y"), 4, 0.001, 0.002, (80.0, 80.1, -69.0, -68.96))


def clip_sql(name: str, table: str, corners) -> str:
    """Common tables <name>_1, ... that cut the polygons `poly` (lists of x and y) of a table along each side of a convex one in turn."""
    out = []
    for k, ((ax, ay), (bx, by)) in enumerate(zip(corners, [*corners[1:], corners[0]], strict=True), 1):
        side = lambda p: f"({bx - ax!r}e0*({p}.y-({ay!r}e0))-({by - ay!r}e0)*({p}.x-({ax!r}e0)))"  # noqa: E731,B023
        p, q = "poly[i]", "poly[i % len(poly) + 1]"
        cut = f"[{{'x': {p}.x+({q}.x-{p}.x)*({side(p)}/({side(p)}-{side(q)})), 'y': {p}.y+({q}.y-{p}.y)*({side(p)}/({side(p)}-{side(q)}))}}]"
        step = f"flatten(list_transform(range(1, len(poly)+1), lambda i: list_concat(CASE WHEN {side(p)}>=0 THEN [{p}] ELSE [] END, CASE WHEN {side(p)}*{side(q)}<0 THEN {cut} ELSE [] END)))"
        out.append(f"{name}_{k} AS (SELECT * EXCLUDE (poly), {step} AS poly FROM {table if k == 1 else f'{name}_{k - 1}'})")
    return ", ".join(out)


PLACE_KEYS = ["model_id", "realization", "h.bin"]


@query("j21_positions_from_map", "model_id #realization #bin ~ra ~decl", f"""WITH t AS (SELECT i.i AS i_ra, j.j AS i_dec FROM range(5) i(i), range(4) j(j)), c AS (SELECT {tile('ra+0.00005e0', RA)} AS i_ra, {tile('decl+0.00005e0', DEC)} AS i_dec, count(*) AS n FROM fx_stars GROUP BY ALL),
d AS (SELECT t.i_ra, t.i_dec, coalesce(n,0)/(0.0101e0*0.0101e0*cos(radians(-69e0+0.0101e0*(t.i_dec+0.5e0)))) AS value FROM t LEFT JOIN c USING (i_ra, i_dec)), e AS (SELECT min(value) AS lo, max(value) AS hi FROM d), b AS (SELECT i_ra, i_dec, CASE WHEN hi>lo THEN CAST(floor((value-(lo-0.01e0*(hi-lo)))/(1.02e0*(hi-lo)/3)) AS INT) ELSE 0 END AS bin FROM d, e),
w AS (SELECT *, 80e0+0.0101e0*i_ra AS x0, 80e0+0.0101e0*(i_ra+1) AS x1, -69e0+0.0101e0*i_dec AS y0, -69e0+0.0101e0*(i_dec+1) AS y1 FROM b), p AS (SELECT bin, i_ra, i_dec, [{{'x': x0, 'y': y0}}, {{'x': x1, 'y': y0}}, {{'x': x1, 'y': y1}}, {{'x': x0, 'y': y1}}] AS poly FROM w),
{clip_sql('clip', 'p', CORNERS)}, g AS (SELECT *, unnest(range(2, len(poly))) AS k FROM clip_3), h0 AS (SELECT bin, i_ra, i_dec, k, poly[1].x AS ax, poly[1].y AS ay, poly[k].x AS bx, poly[k].y AS by_, poly[k+1].x AS cx, poly[k+1].y AS cy FROM g),
h1 AS (SELECT *, ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))/2 AS area FROM h0), h2 AS (SELECT *, sum(area) OVER o / sum(area) OVER (PARTITION BY bin) AS hi, row_number() OVER (PARTITION BY bin ORDER BY i_ra DESC, i_dec DESC, k DESC) AS r FROM h1 WHERE area>0 WINDOW o AS (PARTITION BY bin ORDER BY i_ra, i_dec, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT *, CASE WHEN r=1 THEN 1e0 ELSE hi END AS up, coalesce(lag(hi) OVER (PARTITION BY bin ORDER BY i_ra, i_dec, k), 0e0) AS lo FROM h2), m AS (SELECT model_id, realization FROM fx_models, range(2) r(realization)),
x AS (SELECT model_id, realization, h.bin, h.* EXCLUDE (bin), {unit_sql(2, *PLACE_KEYS)} AS s0, {unit_sql(3, *PLACE_KEYS)} AS t0 FROM m JOIN h ON {unit_sql(1, *PLACE_KEYS)}>=lo AND {unit_sql(1, *PLACE_KEYS)}<up),
y AS (SELECT *, CASE WHEN s0+t0>1 THEN 1-s0 ELSE s0 END AS s, CASE WHEN s0+t0>1 THEN 1-t0 ELSE t0 END AS t FROM x) SELECT model_id, realization, bin, ax+s*(bx-ax)+t*(cx-ax) AS ra, ay+s*(by_-ay)+t*(cy-ay) AS decl FROM y""", 7)
def _j21(v):
    stars = v("fx_stars").withColumns({"ra": F.col("ra") + 0.00005, "decl": F.col("decl") + 0.00005})
    tiles = sky.bin_density_map(sky.source_density(stars, RA, DEC), 3)
    return samples.positions_in_tiles(v("fx_models"), tiles, 2, corners=CORNERS)


@query("a43_mass_formed", "~log_a ~share ~min_mass ~max_mass", "WITH a AS (SELECT log_a, min(m_ini) AS min_mass, max(m_ini) AS max_mass FROM fx_models GROUP BY log_a), y AS (SELECT *, power(10e0,log_a+0.25e0)-power(10e0,log_a-0.25e0) AS y FROM a) SELECT log_a, y/sum(y) OVER () AS share, min_mass, max_mass FROM y")
def _mass(v):
    return samples.mass_formed(v("fx_models"), "log_a", "m_ini", 0.6)
