"""Queries of table verbs, sources and set operations."""

from pyspark.sql import functions as F

from starmill.operators import tables as T
from starmill.operators import summaries
from starmill.plans.registry import query
from starmill.sources import tables as S


@query("p1_select", "f0 f1 f2", "SELECT f0, f1, f2 FROM fx_stars")
def _p1(v):
    return T.select(v("fx_stars"), r"f\d")


@query("p2_where", "model_id", "SELECT model_id FROM fx_models WHERE av>0.9e0 AND log_a<8e0")
def _p2(v):
    return T.where(v("fx_models"), "av > :a AND log_a < :b", a=0.9, b=8.0)


@query("p3_select_where", "av rv", "SELECT av, rv FROM fx_models WHERE av>1.1e0")
def _p3(v):
    return T.select_where(v("fx_models"), "av,rv", "av > :a", a=1.1)


@query("p4_evaluate", "model_id ~y", "SELECT model_id, sqrt(f0)*ln(f1)+abs(av-1) AS y FROM fx_models")
def _p4(v):
    return T.evaluate(v("fx_models"), "y", "sqrt(f0)*ln(f1)+abs(av-1)", "mag")


@query("p5_take", "model_id ~f0", "SELECT model_id, f0 FROM fx_models WHERE model_id IN (SELECT s_suppkey FROM supplier)")
def _p5(v):
    return T.take(v("fx_models"), "model_id", v("supplier").select("s_suppkey"))


@query("p6_columns", "model_id ~colour", "SELECT model_id, f0-f1 AS colour FROM fx_models")
def _p6(v):
    return T.evaluate(v("fx_models"), "colour", "f0-f1").drop("f0", "f1")


@query("p7_aliases", "id ~Flux0", "SELECT model_id AS id, f0 AS Flux0 FROM fx_models")
def _p7(v):
    return T.aliases(v("fx_models"), {"id": "model_id", "Flux0": "F0"})


@query("p8_units", "#n unit", "SELECT count(*) AS n, 'mag' AS unit FROM fx_models")
def _p8(v):
    df = T.evaluate(v("fx_models"), "y", "av", "mag").select("model_id", "y")
    return df.agg(F.count("y").alias("n")).withColumn("unit", F.lit(df.schema["y"].metadata["unit"]))


@query("j1_join_by", "model_id ~f0 ~fs ~ra", "SELECT m.model_id, m.f0, coalesce(s.f0,-1) AS fs, coalesce(ra,0) AS ra FROM fx_models m LEFT JOIN fx_stars s ON s.star_id=m.model_id")
def _j1(v):
    out = T.join_by(v("fx_models").select("model_id", "f0"), v("fx_stars").selectExpr("star_id AS model_id", "f0", "ra"), "model_id", "leftouter", ("_m", "_s"), {"f0_s": -1.0, "ra": 0.0})
    return out.withColumnsRenamed({"f0_m": "f0", "f0_s": "fs"})


@query("j2_match", "left_id right_id", "SELECT n_nationkey AS left_id, s_suppkey AS right_id FROM nation JOIN supplier ON s_nationkey=n_nationkey")
def _j2(v):
    return T.match(v("nation").withColumnRenamed("n_nationkey", "k").withColumn("a", F.col("k")), v("supplier").withColumnRenamed("s_nationkey", "k"), "k", "a", "s_suppkey")


@query("j8_anti_join", "model_id", "SELECT model_id FROM fx_models WHERE model_id NOT IN (SELECT s_suppkey FROM supplier)")
def _j8(v):
    return T.without(v("fx_models"), v("supplier").select(F.col("s_suppkey").alias("model_id")), "model_id").select("model_id")


@query("a27_stats", "field ~mean ~std ~min ~max ~p16 ~p50 has_nan", "WITH u AS (SELECT 'f0' AS field, f0 AS x FROM fx_models UNION ALL SELECT 'm_ini', m_ini FROM fx_models) SELECT field, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x,0.16) AS p16, median(x) AS p50, false AS has_nan FROM u GROUP BY field")
def _a27(v):
    return T.stats(v("fx_models"), ["f0", "m_ini"])


@query("a28_runs", "#run l_returnflag #first #last #n", "WITH o AS (SELECT l_returnflag, row_number() OVER w AS p, CASE WHEN l_returnflag IS NOT DISTINCT FROM lag(l_returnflag) OVER w AND row_number() OVER w>1 THEN 0 ELSE 1 END AS nw FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)), r AS (SELECT *, sum(nw) OVER (ORDER BY p) AS run FROM o) SELECT run, l_returnflag, min(p) AS first, max(p) AS last, count(*) AS n FROM r GROUP BY run, l_returnflag")
def _a28(v):
    return T.runs(v("lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"])


@query("a29_duplicates", "av rv #model_id #n", "SELECT av, rv, min(model_id) AS model_id, count(*) AS n FROM fx_models GROUP BY av, rv HAVING count(*)>1")
def _a29(v):
    return T.find_duplicates(v("fx_models"), ["av", "rv"], "model_id")


@query("a30_grid_metrics", "field ~min ~max ~median ~mean", "WITH s AS (SELECT abs(log_l-lag(log_l) OVER w) AS l, abs(log_t-lag(log_t) OVER w) AS t FROM fx_tracks WINDOW w AS (PARTITION BY z_id, mass_id ORDER BY eep)), u AS (SELECT 'log_l' AS field, l AS d FROM s UNION ALL SELECT 'log_t', t FROM s) SELECT field, min(d) AS min, max(d) AS max, median(d) AS median, avg(d) AS mean FROM u WHERE d IS NOT NULL GROUP BY field")
def _a30(v):
    return T.difference_metrics(v("fx_tracks"), ["log_l", "log_t"], ["z_id", "mass_id"], ["eep"])


@query("u1_stack", "id ~f0 ~ra", "SELECT model_id AS id, f0, 0e0 AS ra FROM fx_models UNION ALL SELECT star_id, f0, ra FROM fx_stars")
def _u1(v):
    return T.stack([v("fx_models").selectExpr("model_id AS id", "f0"), v("fx_stars").selectExpr("star_id AS id", "f0", "ra")], {"ra": 0.0})


@query("u2_merge_grids", "#n ~w", "SELECT count(*) AS n, sum(weight) AS w FROM fx_models")
def _u2(v):
    parts = [v("fx_models").where(F.col("model_id") % 3 == k) for k in range(3)]
    return T.stack(parts).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))


@query("u3_merge_stats", "star_id reorder_tag", "SELECT star_id, 'part' || CAST(star_id % 2 AS VARCHAR) AS reorder_tag FROM fx_stars")
def _u3(v):
    return T.stack([v("fx_stars").where(F.col("star_id") % 2 == k).withColumn("reorder_tag", F.lit(f"part{k}")) for k in range(2)])


@query("u4_unique_values", "~q", "SELECT DISTINCT av AS q FROM fx_models UNION SELECT DISTINCT rv FROM fx_models")
def _u4(v):
    return T.unique_values(v("fx_models"), ["av", "rv"])


@query("u5_positive_sets", "star_id", "SELECT star_id FROM fx_catalog WHERE f475w_rate>0 INTERSECT SELECT star_id FROM fx_catalog WHERE f814w_rate>0")
def _u5(v):
    return summaries.positive_in_all(v("fx_catalog"), ["f475w_rate", "f814w_rate"])


@query("u6_difference", "model_id", "SELECT model_id FROM fx_models EXCEPT SELECT star_id FROM fx_stars")
def _u6(v):
    return T.without(v("fx_models").select("model_id"), v("fx_stars").select(F.col("star_id").alias("model_id")), "model_id")


@query("u7_isochrone_stack", "track_row ~z", "SELECT track_row, CASE z_id WHEN 0 THEN 0.004e0 WHEN 1 THEN 0.008e0 WHEN 2 THEN 0.019e0 ELSE 0.03e0 END AS z FROM fx_tracks")
def _u7(v):
    t = v("fx_tracks")
    return T.stack([t.where(F.col("z_id") == k).withColumn("z", F.lit(z)) for k, z in enumerate((0.004, 0.008, 0.019, 0.03))])


@query("s7_sort", "#place model_id", "SELECT row_number() OVER (ORDER BY av, rv DESC, model_id)-1 AS place, model_id FROM fx_models")
def _s7(v):
    return T.row_ids(v("fx_models"), ["av", "-rv", "model_id"], "place", 300)


@query("w6_row_ids", "#row_id model_id", "SELECT row_number() OVER (ORDER BY f0, model_id)-1 AS row_id, model_id FROM fx_models")
def _w6(v):
    return T.row_ids(v("fx_models"), ["f0", "model_id"], rows_per_part=300)


@query("io4_read_obs", "star_id ~a ~b", "SELECT star_id, f475w_rate AS a, f814w_rate AS b FROM fx_catalog")
def _io4(v):
    return S.read_observations(v("fx_catalog"), ["F475W", "F814W"]).select("star_id", F.get("flux", F.lit(0)).alias("a"), F.get("flux", F.lit(1)).alias("b"))


@query("io5_read_columns", "~av ~z", "SELECT av, z FROM fx_models")
def _io5(v):
    return S.read_sed_data(v("fx_models"), ["av", "z"])


@query("io6_noise_band", "model_id ~error", "SELECT model_id, e1 AS error FROM fx_noise")
def _io6(v):
    noise = v("fx_noise").select("model_id", *[F.array(*[f"{n}{k}" for k in range(3)]).alias(c) for n, c in (("b", "bias"), ("e", "error"), ("c", "completeness"))])
    return S.read_noise_data(noise, ["error"], 1)


@query("io11_band_lookup", "#pos name #n_regionkey", "SELECT pos, name, n_regionkey FROM (VALUES (0,'FRANCE'),(1,'NOWHERE'),(2,'CHINA')) t(pos, name) LEFT JOIN nation ON n_name=name")
def _io11(v):
    return S.band_lookup(v("nation").selectExpr("n_name AS name", "n_regionkey"), ["FRANCE", "NOWHERE", "CHINA"])


@query("io12_import_tracks", "track_row #eep ~m_ini", "SELECT track_row, row_number() OVER (PARTITION BY mass_id ORDER BY track_row)-1 AS eep, max(log_l) OVER (PARTITION BY mass_id) AS m_ini FROM fx_tracks")
def _io12(v):
    return S.import_tracks(v("fx_tracks").drop("eep"), "mass_id", "track_row", "log_l")


@query("io13_append", "k", "SELECT s_suppkey AS k FROM supplier UNION SELECT c_custkey FROM customer")
def _io13(v):
    return S.append_rows(v("supplier").selectExpr("s_suppkey AS k"), v("customer").selectExpr("c_custkey AS k"), "k")


@query("io14_region_lines", "value", "SELECT printf('fk5;circle(%.6f,%.6f,0.5\") # color=%s', ra, decl, CASE WHEN star_id % 2 <> 0 THEN 'red' ELSE 'green' END) AS value FROM fx_stars")
def _io14(v):
    return S.region_lines(v("fx_stars").withColumn("flag", F.col("star_id") % 2), "ra", "decl", "flag")


@query("io15_flatten", "star_id ~RATE_A ~RATE_B ~MAG_A", 'SELECT star_id, f475w_rate AS "RATE_A", f814w_rate AS "RATE_B", f475w_vega AS "MAG_A" FROM fx_catalog')
def _io15(v):
    blocks = v("fx_catalog").select("star_id", F.array("f475w_rate", "f814w_rate").alias("rates"), F.array("f475w_vega").alias("mags"))
    return S.flat_catalogue(blocks, {"rates": ["rate_a", "rate_b"], "mags": ["mag_a"]}, "star_id")


@query("io16_load_tracks", "~feh #n", "WITH f AS (SELECT z_id*0.5e0-1 AS feh, count(*) AS n FROM fx_tracks GROUP BY ALL), g AS (SELECT *, lag(feh) OVER (ORDER BY feh) AS b, lead(feh) OVER (ORDER BY feh) AS a FROM f) SELECT feh, n FROM g WHERE feh BETWEEN -0.6e0 AND -0.4e0 OR a BETWEEN -0.6e0 AND -0.4e0 OR b BETWEEN -0.6e0 AND -0.4e0")
def _io16(v):
    return S.tracks_in_range(v("fx_tracks").withColumn("feh", F.col("z_id") * 0.5 - 1), "feh", -0.6, -0.4).groupBy("feh").agg(F.count(F.lit(1)).alias("n"))


@query("io17_load_isochrones", "~log_a ~z", "SELECT DISTINCT round(log_a,6) AS log_a, round(z,6) AS z FROM fx_models")
def _io17(v):
    return S.load_isochrones(v("fx_models"))
