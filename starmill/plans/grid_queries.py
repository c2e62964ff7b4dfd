"""Queries of grid building."""

import numpy as np
from pyspark.sql import functions as F

from starmill.functions import extinction
from starmill.operators import grids as G
from starmill.plans.registry import query

SPECTRA = "spec AS (SELECT vec_id, 1000e0+10*(i-1) AS wave, abs(CAST(embedding[i] AS DOUBLE)) AS flux FROM embeddings, range(1, 65) r(i))"


def spectra(v):
    return v("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).select("vec_id", (1000.0 + 10 * F.col("i")).alias("wave"), F.abs(F.col("e").cast("double")).alias("flux"))


def filters(v):
    spark = v("region").sparkSession
    return G.top_hat(spark, "A", 1100.0, 1300.0, 10.0).unionByName(G.top_hat(spark, "B", 1200.0, 1500.0, 10.0, photons=False))


FILTERS = "filt AS (SELECT 'A' AS band, 1100e0+10*i AS wave, 1100e0/(1100e0+10*i) AS throughput FROM range(20) r(i) UNION ALL SELECT 'B', 1200e0+10*i, 1e0 FROM range(30) r(i))"
NODES = "nodes AS (SELECT band, wave, throughput, {0}*(coalesce(wave-lag(wave) OVER w,0)+coalesce(lead(wave) OVER w-wave,0))/2 AS node FROM filt WINDOW w AS (PARTITION BY band ORDER BY wave))"


HATS = "filt AS (SELECT s_suppkey AS band, 1000e0+10*(s_suppkey % 40)+10*i AS wave, (1000e0+10*(s_suppkey % 40))/(1000e0+10*(s_suppkey % 40)+10*i) AS throughput FROM supplier, range(25) r(i) WHERE i<5+s_suppkey % 20)"


def hats(v):
    return G.top_hats(v("supplier").selectExpr("s_suppkey AS band", "1000e0+10*(s_suppkey % 40) AS start", "1000e0+10*(s_suppkey % 40)+10*(5+s_suppkey % 20) AS stop"), 10.0)


@query("m25_top_hat", "band ~wave ~throughput", f"WITH {HATS} SELECT * FROM filt")
def _hat(v):
    return hats(v)


@query("a44_filter_moments", "band ~norm ~cl ~lpivot", f"WITH {HATS}, {NODES.format('throughput')} SELECT band, sum(node) AS norm, sum(wave*node)/sum(node) AS cl, sqrt(sum(wave*node)/sum(node/wave)) AS lpivot FROM nodes GROUP BY band")
def _moments(v):
    return G.filter_moments(hats(v))


@query("a19_bandpass", "vec_id band ~flux", f"WITH {SPECTRA}, {FILTERS}, {NODES.format('throughput*wave')} SELECT vec_id, band, sum(flux*node)/sum(node) AS flux FROM spec JOIN nodes USING (wave) GROUP BY vec_id, band")
def _bandpass(v):
    return G.bandpass(spectra(v), filters(v), "vec_id")


@query("io10_read_filters", "band ~wave ~throughput", f"WITH {FILTERS}, g AS (SELECT DISTINCT 1000e0+7.3e0*p_partkey AS wave FROM part), s AS (SELECT band, wave AS w0, throughput AS t0, lead(wave) OVER w AS w1, lead(throughput) OVER w AS t1 FROM filt WINDOW w AS (PARTITION BY band ORDER BY wave)), x AS (SELECT s.band, g.wave, max(t0+(t1-t0)*(wave-w0)/(w1-w0)) AS throughput FROM g JOIN s ON wave>=w0 AND wave<=w1 GROUP BY ALL) SELECT b.band, g.wave, coalesce(throughput,0) AS throughput FROM g CROSS JOIN (SELECT DISTINCT band FROM filt) b LEFT JOIN x ON x.band=b.band AND x.wave=g.wave")
def _filters(v):
    waves = v("part").select((1000.0 + 7.3 * F.col("p_partkey")).alias("wave"))
    return G.resample(filters(v), waves)


@query("a20_gen_spectrum", "point #wave ~flux", f"WITH {SPECTRA}, w AS (SELECT n_nationkey AS point, k AS vec_id, (k+1)/10e0 AS w FROM nation, range(4) r(k)) SELECT point, wave, sum(w*flux) AS flux FROM w JOIN spec USING (vec_id) GROUP BY point, wave")
def _spectrum(v):
    w = v("nation").select(F.col("n_nationkey").alias("point"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("vec_id")).withColumn("w", (F.col("vec_id") + 1) / 10.0)
    return G.weighted_spectra(w, spectra(v), "point", "vec_id")


@query("p21_wave_range", "#n ~flux", f"WITH {SPECTRA} SELECT count(*) AS n, sum(flux) AS flux FROM spec WHERE 1e4/(3*wave-2000.5e0) BETWEEN 0.3e0 AND 1e1")
def _range(v):
    moved = spectra(v).withColumn("wave", 3 * F.col("wave") - 2000.5)
    return extinction.wave_range(moved, "ccm89").agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("flux"))


@query("j15_distance_grid", "model_id ~distance ~f0 ~f2", "SELECT model_id, d AS distance, f0/power(0.1e0*d,2) AS f0, f2/power(0.1e0*d,2) AS f2 FROM fx_models, (VALUES (20e0),(35e0)) t(d)")
def _distance(v):
    return G.distance_grid(v("fx_models").select("model_id", "f0", "f2"), [20, 35], ["f0", "f2"])


DUST = "d AS (SELECT av, rv, fa, 1/(1/(rv*fa)-(1-fa)/(fa*2.74e0)) AS rv_a FROM (VALUES (0e0),(0.5e0),(1e0)) a(av), (VALUES (2.2e0),(2.7e0),(3.1e0),(4.5e0)) r(rv), (VALUES (0.2e0),(0.6e0),(1e0)) f(fa) WHERE 1/rv>=fa/6e0+(1-fa)/2.74e0-1e-12 AND 1/rv<=fa/2e0+(1-fa)/2.74e0+1e-12)"


def ccm_sql(wave: float, rv: str) -> str:
    """Optical part of the law at one wavelength."""
    y = 1e4 / wave - 1.82
    a, b = (sum(c * y**k for k, c in enumerate(cs)) for cs in (extinction.CCM_A, extinction.CCM_B))
    return f"(({a!r}e0)+({b!r}e0)/{rv})"


def smc_sql(wave: float) -> str:
    knots = [*extinction.SMC_ANCHORS, *extinction.UV_ANCHORS]
    uv = lambda x: 1 + (extinction.SMC_UV[0] + extinction.SMC_UV[1] * x + extinction.SMC_UV[2] * x * x / ((x * x - extinction.SMC_X0**2) ** 2 + x * x * extinction.SMC_GAMMA**2)) / extinction.SMC_RV
    values, x = np.array([*extinction.SMC_VALUES, *[uv(k) for k in extinction.UV_ANCHORS]]), 1e4 / wave
    i = max(k for k in range(len(knots) - 1) if knots[k] <= x)
    c = extinction.spline_basis(knots)[i] @ values
    return f"({float(sum(v * (x - knots[i]) ** k for k, v in enumerate(c)))!r}e0)"


@query("j16_dust_grid", "model_id ~av ~rv ~f_a ~rv_a ~f1 ~f2", f"WITH {DUST} SELECT model_id, d.av, d.rv, fa AS f_a, d.rv_a, f1*exp(-d.av*(fa*{ccm_sql(4750.0, 'd.rv_a')}+(1-fa)*{smc_sql(4750.0)})) AS f1, f2*exp(-d.av*(fa*{ccm_sql(8140.0, 'd.rv_a')}+(1-fa)*{smc_sql(8140.0)})) AS f2 FROM d, fx_models m")
def _dust(v):
    models = v("fx_models").select("model_id", "f1", "f2")
    dust = G.dust_points(models.sparkSession, [0.0, 0.5, 1.0], [2.2, 2.7, 3.1, 4.5], [0.2, 0.6, 1.0])
    return G.dust_grid(models, dust, {"f1": 4750.0, "f2": 8140.0})


@query("j13_quadrant_nodes", "track_row #hot #dense #node ~d", "WITH p AS (SELECT track_row, log_t, log_l AS log_g FROM fx_tracks), n AS (SELECT star_id AS node, 3.5e0+0.0052e0*star_id AS n_t, 0.03e0*(star_id*7 % 100)+0.001e0 AS n_g FROM fx_stars), b AS (SELECT track_row, CASE WHEN n_t>=log_t THEN 1 ELSE 0 END AS hot, CASE WHEN n_g>=log_g THEN 1 ELSE 0 END AS dense, node, abs(n_t-log_t)+0.1e0*abs(n_g-log_g) AS d FROM p, n) SELECT track_row, hot, dense, arg_min(node, row(d, node)) AS node, min(d) AS d FROM b GROUP BY ALL")
def _quadrants(v):
    points = v("fx_tracks").select("track_row", "log_t", F.col("log_l").alias("log_g"))
    nodes = v("fx_stars").selectExpr("star_id AS node_id", "3.5e0+0.0052e0*star_id AS log_t", "0.03e0*(star_id*7 % 100)+0.001e0 AS log_g")
    return G.quadrant_nodes(points, nodes, "track_row", "node_id")


@query("b15_library_boundary", "~log_g ~left ~right", 'WITH g AS (SELECT mass_id*0.1e0 AS log_g, min(log_t)-0.1e0 AS l, max(log_t)+0.1e0 AS r FROM fx_tracks GROUP BY ALL) SELECT log_g, l AS "left", r AS "right" FROM g UNION ALL SELECT log_g-0.3e0, l, r FROM g WHERE log_g=(SELECT min(log_g) FROM g) UNION ALL SELECT log_g+0.3e0, l, r FROM g WHERE log_g=(SELECT max(log_g) FROM g)')
def _boundary(v):
    return G.library_boundary(v("fx_tracks").select((F.col("mass_id") * 0.1).alias("log_g"), "log_t"))


@query("j14_which_osl", "track_row #osl", "SELECT track_row, CASE WHEN log_t BETWEEN 3.595e0 AND 3.755e0 AND log_l BETWEEN 0.49e0 AND 1.51e0 THEN 1 WHEN log_t BETWEEN 3.545e0 AND 3.805e0 AND log_l BETWEEN -0.01e0 AND 2.01e0 THEN 2 WHEN log_t BETWEEN 3.575e0 AND 3.775e0 AND log_l BETWEEN 0.29e0 AND 1.71e0 THEN 1 WHEN log_t BETWEEN 3.525e0 AND 3.875e0 AND log_l BETWEEN -0.21e0 AND 2.21e0 THEN 2 ELSE 0 END AS osl FROM fx_tracks")
def _osl(v):
    e = 1e-9
    box = lambda a, b, c, d, pad=0.0: [(a - e - pad, c - e - 10 * pad), (b + e + pad, c - e - 10 * pad), (b + e + pad, d + e + 10 * pad), (a - e - pad, d + e + 10 * pad)]
    ends = [(3.595, 3.755, 0.49, 1.51), (3.545, 3.805, -0.01, 2.01)]
    padded = [box(3.575, 3.775, 0.29, 1.71), box(3.525, 3.875, -0.21, 2.21)]
    return v("fx_tracks").select("track_row", G.which_library(F.col("log_t"), F.col("log_l"), [box(*b) for b in ends], padded).alias("osl"))


SEG = "s AS (SELECT z_id, mass_id, eep AS x0, lead(eep) OVER w AS x1, log_l AS l0, lead(log_l) OVER w AS l1 FROM fx_tracks WINDOW w AS (PARTITION BY z_id, mass_id ORDER BY eep))"


@query("w7_regrid_masses", "z_id mass_id ~x ~log_l", f"WITH {SEG}, k AS (SELECT 0.5e0+1.7e0*i AS x FROM range(60) r(i)) SELECT z_id, mass_id, x, l0+(l1-l0)*(x-x0)/(x1-x0) AS log_l FROM (SELECT *, lead(x1) OVER (PARTITION BY z_id, mass_id ORDER BY x0) IS NULL AS final FROM s WHERE x1 IS NOT NULL) JOIN k ON x>=x0 AND (x<x1 OR x=x1 AND final)")
def _regrid(v):
    tracks = v("fx_tracks").withColumn("x", F.col("eep").cast("double"))
    return G.regrid(tracks, ["z_id", "mass_id"], "x", 1.7, 0.5, 0.5 + 1.7 * 59, ["log_l"])


@query("w8_regrid_metallicities", "mass_id ~x ~log_l", "WITH t AS (SELECT mass_id, eep*1e0 AS x, avg(log_l) AS l FROM fx_tracks GROUP BY ALL), s AS (SELECT mass_id, x AS x0, lead(x) OVER w AS x1, l AS l0, lead(l) OVER w AS l1 FROM t WINDOW w AS (PARTITION BY mass_id ORDER BY x)), k AS (SELECT 0.25e0+2.3e0*i AS x FROM range(40) r(i)) SELECT mass_id, k.x, l0+(l1-l0)*(k.x-x0)/(x1-x0) AS log_l FROM (SELECT *, lead(x1) OVER (PARTITION BY mass_id ORDER BY x0) IS NULL AS final FROM s WHERE x1 IS NOT NULL) s JOIN k ON k.x>=x0 AND (k.x<x1 OR k.x=x1 AND final)")
def _regrid_z(v):
    tracks = v("fx_tracks").groupBy("mass_id", F.col("eep").cast("double").alias("x")).agg(F.avg("log_l").alias("log_l"))
    return G.regrid(tracks, ["mass_id"], "x", 2.3, 0.25, 0.25 + 2.3 * 39, ["log_l"])


@query("w9_condense_grid", "track_row", """WITH RECURSIVE t AS (SELECT track_row, z_id, mass_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY z_id, mass_id) AS n, abs(log_l-lag(log_l) OVER w) AS dl, abs(log_t-lag(log_t) OVER w) AS dt FROM fx_tracks WINDOW w AS (PARTITION BY z_id, mass_id ORDER BY eep)),
f AS (SELECT track_row, z_id, mass_id, k, 0e0 AS sl, 0e0 AS st, true AS hit FROM t WHERE k=1 UNION ALL SELECT t.track_row, t.z_id, t.mass_id, t.k, CASE WHEN f.sl+dl>0.7e0 OR f.st+dt>0.5e0 OR t.k=n-1 THEN 0e0 ELSE f.sl+dl END, CASE WHEN f.sl+dl>0.7e0 OR f.st+dt>0.5e0 OR t.k=n-1 THEN 0e0 ELSE f.st+dt END, f.sl+dl>0.7e0 OR f.st+dt>0.5e0 OR t.k=n-1 FROM f JOIN t ON t.z_id=f.z_id AND t.mass_id=f.mass_id AND t.k=f.k+1)
SELECT track_row FROM f WHERE hit""")
def _condense(v):
    return G.condense(v("fx_tracks"), ["z_id", "mass_id"], "eep", "log_l", "log_t", 0.7, 0.5)


@query("w10_densify", "z_id mass_id eep #k ~log_l", "WITH s AS (SELECT z_id, mass_id, eep, log_l, lead(log_l) OVER w AS l1, lead(eep) OVER w AS e1 FROM fx_tracks WINDOW w AS (PARTITION BY z_id, mass_id ORDER BY eep)), n AS (SELECT *, CASE WHEN e1 IS NULL THEN 0 ELSE CAST(floor(abs(l1-log_l)/0.151e0) AS INT) END AS n FROM s), x AS (SELECT *, unnest(range(0, n+1)) AS k FROM n) SELECT z_id, mass_id, eep, k, coalesce(log_l+(l1-log_l)*k/(n+1), log_l) AS log_l FROM x")
def _densify(v):
    return G.densify(v("fx_tracks"), ["z_id", "mass_id"], "eep", {"log_l": 0.151}, ["log_l"])


@query("j17_iso_age_interp", "z_id #place ~log_l ~log_t", """WITH g AS (SELECT list(DISTINCT eep) AS e FROM fx_tracks), h AS (SELECT list_sort(list_filter(e, lambda x: x<=12.3e0), 'DESC') AS lo, list_sort(list_filter(e, lambda x: x>12.3e0)) AS hi FROM g),
c AS (SELECT CASE WHEN len(lo)>0 THEN lo[1] ELSE hi[1] END AS a0, CASE WHEN len(lo)>0 AND len(hi)>0 THEN hi[1] WHEN len(lo)>0 THEN coalesce(lo[2], lo[1]) ELSE coalesce(hi[2], hi[1]) END AS a1 FROM h), a AS (SELECT *, row_number() OVER (PARTITION BY z_id, eep ORDER BY track_row) AS place FROM fx_tracks),
t AS (SELECT a0, a1, CASE WHEN a1=a0 THEN 0e0 ELSE (12.3e0-a0)/(a1-a0) END AS t FROM c) SELECT x.z_id, x.place, x.log_l*(1-t)+y.log_l*t AS log_l, x.log_t*(1-t)+y.log_t*t AS log_t FROM t JOIN a x ON x.eep=a0 JOIN a y ON y.eep=a1 AND x.z_id=y.z_id AND x.place=y.place""")
def _ages(v):
    tracks = v("fx_tracks").withColumn("age", F.col("eep").cast("double"))
    return G.between_ages(tracks, ["z_id"], "age", 12.3, "track_row", ["log_l", "log_t"])


@query("j18_regrid_eep", "mass_id ~x ~log_l", "WITH t AS (SELECT mass_id, eep*1e0 AS x, max(log_l) AS l FROM fx_tracks GROUP BY ALL), s AS (SELECT mass_id, x AS x0, lead(x) OVER w AS x1, l AS l0, lead(l) OVER w AS l1 FROM t WINDOW w AS (PARTITION BY mass_id ORDER BY x)), k AS (SELECT 3.37e0+9.1e0*i AS x FROM range(9) r(i)) SELECT mass_id, k.x, l0+(l1-l0)*(k.x-x0)/(x1-x0) AS log_l FROM (SELECT *, lead(x1) OVER (PARTITION BY mass_id ORDER BY x0) IS NULL AS final FROM s WHERE x1 IS NOT NULL) s JOIN k ON k.x>=x0 AND (k.x<x1 OR k.x=x1 AND final)")
def _eep(v):
    tracks = v("fx_tracks").groupBy("mass_id", F.col("eep").cast("double").alias("x")).agg(F.max("log_l").alias("log_l"))
    return G.regrid(tracks, ["mass_id"], "x", 9.1, 3.37, 3.37 + 9.1 * 8, ["log_l"])


def corner(a: str, x: str) -> str:
    return f"CASE WHEN {a}_1>{a}_0 THEN CASE WHEN l.{x}={a}_1 THEN ({a}-{a}_0)/({a}_1-{a}_0) ELSE 1-({a}-{a}_0)/({a}_1-{a}_0) END ELSE 1 END"


@query("j18_lattice_interp", "star_id ~f0", f"""WITH l AS (SELECT z, log_a, m_ini, avg(f0) AS f0 FROM fx_models GROUP BY ALL), p AS (SELECT star_id, 0.004e0+0.00025e0*(star_id % 101) AS za, 6e0+0.0397e0*(star_id % 99) AS aa, 0.5e0+0.19e0*(star_id % 97) AS ma FROM fx_stars),
c AS (SELECT *, (SELECT max(z) FROM l WHERE z<=za) AS za_0, (SELECT min(z) FROM l WHERE z>=za) AS za_1, (SELECT max(log_a) FROM l WHERE log_a<=aa) AS aa_0, (SELECT min(log_a) FROM l WHERE log_a>=aa) AS aa_1, (SELECT max(m_ini) FROM l WHERE m_ini<=ma) AS ma_0, (SELECT min(m_ini) FROM l WHERE m_ini>=ma) AS ma_1 FROM p),
j AS (SELECT star_id, f0, ({corner('za', 'z')})*({corner('aa', 'log_a')})*({corner('ma', 'm_ini')}) AS w FROM c JOIN l ON (l.z=za_0 OR l.z=za_1) AND (l.log_a=aa_0 OR l.log_a=aa_1) AND (l.m_ini=ma_0 OR l.m_ini=ma_1)) SELECT star_id, sum(w*f0) AS f0 FROM j WHERE w>0 GROUP BY star_id HAVING sum(w)>1-1e-9""")
def _lattice(v):
    lattice = v("fx_models").groupBy("z", "log_a", "m_ini").agg(F.avg("f0").alias("f0"))
    points = v("fx_stars").selectExpr("star_id", "0.004e0+0.00025e0*(star_id % 101) AS z", "6e0+0.0397e0*(star_id % 99) AS log_a", "0.5e0+0.19e0*(star_id % 97) AS m_ini")
    return G.lattice_interp(points, lattice, ["z", "log_a", "m_ini"], ["f0"], "star_id")


@query("j13_atmosphere_interp", "star_id node ~w", f"""WITH l AS (SELECT z, 3.5e0+0.02e0*weight AS t, rv AS g, min(model_id) AS node FROM fx_models GROUP BY ALL), p AS (SELECT star_id, 0.004e0+0.00025e0*(star_id % 101) AS za, 3.521e0+0.00079e0*(star_id % 97) AS ta, 2.01e0+0.0297e0*(star_id % 98) AS ga FROM fx_stars),
c AS (SELECT *, (SELECT max(z) FROM l WHERE z<=za) AS za_0, (SELECT min(z) FROM l WHERE z>=za) AS za_1, (SELECT max(t) FROM l WHERE t<=ta) AS ta_0, (SELECT min(t) FROM l WHERE t>=ta) AS ta_1, (SELECT max(g) FROM l WHERE g<=ga) AS ga_0, (SELECT min(g) FROM l WHERE g>=ga) AS ga_1 FROM p),
j AS (SELECT star_id, node, ({corner('za', 'z')})*({corner('ta', 't')})*({corner('ga', 'g')}) AS w FROM c JOIN l ON (l.z=za_0 OR l.z=za_1) AND (l.t=ta_0 OR l.t=ta_1) AND (l.g=ga_0 OR l.g=ga_1)) SELECT star_id, node, w FROM j WHERE w>0""")
def _atmosphere(v):
    nodes = v("fx_models").groupBy("z", (3.5 + 0.02 * F.col("weight")).alias("log_t"), F.col("rv").alias("log_g")).agg(F.min("model_id").alias("node"))
    points = v("fx_stars").selectExpr("star_id", "0.004e0+0.00025e0*(star_id % 101) AS z", "3.521e0+0.00079e0*(star_id % 97) AS log_t", "2.01e0+0.0297e0*(star_id % 98) AS log_g")
    return G.atmosphere_interp(points, nodes, "star_id", "node")
