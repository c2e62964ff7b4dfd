"""Literal vectors, properties and errors of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmill.functions import columns as C
from starmill.functions import priors
from starmill.operators import catalogues, covariances, fit, grids, merge, samples, sky, tables, trim, weights
from starmill.plans.fixtures import view
from starmill.sources import tables as sources
from starmill.streaming.fits import fit_stream

SF = "/root/testdata/sf0.001"
PARAMS = ["av", "rv", "log_a"]


def axis(spark, values):
    return spark.createDataFrame([(float(x),) for x in values], "x double")


# What these weights, boundaries and priors have to come to.
@pytest.mark.parametrize(
    ("values", "log", "want"),
    [
        ([6, 7, 8, 9, 10], True, [4.500045e-04, 4.500045e-03, 4.500045e-02, 4.500045e-01, 4.500045]),
        ([1, 2, 5, 7, 10, 30], False, [0.15189873, 0.30379747, 0.37974684, 0.37974684, 1.74683544, 3.03797468]),
        ([0.03, 0.019, 0.008, 0.004], False, [1.31343284, 1.31343284, 0.89552239, 0.47761194]),
        ([10, 100, 1000], False, [0.18181818, 1, 1.81818182]),
        ([5], False, [0]),
    ],
)
def test_grid_weight(spark, values, log, want):
    got = {r.x: r.grid_weight for r in weights.grid_weight(axis(spark, values), "x", log=log).collect()}
    assert np.allclose([got[float(v)] for v in values], want, rtol=1e-6)


def test_boundaries(spark):
    rows = weights.bin_boundaries(axis(spark, [1, 2, 5, 10, 50]), "x").orderBy("x").collect()
    assert np.allclose([r.lo for r in rows] + [rows[-1].hi], [0.5, 1.5, 3.5, 7.5, 30, 70])


def test_priors():
    # fixed values, as above
    x = np.array([6.0, 7, 8, 9, 10])
    assert np.allclose(priors.prior("age", "flat_log", x), [9.00009e-01 / 10**k for k in range(5)], atol=1e-6)
    assert np.allclose(priors.prior("age", "bins_histo", x, x_bins=[6, 7, 8, 9, 10], values=[1, 2, 1, 5]), [1, 2, 1, 5, 0])
    assert np.allclose(priors.prior("age", "exponential", x, tau=0.1), [0.9900498, 0.9048374, 0.3678794, 4.539993e-05, 0], atol=1e-6)
    m = np.arange(1.0, 6)
    assert np.allclose(priors.prior("mass", "salpeter", m), [4.02338441, 0.58842044, 0.21633931, 0.10825509, 0.06360075], atol=1e-6)
    assert np.allclose(priors.prior("mass", "kroupa", m), [3.97740709, 0.60861986, 0.22874078, 0.11618704, 0.06904523], atol=1e-6)
    assert np.allclose(priors.prior("distance", "absexponential", [53e3, 60e3, 69e3], dist0=60e3, tau=5e3), [0.246597, 1, 0.165299], atol=1e-6)
    assert np.allclose(priors.prior("dust", "lognormal", [0, 2, 4, 6, 8, 10], mean=2, sigma=1)[0], 0)
    with pytest.raises(ValueError):
        priors.prior("met", "salpeter", x)
    with pytest.raises(ValueError):
        priors.prior("age", "bins_interp", x, x_bins=[7, 10], values=[1, 2])


def test_symlog(spark):
    y = [-1e-10, -1e-19, -1e-20, -1e-24, 0.0, 1e-19]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in y], "y double").select(C.symlog(F.col("y"))).collect()]
    assert np.allclose(got, [-10, -1.04139269, -0.301029996, -4.34272769e-05, 0, 1.04139269])


def test_sexagesimal_carries(spark):
    df = spark.createDataFrame([(14.9999999999, -0.00000001)], "ra double, dec double")
    assert tuple(df.select(C.deg2hms(F.col("ra")).alias("a"), C.deg2dms(F.col("dec")).alias("b")).first()) == ("01:00:00.000", "00:00:00.000")
    assert df.select(C.iau_name(F.lit(None).cast("double"), F.col("dec"), "S")).first()[0] == "noname"


def test_rotations_are_inverse(spark):
    df = spark.createDataFrame([(10.0, 20.0), (266.0, -29.0), (359.0, 89.0)], "ra double, dec double")
    for there, back in ((C.equatorial_to_galactic, C.galactic_to_equatorial), (C.equatorial_to_ecliptic, C.ecliptic_to_equatorial)):
        l, b = there(F.col("ra"), F.col("dec"))  # noqa: E741
        x, y = back(F.col("l"), F.col("b"))
        for r in df.withColumn("l", l).withColumn("b", b).select("ra", "dec", x.alias("x"), y.alias("y")).collect():
            assert np.allclose([r.ra, r.dec], [r.x, r.y], atol=1e-6)


def fitted(spark, models=None):
    v = lambda n: view(spark, SF, n)
    ready = fit.positive_weight(fit.attach_noise(v("fx_models"), v("fx_noise")))
    return v("fx_stars"), ready


def test_fit_properties(spark):
    v = lambda n: view(spark, SF, n)
    out = fit.fit(v("fx_stars"), v("fx_models"), v("fx_noise"), PARAMS)
    assert all(abs(r.s - 1) < 1e-9 for r in out["pdf1d"].groupBy("star_id", "param").agg(F.sum("p").alias("s")).collect())
    assert all(abs(r.s - 1) < 1e-9 for r in out["pdf2d"].groupBy("star_id", "p1", "p2").agg(F.sum("p").alias("s")).collect())
    for r in out["stats"].collect():
        for p in PARAMS:
            assert r[f"{p}_p16"] <= r[f"{p}_p50"] <= r[f"{p}_p84"]
    best = out["stats"].selectExpr("star_id", "pmax_indx AS model_id")
    assert best.join(out["lnp"], ["star_id", "model_id"], "left_anti").isEmpty()


def test_fit_equals_merged_parts(spark):
    stars, ready = fitted(spark)
    whole = {r.star_id: r for r in fit.summary(fit.sparse(stars, ready, PARAMS, -60.0), PARAMS).collect()}
    parts = [fit.summary(fit.sparse(stars, ready.where(F.col("model_id") % 3 == k), PARAMS, -60.0), PARAMS).withColumn("subgrid", F.lit(k)) for k in range(3)]
    for r in merge.merge_stats(tables.stack(parts), PARAMS, 3).collect():
        w = whole[r.star_id]
        assert np.allclose([r.pmax, r.chi2min, r.total_log_norm, r.av_exp], [w.pmax, w.chi2min, w.total_log_norm, w.av_exp], rtol=1e-6)


def test_cartesian_equals_broadcast(spark):
    stars, ready = fitted(spark)
    few = stars.select("star_id", "f0", "f1", "f2")
    one, two = (fit.stars_to_models(few, fit.prepare(ready, ()), (), most=m).agg(F.sum("lnp"), F.count("lnp")).first() for m in (10**6, 1))
    assert one[1] == two[1] and np.isclose(one[0], two[0])


def test_percentile_errors(spark):
    stars, ready = fitted(spark)
    with pytest.raises(ValueError):
        fit.weighted_percentile(ready, "z", "av", "weight", [101])


def test_trim_skips_a_hopeless_band(spark):
    v = lambda n: view(spark, SF, n)
    models, far = fit.attach_noise(v("fx_models"), v("fx_noise")), v("fx_stars").withColumn("f1", F.lit(1e9))
    assert trim.trim_models(models, far).count() > 0
    with pytest.raises(ValueError):
        trim.trim_models(models, far, strict=True)


def test_hull_and_polygon(spark):
    points = spark.createDataFrame([(float(x), float(y)) for x in range(5) for y in range(4)], "x double, y double")
    assert sorted(map(tuple, sky.hull_of(points, "x", "y").collect())) == [(0, 0), (0, 3), (4, 0), (4, 3)]
    inside = points.where(sky.in_polygon(F.col("x"), F.col("y"), [(0.5, 0.5), (3.5, 0.5), (3.5, 2.5), (0.5, 2.5)]))
    assert inside.count() == 6


def test_match_across_zero_and_poles(spark):
    a = spark.createDataFrame([(1, 359.9999, 0.0), (2, 10.0, 89.9999), (3, 50.0, 0.0)], "star_id long, ra double, decl double")
    b = spark.createDataFrame([(7, 0.0001, 0.0), (8, 190.0, 89.9999)], "star_id long, ra double, decl double")
    got = {r.left_id: r.right_id for r in sky.nearest_match(a, b, 0.001, "star_id", "star_id").collect()}
    assert got == {1: 7, 2: 8, 3: None}


def test_remove_bands(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "sed array<double>")
    bands = ["HST_WFC3_F475W", "HST_ACS_WFC_F475W", "HST_ACS_WFC_F814W"]
    rows, left = catalogues.remove_bands(df, "sed", bands, ["F814W"])
    assert rows.first().sed == [1, 2] and left == bands[:2]
    rows, left = catalogues.remove_bands(df, "sed", bands, ["HST_ACS_WFC_F475W"])
    assert rows.first().sed == [1, 3]
    with pytest.raises(ValueError):
        catalogues.remove_bands(df, "sed", bands, ["F475W"])


def test_condense_keeps_first_and_last_but_one(spark):
    rows = [(1, k, 0.1 * k, 3.0) for k in range(20)]
    got = grids.condense(spark.createDataFrame(rows, "track int, eep int, l double, t double"), ["track"], "eep", "l", "t", 0.55, 9.0)
    kept = sorted(r.eep for r in got.collect())
    assert kept[0] == 0 and 18 in kept and np.all(np.diff(kept[:-1]) <= 6)


def test_weighted_draws_follow_the_weights(spark):
    models = spark.range(50).select(F.col("id").alias("model_id"), (F.col("id") % 5 + 1).cast("double").alias("w"))
    got = samples.sample_models(models, 15000, F.col("w")).groupBy("w").count().collect()
    assert all(abs(r["count"] - 1000 * r.w) < 60 for r in got) and sum(r["count"] for r in got) == 15000


def test_row_ids_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [r.row_id for r in tables.row_ids(df, ["k"], rows_per_part=90).orderBy("k").collect()] == list(range(1000))


def test_inverse_covariance(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0, 3.0, 1.0, 1.0)], "model_id long, cov_0_0 double, cov_0_1 double, cov_1_1 double, flux_0 double, flux_1 double")
    r = covariances.trunchen_noise(df, 2).first()
    inv = np.linalg.inv([[4, 1], [1, 3]])
    assert np.allclose(r.icov_diag, np.diag(inv)) and np.allclose(r.icov_off, inv[0, 1]) and np.isclose(r.q_norm, -0.5 * np.log(11))


def test_files_come_back(spark, tmp_path):
    models = merge.split_grid(view(spark, SF, "fx_models"), 3)
    bands = spark.createDataFrame([("f0", 1.0)], "name string, wave double")
    sources.write_grid(models, bands, f"{tmp_path}/grid")
    back, _ = sources.read_grid(spark, f"{tmp_path}/grid", ["model_id", "f0"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, models.select("model_id", "f0").collect()))
    for kind in ("csv", "json", "orc"):
        sources.write_table(bands, f"{tmp_path}/bands.{kind}")
        assert sources.read_table(spark, f"{tmp_path}/bands.{kind}", None if kind == "orc" else "name string, wave double").collect() == bands.collect()
    with pytest.raises(ValueError):
        sources.read_noise(spark, f"{tmp_path}/grid/models.parquet")


def test_stream_resumes(spark, tmp_path):
    stars, ready = fitted(spark)
    stars.where("star_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: fit_stream(spark, f"{tmp_path}/in", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stars.schema), ready, PARAMS, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    stars.where("star_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert first == stars.where("star_id % 2 = 0").count() and got.count() == stars.count() == got.select("star_id").distinct().count()


def test_hull_of_partitions(spark):
    """Only corners meet in one task: the hulls of the partitions come before the exchange."""
    df = spark.range(0, 900, 1, 6).selectExpr("id % 30 AS x", "floor(id / 30) AS y")
    hull = sky.hull_of(df, "x", "y")
    assert "SinglePartition" in hull._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, hull.collect())) == [(0, 0), (0, 29), (29, 0), (29, 29)]


def test_running_sums_follow_the_order(spark):
    from starmill.operators import samples

    df = spark.range(1000).select((999 - F.col("id")).alias("k"), F.lit(1.0).alias("w")).repartition(5)
    got = [(r.below, r.upto) for r in samples.cumulative(df, "w", "k", rows_per_part=70).orderBy("k").collect()]
    assert got == [(float(k), float(k + 1)) for k in range(1000)]


def test_ranges_of_mixed_orders(spark):
    rows = [(k % 3, None if k % 10 == 0 else float(k % 7), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b double, c int").repartition(4)
    got = [r.c for r in tables.row_ids(df, ["a", "-b", "c"], rows_per_part=20).orderBy("row_id").collect()]
    assert got == [c for _, _, c in sorted(rows, key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2]))]
    assert tables.row_ids(df.limit(0), ["a"]).isEmpty()


def test_splines_of_extinction_laws(spark):
    """Not-a-knot cubics give a cubic back, pass through the anchors, and meet the ultraviolet forms without a step."""
    from starmill.functions import extinction as X

    knots = [0.0, 0.4, 1.0, 1.5, 2.7, 3.1]
    cubic = lambda x: 1 - 2 * x + 0.3 * x**2 - 0.7 * x**3
    at = spark.range(32).select((F.col("id") / 10.0).alias("x"))
    for r in at.select("x", X.spline(F.col("x"), knots, [cubic(k) for k in knots]).alias("y")).collect():
        assert abs(r.y - cubic(r.x)) < 1e-9
    waves = spark.createDataFrame([(1e4 / x,) for x in (0.2, 0.3, *X.SMC_ANCHORS[1:], 1e4 / 2700 - 1e-9, 1e4 / 2700 + 1e-9, 10.0, 10.1)], "wave double")
    got = waves.select("wave", X.g03_smc(F.col("wave")).alias("smc"), X.f99(F.col("wave"), 3.1).alias("f99"), X.f99(F.col("wave"), F.lit(5.0)).alias("f99_5")).collect()
    assert got[0].smc is None and got[-1].f99 is None and got[1].f99 is not None
    assert all(abs(r.smc - v) < 1e-9 for r, v in zip(got[2:10], X.SMC_VALUES[1:], strict=True))
    assert all(abs(got[10][c] - got[11][c]) < 1e-6 for c in ("smc", "f99", "f99_5"))
    v = waves.select(X.f99(F.lit(1e4 / 1.82), 3.1).alias("v")).first().v
    assert abs(v - 1) < 0.03 and X.wave_range(waves, "f99").count() == waves.count() - 2


def test_registered_noise_models(spark):
    from starmill.operators import noise

    models = spark.createDataFrame([(1, 10.0), (2, 20.0)], "model_id long, f double")
    assert [(r.bias, r.error, r.completeness) for r in noise.noise_model("splinter", models, None, "f", fraction=0.5).orderBy("model_id").collect()] == [(0.0, 5.0, 1.0), (0.0, 10.0, 1.0)]
    noise.register("flat")(lambda m, asts, flux: m.select("model_id", F.lit(0.0).alias("bias"), F.lit(1.0).alias("error"), F.lit(1.0).alias("completeness")))
    assert noise.noise_model("flat", models, None, "f").count() == 2
    with pytest.raises(ValueError):
        noise.noise_model("nothing", models, None, "f")


def test_extension_points(spark):
    from starmill.operators import grids

    df = spark.createDataFrame([(1, 100.0, -2.0), (2, 1000.0, 3.0)], "k long, f double, g double")
    assert [r.y for r in df.select(tables.expression("np.log10(f)**2 + where(g > :limit, 1, 0)", limit=0).alias("y")).collect()] == [4.0, 10.0]
    assert [r.k for r in df.where(tables.expression("(f == 100) | (g > 2) & ~(k == 1)")).collect()] == [1, 2]
    out = tables.callables(df, [lambda d: d.withColumn("h", F.col("f") * 2), lambda d: d.withColumn("i", F.col("h") + 1)])
    assert [r.i for r in out.orderBy("k").collect()] == [201.0, 2001.0]
    assert [r.c for r in df.select(tables.elementwise(lambda x: x.clip(0, 500))(F.col("f")).alias("c")).collect()] == [100.0, 500.0]
    both = grids.stack_libraries(df, df.drop("g"))
    assert sorted((r.library, r.k) for r in both.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_fit_products_together(spark, tmp_path):
    from starmill.sources import tables as S

    products = {n: spark.createDataFrame([(k, k % 2) for k in range(4)], "star_id long, sub int") for n in ("stats", "pdf1d", "pdf2d", "lnp")}
    S.write_fit(products, f"{tmp_path}/fit", ["sub"])
    back = S.read_fit(spark, f"{tmp_path}/fit")
    assert all(sorted(r.star_id for r in df.collect()) == [0, 1, 2, 3] for df in back.values()) and (tmp_path / "fit" / "lnp.parquet" / "sub=1").exists()


def test_described_text(spark, tmp_path):
    from starmill.sources import tables as S

    (tmp_path / "t.txt").write_text("# a comment\n## mass Msun initial mass\n# alias M = mass\nmass  age\n1.0 7\n\n2.5  8\n")
    df, aliases = S.read_described(spark, f"{tmp_path}/t.txt")
    assert aliases == {"M": "mass"} and df.schema["mass"].metadata == {"unit": "Msun", "comment": "initial mass"}
    assert sorted(tuple(r) for r in df.collect()) == [("1.0", "7"), ("2.5", "8")]


def test_hull_overlap():
    from starmill.operators.sky import clipped_area, convex_hull

    triangle = convex_hull(np.array([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]))
    assert abs(clipped_area((0, 4, 0, 4), triangle) - 8) < 1e-12 and abs(clipped_area((1, 2, 1, 2), triangle) - 1) < 1e-12
    assert clipped_area((3, 4, 3, 4), triangle) == 0 and abs(clipped_area((-1, 1, -1, 1), triangle) - 1) < 1e-12


def test_atmosphere_weights(spark):
    """Against the rules one point at a time; the blend gives back a function linear in t, g and z inside a full cell."""
    rng = np.random.default_rng(4)
    nodes = [(k, z, float(t), float(g)) for k, (z, t, g) in enumerate((z, t, g) for z in (0.01, 0.02) for t in (3.5, 3.6, 3.7) for g in (1.0, 2.0, 3.0))]
    points = [(k, float(z), float(t), float(g)) for k, (z, t, g) in enumerate(zip(rng.uniform(0.01, 0.02, 40), rng.uniform(3.51, 3.69, 40), rng.uniform(1.1, 2.9, 40), strict=True))]
    points += [(100, 0.01, 3.55, 1.5), (101, 0.005, 3.8, 0.5), (102, 0.03, 3.45, 3.5)]
    lib = spark.createDataFrame(nodes, "node long, z double, log_t double, log_g double")
    out = grids.atmosphere_interp(spark.createDataFrame(points, "p long, z double, log_t double, log_g double"), lib, "p", "node").collect()
    of, by = {n[0]: n for n in nodes}, {}
    for r in out:
        by.setdefault(r.p, []).append((of[r.node], r.w))
    assert set(by) == {p[0] for p in points} and all(abs(sum(w for _, w in v) - 1) < 1e-9 for v in by.values())
    for p in points[:41]:
        for axis in (1, 2, 3):
            assert abs(sum(n[axis] * w for n, w in by[p[0]]) - p[axis]) < 1e-9
    assert by[101][0][0][1:] == (0.01, 3.7, 1.0) and by[102][0][0][1:] == (0.02, 3.5, 3.0)
    nan = np.nan
    w = lambda ts, gs, t=0.0, g=0.0: grids.quadrant_weights(np.array([t]), np.array([g]), np.array([ts]), np.array([gs]), 0.5)[0].round(9).tolist()
    assert w([0.2, 0.2, nan, nan], [1.0, -3.0, nan, nan]) == [0.75, 0.25, 0, 0] and w([0.3, 0.2, nan, nan], [1.0, -3.0, nan, nan]) == [0, 1, 0, 0]
    assert w([0.2, 0.9, nan, nan], [1.0, -3.0, nan, nan]) == [1, 0, 0, 0] and w([0.3, nan, nan, -0.1], [1.0, nan, nan, -1.0]) == [0.25, 0, 0, 0.75]
    assert w([0.2, 0.2, -0.2, nan], [1.0, -1.0, 1.0, nan]) == [0, 0.5, 0.5, 0] and w([0.4, nan, -0.1, -0.1], [0.1, nan, 3.0, -0.1])[2] >= 0
