"""What makes operators work at scale, with the constants made small: pruned fits, percentiles by selection, strata, merged tables, places by area."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmill.operators import fit, grids, merge, noise, percentiles, samples, sky, tables
from starmill.plans.fixtures import view

SF = "/root/testdata/sf0.001"
PARAMS = ["av", "rv", "log_a"]


def grid(spark, copies=1, sigma=1.0):
    """Stars of the small tables, and `copies` of its models, each at slightly other fluxes."""
    v = lambda n: view(spark, SF, n)
    models = fit.positive_weight(fit.attach_noise(v("fx_models"), v("fx_noise"))).crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
    far = (F.col("copy") + 1) / F.lit(float(copies))
    models = models.withColumns({"model_id": F.col("model_id") * copies + F.col("copy")} | {f"f{k}": F.col(f"f{k}") * (1 + 0.7 * k * far / copies) + 25 * far for k in range(3)}).drop("copy")
    return v("fx_stars"), models.withColumns({f"e{k}": F.col(f"e{k}") * sigma for k in range(3)})


def by_hand(stars, models, threshold):
    """Likely rows by one numpy product."""
    s, m = stars.orderBy("star_id").toPandas(), models.orderBy("model_id").toPandas()
    p = [(m[f"f{k}"] + m[f"b{k}"]).to_numpy() for k in range(3)]
    c2 = sum((s[f"f{k}"].to_numpy()[:, None] - p[k]) ** 2 / m[f"e{k}"].to_numpy() ** 2 for k in range(3))
    lnp = -1.5 * np.log(2 * np.pi) - sum(np.log(m[f"e{k}"].to_numpy()) for k in range(3)) + np.log(m["weight"].to_numpy()) - 0.5 * c2
    likely = lnp - lnp.max(1)[:, None] > threshold
    return s, m, c2, lnp, likely


@pytest.mark.parametrize("stars_to_all", [100_000, 1])
def test_fit_of_blocks(spark, monkeypatch, stars_to_all):
    monkeypatch.setattr(fit, "STAR_BLOCK", 3)
    monkeypatch.setattr(fit, "MODEL_BLOCK", 32)
    monkeypatch.setattr(fit, "BROADCAST_STARS", stars_to_all)
    monkeypatch.setattr(fit, "HELD", 50)
    stars, models = grid(spark, 3, 0.4)
    models = models.cache()
    # a star without a number, and models of equal likelihood
    stars = stars.unionByName(stars.limit(1).withColumns({"star_id": F.lit(10**6).cast("long"), "f1": F.lit(float("nan"))}))
    models = models.unionByName(models.where("model_id % 7 = 0").withColumn("model_id", F.col("model_id") + 10**6))
    s, m, c2, lnp, likely = by_hand(stars.where("star_id < 1000000"), models, -10.0)
    one = fit.StarFit(stars, models, PARAMS)
    specs = fit.bin_specs(models, PARAMS)
    w = np.where(likely, np.exp(lnp - lnp.max(1)[:, None]), 0)
    got = {r.star_id: r for r in one.stats((16, 50), specs).collect()}
    assert sorted(got) == s.star_id.tolist()
    ids = m.model_id.to_numpy()
    for i, star in enumerate(s.star_id):
        r = got[star]
        tied = np.isclose(lnp[i], lnp[i].max(), rtol=0, atol=1e-12)
        assert r.n_sparse == likely[i].sum() and np.isclose(r.pmax, lnp[i].max()) and r.pmax_indx == ids[tied].min()
        near = np.where(likely[i], c2[i], np.inf)
        assert np.isclose(r.chi2min, near.min()) and r.chi2min_indx == ids[np.isclose(near, near.min(), rtol=0, atol=1e-12)].min()
        assert np.isclose(r.total_log_norm, lnp[i].max() + np.log(w[i].sum())) and np.isclose(r.av_exp, (w[i] * m["av"]).sum() / w[i].sum())
    assert {(r.star_id, r.model_id) for r in one.likely().select("star_id", "model_id").collect()} == {(s.star_id[i], ids[j]) for i, j in zip(*np.nonzero(likely), strict=True)}
    table = {(r.star_id, r.param, r.bin): r.p for r in one.pdf1d(specs).collect()}
    joint = {(r.star_id, r.p1, r.p2, r.bin1, r.bin2): r.p for r in one.pdf2d(specs).collect()}
    codes = [np.array(models.orderBy("model_id").select(fit.bin_of(x).alias("b")).toPandas()["b"]) for x in specs]
    want, both = {}, {}
    for i, star in enumerate(s.star_id):
        for j in np.flatnonzero(likely[i]):
            for a, x in enumerate(PARAMS):
                want[star, x, codes[a][j]] = want.get((star, x, codes[a][j]), 0) + w[i, j] / w[i].sum()
                for b in range(a + 1, 3):
                    key = (star, x, PARAMS[b], codes[a][j], codes[b][j])
                    both[key] = both.get(key, 0) + w[i, j] / w[i].sum()
    assert table.keys() == want.keys() and all(np.isclose(table[k], want[k]) for k in want)
    assert joint.keys() == both.keys() and all(np.isclose(joint[k], both[k]) for k in both)


def test_pairs_of_blocks_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(fit, "STAR_BLOCK", 2)
    monkeypatch.setattr(fit, "MODEL_BLOCK", 16)
    shares = []
    for copies in (5, 50):
        stars, models = grid(spark, copies, 0.2)
        one = fit.StarFit(stars, models.cache())
        pairs = one.pairs(one.star_blocks(one.maxima), one.threshold).select(F.size("id").alias("m"), F.size("s_id").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m") * F.col("s")).alias("cost")).first()
        all_blocks = one.model_blocks.count() * one.star_blocks().count()
        shares.append(pairs.cost / (models.count() * stars.count()))
        assert pairs.n < 0.5 * all_blocks
        one.release()
    # ten times the models cost less than ten times as much
    assert shares[1] < shares[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_by_selection(spark, monkeypatch, seed):
    monkeypatch.setattr(percentiles, "MOST", 40)
    r = np.random.default_rng(seed)
    groups = {0: r.normal(size=3000), 1: np.round(r.exponential(size=2000), 1), 2: np.full(500, 7.0), 3: 10.0 ** r.uniform(-300, 300, 1500), None: r.normal(size=60), 5: np.array([3.0]), 6: np.r_[np.full(900, 1.0), r.normal(size=100) + 5]}
    rows = [(g, float(x), "t") for g, xs in groups.items() for x in xs] + [(0, None, "t"), (9, None, "t")]
    df = spark.createDataFrame(rows, "g int, x double, n string").repartition(7)
    probs = {"a": 0.16, "b": 0.5, "c": 0.84, "d": 0.0, "e": 1.0, "f": 0.999}
    got = {row.g: row for row in percentiles.grouped_percentiles(df, ["g"], "x", probs, F.count(F.lit(1)).alias("n")).collect()}
    assert got[9].a is None and got[9].n == 1 and got[0].n == 3001
    for g, xs in groups.items():
        for name, p in probs.items():
            assert np.isclose(got[g][name], np.percentile(xs, 100 * p), rtol=1e-12, atol=0), (g, name)
    whole = percentiles.grouped_percentiles(df, [], "x", probs).first()
    everything = np.concatenate(list(groups.values()))
    assert all(np.isclose(whole[name], np.percentile(everything, 100 * p), rtol=1e-12) for name, p in probs.items())


def test_percentiles_of_wrong_sketches(spark, monkeypatch):
    """Bounds that a sketch puts aside of the rank are widened again."""
    monkeypatch.setattr(percentiles, "MOST", 40)
    monkeypatch.setattr(percentiles, "ACCURACY", 3)
    x = np.random.default_rng(3).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = percentiles.grouped_percentiles(df, [], "x", {"a": 0.16, "b": 0.5, "c": 0.9}).first()
    assert np.allclose([got.a, got.b, got.c], np.percentile(x, [16, 50, 90]), rtol=1e-12)


def test_merged_parts_equal_the_whole(spark):
    stars, models = grid(spark)
    low = -600.0
    models = models.withColumn("subgrid", (F.col("model_id") % 3).cast("int"))
    specs = merge.merged_specs(merge.grid_info(models, PARAMS, ["subgrid"]), PARAMS)
    assert specs == fit.bin_specs(models, PARAMS)
    whole = {r.star_id: r for r in fit.StarFit(stars, models, PARAMS, low).stats((16, 50, 84), specs).collect()}
    fits = [fit.StarFit(stars, models.where(F.col("subgrid") == k), PARAMS, low) for k in range(3)]
    stats = tables.stack([f.stats().withColumn("subgrid", F.lit(k)) for k, f in enumerate(fits)])
    pdfs = tables.stack([f.pdf1d(specs).withColumn("subgrid", F.lit(k)) for k, f in enumerate(fits)])
    got = merge.merge_fits(stats, pdfs, PARAMS, n_parts=3)["stats"].collect()
    assert len(got) == len(whole) > 5
    for r in got:
        for p in PARAMS:
            assert np.allclose([r[f"{p}_p{q}"] for q in (16, 50, 84)], [whole[r.star_id][f"{p}_p{q}"] for q in (16, 50, 84)], rtol=1e-9)
    assert merge.merge_fits(stats.where("subgrid > 0 OR star_id % 2 = 0"), pdfs, PARAMS, n_parts=3)["pdf1d"].where("star_id % 2 = 1").isEmpty()


def test_rebinned_tables(spark):
    even = fit.spec_of("x", 0.0, 10.0, range(60), 11)
    assert even["even"] and even["edges"][0] == -0.5
    assert merge.overlaps(even, fit.spec_of("x", 0.0, 10.0, range(60), 6))[:4] == [(0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5), (2, 1, 1.0)]
    values = fit.spec_of("x", 0.0, 4.0, [0.0, 1.0, 4.0])
    assert merge.overlaps(values, even) == [(0, 0, 1.0), (1, 1, 1.0), (2, 4, 1.0)]
    beyond = merge.overlaps(fit.spec_of("x", -20.0, 20.0, range(60), 5), even)
    assert all(np.isclose(sum(s for a, _, s in beyond if a == k), 1) for k in range(5)) and {b for _, b, _ in beyond} == set(range(11))
    pdfs = spark.createDataFrame([(1, 0, "x", k, p) for k, p in enumerate((0.25, 0.75))] + [(1, 1, "x", 2, 1.0)], "star_id long, subgrid int, param string, bin int, p double")
    got = {(r.subgrid, r.bin): (r.bin_val, r.p) for r in merge.rebinned(pdfs, {0: [fit.spec_of("x", 0.0, 10.0, range(60), 6)], 1: [values]}, [even]).collect()}
    assert got == {(0, 0): (0.0, pytest.approx(0.25 * 0.75)), (0, 1): (1.0, pytest.approx(0.25 * 0.25 + 0.75 * 0.25)), (0, 2): (2.0, pytest.approx(0.75 * 0.5)), (0, 3): (3.0, pytest.approx(0.75 * 0.25)), (1, 4): (4.0, pytest.approx(1.0))}
    with pytest.raises(ValueError):
        merge.overlaps(values | {"log": True}, even)


def test_strata(spark):
    rows = [(k, k % 3, float(1 + k % 5)) for k in range(900)] + [(10_000, 7, 0.0)]
    models = spark.createDataFrame(rows, "model_id long, age int, weight double")
    numbers = spark.createDataFrame([(0, 500), (1, 30), (2, 0), (7, 10)], "age int, stars long")
    got = samples.stratified_sample(models, "age", numbers, F.col("weight"), rows_per_part=50).collect()
    assert {a: sorted(r.draw for r in got if r.age == a) for a in (0, 1, 2, 7)} == {0: list(range(500)), 1: list(range(30)), 2: [], 7: []}
    # systematic: a model has its share of the draws, up to one
    for k in range(0, 900, 3):
        assert abs(sum(r.model_id == k for r in got) - 500 * (1 + k % 5) / 900) < 1


def test_draws_with_replacement(spark):
    models = spark.createDataFrame([(k, k % 2, 0.1 * k) for k in range(100)], "model_id long, age int, m double")
    got = samples.draw_per_group(models, ["age"], 400, 2, rows_per_part=16).collect()
    assert len(got) == 2 * 2 * 400 and {(r.age, r.draw, r.realization) for r in got} == {(a, d, k) for a in (0, 1) for d in range(400) for k in (0, 1)}
    assert all(r.model_id % 2 == r.age for r in got) and max(sum(r.model_id == k for r in got) for k in range(100)) > 16
    cut = samples.within_cuts({"m": (1.0, 2.0)}, {"m": [("age", 1.95)], "n": [("m", 0.0)]})
    some = samples.supplement_draws(models, models.where("model_id = 12"), 50, cut).collect()
    assert len(some) == 50 and {r.model_id for r in some} <= set(range(10, 20)) - {12}
    assert samples.supplement_draws(models, models, 50).isEmpty()


def test_places_by_area(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 0.0, 1.0, 0.0, 1.0), (0, 1, 0, 1.0, 3.0, 0.0, 1.0), (1, 0, 1, 0.0, 1.0, 1.0, 2.0), (2, 9, 9, 9.0, 10.0, 9.0, 10.0)], "bin int, i_ra long, i_dec long, min_ra double, max_ra double, min_dec double, max_dec double")
    models = spark.range(4000).withColumnRenamed("id", "model_id")
    corners = [(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)]
    got = samples.positions_in_tiles(models, tiles, 1, corners=corners).toPandas()
    assert got.groupby("bin").size().to_dict() == {0: 4000, 1: 4000} and (got.ra + got.decl <= 3 + 1e-9).all()
    one = got[got.bin == 0]
    # of the area 2.5 of bin 0 the left tile has 1, and below the line that halves the right one lies as much as above
    assert abs((one.ra < 1).mean() - 1 / 2.5) < 0.03 and abs(one.ra[one.ra > 1].mean() - (0.5 * 2.0 * 0 + 1 * 1.5 + 0.5 * (2 + 1 / 3)) / 1.5) < 0.03
    whole = samples.positions_in_tiles(models, tiles, 2)
    assert whole.groupBy("bin").count().toPandas().set_index("bin")["count"].to_dict() == {0: 8000, 1: 8000, 2: 8000}


@pytest.mark.parametrize("nodes_to_all", [100_000, 1])
def test_nearest_nodes_of_blocks(spark, monkeypatch, nodes_to_all):
    from starmill.operators import noise

    monkeypatch.setattr(noise, "BROADCAST_NODES", nodes_to_all)
    monkeypatch.setattr(noise, "NODE_BLOCK", 5)
    monkeypatch.setattr(noise, "MODEL_BLOCK", 16)
    r = np.random.default_rng(4)
    nodes = np.round(10 ** r.uniform(0, 2, (90, 2)), 1)
    nodes[60:] = nodes[:30]  # nodes at one place
    models = np.concatenate([10 ** r.uniform(-0.5, 2.5, (100, 2)), nodes[:10]])
    n_df = spark.createDataFrame([(f"n{k:02d}", *map(float, x), float(k), k * 0.5) for k, x in enumerate(nodes)], "node_id string, f double, g double, v double, w double")
    m_df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(models)], "model_id long, f double, g double")
    for k in (10, 200):
        got = {x.model_id: x for x in noise.knn_blend(m_df, n_df, ["f", "g"], ["v", "w"], k, ["g"]).collect()}
        assert len(got) == len(models)
        for i, m in enumerate(models):
            d = np.sqrt(((np.log10(m) - np.log10(nodes)) ** 2).sum(1))
            at = np.lexsort((np.arange(90), d))[:k]
            w = 1 / np.maximum(d[at], 0.01)
            assert np.isclose(got[i].v, (w * at).sum() / w.sum()) and np.isclose(got[i].w, (w * at).sum() / w.sum() / 2) and got[i].g == m[1]


def test_ranges_of_many_keys(spark):
    df = spark.range(20_000).selectExpr("id", "id % 7 AS a", "-id AS b")
    placed = tables.in_ranges(df, ["a", "-id"], 500).groupBy("part_of").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", -F.col("id"))).alias("lo"), F.max(F.struct("a", -F.col("id"))).alias("hi")).orderBy("part_of").collect()
    assert len(placed) == 40 and max(x.n for x in placed) < 1500
    assert all(tuple(one.hi) < tuple(two.lo) for one, two in zip(placed[:-1], placed[1:], strict=True))


def test_buckets_meet_without_exchange(spark, tmp_path):
    from starmill.sources.tables import save_bucketed

    v = lambda n: view(spark, SF, n)
    grid_table = save_bucketed(v("fx_models"), "bucketed_models", 4, path=f"{tmp_path}/models")
    noise_table = save_bucketed(v("fx_noise"), "bucketed_noise", 4, path=f"{tmp_path}/noise")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = fit.attach_noise(grid_table, noise_table)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert both.count() == v("fx_models").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_models")
        spark.sql("DROP TABLE bucketed_noise")


def test_parts_merge_as_they_come(spark, tmp_path):
    from starmill.streaming.fits import merge_stream

    stars, models = grid(spark)
    parts = [fit.StarFit(stars, models.where(F.col("model_id") % 3 == k), PARAMS, -300.0).stats().withColumn("subgrid", F.lit(k)) for k in range(3)]
    columns = ["star_id", "subgrid", "pmax", "chi2min", "total_log_norm", *[f"{p}_{e}" for p in PARAMS for e in ("best", "exp")]]
    parts = [p.select(*columns).cache() for p in parts]
    parts[0].write.parquet(f"{tmp_path}/in/a")
    schema = spark.read.parquet(f"{tmp_path}/in/a").schema

    def run():
        """Each start goes on where the last one has stopped."""
        stream = merge_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), PARAMS, 3)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema("star_id long, pmax double, chi2min double, total_log_norm double, best_gridsub_tag int, " + ", ".join(f"{p}_{e} double" for e in ("best", "exp") for p in PARAMS)).parquet(f"{tmp_path}/out")

    assert run().isEmpty()
    # the last part first, and a part again; the second one is late for some stars
    parts[2].union(parts[0]).write.parquet(f"{tmp_path}/in/b")
    assert run().isEmpty()
    parts[1].where("star_id % 2 = 0").write.parquet(f"{tmp_path}/in/c")
    first = run()
    assert first.where("star_id % 2 = 1").isEmpty() and first.count() == stars.where("star_id % 2 = 0").count()
    parts[1].where("star_id % 2 = 1").write.parquet(f"{tmp_path}/in/d")
    got = {x.star_id: x for x in run().collect()}
    want = merge.merge_stats(tables.stack(parts), PARAMS, 3).collect()
    assert len(got) == len(want) == stars.count()
    for w in want:
        g = got[w.star_id]
        assert g.best_gridsub_tag == w.best_gridsub_tag
        assert np.allclose([g.pmax, g.chi2min, g.total_log_norm, *[g[f"{p}_{e}"] for p in PARAMS for e in ("best", "exp")]], [w.pmax, w.chi2min, w.total_log_norm, *[w[f"{p}_{e}"] for p in PARAMS for e in ("best", "exp")]], rtol=1e-9)


def repeated(stars):
    """Stars of which each has two more of its fluxes, besides two without a number."""
    more = stars.withColumn("star_id", F.explode(F.array("star_id", F.col("star_id") + 10_000, F.col("star_id") + 20_000)))
    return more.unionByName(stars.limit(2).withColumns({"star_id": F.col("star_id") + 10**6, "f0": F.lit(1.0), "f1": F.lit(None).cast("double"), "f2": F.lit(1.0)}))


@pytest.mark.parametrize("to_all", [100_000, 1])
def test_stars_alike_are_fitted_once(spark, monkeypatch, to_all):
    monkeypatch.setattr(fit, "STAR_BLOCK", 3)
    monkeypatch.setattr(fit, "MODEL_BLOCK", 32)
    monkeypatch.setattr(fit, "BROADCAST_STARS", to_all)
    monkeypatch.setattr(fit, "BROADCAST_ALIKE", to_all)
    stars, models = grid(spark, 2, 0.4)
    some, models = repeated(stars), models.cache()
    s, m, c2, lnp, likely = by_hand(stars, models, -2000.0)
    one = fit.StarFit(some, models, PARAMS, -2000.0)
    assert one.alike.counts == {"stars": 3 * len(s) + 2, "leaders": len(s) + 1}
    pairs = one.pairs(one.star_blocks(one.maxima), one.threshold).select(F.explode("s_id").alias("star_id"))
    assert {r.star_id for r in pairs.distinct().collect()} == set(s.star_id)  # the others meet no model
    at = {k + int(i): n for n, i in enumerate(s.star_id) for k in (0, 10_000, 20_000)}
    for got in (one.stats(), one.ranges()):
        rows = {r.star_id: r for r in got.collect()}
        assert rows.keys() == at.keys() and len(rows) == got.count()
        for i, n in at.items():
            r = rows[i].asDict()
            assert r.get("n", r.get("n_sparse")) == likely[n].sum() and np.isclose(r.get("mx", r.get("pmax")), lnp[n].max())
            assert np.isclose(r.get("chi2", r.get("chi2min")), c2[n][likely[n]].min()) and np.isclose(r.get("low", lnp[n][likely[n]].min()), lnp[n][likely[n]].min())
    assert {(r.star_id, r.model_id) for r in one.likely().collect()} == {(i, int(m.model_id[j])) for i, n in at.items() for j in np.flatnonzero(likely[n])}
    sizes = {i: likely[n].sum() for i, n in at.items()}
    specs = fit.bin_specs(models, PARAMS)
    assert all(np.isclose(r.p, 3) for r in one.pdf1d(specs).groupBy("star_id").agg(F.sum("p").alias("p")).collect()) and one.pdf1d(specs).select("star_id").distinct().count() == len(at)
    for most in (3, 10**6):
        rows = one.sample(most).collect()
        assert {i: sum(r.star_id == i for r in rows) for i in at} == {i: min(most, n) for i, n in sizes.items()}
        assert len({(r.star_id, r.model_id) for r in rows}) == len(rows) and all(likely[at[r.star_id], m.model_id.tolist().index(r.model_id)] for r in rows)
        if most == 3:
            assert sorted(rows) == sorted(one.sample(most).collect()) != sorted(one.sample(most, 2).collect())
    one.release()


def test_stars_of_one_id_are_one(spark):
    """An id that stands twice keeps both its rows, so nothing is taken as alike."""
    stars, models = grid(spark)
    both = stars.unionByName(stars.limit(2))
    alike = fit.Alike(both)
    assert alike.counts["leaders"] == both.count() and alike.leaders.count() == both.count()
    want = {r.star_id: r.n for r in fit.stars_to_models(both.select("star_id", "f0", "f1", "f2"), fit.prepare(models, PARAMS), PARAMS).groupBy("star_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.star_id: r.n for r in alike.of_all(fit.stars_to_models(alike.leaders, fit.prepare(models, PARAMS), PARAMS).groupBy("star_id").agg(F.count(F.lit(1)).alias("n"))).collect()} == want


def test_ranges_are_those_of_the_rows(spark):
    stars, models = grid(spark, 2)
    rows = fit.StarFit(stars, models, PARAMS).likely()
    found = {r.star_id: r for r in fit.StarFit(stars, models, PARAMS).ranges().collect()}
    low = {r.star_id: r.lnp for r in fit.shifted(rows, per_star=True).groupBy("star_id").agg(F.min("lnp").alias("lnp")).collect()}
    assert found and all(np.isclose(r.low - r.mx, low[i]) for i, r in found.items())
    merged = {r.star_id: r["count"] for r in merge.merge_lnp(rows.select("star_id", "model_id", "lnp"), -5.0).groupBy("star_id").count().collect()}
    assert {r.star_id: r.n for r in fit.StarFit(stars, models, threshold=-5.0).ranges().collect()} == merged
    sizes = {r.star_id: r["count"] for r in fit.lnp_sample(rows, 20).groupBy("star_id").count().collect()}
    assert {r.star_id: r["count"] for r in fit.StarFit(stars, models, PARAMS).sample(20).groupBy("star_id").count().collect()} == sizes
    joined = {(r.star_id, r.model_id): r.z for r in fit.lnp_grid_vals(rows.select("star_id", "model_id", "lnp"), models, ["z"]).collect()}
    assert {(r.star_id, r.model_id): r.z for r in fit.StarFit(stars, models, ["z"]).likely().collect()} == joined


@pytest.mark.parametrize("block", [512, 4])
def test_quadrants_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(grids, "QUADRANT_BLOCK", block)
    monkeypatch.setattr(fit, "BROADCAST_ALIKE", 10**6 if block > 4 else 1)
    r = np.random.default_rng(block)
    places = [(float(a), float(b)) for a, b in r.integers(0, 12, (40, 2)) / 4]
    points = [(i, *places[i % 40]) for i in range(200)]
    nodes = [(int(i), float(a), float(b)) for i, (a, b) in zip(r.permutation(300), r.integers(0, 16, (300, 2)) / 4, strict=True)]
    p_df = spark.createDataFrame([*points, (900, None, 1.0)], "p long, log_t double, log_g double")
    got = {(x.p, x.hot, x.dense): (x.node, x.d) for x in grids.quadrant_nodes(p_df, spark.createDataFrame(nodes, "n long, log_t double, log_g double"), "p", "n").collect()}
    want: dict = {}
    for p, t, g in points:
        for n, n_t, n_g in nodes:
            key, e = (p, int(n_t >= t), int(n_g >= g)), (abs(n_t - t) + 0.1 * abs(n_g - g), n)
            want[key] = min(want.get(key, e), e)
    assert {k: v for k, v in got.items() if k[0] < 900} == {k: (n, d) for k, (d, n) in want.items()}
    assert {k: d for k, (_, d) in got.items() if k[0] == 900} == {(900, 0, 0): None, (900, 0, 1): None}
    plan = grids.quadrant_nodes(p_df, spark.createDataFrame(nodes, "n long, log_t double, log_g double"), "p", "n")._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan  # no row per pair of point and node is sorted


@pytest.mark.parametrize("digits", [9, 2])
def test_matches_sort_no_pairs(spark, digits):
    r = np.random.default_rng(3)
    place = lambda n: [(float(80 + a / 100), float(-60 + b / 100)) for a, b in r.integers(0, 9, (n, 2))]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(place(60))] + [(500, None, 1.0), (501, 10.0, 10.0)], "star_id long, ra double, decl double")
    flux = [float(x) for x in r.integers(0, 4, 90)]
    right = spark.createDataFrame([(1000 + i, *p, flux[i] if i % 7 else None) for i, p in enumerate(place(90))], "star_id long, ra double, decl double, flux double")
    pairs = sky.pairs_within(left, right, 0.02, "star_id", "star_id", keep=["flux"]).toPandas()
    near, bright = sky.nearest_rounded(left, right, 0.02, digits), sky.brightest_within(left, right, 0.02, "star_id", "star_id", "flux")
    for got, order in ((near, lambda p: (round(p.separation, digits), p.right_id)), (bright, lambda p: (-p.flux, p.right_id))):
        want = {}
        for p in pairs.itertuples():
            if order is None or got is near or p.flux == p.flux:
                want[p.left_id] = min(want.get(p.left_id, order(p)), order(p))
        rows = {x.left_id: x for x in got.collect()}
        assert len(rows) == 62 == got.count() and rows[500].right_id is None and rows[501].right_id is None
        for i in range(60):
            assert rows[i].right_id == (want[i][1] if i in want else None)
            assert i not in want or np.isclose(rows[i].separation if got is near else -rows[i].flux, want[i][0])
    first = sky.best_within(left, right, 0.02, "star_id", "star_id", "ra", "decl", F.col("separation"))._jdf.queryExecution().toString()
    assert "max(struct" not in first and "min(separation" in first  # a number, which a hash aggregate holds


def test_regions_by_place(spark):
    r = np.random.default_rng(5)
    places = [(float(a), float(b)) for a, b in r.uniform(0, 1, (30, 2))]
    corner = lambda cx, cy, k: (cx + 0.2 * (1 if k % 2 else 0.45) * np.cos(np.pi * k / 5), cy + 0.2 * (1 if k % 2 else 0.45) * np.sin(np.pi * k / 5))
    shapes = [(i, [tuple(map(float, corner(*c, k))) for k in range(10)]) for i, c in enumerate(r.uniform(0, 1, (25, 2)))]
    regions = spark.createDataFrame(shapes, "region_id long, corners array<struct<x:double,y:double>>")
    once = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "star_id long, ra double, decl double")
    more = spark.createDataFrame([(i, *places[i % 30]) for i in range(90)] + [(99, None, 0.5)], "star_id long, ra double, decl double")
    some = lambda df: {(x.star_id, x.region_id) for x in sky.regions_of(df, regions, 0.05).collect()}
    want = {(i, k) for i, (x, y) in enumerate(places) for k, c in shapes if sum((y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 for (x0, y0), (x1, y1) in zip(c, c[1:] + c[:1], strict=True)) % 2}
    assert some(once) == want and len(want) > 20
    assert some(more) == {(i + 30 * n, k) for i, k in want for n in range(3)}
    plan = sky.regions_of(more, regions, 0.05)._jdf.queryExecution().toString()
    assert "x_of_place" in plan and "x_of_place" not in sky.regions_of(once, regions, 0.05)._jdf.queryExecution().toString()


def test_noise_of_fluxes_too_small_for_a_number(spark):
    """Copies of the grid have fluxes of 0, and such whose squares are 0: their relative error is that of the faintest bin."""
    knots = spark.createDataFrame([(0, 30, 1e-10, 0.5, 0.1, 0.3), (1, 30, 1e-9, 1.0, 0.0, 0.1)], "bin int, n long, flux_in double, compl double, bias double, sigma double")
    models = spark.createDataFrame([(1, 0.0), (2, 1e-200), (3, 1e-10), (4, 1e-9), (5, 5.0)], "model_id long, flux double")
    got = {r.model_id: r for r in noise.toothpick_noise(models, knots, "flux", 0.4).collect()}
    faint, bright = 0.5, (0.1**2 + 0.4**2) ** 0.5
    assert [round(got[i].rel_error, 12) for i in (1, 2, 3, 4, 5)] == [round(x, 12) for x in (-faint, -faint, faint, bright, bright)]
    assert got[1].error == 0 and np.isclose(got[2].error / 1e-200, -faint) and np.isclose(got[5].error, 5 * bright) and got[1].completeness == 0
    none = noise.toothpick_noise(models, knots.where("n < 0"), "flux").collect()
    assert len(none) == 5 and all(r.error is None for r in none)


def test_ccm89_beyond_its_range(spark, tmp_path):
    """Tables of many parts reach wavelengths where the law ends; the query's SQL carries it on."""
    import duckdb

    from starmill.functions.extinction import LAWS
    from starmill.plans.catalogue import ORACLES, QUERIES

    spark.range(5).selectExpr("id * 60000 AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["m18_ccm89"](spark, str(tmp_path)).collect()))
    assert got == sorted(duck.sql(ORACLES["m18_ccm89"]).fetchall()) and all(a is not None for _, a in got)
    ends = spark.createDataFrame([(500.0,), (5000.0,), (50000.0,)], "w double").select("w", LAWS["ccm89"](F.col("w"), 3.1).alias("a"), LAWS["ccm89"](F.col("w"), 3.1, beyond=True).alias("b")).orderBy("w").collect()
    assert [r.a is None for r in ends] == [True, False, True] and ends[1].a == ends[1].b and all(r.b is not None for r in ends)


def test_models_aside_of_nodes_are_dealt_out(spark, monkeypatch):
    """Where all models lie beyond the nodes' range, tasks share them, and the few nearest nodes are found among many of equal distance."""
    made = []
    monkeypatch.setattr(noise, "in_blocks", lambda *a, f=noise.in_blocks, **b: made.append((f(*a, **b), b)) or made[-1][0])
    r = np.random.default_rng(6)
    nodes, models = np.repeat(10 ** r.uniform(0, 0.1, (50, 2)), 4, axis=0), 10 ** r.uniform(1, 2, (400, 2))
    n_df = spark.createDataFrame([(k, *map(float, x), float(k)) for k, x in enumerate(nodes)], "node_id long, f double, g double, v double")
    m_df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(models)], "model_id long, f double, g double")
    got = {x.model_id: x.v for x in noise.knn_blend(m_df, n_df, ["f", "g"], ["v"], 10).collect()}
    for i, m in enumerate(models):
        d = np.sqrt(((np.log10(m) - np.log10(nodes)) ** 2).sum(1))
        at = np.lexsort((np.arange(200), d))[:10]
        assert np.isclose(got[i], (at / d[at]).sum() / (1 / d[at]).sum())
    here = next(df for df, how in made if "ahead" not in how)
    sizes = [x.n for x in here.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("id")).alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 200
    assert noise.first_nearest(np.array([[2.0, 1, 1, 1], [np.nan, 3, np.nan, 1], [0, 0, 0, 0]]), 2)[[0, 2]].tolist() == [[1, 2], [0, 1]]
    parts = noise.leaves(models, 32)
    assert sorted(np.concatenate(parts)) == list(range(400)) and max(map(len, parts)) <= 32
