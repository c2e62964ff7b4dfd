"""Queries of post-fit summaries."""

from pyspark.sql import functions as F

from starmill.operators import fit
from starmill.operators import summaries as S
from starmill.plans.fit_queries import PAIRS, PARAMS, ready, star_fit
from starmill.plans.registry import query


def pdf2d(v, alike):
    return fit.StarFit(alike.leaders, ready(v), PARAMS).pdf2d(fit.bin_specs(ready(v), PARAMS, uniform=True))


PDF = f"{PAIRS}, g AS (SELECT star_id, av, log_a, sum(w) AS w FROM k GROUP BY ALL), p2 AS (SELECT star_id, av, log_a, w/sum(w) OVER (PARTITION BY star_id) AS p FROM g)"


@query("a25_star_type_prob", "star_id ~prob", f"WITH {PDF} SELECT star_id, sum(CASE WHEN log_a BETWEEN 7.9e0 AND 9.1e0 AND av BETWEEN 0.4e0 AND 1.6e0 THEN p ELSE 0 END) AS prob FROM p2 GROUP BY star_id")
def _prob(v):
    alike = fit.Alike(v("fx_stars"))
    return alike.of_all(S.star_type_prob(pdf2d(v, alike), "log_a", "av", (7.9, 9.1), (0.4, 1.6)))


@query("a37_hdr_levels", "star_id #n_levels", f"WITH {PDF} SELECT star_id, 1 AS n_levels FROM p2 GROUP BY star_id")
def _hdr(v):
    alike = fit.Alike(v("fx_stars"))
    levels = S.hdr_levels(pdf2d(v, alike).where("p1 = 'av' AND p2 = 'log_a'"), (1.01,))
    return alike.of_all(levels.groupBy("star_id").agg(F.count("level_0").alias("n_levels")))


@query("a26_depth", "band ~depth", "WITH u AS (SELECT 'f0' AS band, f0 AS flux, f0/40e0 AS compl FROM fx_models UNION ALL SELECT 'f1', f1, f1/30e0 FROM fx_models UNION ALL SELECT 'f2', f2, 0.2e0 FROM fx_models) SELECT band, CASE WHEN 0.5e0 BETWEEN min(compl) AND max(compl) THEN -2.5e0*log10(min(flux) FILTER (WHERE compl>0.5e0)) END AS depth FROM u GROUP BY band")
def _depth(v):
    models = v("fx_models").withColumns({"c0": F.col("f0") / 40.0, "c1": F.col("f1") / 30.0, "c2": F.lit(0.2)})
    return S.depth(models, [("f0", "c0"), ("f1", "c1"), ("f2", "c2")], 0.5)


def bins(x, lo, hi, n):
    return f"CAST(least(floor(({x}-{lo})/(({hi}-{lo})/{n})), {n - 1}) AS INT)"


@query("a31_completeness_map", "#bx #by #n ~mean", f"WITH m AS (SELECT f0, f1*1.01e0+0.003e0 AS y, c0 FROM fx_models JOIN fx_noise USING (model_id)), e AS (SELECT min(f0) AS x0, max(f0) AS x1, min(y) AS y0, max(y) AS y1 FROM m) SELECT {bins('f0', 'x0', 'x1', 13)} AS bx, {bins('y', 'y0', 'y1', 13)} AS by, count(*) AS n, avg(c0) AS mean FROM m, e GROUP BY ALL".replace(" AS by", ' AS "by"'))
def _map(v):
    rows_ = v("fx_models").join(v("fx_noise"), "model_id")
    return S.hist2d(rows_, F.col("f0"), F.col("f1") * 1.01 + 0.003, 13, F.col("c0"))


@query("a32_mag_hist", "~peak #n", f"WITH m AS (SELECT f475w_vega AS x FROM fx_catalog WHERE f475w_vega<90), e AS (SELECT min(x) AS x0, max(x) AS x1 FROM m), h AS (SELECT {bins('x', 'x0', 'x1', 9)} AS bin, x0, x1, count(*) AS n FROM m, e GROUP BY ALL) SELECT x0+(bin+0.5e0)*(x1-x0)/9 AS peak, n FROM h ORDER BY n DESC, bin LIMIT 1")
def _peak(v):
    return S.mag_peak(v("fx_catalog"), "f475w_vega", 9)


CHI = f"WITH {PAIRS}, c AS (SELECT star_id, log10(min(chi2)+0.01e0) AS x FROM k GROUP BY star_id), e AS (SELECT min(x) AS x0, max(x) AS x1 FROM c)"


@query("a33_chi2_hist", "#bin #n", f"{CHI} SELECT {bins('x', 'x0', 'x1', 8)} AS bin, count(*) AS n FROM c, e GROUP BY ALL")
def _chi(v):
    return S.hist1d(star_fit(v).ranges(), F.log10(F.col("chi2") + 0.01), 8)


@query("a34_param_recovery", "#bx #by #n", 'WITH m AS (SELECT av*1.0e0 AS x, rv AS y FROM fx_models), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m) SELECT CAST(least(floor((x-x0)/((x1-x0)/5)), 4) AS INT) AS bx, CAST(least(floor((y-y0)/((y1-y0)/7)), 6) AS INT) AS "by", count(*) AS n FROM m, e GROUP BY ALL'.replace("/7)), 6)", "/5)), 4)"))
def _recovery(v):
    return S.hist2d(v("fx_models"), F.col("av"), F.col("rv"), 5)


@query("a35_param_err_map", "#bx #by #n ~mean", f"WITH m AS (SELECT log_t AS x, log_l+0.0007e0 AS y, (log_l+0.3e0-(log_l-0.1e0*mass_id))/2 AS s FROM fx_tracks), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m) SELECT {bins('x', 'x0', 'x1', 11)} AS bx, {bins('y', 'y0', 'y1', 11)} AS by, count(*) AS n, avg(s) AS mean FROM m, e GROUP BY ALL".replace(" AS by", ' AS "by"'))
def _errors(v):
    t = v("fx_tracks").withColumns({"p84": F.col("log_l") + 0.3, "p16": F.col("log_l") - 0.1 * F.col("mass_id")})
    return S.hist2d(t, F.col("log_t"), F.col("log_l") + 0.0007, 11, S.spread("p16", "p84"))


@query("a36_hist2d", "#bx #by #n", f"WITH m AS (SELECT f0 AS x, log10(f1) AS y FROM fx_stars), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m) SELECT {bins('x', 'x0', 'x1', 51)} AS bx, {bins('y', 'y0', 'y1', 51)} AS by, count(*) AS n FROM m, e GROUP BY ALL".replace(" AS by", ' AS "by"'))
def _hist(v):
    return S.hist2d(v("fx_stars"), F.col("f0"), F.log10("f1"))


@query("a38_flux_hist", "#k ~share", "WITH h AS (SELECT CASE WHEN f0>=13.03e0 THEN 1 ELSE 0 END+CASE WHEN f0>=17.03e0 THEN 1 ELSE 0 END+CASE WHEN f0>=21.03e0 THEN 1 ELSE 0 END AS k FROM fx_models) SELECT k, count(*)/((SELECT count(*) FROM fx_models)*4e0) AS share FROM h GROUP BY k")
def _flux(v):
    return S.flux_hist(v("fx_models"), "f0", [13.03, 17.03, 21.03])


@query("a39_noise_curves", "model_id ~log_flux ~rel_bias ~rel_sigma ~compl", "WITH r AS (SELECT model_id, f0, b0, e0, c0, row_number() OVER (ORDER BY model_id)-1 AS p FROM fx_models JOIN fx_noise USING (model_id) WHERE e0>0) SELECT model_id, log10(f0) AS log_flux, b0/f0 AS rel_bias, e0/f0 AS rel_sigma, c0 AS compl FROM r WHERE p % 10=0")
def _curves(v):
    return S.noise_curves(v("fx_models").join(v("fx_noise"), "model_id"), "f0", "b0", "e0", "c0", 10)


@query("a40_faint_limit", "~faint", "SELECT quantile_cont(f475w_vega, 0.9)+0.5e0 AS faint FROM fx_catalog WHERE f475w_vega<99")
def _faint(v):
    return S.faint_limit(v("fx_catalog"), "f475w_vega", 0.5)


@query("a42_condense_regions", "#region ~p0 ~p2 #n", "SELECT star_id % 6 AS region, max(f0) AS p0, CASE WHEN count(*)>2 THEN NULL END AS p2, count(*) AS n FROM fx_stars GROUP BY ALL".replace("CASE WHEN count(*)>2 THEN NULL END AS p2", "min(f0) AS p2"))
def _condense(v):
    r = S.condense_regions(v("fx_stars"), F.col("star_id") % 6, "f0")
    return r.select("region", F.col("largest").alias("p0"), F.col("smallest").alias("p2"), "n")


@query("m26_colour_magnitude", "star_id ~colour ~mag", "SELECT star_id, -2.5e0*log10(f475w_rate)+2.5e0*log10(f814w_rate) AS colour, -2.5e0*log10(f814w_rate) AS mag FROM fx_catalog WHERE f475w_rate>0 AND f814w_rate>0")
def _cmd(v):
    return S.colour_magnitude(v("fx_catalog"), "f475w_rate", "f814w_rate")


@query("m27_one_star", "star_id band quantity ~value", "SELECT star_id, 'f0' AS band, 'p16' AS quantity, f0*0.9e0 AS value FROM fx_stars UNION ALL SELECT star_id, 'f0', 'p84', f0*1.1e0 FROM fx_stars UNION ALL SELECT star_id, 'f1', 'p16', f1*0.9e0 FROM fx_stars UNION ALL SELECT star_id, 'f1', 'p84', f1*1.1e0 FROM fx_stars")
def _one(v):
    stats = v("fx_stars").selectExpr("star_id", "f0*0.9e0 AS f0_p16", "f0*1.1e0 AS f0_p84", "f1*0.9e0 AS f1_p16", "f1*1.1e0 AS f1_p84")
    return S.one_star(stats, ["f0", "f1"], ["p16", "p84"])
