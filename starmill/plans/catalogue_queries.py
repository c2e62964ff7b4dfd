"""Queries of covariances, lattices and canonical tables."""

import numpy as np
from pyspark.sql import functions as F

from starmill.operators import covariances as V
from starmill.plans.registry import query

COV = ["4e0+0.1e0*f0 AS cov_0_0", "0.5e0+0.01e0*f1 AS cov_0_1", "3e0+0.2e0*f1 AS cov_1_1", "f0 AS flux_0", "f1 AS flux_1"]


@query("a17_trunchen_noise", "model_id ~d0 ~d1 ~off ~q_norm", f"WITH c AS (SELECT model_id, {', '.join(COV)} FROM fx_models), a AS (SELECT model_id, cov_0_0+0.0004e0*flux_0*flux_0 AS a, cov_0_1+0.0004e0*flux_0*flux_1 AS b, cov_1_1+0.0004e0*flux_1*flux_1 AS d FROM c) SELECT model_id, d/(a*d-b*b) AS d0, a/(a*d-b*b) AS d1, -b/(a*d-b*b) AS off, -0.5e0*ln(a*d-b*b) AS q_norm FROM a")
def _trunchen(v):
    out = V.trunchen_noise(v("fx_models").selectExpr("model_id", *COV), 2, 0.02)
    return out.select("model_id", F.get("icov_diag", F.lit(0)).alias("d0"), F.get("icov_diag", F.lit(1)).alias("d1"), F.get("icov_off", F.lit(0)).alias("off"), "q_norm")


@query("a21_absflux_cov", "vec_id ~c00 ~c01", "WITH s AS (SELECT vec_id, i, abs(CAST(embedding[i] AS DOUBLE)) AS f FROM embeddings, range(1, 65) r(i)), g AS (SELECT vec_id, i, CASE WHEN i<=40 THEN f ELSE 0 END AS a, CASE WHEN i>20 THEN f ELSE 0 END AS b FROM s), t AS (SELECT vec_id, sum(a) AS sa, sum(b) AS sb FROM g GROUP BY vec_id) SELECT x.vec_id, sum(x.a*y.a*exp(-abs(x.i-y.i)/8e0))/(max(sa)*max(sa))+4.9e-5 AS c00, sum(x.a*y.b*exp(-abs(x.i-y.i)/8e0))/(max(sa)*max(sb))+4.9e-5 AS c01 FROM g x JOIN g y ON x.vec_id=y.vec_id JOIN t ON t.vec_id=x.vec_id GROUP BY x.vec_id")
def _absflux(v):
    k = np.arange(64)
    bands = np.array([(k < 40).astype(float), (k >= 20).astype(float)])
    spectra = v("embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("sed"))
    out = V.absflux_covariance(spectra, "vec_id", "sed", bands, np.exp(-np.abs(k[:, None] - k[None, :]) / 8.0))
    return out.select("vec_id", F.get("cov", F.lit(0)).alias("c00"), F.get("cov", F.lit(1)).alias("c01"))


def lattice(v, f):
    return v("nation").where("n_nationkey < 20").select((F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y")).select("x", "y", f.alias("value"))


@query("m20_tabulated_curve", "model_id ~k", "WITH p AS (SELECT model_id, (model_id % 37)*0.1e0 AS x, (model_id % 29)*0.1e0 AS y FROM fx_models), c AS (SELECT *, floor(x) AS i, floor(y) AS j, x-floor(x) AS s, y-floor(y) AS u FROM p) SELECT model_id, (i*i+2*j*j)*(1-s)*(1-u)+((i+1)*(i+1)+2*j*j)*s*(1-u)+(i*i+2*(j+1)*(j+1))*(1-s)*u+((i+1)*(i+1)+2*(j+1)*(j+1))*s*u AS k FROM c")
def _curve(v):
    points = v("fx_models").selectExpr("model_id", "(model_id % 37)*0.1e0 AS x", "(model_id % 29)*0.1e0 AS y")
    return V.bilinear(points, "x", "y", lattice(v, F.col("x") * F.col("x") + 2 * F.col("y") * F.col("y")).withColumnRenamed("value", "k"), "k")


@query("j22_spec_type_params", "star_id ~t_eff ~log_g", "SELECT star_id, 30000e0-400*(10*(star_id % 4)+star_id % 9)-100*(1+star_id % 3) AS t_eff, -0.2e0*(1+star_id % 3)+0.01e0*(10*(star_id % 4)+star_id % 9)+4.43797e0 AS log_g FROM fx_stars")
def _spec(v):
    stars = v("fx_stars").selectExpr("star_id", "substring('OBAF', CAST(star_id % 4 + 1 AS INT), 1) AS spec_type", "star_id % 9 AS spec_subtype", "CAST(1 + star_id % 3 AS DOUBLE) AS lum_class")
    t = lattice(v, 30000.0 - 4000 * F.col("x") - 100 * (F.col("y") + 1)).select((F.col("x") * 10).alias("x"), (F.col("y") + 1).alias("y"), "value")
    g = lattice(v, -0.2 * (F.col("y") + 1) + 0.1 * F.col("x")).select((F.col("x") * 10).alias("x"), (F.col("y") + 1).alias("y"), "value")
    return V.spec_type_params(stars, t, g)


@query("p16_clean_cols", "#track_row ~logA ~logT", "SELECT track_row, log_a AS logA, log_t AS logT FROM fx_tracks")
def _clean(v):
    return V.clean_columns(v("fx_tracks"), {"log_a": "logA", "log_t": "logT"}, ["track_row", "logA", "logT", "Mbol"])
