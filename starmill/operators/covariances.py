"""Operators that need small matrices: noise covariances, their inverses and calibration terms; and two-way lookups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def packed(n: int) -> list[tuple[int, int]]:
    """Pairs of a packed upper triangle, row by row: (0, 1), (0, 2), ..., (1, 2), ..."""
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def trunchen_noise(rows: DataFrame, n: int, absflux: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """model_id, icov_diag, icov_off, q_norm of covariances cov_i_j (i <= j) with fluxes flux_i, and the columns in keep; the calibration term adds absflux^2 f_i f_j.

    Matrices of one batch are inverted together. q_norm is -1/2 ln det.
    """
    columns = [f"cov_{i}_{j}" for i in range(n) for j in range(i, n)]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c = np.zeros((len(f), n, n))
            for i in range(n):
                for j in range(i, n):
                    c[:, i, j] = c[:, j, i] = f[f"cov_{i}_{j}"].to_numpy() + absflux**2 * f[f"flux_{i}"].to_numpy() * f[f"flux_{j}"].to_numpy()
            inv, (_, det) = np.linalg.inv(c), np.linalg.slogdet(c)
            off = [inv[:, i, j] for i, j in packed(n)]
            yield pd.DataFrame({"model_id": f["model_id"], "icov_diag": list(np.einsum("kii->ki", inv)), "icov_off": list(np.array(off).reshape(len(off), -1).T), "q_norm": -0.5 * det} | {c: f[c] for c in keep})

    some = rows.select("model_id", *columns, *[f"flux_{i}" for i in range(n)], *keep)
    return some.mapInPandas(work, ", ".join(["model_id long, icov_diag array<double>, icov_off array<double>, q_norm double", *[f"{c} double" for c in keep]]))


def absflux_covariance(spectra: DataFrame, key: str, sed: str, bands: np.ndarray, covariance: np.ndarray, floor: float = 4.9e-5) -> DataFrame:
    """key and cov (packed with the diagonal, i <= j) of each spectrum: g_i C g_j with g_i = band i times the spectrum, over the products of their sums, plus `floor`.

    bands: n x waves; covariance: waves x waves, of one library, the same for all spectra.
    """
    n = len(bands)
    kind = spectra.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                g = np.stack(f[sed].to_list()).astype(float)[:, None, :] * bands
                total = g.sum(2)
                form = np.einsum("kiw,wx,kjx->kij", g, covariance, g, optimize=True) / (total[:, :, None] * total[:, None, :]) + floor
                yield pd.DataFrame({key: f[key], "cov": [m[np.triu_indices(n)] for m in form]})

    return spectra.select(key, sed).mapInPandas(work, f"{key} {kind}, cov array<double>")


def bilinear(points: DataFrame, x: str, y: str, table: DataFrame, value: str) -> DataFrame:
    """Adds `value` of a full lattice (x, y, value) at each point, linear in x and y; null outside. Lattices are bounded: their cells go to every executor."""
    by_x, by_y = W.partitionBy("y").orderBy("x"), W.partitionBy("x").orderBy("y")
    t = table.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("double").alias("v"))
    t = t.select("x", "y", "v", F.lead("x").over(by_x).alias("x1"), F.lead("v").over(by_x).alias("v_x"), F.lead("y").over(by_y).alias("y1"))
    t = t.select("*", F.lead("v").over(by_y).alias("v_y"), F.lead("v_x").over(by_y).alias("v_xy")).where("x1 IS NOT NULL AND y1 IS NOT NULL")
    cells = t.select(F.col("x").alias("c_x"), F.col("y").alias("c_y"), "x1", "y1", "v", "v_x", "v_y", "v_xy", (F.col("x1") == F.max("x1").over(W.partitionBy())).alias("x_end"), (F.col("y1") == F.max("y1").over(W.partitionBy())).alias("y_end"))
    at = lambda p, a, b, end: (F.col(p) >= F.col(a)) & ((F.col(p) < F.col(b)) | (F.col(end) & (F.col(p) == F.col(b))))
    both = points.join(F.broadcast(cells), at(x, "c_x", "x1", "x_end") & at(y, "c_y", "y1", "y_end"), "left")
    s, u = (F.col(x) - F.col("c_x")) / (F.col("x1") - F.col("c_x")), (F.col(y) - F.col("c_y")) / (F.col("y1") - F.col("c_y"))
    blend = F.col("v") * (1 - s) * (1 - u) + F.col("v_x") * s * (1 - u) + F.col("v_y") * (1 - s) * u + F.col("v_xy") * s * u
    return both.select(*points.columns, blend.alias(value))


# Order of spectral types, and log10 of the solar surface gravity (cgs).
TYPES, LOG_G_SUN = "OBAFGKM", 4.43797


def spec_type_params(stars: DataFrame, t_eff: DataFrame, log_g: DataFrame) -> DataFrame:
    """Adds t_eff and log_g of stars (spec_type, spec_subtype, lum_class as a number) from lattices (x: 10 * place of the type + subtype, y: class, value)."""
    place = sum((F.when(F.col("spec_type") == c, 10 * k).otherwise(0) for k, c in enumerate(TYPES)), F.lit(0)) + F.col("spec_subtype")
    rows = stars.withColumn("type_x", place.cast("double"))
    rows = bilinear(rows, "type_x", "lum_class", t_eff.withColumnRenamed("value", "t_eff"), "t_eff")
    rows = bilinear(rows, "type_x", "lum_class", log_g.withColumnRenamed("value", "log_g"), "log_g")
    return rows.withColumn("log_g", F.col("log_g") + LOG_G_SUN).drop("type_x")


def clean_columns(df: DataFrame, names: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Columns renamed {old: new} and cut to the canonical ones that are there."""
    renamed = df.withColumnsRenamed(names)
    return renamed.select(*[c for c in keep if c in renamed.columns])
