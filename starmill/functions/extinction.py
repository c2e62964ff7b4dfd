"""Extinction laws A(lambda) / A(V) as columns over a wavelength in Angstrom."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAWS: dict[str, Callable[..., Column]] = {}


def register(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        LAWS[name] = f
        return f

    return put


# Coefficients of the optical polynomials of the CCM89 law, constant term first.
CCM_A = (1.0, 0.17699, -0.50447, -0.02427, 0.72085, 0.01979, -0.77530, 0.32999)
CCM_B = (0.0, 1.41338, 2.28305, 1.07233, -5.38434, -0.62251, 5.30260, -2.09002)
# Terms of its far ultraviolet part, constant term first; the numbers in ccm89() are the law's own for infrared and ultraviolet.
FUV_A, FUV_B = (-1.073, -0.628, 0.137, -0.070), (13.670, 4.257, -0.420, 0.374)


def poly(x: Column, c: tuple[float, ...]) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * x + k
    return out


@register("ccm89")
def ccm89(wave: Column, rv: Column | float, beyond: bool = False) -> Column:
    """From 0.3 to 10 inverse microns; null beyond, or carried on by the formulas at the ends."""
    x, rv = 1e4 / wave, F.lit(rv) if not isinstance(rv, Column) else rv
    infrared = 0.574 * F.pow(x, 1.61) - 0.527 * F.pow(x, 1.61) / rv
    y = x - 1.82
    optical = poly(y, CCM_A) + poly(y, CCM_B) / rv
    d = x - 5.9
    f_a = F.when(x >= 5.9, -0.04473 * d * d - 0.009779 * d * d * d).otherwise(0.0)
    f_b = F.when(x >= 5.9, 0.2130 * d * d + 0.1207 * d * d * d).otherwise(0.0)
    uv = 1.752 - 0.316 * x - 0.104 / (F.pow(x - 4.67, 2) + 0.341) + f_a + (-3.090 + 1.825 * x + 1.206 / (F.pow(x - 4.62, 2) + 0.263) + f_b) / rv
    far = poly(x - 8, FUV_A) + poly(x - 8, FUV_B) / rv
    low, high = (F.lit(True), F.lit(True)) if beyond else (x >= 0.3, x <= 10)
    return F.when(low & (x < 1.1), infrared).when((x >= 1.1) & (x < 3.3), optical).when((x >= 3.3) & (x < 8), uv).when((x >= 8) & high, far)


@register("fm_uv")
def fm_uv(wave: Column, rv: Column | float, c: tuple[Column | float, ...], x0: float, gamma: float) -> Column:
    """Ultraviolet form of Fitzpatrick and Massa: a line, a bump and a rise beyond 5.9 inverse microns."""
    x, rv = 1e4 / wave, F.lit(rv) if not isinstance(rv, Column) else rv
    x2 = x * x
    bump = x2 / (F.pow(x2 - x0 * x0, 2) + x2 * gamma * gamma)
    y = F.when(x >= 5.9, x - 5.9).otherwise(0.0)
    k = c[0] + c[1] * x + c[2] * bump + c[3] * (0.5392 * y * y + 0.05644 * y * y * y)
    return 1 + k / rv


def spline_basis(knots: Sequence[float]) -> np.ndarray:
    """Cubics through knots, not-a-knot at both ends: an array [piece, power, knot]; a piece's coefficient of a power of x - knot is the sum over the knots' values."""
    x = np.asarray(knots, float)
    n, h = len(x), np.diff(x)
    # second derivatives m at the knots: slopes agree at inner knots, third derivatives at the second and last but one
    left, right = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        left[i, i - 1 : i + 2] = h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6
        right[i, i - 1 : i + 2] = 1 / h[i - 1], -1 / h[i - 1] - 1 / h[i], 1 / h[i]
    left[0, :3] = 1 / h[0], -1 / h[0] - 1 / h[1], 1 / h[1]
    left[-1, -3:] = 1 / h[-2], -1 / h[-2] - 1 / h[-1], 1 / h[-1]
    m, one = np.linalg.solve(left, right), np.eye(n)
    return np.array([[one[i], (one[i + 1] - one[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6, m[i] / 2, (m[i + 1] - m[i]) / (6 * h[i])] for i in range(n - 1)])


def spline(x: Column, knots: Sequence[float], values: Sequence[Column | float]) -> Column:
    """The cubic spline through (knots, values) at x: fixed numbers times the values, which may be columns."""
    out = None
    for i, piece in reversed(list(enumerate(spline_basis(knots)))):
        d = x - float(knots[i])
        c = [sum((F.lit(float(w)) * v for w, v in zip(row, values, strict=True)), F.lit(0.0)) for row in piece]
        value = ((c[3] * d + c[2]) * d + c[1]) * d + c[0]
        out = value if out is None else F.when(x < float(knots[i + 1]), value).otherwise(out)
    return out


# Where the ultraviolet form begins (in inverse microns), and the anchors that the spline below it goes through besides the form's own at 2700 and 2600 Angstrom.
UV_FROM, UV_ANCHORS = 1e4 / 2700, (1e4 / 2700, 1e4 / 2600)
F99_ANCHORS = (0.0, 1e4 / 26500, 1e4 / 12200, 1e4 / 6000, 1e4 / 5470, 1e4 / 4670, 1e4 / 4110)
F99_INFRARED = (0.0, 0.26469, 0.82925)
F99_OPTICAL = ((-0.422809, 1.00270, 2.13572e-04), (-5.13540e-02, 1.00216, -7.35778e-05), (0.700127, 1.00184, -3.32598e-05), (1.19456, 1.01707, -5.46959e-03, 7.97809e-04, -4.45636e-05))
SMC_ANCHORS = (0.0, 1 / 2.198, 1 / 1.65, 1 / 1.25, 1 / 0.81, 1 / 0.65, 1 / 0.55, 1 / 0.44, 1 / 0.37)
SMC_VALUES = (0.0, 0.11, 0.169, 0.25, 0.567, 0.801, 1.0, 1.374, 1.672)
# Terms of the ultraviolet form of the SMC Bar.
SMC_UV, SMC_X0, SMC_GAMMA, SMC_RV = (-4.959, 2.264, 0.389, 0.461), 4.6, 1.0, 2.74


@register("f99")
def f99(wave: Column, rv: Column | float) -> Column:
    """Fitzpatrick 1999, from 0.3 to 10 inverse microns; null beyond."""
    x, rv = 1e4 / wave, F.lit(rv) if not isinstance(rv, Column) else rv
    # fixed values: the law's own ultraviolet parameters
    slope = -0.824 + 4.717 / rv
    ultraviolet = lambda w: fm_uv(w, rv, (2.030 - 3.007 * slope, slope, 3.23, 0.41), 4.596, 0.99)
    values = [*[v / 3.1 for v in F99_INFRARED], *[poly(rv, c) / rv for c in F99_OPTICAL], *[ultraviolet(F.lit(1e4 / a)) for a in UV_ANCHORS]]
    below = spline(x, [*F99_ANCHORS, *UV_ANCHORS], values)
    return F.when((x >= 0.3) & (x < UV_FROM), below).when((x >= UV_FROM) & (x <= 10), ultraviolet(wave))


@register("g03_smc")
def g03_smc(wave: Column) -> Column:
    """SMC Bar of Gordon et al. 2003, from 0.3 to 10 inverse microns; null beyond."""
    x = 1e4 / wave
    ultraviolet = lambda w: fm_uv(w, SMC_RV, SMC_UV, SMC_X0, SMC_GAMMA)
    below = spline(x, [*SMC_ANCHORS, *UV_ANCHORS], [*SMC_VALUES, *[ultraviolet(F.lit(1e4 / a)) for a in UV_ANCHORS]])
    return F.when((x >= 0.3) & (x < UV_FROM), below).when((x >= UV_FROM) & (x <= 10), ultraviolet(wave))


@register("g03_smc_uv")
def g03_smc_uv(wave: Column) -> Column:
    """SMC Bar beyond 1/0.27 inverse microns; null below."""
    return F.when(1e4 / wave >= UV_FROM, fm_uv(wave, SMC_RV, SMC_UV, SMC_X0, SMC_GAMMA))


#: Inverse microns in which a law holds.
RANGES = {"ccm89": (0.3, 10.0), "f99": (0.3, 10.0), "g03_smc": (0.3, 10.0), "g03_smc_uv": (UV_FROM, 10.0)}


def wave_range(df: DataFrame, law: str, wave: str = "wave") -> DataFrame:
    """The wavelengths at which a law holds."""
    low, high = RANGES[law]
    return df.where((1e4 / F.col(wave)).between(low, high))


@register("power")
def power(wave: Column, beta: float = 1.3, reference: float = 5500.0) -> Column:
    return F.pow(wave / reference, -beta)


def mixture(a: Column, b: Column, f_a: Column | float) -> Column:
    """f_a of one law and the rest of another."""
    f = F.lit(f_a) if not isinstance(f_a, Column) else f_a
    return f * a + (1 - f) * b


def extended(rows: DataFrame, wave: str, rv: Column | float, law: str, reach: tuple[float, float], curves: DataFrame, of_rv: dict[float, str], seam: tuple[float, float], out: str = "a") -> DataFrame:
    """Adds A(lambda) / A(V) of a law within its reach, and beyond of tabulated curves, with linear weights across the seam (all in inverse microns; in it the curves' weight grows from 0 to 1).

    curves: x and a column for each R_V in of_rv, of which the two around a row's R_V count, linear between them and carried on beyond the ends.
    """
    from starmill.operators.noise import interp_join

    rv = rv if isinstance(rv, Column) else F.lit(float(rv))
    found = interp_join(rows.withColumn("x_of", 1e4 / F.col(wave)), "x_of", curves.withColumnRenamed("x", "x_at"), "x_at", list(of_rv.values()))
    known = sorted(of_rv.items())
    table = F.col(known[0][1]) if len(known) == 1 else F.lit(None)
    for k in range(len(known) - 2, -1, -1):
        (r0, c0), (r1, c1) = known[k], known[k + 1]
        line = F.col(c0) + (F.col(c1) - F.col(c0)) * ((rv - r0) / (r1 - r0))
        table = line if k == len(known) - 2 else F.when(rv < r1, line).otherwise(table)
    x, inner = F.col("x_of"), LAWS[law](F.col(wave), rv)
    share = (x - seam[0]) / (seam[1] - seam[0])
    merged = F.when((x > reach[0]) & (x < reach[1]), F.when((x > seam[0]) & (x < seam[1]), (1 - share) * inner + share * table).otherwise(inner)).otherwise(table)
    return found.withColumn(out, merged).drop("x_of", *of_rv.values())
