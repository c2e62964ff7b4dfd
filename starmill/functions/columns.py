"""Column builders: sky geometry, photometry and likelihoods. Null in, null out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log, pi
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale of symlog, zero point of ST magnitudes, solar metallicity, and solar units (cgs) in radius().
SYMLOG, ST_ZERO, Z_SUN = 1e-20, 21.1, 0.02
L_SUN, SIGMA = 3.839e33, 5.67037e-5
UNDETECTED, NO_FLUX = 99.999, -100.0


def total(terms: Sequence[Column]) -> Column:
    return reduce(add, terms)


def sphdist(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Separation on the sphere by haversines; degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(dec1, dec2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half(ra1, ra2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def sexagesimal(x: Column, digits: int = 3, delimiter: str = ":") -> Column:
    """Hours or degrees as [-]dd:mm:ss.sss, rounded as a whole so that 60 seconds never appear."""
    unit = 10**digits
    n = F.round(F.abs(x) * 3600 * unit).cast("long")
    sec = n % (60 * unit)
    parts = [F.lpad((n / (3600 * unit)).cast("long").cast("string"), 2, "0"), F.lpad(((n / (60 * unit)).cast("long") % 60).cast("string"), 2, "0"), F.concat(F.lpad((sec / unit).cast("long").cast("string"), 2, "0"), F.lit("."), F.lpad((sec % unit).cast("string"), digits, "0"))]
    return F.when(x.isNotNull(), F.concat(F.when((x < 0) & (n > 0), "-").otherwise(""), F.concat_ws(delimiter, *parts)))


def deg2hms(ra: Column, **how) -> Column:
    return sexagesimal(ra / 15, **how)


def deg2dms(dec: Column, **how) -> Column:
    return sexagesimal(dec, **how)


def dms2deg(text: Column, delimiter: str = ":") -> Column:
    """Degrees (or hours) of a sexagesimal text; the sign holds for all parts."""
    part = [F.abs(F.get(F.split(text, delimiter), F.lit(k)).cast("double")) for k in range(3)]
    return F.when(F.ltrim(text).startswith("-"), -1.0).otherwise(1.0) * (part[0] + part[1] / 60 + part[2] / 3600)


def hms2deg(text: Column, delimiter: str = ":") -> Column:
    return dms2deg(text, delimiter) * 15


def rotate(lon: Column, lat: Column, phi: float, psi: float, sin_t: float, cos_t: float) -> tuple[Column, Column]:
    """Spherical rotation by the pole's longitudes phi and psi (radians) and the tilt; degrees."""
    a, b = F.radians(lon) - phi, F.radians(lat)
    s = -sin_t * F.cos(b) * F.sin(a) + cos_t * F.sin(b)
    new_lat = F.degrees(F.asin(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0))))
    turn = F.atan2(cos_t * F.cos(b) * F.sin(a) + sin_t * F.sin(b), F.cos(b) * F.cos(a))
    return F.pmod(F.degrees(turn + psi + 4 * pi), F.lit(360.0)), new_lat


def equatorial_to_galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    return rotate(ra, dec, 4.9368292465, 0.57477043300, 0.88998808748, 0.45598377618)


def galactic_to_equatorial(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, 0.57477043300, 4.9368292465, -0.88998808748, 0.45598377618)


def equatorial_to_ecliptic(ra: Column, dec: Column) -> tuple[Column, Column]:
    return rotate(ra, dec, 0.0, 0.0, 0.39777715593, 0.91748206207)


def ecliptic_to_equatorial(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, 0.0, 0.0, -0.39777715593, 0.91748206207)


def iau_name(ra: Column, dec: Column, survey: str) -> Column:
    """Survey J hhmmss.ssss +ddmmss.sss; `noname` without a position."""
    sign = F.when(dec < 0, "-").otherwise("+")
    return F.coalesce(F.concat(F.lit(f"{survey} J"), sexagesimal(ra / 15, 4, ""), sign, sexagesimal(F.abs(dec), 3, "")), F.lit("noname"))


def symlog(y: Column) -> Column:
    return F.signum(y) * F.log10(1 + F.abs(y / SYMLOG))


def inverse_symlog(y: Column) -> Column:
    return F.signum(y) * SYMLOG * (F.pow(F.lit(10.0), F.abs(y)) - 1)


def flux2mag(flux: Column) -> Column:
    """-2.5 log10 of a positive flux, else null."""
    return F.when(flux > 0, -2.5 * F.log10(flux))


def mag2flux(mag: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * mag)


def fluxerr2magerr(flux: Column, err: Column) -> Column:
    return F.when(flux > 0, -2.5 * F.log10(1 - err / flux))


def magerr2fluxerr(mag: Column, err: Column) -> Column:
    """(Lower, upper) flux errors are of the two sides; here their mean."""
    return mag2flux(mag) * (1 - mag2flux(err))


def vega_mag(flux: Column, vega_flux: Column) -> Column:
    return flux2mag(flux / vega_flux)


def stmag_from_flux(flux: Column) -> Column:
    return F.when(flux > 0, -2.5 * F.log10(flux) - ST_ZERO)


def stmag_to_flux(mag: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * (mag + ST_ZERO))


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges that x has reached: i with edges[i-1] <= x < edges[i]."""
    return total([F.when(x >= float(e), 1).otherwise(0) for e in edges]) if len(edges) else F.lit(0)


def uniform_bin(x: Column, low: Column | float, width: Column | float, n: int | None = None) -> Column:
    """Number of the bin of `width` from `low`; with n the last bin is closed at its end."""
    k = F.floor((x - low) / width)
    return k if n is None else F.when(k == n, n - 1).otherwise(k)


def tan_pixel(ra: Column, dec: Column, ra0: float, dec0: float, scale: float) -> tuple[Column, Column]:
    """Gnomonic pixel offsets from the tangent point (ra0, dec0), `scale` degrees a pixel; x grows to smaller RA."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(F.lit(dec0))
    down = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    x = F.cos(d) * F.sin(a) / down
    y = (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / down
    return -F.degrees(x) / scale, F.degrees(y) / scale


def chi2(flux: Sequence[Column], model: Sequence[Column], ivar: Sequence[Column], mask: Sequence[Column] | None = None) -> Column:
    """Sum of squared differences over variances; a band whose mask is true is left out."""
    terms = [F.pow(f - m, 2) * w for f, m, w in zip(flux, model, ivar, strict=True)]
    return total(terms if mask is None else [F.when(k, 0.0).otherwise(t) for t, k in zip(terms, mask, strict=True)])


def lnp_diag(chi_square: Column, sigmas: Sequence[Column]) -> Column:
    return -0.5 * len(sigmas) * log(2 * pi) - total([F.log(s) for s in sigmas]) - 0.5 * chi_square


def chi2_cov(diff: Sequence[Column], icov_diag: Sequence[Column], icov_off: Sequence[Column]) -> Column:
    """Quadratic form of a packed inverse covariance: the diagonal, and the pairs i < j row by row."""
    n, at = len(diff), iter(icov_off)
    off = [2 * diff[i] * diff[j] * next(at) for i in range(n) for j in range(i + 1, n)]
    return total([d * d * c for d, c in zip(diff, icov_diag, strict=True)] + off)


def lnp_cov(chi_square: Column, n: int, q_norm: Column) -> Column:
    return -0.5 * n * log(2 * pi) + q_norm - 0.5 * chi_square


def lnp_cholesky(diff: Sequence[Column], factor: Sequence[Sequence[Column]], ln_q: Column) -> Column:
    """-1/2 |L^-1 diff|^2 - ln Q, by forward substitution with the rows of the factor L."""
    z: list[Column] = []
    for i, d in enumerate(diff):
        z.append((d - total([factor[i][j] * z[j] for j in range(i)]) if i else d) / factor[i][i])
    return -0.5 * total([v * v for v in z]) - ln_q


def log_band(flux: Column) -> Column:
    return F.when(flux > 0, F.log10(flux)).otherwise(NO_FLUX)


def radius(log_l: Column, log_t: Column) -> Column:
    """Stellar radius (cm) by Stefan-Boltzmann."""
    return F.sqrt(F.pow(F.lit(10.0), log_l) * L_SUN / (4 * pi * SIGMA * F.pow(F.lit(10.0), 4 * log_t)))


def feh_to_z(feh: Column) -> Column:
    return F.pow(F.lit(10.0), feh) * Z_SUN


def z_to_feh(z: Column) -> Column:
    return F.log10(z / Z_SUN)


def dilute(flux: Column, parsec: Column | float) -> Column:
    """Flux at a distance, from that at 10 pc."""
    d = F.lit(parsec) if not isinstance(parsec, Column) else parsec
    return flux / F.pow(0.1 * d, 2)


def extinguish(flux: Column, curve: Column, unit: str = "tau") -> Column:
    """flux exp(-A); unit 'mag': flux 10^(-0.4 A)."""
    return flux * (F.exp(-curve) if unit == "tau" else F.pow(F.lit(10.0), -0.4 * curve))
