"""Priors by name: numbers over an axis of grid values, and columns that look them up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

REGISTRY: dict[str, Callable[..., np.ndarray]] = {}
#: The prior names that are legal for each parameter.
ALLOWED = {
    "age": ["flat", "flat_log", "bins_histo", "bins_interp", "exponential"],
    "mass": ["kroupa", "salpeter", "flat"],
    "met": ["flat"],
    "distance": ["flat", "absexponential"],
    "dust": ["flat", "lognormal", "two_lognormal", "step"],
}


def register(name: str) -> Callable:
    """Adds a prior to the registry; it takes the axis and its parameters."""

    def put(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return put


def prior(parameter: str, name: str, x: Sequence[float], **how) -> np.ndarray:
    """Values of a prior over the axis x. The axis is that of a grid parameter: short, and the same for all models."""
    if name not in ALLOWED.get(parameter, REGISTRY):
        raise ValueError(f"{name} is no prior of {parameter}")
    return REGISTRY[name](np.asarray(x, float), **how)


def boundaries(x: np.ndarray) -> np.ndarray:
    """Edges of the bins around sorted values: midpoints, and mirrored at the ends."""
    mid = (x[1:] + x[:-1]) / 2
    return np.r_[2 * x[0] - mid[0], mid, 2 * x[-1] - mid[-1]] if len(x) > 1 else np.array([x[0] * 0.95, x[0] * 1.05])


@register("flat")
def flat(x: np.ndarray, amp: float = 1.0) -> np.ndarray:
    return np.full(len(x), amp)


@register("flat_log")
def flat_log(x: np.ndarray) -> np.ndarray:
    """As many stars in each bin of log age as years are few in it; sums to 1."""
    w = 1 / np.diff(10 ** boundaries(x))
    return w / w.sum()


@register("exponential")
def exponential(x: np.ndarray, tau: float) -> np.ndarray:
    """tau in Gyr, x log10 of years."""
    return np.exp(-(10**x) / (tau * 1e9))


@register("bins_histo")
def bins_histo(x: np.ndarray, x_bins: Sequence[float], values: Sequence[float]) -> np.ndarray:
    """Steps: value i from x_bins[i] up to the next one; with a value less than bins the last is 0."""
    if len(values) not in (len(x_bins), len(x_bins) - 1):
        raise ValueError("values must be as many as bins, or one less")
    if x.min() < min(x_bins) or x.max() > max(x_bins):
        raise ValueError("x out of the bins' range")
    v = np.r_[values, 0] if len(values) < len(x_bins) else np.asarray(values, float)
    return v[np.searchsorted(x_bins, x, "right") - 1].astype(float)


@register("bins_interp")
def bins_interp(x: np.ndarray, x_bins: Sequence[float], values: Sequence[float]) -> np.ndarray:
    if x.min() < min(x_bins) or x.max() > max(x_bins):
        raise ValueError("x out of the bins' range")
    return np.interp(x, x_bins, values)


@register("lognormal")
def lognormal(x: np.ndarray, mean: float, sigma: float) -> np.ndarray:
    """Mean and sigma of the variable itself."""
    s2 = np.log(sigma**2 / mean**2 + 1)
    m = np.log(mean**2 / np.sqrt(sigma**2 + mean**2))
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.exp(-0.5 * (np.log(x) - m) ** 2 / s2) / (x * np.sqrt(2 * np.pi * s2))
    return np.where(x > 0, np.nan_to_num(y), 0.0)


@register("two_lognormal")
def two_lognormal(x: np.ndarray, mean1: float, mean2: float, sigma1: float, sigma2: float, n1_to_n2: float) -> np.ndarray:
    """Two of them with numbers in a ratio, each normalised over the whole axis."""
    n1 = 1 - 1 / (n1_to_n2 + 1)
    a, b = lognormal(x, mean1, sigma1), lognormal(x, mean2, sigma2)
    area = lambda y: float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()) or 1.0
    return n1 * a / area(a) + (1 - n1) * b / area(b)


@register("absexponential")
def absexponential(x: np.ndarray, dist0: float, tau: float, amp: float = 1.0) -> np.ndarray:
    return amp * np.exp(-np.abs(x - dist0) / tau)


@register("step")
def step(x: np.ndarray, y: np.ndarray, dist0: float, amp1: float, damp2: float, lgsigma1: float, lgsigma2: float) -> np.ndarray:
    """Dust that is amp1 ahead of the distance dist0 and damp2 more behind it, lognormal around either."""
    out = np.zeros(len(x))
    for near, mean, sigma in ((True, amp1, lgsigma1), (False, amp1 + damp2, lgsigma2)):
        at = (y < dist0) if near else (y >= dist0)
        out[at] = lognormal(x[at], mean, sigma)
    return out


# Slopes of the initial mass functions, and the masses at which they change.
@register("salpeter")
def salpeter(x: np.ndarray, slope: float = 2.35) -> np.ndarray:
    return mean_imf(x, [0.0, np.inf], [slope])


@register("kroupa")
def kroupa(x: np.ndarray, alpha: Sequence[float] = (0.3, 1.3, 2.3, 2.3)) -> np.ndarray:
    return mean_imf(x, [0.0, 0.08, 0.5, 1.0, np.inf], alpha)


def mean_imf(x: np.ndarray, breaks: Sequence[float], slopes: Sequence[float]) -> np.ndarray:
    """Integral of a broken power law over each mass bin, over their mean; the law is continuous at its breaks."""
    order = np.argsort(x)
    edges = boundaries(x[order])
    scale = [1.0]
    for b, s0, s1 in zip(breaks[1:-1], slopes[:-1], slopes[1:], strict=True):
        scale.append(scale[-1] * b ** (s1 - s0))
    out = np.zeros(len(x))
    for lo, hi, s, c in zip(breaks[:-1], breaks[1:], slopes, scale, strict=True):
        a, b = np.clip(edges[:-1], max(lo, 1e-12), hi), np.clip(edges[1:], max(lo, 1e-12), hi)
        part = c * (np.log(b / a) if s == 1 else (b ** (1 - s) - a ** (1 - s)) / (1 - s))
        out += np.where(b > a, part, 0.0)
    result = np.empty(len(x))
    result[order] = out / out.mean()
    return result
