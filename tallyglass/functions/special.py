"""Special functions and density formulas on plain floats and numpy arrays."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_erf = np.vectorize(math.erf, otypes=[float])


def normal_cdf(z):
    return 0.5 * (1.0 + _erf(np.asarray(z, float) / math.sqrt(2.0)))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


normal_ppf_array = np.vectorize(lambda p: _NORMAL.inv_cdf(min(max(p, 1e-12), 1 - 1e-12)), otypes=[float])


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - scale * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, dof: int) -> float:
    return gamma_upper(dof / 2.0, x / 2.0)


def kolmogorov_sf(t: float) -> float:
    """Limit law of sqrt(n) * D."""
    if t <= 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def ks_p_value(stat: float, n: int, m: int) -> float:
    return kolmogorov_sf(math.sqrt(n * m / (n + m)) * stat)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def density(family: str, params: tuple, x: np.ndarray) -> np.ndarray:
    """Probability density of a fitted family at the points ``x``."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        if family == "norm":
            mu, sd = params
            y = np.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
        elif family == "lognorm":
            mu, sd = params
            y = np.where(x > 0, np.exp(-0.5 * ((np.log(x) - mu) / sd) ** 2) / (x * sd * math.sqrt(2 * math.pi)), 0.0)
        elif family == "expon":
            loc, scale = params
            y = np.where(x >= loc, np.exp(-(x - loc) / scale) / scale, 0.0)
        elif family == "gamma":
            shape, scale = params
            y = np.where(x > 0, np.exp((shape - 1) * np.log(x) - x / scale - math.lgamma(shape)
                                       - shape * math.log(scale)), 0.0)
        elif family == "beta":
            a, b, lo, width = params
            u = (x - lo) / width
            norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
            y = np.where((u > 0) & (u < 1), np.exp(norm + (a - 1) * np.log(u) + (b - 1) * np.log1p(-u)) / width, 0.0)
        elif family == "uniform":
            lo, width = params
            y = np.where((x >= lo) & (x <= lo + width), 1.0 / width, 0.0)
        elif family == "chi2":
            (k,) = params
            y = np.where(x > 0, np.exp((k / 2 - 1) * np.log(x) - x / 2 - (k / 2) * math.log(2) - math.lgamma(k / 2)), 0.0)
        elif family == "weibull_min":
            shape, scale = params
            u = x / scale
            y = np.where(x > 0, shape / scale * np.exp((shape - 1) * np.log(u) - u ** shape), 0.0)
        elif family == "t":
            v, mu, sd = params
            z = (x - mu) / sd
            norm = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(sd)
            y = np.exp(norm - (v + 1) / 2 * np.log1p(z * z / v))
        else:
            raise ValueError(f"unknown family: {family}")
    return np.nan_to_num(y, nan=0.0, posinf=0.0, neginf=0.0)
