"""Distribution functions on numpy arrays: normal, Student's t, its noncentral form, and chi-squared."""

from __future__ import annotations

import math

import numpy as np

_log_gamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def normal_cdf(z):
    return 0.5 * (1 + _erf(np.asarray(z, float) / math.sqrt(2)))


def _bisect(cdf, p, low: float, high: float, steps: int = 80):
    p = np.asarray(p, float)
    a, b = np.full(p.shape, low), np.full(p.shape, high)
    for _ in range(steps):
        middle = (a + b) / 2
        below = cdf(middle) < p
        a, b = np.where(below, middle, a), np.where(below, b, middle)
    return (a + b) / 2


def normal_quantile(p):
    return _bisect(normal_cdf, p, -40.0, 40.0)


def incomplete_beta(x, a, b):
    """The regularised incomplete beta function, by its continued fraction."""
    x, a, b = (v.astype(float) for v in np.broadcast_arrays(x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones(z.shape), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.abs(d * c - 1).max(initial=0) < 1e-15:
            break
    value = np.where(z <= 0, 0.0, front * h)
    return np.where(turn, 1 - value, value)


def t_cdf(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = incomplete_beta(df / (df + t * t), df / 2, 0.5) / 2
    return np.where(t > 0, 1 - tail, tail)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def t_quantile(p, df):
    return _bisect(lambda t: t_cdf(t, df), np.broadcast_arrays(np.asarray(p, float), df)[0], -1e6, 1e6)


def chi2_upper(x, df):
    """Upper tail of the chi-squared distribution for whole degrees of freedom, by its recurrence."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df))
    out = np.zeros(x.shape)
    for i in np.ndindex(x.shape):
        half, k = max(float(x[i]), 0.0) / 2, int(df[i])
        if half == 0:
            out[i] = 1.0
            continue
        tail = math.erfc(math.sqrt(half)) if k % 2 else math.exp(-half)
        for s in np.arange(0.5 if k % 2 else 1.0, k / 2, 1.0):
            tail += math.exp(s * math.log(half) - half - math.lgamma(s + 1))
        out[i] = tail
    return out


def noncentral_t_cdf(t: float, df: float, shift: float) -> float:
    """P(T <= t): the normal part averaged over the distribution of the estimated deviation."""
    u = np.linspace(max(1e-9, 1 - 12 / math.sqrt(2 * df)), 1 + 14 / math.sqrt(2 * df), 4001)
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(u) - df * u * u / 2
    return float(np.clip(np.trapezoid(np.exp(log_density) * normal_cdf(t * u - shift), u), 0, 1))


def t_test_power(effect: float, n1: int, n2: int, alpha: float = 0.05) -> float:
    """Power of the two-sided t-test of two groups at a standardised effect."""
    df, shift = n1 + n2 - 2, abs(effect) * math.sqrt(n1 * n2 / (n1 + n2))
    critical = float(t_quantile(1 - alpha / 2, df))
    return min(1.0, max(0.0, 1 - noncentral_t_cdf(critical, df, shift) + noncentral_t_cdf(-critical, df, shift)))
