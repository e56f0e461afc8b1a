"""Tail probabilities of a few result rows, in numpy."""

from __future__ import annotations

import math

import numpy as np


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2.0))


def beta_inc(a, b, x):
    """Regularised incomplete beta by its continued fraction (Lentz), elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    t = np.clip(t, 0.0, 1.0)
    tiny = 1e-300
    c = np.ones_like(t)
    d = 1.0 - (p + q) * t / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 400):
        for step in (
            m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        log_front = _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(t) + q * np.log1p(-t)
    value = np.where(t <= 0.0, 0.0, np.exp(log_front) * f / p)
    return np.where(swap, 1.0 - value, value)


def f_sf(f, df1, df2):
    """P(F > f)."""
    f = np.asarray(f, dtype=float)
    return beta_inc(np.asarray(df2) / 2.0, np.asarray(df1) / 2.0, df2 / (df2 + df1 * f))


def t_sf(t, df):
    """P(T > t)."""
    t = np.asarray(t, dtype=float)
    half = 0.5 * beta_inc(np.asarray(df) / 2.0, 0.5, df / (df + t * t))
    return np.where(t >= 0, half, 1.0 - half)


def t_upper(alpha: float, df):
    """t with P(T > t) = alpha, by bisection."""
    df = np.asarray(df, dtype=float)
    low, high = np.zeros_like(df), np.full_like(df, 1e6)
    for _ in range(200):
        mid = (low + high) / 2.0
        above = t_sf(mid, df) > alpha
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2.0


def noncentral_t_power(effect, n_per_group, alpha: float = 0.05):
    """Two-sided power of the two-sample t test: the normal tail averaged over the chi density."""
    effect, n = np.broadcast_arrays(np.asarray(effect, dtype=float), np.asarray(n_per_group, dtype=float))
    df = 2.0 * n - 2.0
    shift = effect * np.sqrt(n / 2.0)
    crit = t_upper(alpha / 2.0, np.maximum(df, 1.0))
    nodes, weights = np.polynomial.legendre.leggauss(400)
    out = np.zeros_like(effect)
    for i in np.ndindex(effect.shape):
        v = df[i]
        if v < 1:
            continue
        # s = sqrt(chi2_v / v) lies within a few standard deviations of 1
        width = 12.0 / math.sqrt(2.0 * v)
        lo, hi = max(1e-12, 1.0 - width), 1.0 + width
        s = lo + (nodes + 1.0) * (hi - lo) / 2.0
        log_pdf = math.log(2.0) + (v / 2.0) * math.log(v / 2.0) - math.lgamma(v / 2.0) + (v - 1.0) * np.log(s) - v * s * s / 2.0
        tails = normal_sf(crit[i] * s - shift[i]) + normal_sf(crit[i] * s + shift[i])
        out[i] = float(np.sum(weights * np.exp(log_pdf) * tails) * (hi - lo) / 2.0)
    return np.clip(out, 0.0, 1.0)
