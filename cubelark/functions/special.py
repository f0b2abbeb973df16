"""Distribution functions in NumPy alone, on arrays; NaN in, NaN out.

Tails are kept on the log scale, so p-values far below the smallest double
still give finite z-scores.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_TINY = 1e-300


def lgamma(x):
    return np.asarray(_lgamma(x), float) if np.ndim(x) else math.lgamma(x)


def norm_sf(z):
    """Upper tail of the standard normal."""
    return 0.5 * np.asarray(_erfc(np.asarray(z, float) / math.sqrt(2)), float)


def norm_logsf(z):
    """Log of the upper tail; by the asymptotic series beyond 30."""
    z = np.asarray(z, float)
    far = z > 30
    near = np.log(np.maximum(norm_sf(np.where(far, 0, z)), _TINY))
    s = np.where(far, z, 31.0)
    series = 1 - 1 / s**2 + 3 / s**4 - 15 / s**6 + 105 / s**8
    return np.where(far, -0.5 * s * s - np.log(s) - 0.5 * math.log(2 * math.pi) + np.log(series), near)


def norm_isf_log(logp):
    """z with log upper tail ``logp`` (natural log); Newton steps on the log scale."""
    logp = np.asarray(logp, float)
    flat = np.atleast_1d(logp).astype(float)
    out = np.full(flat.shape, np.nan)
    inv = NormalDist().inv_cdf
    for i, lp in enumerate(flat):
        if np.isnan(lp):
            continue
        if lp >= 0:
            out[i] = -np.inf
        elif lp == -np.inf:
            out[i] = np.inf
        elif lp > -600:
            p = math.exp(lp)
            out[i] = -inv(p) if p < 0.5 else inv(-math.expm1(lp)) if -math.expm1(lp) > 0 else -np.inf
        else:
            out[i] = math.sqrt(-2 * lp)
    good = np.isfinite(out)
    for _ in range(4):
        z = np.where(good, out, 0.0)
        f = norm_logsf(z)
        hazard = np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - f)
        step = np.where(good & (z > 1), (f - flat) / hazard, 0.0)
        out = np.where(good, z + np.clip(np.where(np.isfinite(step), step, 0.0), -5, 5), out)
    return out.reshape(logp.shape) if logp.ndim else float(out[0])


def _betacf(a, b, x, rounds=400):
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-30
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def log_betainc(a, b, x, y=None):
    """log I_x(a, b); ``y`` is 1 - x where that is known more exactly."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    y = 1 - x if y is None else np.broadcast_to(np.asarray(y, float), x.shape)
    ok = (x > 0) & (y > 0)
    xs, ys = np.where(ok, x, 0.5), np.where(ok, y, 0.5)
    front = lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(xs) + b * np.log(ys)
    direct = xs < (a + 1) / (a + b + 2)
    lower = front + np.log(np.maximum(_betacf(a, b, np.where(direct, xs, 0.25), 400), _TINY)) - np.log(a)
    upper = front + np.log(np.maximum(_betacf(b, a, np.where(direct, 0.25, ys), 400), _TINY)) - np.log(b)
    value = np.where(direct, lower, np.log1p(-np.minimum(np.exp(np.minimum(upper, 0)), 1 - 1e-16)))
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, -np.inf, np.where(y <= 0, 0.0, value)))


def t_logsf(t, df):
    """Log upper tail of Student's t; an infinite df is the normal."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    big = np.isinf(df) | (df > 1e10)
    d = np.where(big | ~(df > 0), 1.0, df)
    s = np.abs(t)
    x = d / (d + s * s)
    half = log_betainc(d / 2, 0.5, x, s * s / (d + s * s)) - math.log(2)
    tail = np.where(t >= 0, half, np.log1p(-np.exp(np.minimum(half, -math.log(2)))))
    out = np.where(big, norm_logsf(t), tail)
    return np.where((df > 0) & ~np.isnan(t), out, np.nan)


def t_sf(t, df):
    return np.exp(t_logsf(t, df))


def t_two_sided(t, df):
    return np.minimum(1.0, 2 * np.exp(t_logsf(np.abs(t), df)))


def f_logsf(f, d1, d2):
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    s = np.maximum(f, 0)
    x = d2 / (d2 + d1 * s)
    return np.where(np.isnan(f), np.nan, log_betainc(d2 / 2, d1 / 2, x, d1 * s / (d2 + d1 * s)))


def f_sf(f, d1, d2):
    return np.exp(f_logsf(f, d1, d2))


def gammaincc(a, x):
    """Regularised upper incomplete gamma."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    bad, zero, inf = np.isnan(a) | np.isnan(x) | (a <= 0), x <= 0, np.isinf(x)
    aa, xx = np.where(bad, 1.0, a), np.where(bad | zero | inf, 1.0, x)
    front = np.exp(-xx + aa * np.log(xx) - lgamma(aa))
    low = xx < aa + 1
    term = 1 / aa
    total, k = term.copy(), aa.copy()
    for _ in range(2000):
        k = k + 1
        term = term * np.where(low, xx, 0.0) / k
        total = total + term
        if np.all(np.abs(term) <= np.abs(total) * 1e-16):
            break
    xc = np.where(low, aa + 2, xx)
    b = xc + 1 - aa
    c = np.full_like(b, 1e300)
    d = 1 / b
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - aa)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    q = np.where(low, 1 - front * total, front * h)
    return np.where(bad, np.nan, np.where(zero, 1.0, np.where(inf, 0.0, np.clip(q, 0, 1))))


def chi2_sf(x, df):
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chi2_isf(p, df):
    """Upper quantile: Wilson-Hilferty's start, then guarded Newton steps on the log of the tail."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    ok = (p > 0) & (p < 1) & (df > 0)
    pp, d = np.where(ok, p, 0.5), np.where(ok, df, 1.0)
    z = norm_isf_log(np.log(pp))
    x = np.maximum(d * (1 - 2 / (9 * d) + z * np.sqrt(2 / (9 * d))) ** 3, 1e-8)
    for _ in range(60):
        q = np.maximum(chi2_sf(x, d), _TINY)
        density = np.exp((d / 2 - 1) * np.log(x) - x / 2 - d / 2 * math.log(2) - lgamma(d / 2))
        step = (np.log(q) - np.log(pp)) * q / np.maximum(density, _TINY)
        new = np.where(x + step > 0, x + step, x / 2)
        if np.all(np.abs(new - x) <= 1e-14 * np.maximum(x, 1)):
            x = new
            break
        x = new
    return np.where(ok, x, np.where(p <= 0, np.inf, np.where(p >= 1, 0.0, np.nan)))


def t_to_z(t, df):
    """z of the same one-sided tail as t."""
    t = np.asarray(t, float)
    return np.sign(t) * norm_isf_log(t_logsf(np.abs(t), df))


def p_to_z(p, effect):
    """z of a two-sided p, signed by the effect."""
    return norm_isf_log(np.log(np.maximum(np.asarray(p, float) / 2, _TINY))) * np.sign(effect)


def tail_p(stat, alternative="two.sided", df=None):
    """p of a z (or t, with df): anything but 'greater' and 'less' is two-sided."""
    logsf = norm_logsf if df is None else lambda v: t_logsf(v, df)
    stat = np.asarray(stat, float)
    if alternative == "greater":
        return np.exp(logsf(stat))
    if alternative == "less":
        return np.exp(logsf(-stat))
    return np.minimum(1.0, 2 * np.exp(logsf(np.abs(stat))))
