"""Linear mixed models: random intercepts, one random slope, known sampling variances.

Repeats of a subject are its contrasts. A sample with any missing cell has no
fit. Without known variances the model of each block depends on the variance
ratios alone, so sigma^2 and the fixed effects drop out of the search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from ..functions import formula as M
from ..functions import special as S

#: Bounds of the search over the log variance ratio.
LOW, HIGH = -14.0, 10.0


def between_within_df(x: np.ndarray, repeats: int) -> list[int]:
    """Degrees of freedom by term: subjects less the rank of what is constant within subjects, else cells less terms."""
    n = len(x) // repeats
    blocks = x.reshape(n, repeats, -1)
    constant = (blocks == blocks[:, :1]).all((0, 1))
    rank = int(np.linalg.matrix_rank(blocks[:, 0][:, constant])) if constant.any() else 0
    return [n - rank if c else len(x) - x.shape[1] for c in constant]


def _profile(v: np.ndarray, x: np.ndarray, y: np.ndarray, reml: bool, known: bool):
    """Criterion (-2 log likelihood up to a constant), coefficients, their unscaled covariance and sigma^2, for blocks v."""
    n, k = len(v), v.shape[1]
    try:
        chol = np.linalg.cholesky(v)
    except np.linalg.LinAlgError:
        return np.inf, None, None, None
    xb = np.linalg.solve(chol, x.reshape(n, k, -1)).reshape(n * k, -1)
    yb = np.linalg.solve(chol, y.reshape(n, k, 1)).reshape(-1)
    a = xb.T @ xb
    inv = np.linalg.pinv(a)
    coef = inv @ (xb.T @ yb)
    rss = float(((yb - xb @ coef) ** 2).sum())
    df = n * k - x.shape[1] if reml else n * k
    logdet = 2 * float(np.log(np.diagonal(chol, axis1=1, axis2=2)).sum()) + (float(np.linalg.slogdet(a)[1]) if reml else 0.0)
    if known:
        return logdet + rss + df * np.log(2 * np.pi), coef, inv, 1.0
    sigma2 = max(rss / df, 1e-12)
    return logdet + df * (np.log(sigma2) + 1 + np.log(2 * np.pi)), coef, inv, sigma2


def golden(fun, low: float = LOW, high: float = HIGH, grid: int = 49, rounds: int = 60) -> float:
    """The least point of a grid, refined by golden-section search around it."""
    at = np.linspace(low, high, grid)
    values = [fun(a) for a in at]
    i = int(np.argmin(values))
    a, b = at[max(0, i - 1)], at[min(grid - 1, i + 1)]
    r = (np.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = fun(c), fun(d)
    for _ in range(rounds):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = fun(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = fun(d)
    return float((a + b) / 2)


def nelder_mead(fun, start: np.ndarray, step: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    points = [start, *(start + step * e for e in np.eye(len(start)))]
    values = [fun(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-10 and np.abs(points[-1] - points[0]).max() < 1e-6:
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = centre + (centre - points[-1])
        fr = fun(reflected)
        if fr < values[0]:
            further = centre + 2 * (centre - points[-1])
            ff = fun(further)
            points[-1], values[-1] = (further, ff) if ff < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            inner = centre + 0.5 * ((reflected if fr < values[-1] else points[-1]) - centre)
            fi = fun(inner)
            if fi < min(fr, values[-1]):
                points[-1], values[-1] = inner, fi
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(fun(p) for p in points[1:])]
    i = int(np.argmin(values))
    return points[i], float(values[i])


def _covariance(theta: np.ndarray, slope: bool, full: bool) -> np.ndarray:
    """Random-effect covariance from logs of standard deviations (or a Cholesky factor)."""
    if not slope:
        return np.array([[np.exp(2 * theta[0])]])
    if not full:
        return np.diag(np.exp(2 * theta))
    c = np.array([[np.exp(theta[0]), 0.0], [theta[1], np.exp(theta[2])]])
    return c @ c.T


def fit(y, x, repeats, z=None, known=None, reml=True, full=False, theta=None):
    """One sample's fit: dict of coefficients, covariance, sigma2, random-effect covariance, log-likelihood, theta."""
    n = len(y) // repeats
    slope = z is not None
    zz = np.stack([np.ones(len(y)), z], 1).reshape(n, repeats, 2) if slope else np.ones((n, repeats, 1))
    eye = np.eye(repeats)
    free = 1 + (1 + full if slope else 0)

    def blocks(th):
        g = _covariance(th[:free], slope, full)
        noise = eye if known is None else known.reshape(n, repeats)[:, :, None] * eye + np.exp(2 * th[free]) * eye
        return zz @ g @ zz.transpose(0, 2, 1) + noise

    def value(th):
        return _profile(blocks(np.clip(th, -20, 20)), x, y, reml, known is not None)[0]

    if theta is None:
        if known is None:
            eta = golden(lambda e: value(np.array([e / 2, *([-7.0] if slope and not full else [0.0, -7.0] if slope else [])])))
            theta = np.array([eta / 2])
            if slope:
                scale = np.log(1 / max(np.std(z), 1e-6))
                starts = [np.array([eta / 2, *([0.0] if full else []), s]) for s in (scale - 2, scale, -7.0)]
                theta = min((nelder_mead(value, s) for s in starts), key=lambda r: r[1])[0]
        else:
            spread = np.log(max(np.std(y), 1e-6))
            starts = [np.array([a, *([0.0] if slope and full else []), *([a] if slope else []), b]) for a in (spread, spread - 3) for b in (spread, spread - 3)]
            theta = min((nelder_mead(value, s) for s in starts), key=lambda r: r[1])[0]
    if known is None and not slope and value(np.array([-20.0])) <= value(theta) + 1e-9:
        theta = np.array([-20.0])  # no variance between subjects
    criterion, coef, inv, sigma2 = _profile(blocks(np.clip(theta, -20, 20)), x, y, reml, known is not None)
    g = _covariance(np.clip(theta[:free], -20, 20), slope, full) * (sigma2 if known is None else 1.0)
    residual = sigma2 if known is None else float(np.exp(2 * np.clip(theta[free], -20, 20)))
    return {"coef": coef, "cov": inv * sigma2, "sigma2": residual, "g": g, "loglik": -criterion / 2, "theta": theta, "converged": float(theta[0] * 2 < HIGH - 1e-3)}


def joint_design(cube, design: M.Design, slope: str | None, center: bool):
    """(x, terms, z): the subject design repeated over the contrasts, the slope column among the fixed effects."""
    repeats = cube.size("contrast")
    x, terms, z = np.repeat(design.matrix, repeats, axis=0), list(design.terms), None
    if slope:
        values = [r[0] for r in cube.contrasts.orderBy("ord").select(slope).collect()]
        if any(v is None for v in values) or len(set(values)) < 2:
            raise ValueError(f"{slope} must be a number of each contrast, and vary")
        v = np.array(values, float)
        z = np.tile(v - v.mean() if center else v, len(design.subjects))
        x, terms = np.column_stack([x, z]), [*terms, slope]
    return x, terms, z


def reduce_lmm(cube, design: M.Design, slope_model=False, known=False, fit_method="REML", theta_mode="voxelwise", slope=None, center_slope=False, covariance="diag"):
    """Fits by sample over all contrasts; theta_mode pooled finds one variance ratio for all samples first."""
    from . import reduce as R

    if slope_model and not slope:
        raise ValueError("a slope model needs the name of a numeric contrast attribute")
    if theta_mode not in ("voxelwise", "pooled") or (known and theta_mode == "pooled"):
        raise ValueError("theta_mode is voxelwise or, without known variances, pooled")
    repeats, n = cube.size("contrast"), cube.size("subject")
    if len(design.subjects) != n:
        raise ValueError("every subject needs its covariates")
    x, terms, z = joint_design(cube, design, slope if slope_model else None, center_slope)
    reml, full = fit_method == "REML", covariance == "full"
    dof = between_within_df(x, repeats)
    assays = ["beta", "var"] if known else ["beta"]
    made = R.blocks(cube, assays, ["sample"], n)
    extra = ["sigma2", "vc_intercept", "vc_resid", "df_res", "logLik", "converged", "lambda"] + (["vc_slope", "corr"] if slope_model else []) + (["sampling_var_mean"] if known else [])
    columns = [f"{q}:{t}" for q in ("coef", "se_coef", "t_coef", "p_coef", "df_coef") for t in terms] + extra
    theta = None
    if theta_mode == "pooled":
        theta = _pooled(made, x, z, n, repeats, reml, full)

    def run(batches):
        for pdf, got in R.stacks(batches, ["sample"], n, assays, repeats):
            rows = []
            for i in range(len(pdf)):
                y, v = got[0][i], got[1][i] if known else None
                if not np.isfinite(y).all() or (known and not (np.isfinite(v).all() and (v > 0).all())):
                    rows.append([None] * len(columns))
                    continue
                f = fit(y, x, repeats, z, v, reml, full, theta)
                se = np.sqrt(np.maximum(np.diag(f["cov"]), 0))
                with np.errstate(all="ignore"):
                    t = f["coef"] / np.where(se > 0, se, np.nan)
                p = S.t_two_sided(t, np.array(dof, float))
                g = f["g"]
                row = [*f["coef"], *se, *t, *p, *dof, f["sigma2"], g[0, 0], f["sigma2"], len(y) - x.shape[1], f["loglik"], f["converged"], g[0, 0] / f["sigma2"] if f["sigma2"] else np.nan]
                if slope_model:
                    row += [g[1, 1], g[0, 1] / np.sqrt(g[0, 0] * g[1, 1]) if g[0, 0] * g[1, 1] > 0 else np.nan]
                if known:
                    row.append(v.mean())
                rows.append([None if not np.isfinite(q) else float(q) for q in row])
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            out.insert(0, "sample", pdf["sample"].to_numpy())
            yield out

    found = made.mapInPandas(run, "sample string, " + ", ".join(f"`{c}` double" for c in columns))
    from pyspark.sql import functions as F

    rows = cube.samples.select(F.col("id").alias("sample")).join(found, "sample", "left")
    return rows.select("sample", F.lit("meta").alias("subject"), F.lit("model").alias("contrast"), *[f"`{c}`" for c in columns])


def _pooled(made, x, z, n, repeats, reml, full):
    """The variance ratios that minimise the sum of all samples' criteria: each trial is one pass that sums in tasks."""
    from pyspark.sql import functions as F

    from . import reduce as R

    slope = z is not None
    zz = np.stack([np.ones(n * repeats), z], 1).reshape(n, repeats, 2) if slope else np.ones((n, repeats, 1))
    spark = made.sparkSession

    def totals(thetas):
        shared = spark.sparkContext.broadcast([np.asarray(t, float) for t in thetas])

        def run(batches):
            sums = np.zeros(len(shared.value))
            for _, got in R.stacks(batches, ["sample"], n, ["beta"], repeats):
                for y in got[0]:
                    if np.isfinite(y).all():
                        for i, th in enumerate(shared.value):
                            v = zz @ _covariance(th, slope, full) @ zz.transpose(0, 2, 1) + np.eye(repeats)
                            sums[i] += _profile(v, x, y, reml, False)[0]
            yield pd.DataFrame({"i": np.arange(len(sums)), "v": sums})

        rows = made.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]

    low, high = LOW / 2, HIGH / 2
    make = (lambda a, s: np.array([a, 0.0, s]) if full else np.array([a, s])) if slope else (lambda a, s: np.array([a]))
    for _ in range(4):  # a grid of trials in each pass, then a finer one around the best
        at = np.linspace(low, high, 9)
        trials = [make(a, s) for a in at for s in (at if slope else [0.0])]
        best = trials[int(np.argmin(totals(trials)))]
        width = (high - low) / 8
        low, high = best[0] - width, best[0] + width
    return best
