"""Frame-native group fits: each feature of an observation x feature frame has its own model.

A frame is a long table (observation, feature, beta, variance...) with a small
table of the observations' covariates. A plan checks the design and the width of
a feature before any cell is read; ``compute`` gives a result frame, (term x
feature), and diagnostics by feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import formula as M
from ..functions import special as S
from . import gram
from . import lmm as L
from . import reduce as R

METHODS = ("ols:voxelwise", "lmm:ri_knownvar")
RESULT = "feature string, result_type string, term string, estimate double, std_error double, statistic double, p_value double, converged boolean, log_likelihood double, sigma2 double, degrees_freedom double, n_obs long"


@dataclass(frozen=True)
class FramePlan:
    """A checked fit that has read no cells yet."""

    frame: DataFrame
    design: M.Design
    groups: tuple
    method: str
    estimate: str
    variance: str | None
    fit: str

    def compute(self) -> "FrameResult":
        return FrameResult(_ols(self) if self.method == METHODS[0] else _random_intercept(self))


@dataclass(frozen=True)
class FrameResult:
    rows: DataFrame

    def result_frame(self) -> DataFrame:
        """(feature, result_type, term, estimate, std_error, statistic, p_value): a row for each term of each feature."""
        return self.rows.select("feature", "result_type", "term", "estimate", "std_error", "statistic", "p_value")

    def diagnostics(self) -> DataFrame:
        """(feature, converged, log_likelihood, sigma2, degrees_freedom, n_obs)."""
        return self.rows.select("feature", "converged", "log_likelihood", "sigma2", "degrees_freedom", "n_obs").distinct()


def group_plan(frame: DataFrame, observations: DataFrame, formula: str = "~ 1", method: str = "lmm:ri_knownvar", group: str | None = None, estimate: str = "beta", variance: str = "variance", memory_budget: int = 256 << 20, fit: str = "REML") -> FramePlan:
    """Check a fit. ``observations`` is (observation, covariates...), one row each; ``group`` names the random intercept's column.

    One feature of all observations must fit ``memory_budget`` bytes; the
    observations' table is read here, so its size is known before it is sent to tasks.
    """
    if method not in METHODS:
        raise ValueError(f"{method} has no frame execution; known: {', '.join(METHODS)}")
    known = method == METHODS[1]
    missing = [c for c in (estimate, *([variance] if known else [])) if c not in frame.columns]
    if missing:
        raise ValueError(f"frame assay not found: {', '.join(missing)}")
    if fit not in ("REML", "ML"):
        raise ValueError("fit is REML or ML")
    if observations.count() * 8 * (2 if known else 1) > memory_budget:
        raise ValueError("memory_budget cannot hold one feature of all observations")
    rows = [r.asDict() for r in observations.orderBy("observation").collect()]
    if len({r["observation"] for r in rows}) != len(rows) or any(r["observation"] is None for r in rows):
        raise ValueError("observation ids must be unique and present")
    design = M.design(rows, "observation", formula)
    if np.linalg.matrix_rank(design.matrix) < design.matrix.shape[1]:
        raise ValueError("the fixed-effects design is rank deficient")
    groups: tuple = ()
    if known:
        if group is None or any(r[group] is None for r in rows):
            raise ValueError("a random intercept needs one complete grouping column")
        of = {r["observation"]: r[group] for r in rows}
        names = {g: i for i, g in enumerate(dict.fromkeys(of[o] for o in design.subjects))}
        groups = tuple(names[of[o]] for o in design.subjects)
    return FramePlan(frame, design, groups, method, estimate, variance if known else None, fit)


def fit_group(frame: DataFrame, observations: DataFrame, formula: str = "~ 1", **options) -> FrameResult:
    """``group_plan(...).compute()``."""
    return group_plan(frame, observations, formula, **options).compute()


def _table(rows: list[list]) -> pd.DataFrame:
    names = [f.split()[0] for f in RESULT.split(", ")]
    table = pd.DataFrame(rows, columns=names, dtype=object)
    return table.where(table.notna(), None)


def _number(x):
    return float(x) if x is not None and np.isfinite(x) else None


def _ols(plan: FramePlan) -> DataFrame:
    terms, design = plan.design.terms, plan.design
    if terms[0] != "(Intercept)" or len(terms) > gram.MOST_TERMS:
        raise ValueError(f"a frame's least squares need an intercept and at most {gram.MOST_TERMS} terms")
    xs = [f"__x{i}" for i in range(1, len(terms))]
    axis = plan.frame.sparkSession.createDataFrame([(o, *map(float, row[1:])) for o, row in zip(design.subjects, design.matrix)], "observation string" + "".join(f", {x} double" for x in xs))
    cells = plan.frame.select(F.col("observation").cast("string").alias("observation"), F.col("feature").cast("string").alias("feature"), X.finite(plan.estimate).alias("__y"))
    made = gram.sums(cells.join(F.broadcast(axis), "observation"), ["feature"], "__y", xs)

    def run(batches):
        for pdf in batches:
            n, m, v = gram.stacked(pdf, len(terms))
            got = gram.solve(n, m, v)
            se, t, p = gram.statistics(got)
            rows = []
            for i, feature in enumerate(pdf["feature"]):
                ok = bool(got["good"][i])
                for k, term in enumerate(terms):
                    own = [_number(a[i, k]) if ok else None for a in (got["coef"], se, t, p)]
                    rows.append([feature, "fixed_effect", term, *own, ok, None, _number(got["sigma2"][i]) if ok else None, float(got["df"][i]), int(n[i])])
            yield _table(rows)

    return made.mapInPandas(run, RESULT)


def _criterion(y, v, x, starts, tau2, sigma2, reml):
    """(-2 log likelihood, coefficients, covariance) of V = diag(v + sigma2) + tau2 within groups; rows lie group by group."""
    w = 1 / (v + sigma2)
    s = np.add.reduceat(w, starts)
    shrink = tau2 / (1 + tau2 * s)
    wx, wy = x * w[:, None], y * w
    gx, gy = np.add.reduceat(wx, starts), np.add.reduceat(wy, starts)
    a = x.T @ wx - (gx * shrink[:, None]).T @ gx
    b = x.T @ wy - (gx * shrink[:, None]).T @ gy
    try:
        chol = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return np.inf, None, None
    cov = np.linalg.inv(a)
    coef = cov @ b
    quadratic = y @ wy - (shrink * gy**2).sum() - b @ coef
    value = -np.log(w).sum() + np.log1p(tau2 * s).sum() + quadratic
    return value + (2 * np.log(np.diag(chol)).sum() if reml else 0.0), coef, cov


def random_intercept(y, v, x, groups, reml=True):
    """One feature's fit, None where it is not determined: coef, cov, the two variances, log-likelihood, df."""
    order = np.argsort(groups, kind="stable")
    y, v, x, groups = y[order], v[order], x[order], groups[order]
    p = x.shape[1]
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    if len(y) <= p or len(starts) < 2 or np.linalg.matrix_rank(x) < p:
        return None
    value = lambda th: _criterion(y, v, x, starts, *np.exp(np.clip(th, -20, 10)), reml)[0]
    observed = float(np.var(y, ddof=1))
    excess = max(observed - float(np.median(v)), observed * 0.1, 1e-8)
    first = np.log([0.65 * excess, 0.35 * excess])
    found = [L.nelder_mead(value, np.array(s, float)) for s in (first, [-12, first[1]], [first[0], -12], [-6, -6])]
    theta, best = min(found, key=lambda f: f[1])
    if not np.isfinite(best):
        return None
    tau2, sigma2 = np.exp(np.clip(theta, -20, 10))
    _, coef, cov = _criterion(y, v, x, starts, tau2, sigma2, reml)
    return coef, cov, float(tau2), float(sigma2), -best / 2, max(len(y) - p, 1)


def _random_intercept(plan: FramePlan) -> DataFrame:
    if plan.frame.where(X.finite(plan.variance) <= 0).limit(1).count():
        raise ValueError("known sampling variances must be positive")
    design, terms, groups = plan.design, plan.design.terms, np.array(plan.groups)
    spark = plan.frame.sparkSession
    axis = spark.createDataFrame([(o, i) for i, o in enumerate(design.subjects)], "observation string, at int")
    cells = plan.frame.select(F.col("observation").cast("string").alias("observation"), F.col("feature").cast("string").alias("feature"), X.finite(plan.estimate).alias("y"), X.finite(plan.variance).alias("v")).where("y is not null and v is not null")
    made = cells.join(F.broadcast(axis) if len(groups) <= R.SENT else axis, "observation").select("feature", "at", "y", "v").repartition("feature").sortWithinPartitions("feature", "at")
    x, reml = design.matrix, plan.fit == "REML"

    def features(batches):
        """(feature, at, y, v) of one feature after another, from sorted batches."""
        name, parts = None, []
        for pdf in batches:
            if not len(pdf):
                continue
            of, cells = pdf["feature"].to_numpy(), [pdf[c].to_numpy() for c in ("at", "y", "v")]
            first = R.starts([of])
            for a, b in zip(first, [*first[1:], len(of)]):
                if parts and of[a] != name:
                    yield name, *map(np.concatenate, zip(*parts))
                    parts = []
                name = of[a]
                parts.append([c[a:b] for c in cells])
        if parts:
            yield name, *map(np.concatenate, zip(*parts))

    def run(batches):
        for feature, at, y, v in features(batches):
            got = random_intercept(y, v, x[at], groups[at], reml)
            n = len(y)
            if got is None:
                rows = [[feature, "fixed_effect", t, *[None] * 4, False, None, None, None, n] for t in terms]
                rows += [[feature, "variance_component", t, *[None] * 4, False, None, None, None, n] for t in ("random_intercept", "residual")]
                yield _table(rows)
                continue
            coef, cov, tau2, sigma2, loglik, df = got
            se = np.sqrt(np.diag(cov))
            t = coef / se
            p = S.t_two_sided(t, np.full(len(t), float(df)))
            rows = [[feature, "fixed_effect", term, *map(_number, (coef[k], se[k], t[k], p[k])), True, loglik, sigma2, float(df), n] for k, term in enumerate(terms)]
            rows += [[feature, "variance_component", term, value, None, None, None, True, loglik, sigma2, float(df), n] for term, value in (("random_intercept", tau2), ("residual", sigma2))]
            yield _table(rows)

    return made.mapInPandas(run, RESULT)
