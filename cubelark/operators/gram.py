"""Ordinary least squares from centred cross-products.

Variances and covariances of the covariates and the measure are Spark aggregates
that merge exactly the sums a fit needs: they are taken in the JVM, partially
before the shuffle, and a fit then costs one row of p (p + 3) / 2 numbers, which
batches of NumPy solves turn into coefficients.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special as S

#: More terms than this make an aggregate of too many columns; wider designs are solved in blocks.
MOST_TERMS = 12


def sums(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """(keys, n, m, v): the number, the means of xs and y, and the upper triangle of their population covariances, of rows with y."""
    columns = [*xs, y]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    own = rows.where(F.col(y).isNotNull())
    return own.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("m"), F.array(*[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).alias("v"))


def solve(n: np.ndarray, m: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """coef, cov [fit, p, p], sigma2, df and whether the fit is determined; the intercept is the first term."""
    q = m.shape[1] - 1
    p = q + 1
    full = np.zeros((len(n), p, p))
    i, j = np.triu_indices(p)
    full[:, i, j] = full[:, j, i] = v
    c, cy, vy = full[:, :q, :q], full[:, :q, q], full[:, q, q]
    scale = np.sqrt(np.maximum(np.einsum("cjj->cj", c), 1e-300))
    unit = c / scale[:, :, None] / scale[:, None, :]
    good = (n >= p + 1) & np.isfinite(full).all((1, 2))
    if q:
        good &= np.linalg.cond(np.where(good[:, None, None], unit, np.eye(q))) < 1e12
    inv = np.linalg.inv(np.where(good[:, None, None], unit, np.eye(q))) / scale[:, :, None] / scale[:, None, :]
    slopes = np.einsum("cjk,ck->cj", inv, cy)
    mean = m[:, :q]
    coef = np.concatenate([(m[:, q] - (slopes * mean).sum(1))[:, None], slopes], 1)
    df = n - p
    rss = np.maximum(n * (vy - (slopes * cy).sum(1)), 0.0)
    sigma2 = rss / np.maximum(df, 1)
    cov = np.empty((len(n), p, p))
    shift = np.einsum("cjk,ck->cj", inv, mean)
    cov[:, 0, 0] = 1 + (shift * mean).sum(1)
    cov[:, 0, 1:] = cov[:, 1:, 0] = -shift
    cov[:, 1:, 1:] = inv
    cov *= (sigma2 / np.maximum(n, 1))[:, None, None]
    return {"coef": coef, "cov": cov, "sigma2": sigma2, "df": df, "good": good}


def statistics(got: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standard errors, t and two-sided p of every coefficient."""
    with np.errstate(all="ignore"):
        se = np.sqrt(np.maximum(np.einsum("cjj->cj", got["cov"]), 0))
        t = got["coef"] / np.where(se > 0, se, np.nan)
    return se, t, S.t_two_sided(t, np.broadcast_to(np.maximum(got["df"], 1)[:, None], t.shape).astype(float))


def stacked(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, m, v) of a batch of ``sums`` for ``width`` columns."""
    dense = lambda c, k: np.array([[np.nan if x is None else x for x in r] for r in c], float).reshape(-1, k)
    return pdf["n"].to_numpy(), dense(pdf["m"], width), dense(pdf["v"], width * (width + 1) // 2)
