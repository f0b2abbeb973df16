"""Distribution functions as Spark columns, in Arrow batches; nulls stay null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special as S


def _lift(fun, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            out = np.asarray(fun(*(s.to_numpy(float, na_value=np.nan) for s in series)), float)
        return pd.Series(out).where(~np.isnan(out), None)

    return run(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns])


def finite(column) -> Column:
    """The value where it is a finite number, else null: NaN and infinities are missing values."""
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def normal_p(z, alternative: str = "two.sided") -> Column:
    return _lift(lambda v: S.tail_p(v, alternative), z)


def t_p(t, df, alternative: str = "two.sided") -> Column:
    return _lift(lambda v, d: S.tail_p(v, alternative, d), t, df)


def f_p(f, df1, df2) -> Column:
    return _lift(S.f_sf, f, df1, df2)


def chi2_p(x, df) -> Column:
    return _lift(S.chi2_sf, x, df)


def chi2_quantile(p, df) -> Column:
    """Upper quantile."""
    return _lift(S.chi2_isf, p, df)


def t_to_z(t, df) -> Column:
    return _lift(S.t_to_z, t, df)


def p_to_z(p, effect) -> Column:
    return _lift(S.p_to_z, p, effect)


def chi2_p_even(x, half_df) -> Column:
    """Upper chi-squared tail for df = 2 * half_df, in the JVM: exp(-x/2) sum (x/2)^i / i!.

    The sum is kept as s e^l, so neither it nor exp(-x/2) leaves the range of a double.
    """
    x, k = (F.col(c) if isinstance(c, str) else c for c in (x, half_df))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"), F.lit(0.0).alias("l"))

    def step(acc, i):
        t = acc["t"] * x / 2 / i
        s = acc["s"] + t
        down = F.when(s > 1e200, 1e-200).otherwise(1.0)
        return F.struct((t * down).alias("t"), (s * down).alias("s"), (acc["l"] - F.ln(down)).alias("l"))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int") - 1, F.lit(1))), zero, step, lambda a: F.ln(a["s"]) + a["l"])
    return F.when(k >= 1, F.least(F.lit(1.0), F.exp(F.when(k == 1, F.lit(0.0)).otherwise(total) - x / 2)))
