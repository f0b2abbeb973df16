"""Incremental fixed-effects means: mergeable sums of an unbounded stream of cells.

The state of a (sample, contrast) is four sums, so the result does not depend on
how cells are batched. Cells carry a shift (a rough location of the measure) out
of the sums, which keeps Q from cancelling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators.verbs import EPS

CELL = ["sample", "contrast"]


def meta_fe_sums(cells: DataFrame, shift: float = 0.0, watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """Running sums of w, w y, w y^2 and the count; with a watermark (column, delay) and a window, of each window."""
    y, v = X.finite("beta") - shift, X.finite("var")
    if watermark:
        cells = cells.withWatermark(*watermark)
    keys = [*CELL, *([F.window(watermark[0], window)] if watermark and window else [])]
    rows = cells.withColumn("__y", y).withColumn("__v", v).where("__y is not null and __v > 0").withColumn("__w", 1 / F.greatest(F.col("__v"), F.lit(EPS)))
    return rows.groupBy(*keys).agg(F.sum("__w").alias("sw"), F.sum(F.col("__w") * F.col("__y")).alias("swy"), F.sum(F.col("__w") * F.col("__y") * F.col("__y")).alias("swyy"), F.count("*").alias("n_eff"))


def finish(sums: DataFrame, shift: float = 0.0, min_subjects: int = 2) -> DataFrame:
    """beta, var, z, Q of the sums of ``meta_fe_sums``."""
    ok = lambda c: F.when(F.col("n_eff") >= min_subjects, c)
    mean = F.col("swy") / F.col("sw")
    rest = [c for c in sums.columns if c not in ("sw", "swy", "swyy")]
    return sums.select(*rest, ok(mean + shift).alias("beta"), ok(1 / F.col("sw")).alias("var"), ok((mean + shift) * F.sqrt("sw")).alias("z"), ok(F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * mean)).alias("Q"))
