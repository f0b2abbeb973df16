"""Tables as cubes: CSV, TSV, Parquet and DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cube import KEYS, Cube, Space, axis_of
from ..functions import columns as X
from ..registry import Adapter, adapters

ROW = "__row"


def read_table(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A file or folder as a table; every CSV column is text, so ids keep their leading zeros."""
    kind = format or ("tsv" if path.endswith((".tsv", ".tsv.gz")) else "csv" if path.endswith((".csv", ".csv.gz")) else "parquet")
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", inferSchema=False)
    return spark.read.parquet(path)


def as_number(column: str):
    """The column as a finite double; text that is no number is null."""
    return X.finite(F.expr(f"try_cast(`{column}` AS double)"))


def first_of_each(df: DataFrame, keys, order: str) -> DataFrame:
    """One row for each key: that of the least ``order``. A plain aggregate, so repeats combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__first")).select(*keys, *[F.col(f"__first.`{c}`").alias(c) for c in rest])


def duplicates(df: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, count) that occur more than once."""
    return df.groupBy(*keys).count().where("count > 1")


def lift_constant(df: DataFrame, by: str, columns) -> DataFrame:
    """(by, columns): attributes that must be constant within ``by``; a mix of values, or of null and values, is an error."""
    checks = [F.count_distinct(c).alias(f"n_{c}") for c in columns] + [F.count_if(F.col(c).isNull()).alias(f"z_{c}") for c in columns]
    seen = df.groupBy(by).agg(F.count("*").alias("n"), *checks, *[F.first(c, ignorenulls=True).alias(c) for c in columns])
    wrong = F.lit(False)
    for c in columns:
        wrong = wrong | (F.col(f"n_{c}") > 1) | ((F.col(f"z_{c}") > 0) & (F.col(f"z_{c}") < F.col("n")))
    bad = seen.where(wrong).select(by).take(3)
    if bad:
        raise ValueError(f"not constant within {by}: {[r[0] for r in bad]}")
    return seen.select(by, *columns)


def from_table(df: DataFrame, sample="sample", subject="subject", contrast="contrast", assays=None, order: str | None = None, contrast_columns=(), space: Space = Space(), dedupe: bool = True) -> Cube:
    """A cube of a long table. ``assays`` maps assay names to columns (default: beta, var, se, t, z, p, df as found).

    Of rows that repeat a key the first by ``order`` wins (by position in the
    source if there is none). Axis order is first appearance by ``order``, else by
    id. A missing contrast column gives the single contrast "all". Cells whose
    sample, subject or contrast is null are left out.
    """
    named = dict(assays or {a: a for a in ("beta", "var", "se", "t", "z", "p", "df", "F", "df1", "df2", "chi2", "n_eff") if a in df.columns})
    if not named:
        raise ValueError("no measure column")
    if "beta" in named and not {"var", "se"} & set(named) and not {"t", "df"} <= set(named):
        meta = {"synthetic_variance": True}
    else:
        meta = {}
    has_contrast = contrast in df.columns
    keep = [F.col(sample).cast("string").alias("sample"), F.col(subject).cast("string").alias("subject"), (F.col(contrast).cast("string") if has_contrast else F.lit("all")).alias("contrast")]
    extra = [F.col(c) for c in contrast_columns]
    placed = df.withColumn(ROW, F.col(order)) if order else df.withColumn(ROW, F.monotonically_increasing_id())
    rows = placed.select(*keep, *[as_number(c).alias(a) for a, c in named.items()], *extra, ROW).dropna(subset=list(KEYS))
    cells = first_of_each(rows, KEYS, ROW) if dedupe else rows
    axes = {k: axis_of(cells, k, ROW if order else None) for k in KEYS}
    if contrast_columns:
        own = lift_constant(rows, "contrast", contrast_columns)
        axes["contrast"] = axes["contrast"].join(own.withColumnRenamed("contrast", "id"), "id").select("ord", "id", *contrast_columns)
    return Cube(cells.select(*KEYS, *named), axes["sample"], axes["subject"], axes["contrast"], tuple(named), space, meta)


def _detect(source) -> float:
    if isinstance(source, DataFrame):
        return 0.9
    return 0.8 if isinstance(source, str) and source.rstrip("/").endswith((".csv", ".tsv", ".csv.gz", ".tsv.gz", ".parquet")) else 0.0


def _read(spark, source, **options):
    return from_table(source if isinstance(source, DataFrame) else read_table(spark, source), **options)


adapters.register("tabular", Adapter("tabular", _detect, _read))
adapters.register("memory", Adapter("memory", lambda s: 1.0 if isinstance(s, Cube) else 0.0, lambda spark, s, **_: s))


def cube(spark: SparkSession, source, **options) -> Cube:
    """The front door: the adapter that fits a source reads it."""
    from ..registry import detect_adapter

    return detect_adapter(source).read(spark, source, **options)


def temporal_mean(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Mean over time of each key; a variance does not survive it."""
    return df.groupBy(*keys).agg(F.avg(X.finite(value)).alias("beta"), F.lit(None).cast("double").alias("var"))


def temporal_design(df: DataFrame, keys, weights: DataFrame, time: str = "t", value: str = "value", variance: str | None = None) -> DataFrame:
    """Contrasts of a time course: sum over t of value c(t, contrast), and of variance c^2; ``weights`` is (t, contrast, c).

    A time without a weight counts as 0; a missing value under a non-zero weight makes the contrast null.
    """
    w = weights.select(F.col("t").alias(time), "contrast", F.col("c").cast("double").alias("c")).where("c <> 0")
    whole = w.groupBy("contrast").agg(F.count("*").alias("__need"))
    rows = df.join(F.broadcast(w), time)  # the design has a row for each time and contrast
    y = X.finite(value)
    out = rows.groupBy(*keys, "contrast").agg(F.sum(y * F.col("c")).alias("b"), F.count(y).alias("n"), *([F.sum(F.col(variance) * F.col("c") * F.col("c")).alias("v")] if variance else []))
    out = out.join(F.broadcast(whole), "contrast")
    return out.select(*keys, "contrast", F.when(F.col("n") == F.col("__need"), F.col("b")).alias("beta"), (F.col("v") if variance else F.lit(None).cast("double")).alias("var"))


def from_manifest(spark: SparkSession, manifest: dict, root: str = "") -> Cube:
    """A cube from a manifest {table, columns: {role: column}, assays}: roles sample, subject, contrast."""
    table = read_table(spark, f"{root}{manifest['table']}", manifest.get("format"))
    roles = manifest["columns"]
    unknown = set(roles) - set(KEYS)
    if unknown or not {"sample", "subject"} <= set(roles):
        raise ValueError("a manifest names the columns of sample, subject and, if any, contrast")
    return from_table(table, **roles, assays=manifest["assays"])


def stack_frame(df: DataFrame, observation: str, feature: str, value: str, observations: DataFrame, subject="subject", contrast="contrast") -> Cube:
    """An observation x feature table as a cube; the subject x contrast grid of observations must be complete and free of repeats."""
    grid = observations.groupBy(subject, contrast).count()
    n = observations.agg(F.count_distinct(subject), F.count_distinct(contrast)).first()
    if grid.count() != n[0] * n[1] or not grid.where("count > 1").isEmpty():
        raise ValueError("observations must be a complete grid of subjects and contrasts")
    rows = df.join(observations, observation)
    return from_table(rows.select(F.col(feature).alias("sample"), F.col(subject).alias("subject"), F.col(contrast).alias("contrast"), F.col(value).alias("beta")))


def unstack_frame(c: Cube, assay: str = "beta") -> DataFrame:
    """The cube as (observation, feature, value); an observation is subject and contrast joined by a colon."""
    return c.df.select(F.concat_ws(":", "subject", "contrast").alias("observation"), F.col("sample").alias("feature"), F.col(assay).alias("value"))
