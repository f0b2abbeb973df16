"""Subset, derive, mask, axis tables and space joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cube import AXIS, KEYS, Cube
from ..functions import columns as X

EPS = 1e-12


def divide(a, b):
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


# --- subset


def subset(cube: Cube, sample=None, subject=None, contrast=None) -> Cube:
    """Keep ids or 1-based positions of the current axes, in the selector's order, repetitions and all.

    A list of booleans as long as the axis selects where it is true. Unknown
    labels and positions outside the axis are errors. A repeated id is made
    distinct by a suffix (``a``, ``a.1``, ``a.2``).
    """
    spark = cube.df.sparkSession
    for key, chosen in (("sample", sample), ("subject", subject), ("contrast", contrast)):
        if chosen is None:
            continue
        axis = cube.axis(key)
        chosen = [chosen] if isinstance(chosen, (str, int)) else list(chosen)
        if chosen and all(isinstance(x, bool) for x in chosen):
            if len(chosen) != axis.count():
                raise ValueError(f"a logical selector of {key} must have the axis's length")
            chosen = [i + 1 for i, x in enumerate(chosen) if x]
        by = "id" if chosen and isinstance(chosen[0], str) else "ord"
        if not all(isinstance(x, str) == (by == "id") and (by == "id" or isinstance(x, int)) for x in chosen):
            raise ValueError(f"a selector of {key} is all labels or all positions")
        wanted = spark.createDataFrame([(i + 1, x) for i, x in enumerate(chosen)], f"__new int, {by} {'string' if by == 'id' else 'int'}")
        found = axis.join(F.broadcast(wanted), by)
        if found.count() != len(chosen):
            known = {r[by] for r in found.select(by).collect()}
            raise ValueError(f"not in the {key} axis: {[x for x in chosen if x not in known][:5]}")
        nth = F.row_number().over(Window.partitionBy("id").orderBy("__new")) - 1
        rest = [c for c in axis.columns if c not in ("ord", "id")]
        moved = found.withColumn("__nth", nth).select(F.col("__new").alias("ord"), F.when(F.col("__nth") == 0, F.col("id")).otherwise(F.concat_ws(".", "id", "__nth")).alias("id"), F.col("id").alias("__old"), *rest)
        pairs = F.broadcast(moved.select(F.col("__old").alias(key), F.col("id").alias("__id")))  # as many rows as the caller's list
        cells = cube.df.join(pairs, key).drop(key).withColumnRenamed("__id", key).select(*KEYS, *cube.assays)
        cube = cube.with_(df=cells, **{AXIS[key]: moved.drop("__old")})
    return cube


def preview(cube: Cube, n: int = 3) -> Cube:
    """The first n samples; what follows then sees these only."""
    axis = cube.samples.where(F.col("ord") <= n)
    return cube.with_(samples=axis, df=cube.df.join(F.broadcast(axis.select(F.col("id").alias("sample"))), "sample", "left_semi"))


# --- derive


def _satisfiable(have: set[str], what: str):
    """The column of a derived assay from those at hand, or None."""
    c = F.col
    if what == "var" and "se" in have:
        return c("se") * c("se")
    if what == "se" and "var" in have:
        return F.when(c("var") >= 0, F.sqrt("var"))
    if what == "t" and {"beta", "var"} <= have:
        return divide(c("beta"), F.when(c("var") > 0, F.sqrt("var")))
    if what == "z":
        if {"t", "df"} <= have:
            return X.t_to_z("t", "df")
        if {"p", "beta"} <= have:
            return X.p_to_z("p", "beta")
        if {"F", "df1", "df2", "beta"} <= have:
            return X.p_to_z(X.f_p("F", "df1", "df2"), "beta")
    if what == "p":
        if {"t", "df"} <= have:
            return X.t_p("t", "df")
        if "z" in have:
            return X.normal_p("z")
        if {"F", "df1", "df2"} <= have:
            return X.f_p("F", "df1", "df2")
        if {"chi2", "df"} <= have:
            return X.chi2_p("chi2", "df")
    return None


def derive(cube: Cube, what=("var", "se", "t", "z"), overwrite: bool = False) -> Cube:
    """Add assays from others; those that exist stay unless ``overwrite``. A target that nothing gives is an error."""
    for name in [what] if isinstance(what, str) else what:
        if name not in ("var", "se", "t", "z", "p"):
            raise ValueError(f"cannot derive {name!r}")
        if name in cube.assays and not overwrite:
            continue
        made = _satisfiable(set(cube.assays), name)
        if made is None:
            raise ValueError(f"{name} cannot be derived from {', '.join(cube.assays)}")
        cube = cube.with_df(cube.df.withColumn(name, made))
    return cube


def sync_derived(cube: Cube) -> Cube:
    """Add whatever of se, var, t, z, p the assays at hand give; overwrite nothing."""
    for name in ("se", "var", "t", "z", "p"):
        if name not in cube.assays and (made := _satisfiable(set(cube.assays), name)) is not None:
            cube = cube.with_df(cube.df.withColumn(name, made))
    return cube


def require(cube: Cube, needed) -> Cube:
    """Derive missing inputs of a reducer or post-hoc method, or fail."""
    for name in needed:
        if name not in cube.assays:
            cube = derive(cube, name)
    return cube


def satterthwaite(df: DataFrame, keys, weight="w", var="var", dof="df") -> DataFrame:
    """(keys, df): (sum w^2 v)^2 / sum (w^4 v^2 / df); a zero denominator gives infinity."""
    w2 = F.col(weight) * F.col(weight) * F.col(var)
    sums = df.groupBy(*keys).agg(F.sum(w2).alias("a"), F.sum(divide(w2 * w2, F.col(dof))).alias("b"))
    return sums.select(*keys, F.when(F.col("b") > 0, F.col("a") * F.col("a") / F.col("b")).otherwise(F.lit(float("inf"))).alias("df"))


# --- masks


@dataclass(frozen=True)
class MaskPolicy:
    """Which samples stay: scope group or subject; rule intersection, union, threshold or custom (cells -> samples)."""

    scope: str = "group"
    rule: str = "intersection"
    threshold: float = 0.95
    custom: object = None

    def __post_init__(self):
        if self.scope not in ("group", "subject") or self.rule not in ("intersection", "union", "threshold", "custom"):
            raise ValueError("a mask's scope is group or subject, its rule intersection, union, threshold or custom")


def _passes(policy: MaskPolicy, n, whole: int):
    if policy.rule == "intersection":
        return n == whole
    if policy.rule == "union":
        return n > 0
    return n / F.lit(float(whole)) >= policy.threshold


def masked_samples(cube: Cube, policy: MaskPolicy) -> DataFrame:
    """(sample) that a policy keeps; shares are of the axes, and only the first measure's finiteness counts."""
    if policy.rule == "custom":
        return policy.custom(cube.df).select("sample").distinct()
    measure = "beta" if "beta" in cube.assays else cube.assays[0]
    subjects, contrasts = cube.size("subject"), cube.size("contrast")
    value = F.count(X.finite(measure))
    if policy.scope == "group":
        return cube.df.groupBy("sample").agg(value.alias("n")).where(_passes(policy, F.col("n"), subjects * contrasts)).select("sample")
    each = cube.df.groupBy("sample", "subject").agg(value.alias("n")).where(_passes(policy, F.col("n"), contrasts))
    return each.groupBy("sample").count().where(F.col("count") == subjects).select("sample")


def mask(cube: Cube, *policies: MaskPolicy) -> Cube:
    """Keep the samples that all policies keep. An empty result is an error."""
    kept = fold(lambda a, b: a.join(b, "sample", "left_semi"), (masked_samples(cube, p) for p in policies))
    if kept.isEmpty():
        raise ValueError("the mask leaves no sample")
    axis = cube.samples.join(kept.withColumnRenamed("sample", "id"), "id", "left_semi")
    axis = axis.select(F.row_number().over(Window.orderBy("ord")).cast("int").alias("ord"), *[c for c in axis.columns if c != "ord"])
    return sync_derived(cube.with_(df=cube.df.join(kept, "sample", "left_semi"), samples=axis))


# --- axis tables and spaces


def with_axis_data(cube: Cube, key: str, table: DataFrame, by: str) -> Cube:
    """Attach attributes to an axis by a unique key: a missing id is an error, extra rows are dropped."""
    if not table.groupBy(by).count().where("count > 1").isEmpty():
        raise ValueError(f"{by} repeats in the {key} table")
    renamed = table.withColumn("__id", F.col(by).cast("string")).drop(*({by, "id", "ord"} & set(table.columns)))
    axis = cube.axis(key)
    lost = axis.join(renamed, axis["id"] == renamed["__id"], "left_anti").select("id").take(5)
    if lost:
        raise ValueError(f"the {key} table lacks: {', '.join(r.id for r in lost)}")
    clash = [c for c in renamed.columns if c in axis.columns]
    return cube.with_(**{AXIS[key]: axis.drop(*clash).join(renamed, axis["id"] == renamed["__id"]).drop("__id")})


def common_mask(a: DataFrame, b: DataFrame, rule: str = "intersection") -> DataFrame:
    """(voxel, pos_a, pos_b) of two packed masks (ord, voxel); a union keeps those of either, null where absent."""
    if rule not in ("intersection", "union"):
        raise ValueError("rule is intersection or union")
    left, right = a.select("voxel", F.col("ord").alias("pos_a")), b.select("voxel", F.col("ord").alias("pos_b"))
    return left.join(right, "voxel", "inner" if rule == "intersection" else "full_outer")


def apply_common_mask(a: Cube, b: Cube, rule: str = "intersection") -> tuple[Cube, Cube]:
    """Both cubes on the samples common to their axes (union: each keeps those it has)."""
    if not a.space.compatible(b.space):
        raise ValueError("the cubes' spaces differ")
    if rule == "union":
        return a, b
    own = a.samples.select("id").join(b.samples.select("id"), "id", "left_semi")

    def cut(c: Cube) -> Cube:
        axis = c.samples.join(own, "id", "left_semi")
        return c.with_(samples=axis.withColumn("ord", F.row_number().over(Window.orderBy("ord")).cast("int")), df=c.df.join(own.withColumnRenamed("id", "sample"), "sample", "left_semi"))

    return cut(a), cut(b)


def relabel(cube: Cube, key: str, names: DataFrame) -> Cube:
    """New ids for an axis from (old, new); ids without a new name stay; results must be unique."""
    pairs = names.select(F.col("old").cast("string").alias("__old"), F.col("new").cast("string").alias("__new"))
    axis = cube.axis(key).join(pairs, F.col("id") == F.col("__old"), "left").withColumn("__final", F.coalesce("__new", "id"))
    if not axis.groupBy("__final").count().where("count > 1").isEmpty():
        raise ValueError(f"the new names of {key} are not unique")
    cells = cube.df.join(pairs, F.col(key) == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key)).select(*KEYS, *cube.assays)
    rest = [c for c in cube.axis(key).columns if c not in ("ord", "id")]
    return cube.with_(df=cells, **{AXIS[key]: axis.select("ord", F.col("__final").alias("id"), *rest)})


def extract_group(cube: Cube, column: str, level) -> Cube:
    """The subjects of one level of an attribute."""
    return subset(cube, subject=[r.id for r in cube.subjects.where(F.col(column) == level).orderBy("ord").select("id").collect()])


def split(cube: Cube, column: str) -> dict:
    levels = [r[0] for r in cube.subjects.select(column).distinct().orderBy(column).collect() if r[0] is not None]
    return {level: extract_group(cube, column, level) for level in levels}


def attach_weight(cube: Cube, name: str, table: DataFrame, on) -> Cube:
    """A weight column by any of the keys, for reducers that declare they use one."""
    return cube.with_df(cube.df.join(table.select(*on, F.col(name).cast("double")), list(on), "left"))


def use_weight(cube: Cube, name: str) -> dict:
    """Options that give a reducer an attached weight column; reducers that don't declare custom weights refuse them."""
    if name not in cube.assays:
        raise ValueError(f"no weight column {name}")
    return {"weights": "custom", "custom_weights": name}


def world(cube: Cube) -> DataFrame:
    """The sample axis with world coordinates x, y, z of its grid indices (counted from 0) under the space's affine; null without one."""
    a = cube.space.affine
    ijk = [F.col(c) for c in ("i", "j", "k")]
    at = [sum((c * float(w) for c, w in zip(ijk, row)), F.lit(float(row[3]))) for row in a[:3]] if len(a) >= 3 else [F.lit(None).cast("double")] * 3
    return cube.samples.select("*", *[c.alias(n) for c, n in zip(at, ("x", "y", "z"))])


def grid_index(voxel, dims: tuple[int, int, int]):
    """(i, j, k) columns of a flat voxel index, the first axis fastest."""
    v = F.col(voxel) if isinstance(voxel, str) else voxel
    return (v % dims[0]).cast("int"), (F.floor(v / dims[0]) % dims[1]).cast("int"), F.floor(v / (dims[0] * dims[1])).cast("int")
