"""Corrections over the sample axis, as windows over (subject, contrast) families."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import columns as X
from ..functions import special as S
from ..functions.shared import checkpoint
from ..registry import posthocs
from . import verbs as V

FAMILY = ["subject", "contrast"]


def step_up(df: DataFrame, p: str = "p", out: str = "q", keys=FAMILY, harmonic: bool = False, ordered: str | None = None, partitions: int | None = None) -> DataFrame:
    """Step-up adjusted p-values of each family; nulls are outside it.

    ``ordered`` names another column to rank and adjust by (a weighted p).
    A family is one window partition, good for tens of millions of rows; with
    ``partitions`` it is dealt out by ranges of p instead, and ranks and
    running minima are carried over from the ranges' small summaries.
    """
    value = ordered or p
    m = F.count(value).over(Window.partitionBy(*keys))
    factor = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("__m"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i) if harmonic else F.lit(1.0)
    if partitions is None:
        up = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        ranked = df.withColumn("__m", m).withColumn("__r", F.count(value).over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        ranked = ranked.withColumn("__a", F.col(value) * F.col("__m") / F.col("__r") * factor)
        down = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        done = ranked.withColumn(out, F.when(F.col(value).isNotNull(), F.least(F.lit(1.0), F.min("__a").over(down))))
        return done.drop("__m", "__r", "__a")
    part = checkpoint(df.repartitionByRange(partitions, *keys, value).withColumn("__part", F.spark_partition_id()))
    spread = part.groupBy(*keys, "__part").agg(F.count(value).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part")
    offsets = spread.withColumn("__before", F.sum("__n").over(before) - F.col("__n")).withColumn("__m", F.sum("__n").over(Window.partitionBy(*keys)))
    local = Window.partitionBy(*keys, "__part").orderBy(F.col(value).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = part.withColumn("__l", F.count(value).over(local)).join(offsets.select(*keys, "__part", "__before", "__m"), [*keys, "__part"])
    ranked = ranked.withColumn("__a", F.col(value) * F.col("__m") / (F.col("__before") + F.col("__l")) * factor)
    later = Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy(*keys, "__part").agg(F.min("__a").alias("__x")).withColumn("__later", F.min("__x").over(later))
    down = Window.partitionBy(*keys, "__part").orderBy(F.col(value).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    done = ranked.withColumn("__own", F.min("__a").over(down)).join(least.select(*keys, "__part", "__later"), [*keys, "__part"])
    done = done.withColumn(out, F.when(F.col(value).isNotNull(), F.least(F.lit(1.0), F.col("__own"), F.coalesce("__later", F.lit(1.0)))))
    return done.drop("__part", "__l", "__before", "__m", "__a", "__own", "__later")


def p_columns(cube: Cube, source: str | None) -> tuple[Cube, list[tuple[str, str]]]:
    """(cube, [(p column, q column)]): the named source, else p, else each p_coef, else a derived p."""
    if source:
        if source not in cube.assays:
            raise ValueError(f"no assay {source!r}")
        return cube, [(source, source.replace("p_coef", "q_coef") if source.startswith("p_coef") else "q")]
    if "p" in cube.assays:
        return cube, [("p", "q")]
    own = [a for a in cube.assays if a.startswith("p_coef:")]
    if own:
        return cube, [(a, a.replace("p_coef", "q_coef", 1)) for a in own]
    return V.require(cube, ["p"]), [("p", "q")]


def _adjust(cube: Cube, harmonic: bool, source=None, partitions=None) -> Cube:
    cube, pairs = p_columns(cube, source)
    df = cube.df
    for i, (p, q) in enumerate(pairs):
        plain = df.withColumn("__p", X.finite(F.col(f"`{p}`")))
        df = step_up(plain, "__p", f"__q{i}", harmonic=harmonic, partitions=partitions).drop("__p", q).withColumnRenamed(f"__q{i}", q)
    return cube.with_df(df)


#: The sample attributes that may hold groups, the first one present counts.
GROUPS = ("feature_group", "spatial_group", "group", "parcel", "parcel_id")


def groups_of(cube: Cube, group=None) -> DataFrame:
    """(sample, grp) of the samples that have a group."""
    found = next((n for n in ([group] if group else GROUPS) if n in cube.samples.columns), None)
    if found is None:
        raise ValueError("no grouping attribute on the samples")
    return cube.samples.select(F.col("id").alias("sample"), F.col(found).cast("string").alias("grp")).where("grp is not null")


def simes(df: DataFrame, keys) -> DataFrame:
    """(keys, simes): least p(r) m / r over a group's finite p."""
    up = Window.partitionBy(*keys).orderBy(F.col("__p").asc_nulls_last())
    ranked = df.where("__p is not null").withColumn("__r", F.row_number().over(up)).withColumn("__m", F.count("__p").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(F.min(F.col("__p") * F.col("__m") / F.col("__r")).alias("simes"))


def fdr_spatial(cube: Cube, source=None, group=None) -> Cube:
    """Simes p of each group, weighted step-up over groups (weight: size / mean size), carried back to members.

    A group's size counts all its samples of the axis, whether or not a family has
    cells or p-values there; the multiplier is the number of all groups, and the
    rank runs over those with a p. Samples without a group have no q. Every p
    column of a fit is corrected.
    """
    cube, pairs = p_columns(cube, source)
    own = groups_of(cube, group)
    sizes = own.groupBy("grp").agg(F.count("*").alias("size"))
    n_groups, mean = sizes.agg(F.count("*"), F.avg("size")).first()
    df = cube.df.join(own, "sample", "left")
    for p, q in pairs:
        cells = df.drop(q).withColumn("__p", X.finite(F.col(f"`{p}`")))
        weighted = simes(cells.where("grp is not null"), [*FAMILY, "grp"]).join(sizes, "grp").withColumn("pw", F.col("simes") * F.lit(mean) / F.col("size"))
        over = Window.partitionBy(*FAMILY)
        up, down = over.orderBy("pw", "grp"), over.orderBy(F.desc("pw"), F.desc("grp")).rowsBetween(Window.unboundedPreceding, 0)
        ranked = weighted.withColumn("a", F.lit(n_groups) * F.col("pw") / F.row_number().over(up))
        ranked = ranked.withColumn("__q", F.least(F.lit(1.0), F.min("a").over(down))).select(*FAMILY, "grp", "__q")
        df = cells.join(ranked, [*FAMILY, "grp"], "left").drop("__p").withColumnRenamed("__q", q)
    return cube.with_df(df.select(*[c for c in cube.df.columns if c not in {q for _, q in pairs}], *[f"`{q}`" for _, q in pairs]))


def _null_of(counts: np.ndarray, mids: np.ndarray, middle: float, spread: float) -> tuple[float, float]:
    """Central matching: mean and sd of a normal whose log density fits log counts near the middle, by Poisson regression."""
    own = np.abs(mids - middle) <= 1.5 * spread
    x = np.stack([np.ones(own.sum()), mids[own], mids[own] ** 2], 1)
    b = np.linalg.lstsq(x, np.log(counts[own] + 0.5), rcond=None)[0]
    for _ in range(40):
        mu = np.exp(np.clip(x @ b, -30, 30))
        step = np.linalg.lstsq(x * np.sqrt(mu)[:, None], (counts[own] - mu) / np.sqrt(mu), rcond=None)[0]
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    if not b[2] < 0:
        return middle, spread
    return float(-b[1] / (2 * b[2])), float(np.sqrt(-1 / (2 * b[2])))


def empirical_null(z: DataFrame) -> tuple[float, float]:
    """``efron_null`` of all values of column z: two quantiles and one histogram, summed in tasks."""
    z = z.select(X.finite("z").alias("z")).where("z is not null")
    if z.limit(500).count() < 500:
        return efron_null(np.array([r.z for r in z.collect()]))  # fewer than 500
    median = lambda df, c: float(df.agg(F.percentile_approx(c, 0.5, 100_000)).first()[0])
    middle = median(z, "z")
    spread = 1.4826 * median(z.select(F.abs(F.col("z") - middle).alias("d")), "d") or 1.0
    low, width = middle - 4 * spread, 8 * spread / 40
    slot = F.least(F.lit(39), F.greatest(F.lit(0), F.floor((F.col("z") - low) / width))).cast("int")
    counts = np.zeros(40)
    for r in z.groupBy(slot.alias("slot")).count().collect():
        counts[r["slot"]] = r["count"]
    return _null_of(counts, low + width * (np.arange(40) + 0.5), middle, spread)


def efron_null(z: np.ndarray) -> tuple[float, float]:
    """(mean, sd) of the empirical null: central matching by a Poisson fit of log counts (500 or more),
    median and scaled MAD (10 or more), else the standard normal."""
    z = z[np.isfinite(z)]
    if len(z) < 10:
        return 0.0, 1.0
    middle = float(np.median(z))
    mad = 1.4826 * float(np.median(np.abs(z - middle)))
    if len(z) < 500:
        return middle, mad or 1.0
    mad = mad or 1.0
    counts, edges = np.histogram(np.clip(z, middle - 4 * mad, middle + 4 * mad), bins=40, range=(middle - 4 * mad, middle + 4 * mad))
    return _null_of(counts, (edges[1:] + edges[:-1]) / 2, middle, mad)


def fdr_sabha(cube: Cube, source=None, group=None, statistic: str = "auto", alpha: float = 0.05, tau: float = 0.5, lam: float = 1.0, neighbors: DataFrame | None = None, min_pi0: float = 0.05, empirical_null: bool = True) -> Cube:
    """Structure-adaptive weights from Storey's null share by group, smoothed over neighbouring groups.

    p mode is all windows. z mode first re-centres z by an empirical null of all
    values. ``neighbors`` is (a, b) pairs of groups. Adds q, reject, weight and pi0;
    of several p columns of a fit each has its own, named after the term.
    """
    if statistic == "z" or (statistic == "auto" and "z" in cube.assays and "p" not in cube.assays):
        cube = V.require(cube, ["z"])
        mu, sd = 0.0, 1.0
        if empirical_null:
            mu, sd = empirical_null(cube.df)
        cube = cube.with_df(cube.df.drop("p").withColumn("p", X.normal_p((F.col("z") - mu) / sd)))
        source = "p"
    cube, pairs = p_columns(cube, source)
    own = groups_of(cube, group)
    both = None if neighbors is None else neighbors.select(F.col("a").alias("grp"), F.col("b").alias("near")).union(neighbors.select("b", "a")).distinct()
    df = cube.df
    for p, q in pairs:
        tail = q.removeprefix("q").removeprefix("_coef")
        cells = df.join(own, "sample", "left").withColumn("__p", X.finite(F.col(f"`{p}`")))
        pi = cells.where("grp is not null").groupBy(*FAMILY, "grp").agg(F.try_divide(F.count(F.when(F.col("__p") > tau, 1)).cast("double"), (1 - tau) * F.count("__p")).alias("raw"))
        pi = pi.withColumn("pi", F.least(F.lit(1.0), F.coalesce("raw", F.lit(1.0)))).drop("raw")
        if both is not None:
            near = both.join(pi.select(*FAMILY, F.col("grp").alias("near"), F.col("pi").alias("other")), "near").groupBy(*FAMILY, "grp").agg(F.avg("other").alias("around"))
            pi = pi.join(near, [*FAMILY, "grp"], "left").withColumn("pi", F.when(F.col("around").isNotNull(), (F.col("pi") + lam * F.col("around")) / (1 + lam)).otherwise(F.col("pi"))).drop("around")
        pi = pi.withColumn("__pi0", F.least(F.lit(1.0), F.greatest(F.lit(min_pi0), F.col("pi")))).drop("pi")
        over = Window.partitionBy(*FAMILY)
        rows = cells.join(pi, [*FAMILY, "grp"], "left").withColumn("__w", F.when(F.col("__pi0").isNotNull(), 1 / F.col("__pi0")).otherwise(1.0))
        has = F.col("__p").isNotNull()
        rows = rows.withColumn("__weight", F.col("__w") * F.count("__p").over(over) / F.sum(F.when(has, F.col("__w"))).over(over))
        rows = rows.withColumn("__pw", F.when(has, F.least(F.lit(1.0), F.col("__p") / F.col("__weight"))))
        made = {q: F.col("__q"), f"reject{tail}": (F.col("__q") <= alpha).cast("double"), f"weight{tail}": F.col("__weight"), f"pi0{tail}": F.col("__pi0")}
        df = step_up(rows, "__p", "__q", ordered="__pw").select(*[f"`{c}`" for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])
    return cube.with_df(df)


def cluster_fdr(clusters: DataFrame, keys=FAMILY) -> DataFrame:
    """q of clusters (keys, cluster_id, p): step-up over a family's clusters."""
    return step_up(clusters, "p", "q", keys=list(keys))


def posthoc(cube: Cube, method: str, **options) -> Cube:
    """Apply a registered correction."""
    return posthocs.get(method)(cube, **options)


posthocs.register("fdr:bh", lambda c, **o: _adjust(c, False, **o))
posthocs.register("fdr:by", lambda c, **o: _adjust(c, True, **o))
posthocs.register("fdr:spatial", fdr_spatial)
posthocs.register("fdr:sabha", fdr_sabha)


def average_rank_share(value: str, keys) -> Column:
    """(average rank - 1) / (n - 1) of finite values; 1 for a single one."""
    up = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    n, ties = F.count(value).over(Window.partitionBy(*keys)), F.count(value).over(Window.partitionBy(*keys, value))
    rank = F.rank().over(up) + (ties - 1) / 2
    return F.when(F.col(value).isNotNull(), F.when(n == 1, 1.0).otherwise((rank - 1) / F.greatest(n - 1, F.lit(1))))


def normal_quantile(p: float) -> float:
    return float(S.norm_isf_log(np.log(p)))
