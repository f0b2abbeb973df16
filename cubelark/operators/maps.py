"""Linear maps between sample spaces, with variance propagation and evidence combination.

A map is an edge table (target, source, w[, subject]). Cells meet edges by
source and are summed by target; a missing or non-finite source under a
non-zero weight makes its target null.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, axis_of
from ..functions import columns as X
from ..registry import maps as registered
from . import verbs as V


@dataclass(frozen=True)
class UncertaintyRule:
    """How variance travels: independent, or cov_provider with a table (source_a, source_b, r) of correlations."""

    mode: str = "independent"
    df_rule: str = "satterthwaite"
    correlations: DataFrame | None = None

    def __post_init__(self):
        if self.mode not in ("independent", "cov_provider", "kernel", "none") or self.df_rule not in ("satterthwaite", "none"):
            raise ValueError("unknown uncertainty rule")


@dataclass(frozen=True)
class MapFamily:
    """A named map: one edge table, or one with a subject column for a map of each subject.

    Traits say what the operators keep; they are declared, not checked.
    """

    name: str
    edges: DataFrame
    kind: str = "linear"
    orthogonal: bool = False
    mass_preserving: bool = False
    uncertainty: UncertaintyRule = UncertaintyRule()

    def __post_init__(self):
        if self.kind not in ("linear", "orthogonal", "affine3d", "deform3d", "ot"):
            raise ValueError(f"unknown kind of map {self.kind!r}")

    @property
    def by_subject(self) -> bool:
        return "subject" in self.edges.columns


def orthogonal_family(name: str, edges: DataFrame, uncertainty: UncertaintyRule = UncertaintyRule()) -> MapFamily:
    return MapFamily(name, edges, "orthogonal", orthogonal=True, uncertainty=uncertainty)


def transport_family(name: str, edges: DataFrame, uncertainty: UncertaintyRule = UncertaintyRule()) -> MapFamily:
    return MapFamily(name, edges, "ot", mass_preserving=True, uncertainty=uncertainty)


def warp_family(spark, name: str, paths: dict[str, str], loader, uncertainty: UncertaintyRule = UncertaintyRule()) -> MapFamily:
    """A deformation for each subject: ``loader(path)`` gives (target, source, w) rows and runs in tasks, one subject at a time."""

    def run(batches):
        for pdf in batches:
            for subject, path in zip(pdf["subject"], pdf["path"]):
                made = pd.DataFrame(list(loader(path)), columns=["target", "source", "w"])
                yield pd.DataFrame({"subject": subject, "target": made["target"].astype(str), "source": made["source"].astype(str), "w": made["w"].astype(float)})

    listed = spark.createDataFrame(list(paths.items()), "subject string, path string").repartition("subject")
    return MapFamily(name, listed.mapInPandas(run, "subject string, target string, source string, w double"), "deform3d", uncertainty=uncertainty)


def register_map(family: MapFamily, overwrite: bool = False) -> MapFamily:
    return registered.register(family.name, family, overwrite)


def list_map_families() -> list[str]:
    return registered.names()


def get_map_family(name: str) -> MapFamily | None:
    return registered.items.get(name)


register_alignment, list_alignments, get_alignment = register_map, list_map_families, get_map_family


def _joined(cube: Cube, edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges with the cells of their sources, edges of each target)."""
    edges = edges.where("w <> 0")
    degree = edges.groupBy("target", *by).agg(F.count("*").alias("degree"))
    cells = edges.join(cube.df, (edges["source"] == cube.df["sample"]) & ((edges["subject"] == cube.df["subject"]) if "subject" in by else F.lit(True)))
    return cells.drop(edges["subject"]) if "subject" in by else cells, degree


def _propagate(cube: Cube, edges: DataFrame, rule: UncertaintyRule, by_subject: bool) -> DataFrame:
    by = ["subject"] if by_subject else []
    cells, degree = _joined(cube, edges, by)
    keys = ["target", "subject", "contrast"]
    beta, var, w = X.finite("beta"), X.finite("var"), F.col("w")
    sums = [F.sum(w * beta).alias("b"), F.count(beta).alias("nb"), F.sum(w * w * var).alias("v"), F.count(var).alias("nv")]
    if "df" in cube.assays and rule.df_rule == "satterthwaite":
        own = w * w * var
        sums += [F.sum(V.divide(own * own, F.col("df"))).alias("d")]
    out = cells.groupBy(*keys).agg(*sums).join(degree, ["target", *by])
    found = out.select(
        F.col("target").alias("sample"), "subject", "contrast",
        F.when(F.col("nb") == F.col("degree"), F.col("b")).alias("beta"),
        F.when(F.col("nv") == F.col("degree"), F.col("v")).alias("var"),
        *([F.when(F.col("d") > 0, F.col("v") * F.col("v") / F.col("d")).otherwise(F.lit(float("inf"))).alias("df")] if "d" in out.columns else []),
    )
    if rule.mode == "cov_provider":
        r = rule.correlations
        r = r.union(r.select(F.col("source_b"), F.col("source_a"), F.col("r"))).distinct()
        s = cells.select(*keys, "source", (w * F.sqrt(F.when(var >= 0, var))).alias("ws"))
        pair = s.join(r, s["source"] == r["source_a"]).select(*keys, F.col("source_b").alias("source"), (F.col("ws") * F.col("r")).alias("left")).join(s, [*keys, "source"])
        extra = pair.groupBy(*keys).agg(F.sum(F.when(F.col("left").isNotNull(), F.col("left") * F.col("ws"))).alias("x")).withColumnRenamed("target", "sample")
        found = found.join(extra, ["sample", "subject", "contrast"], "left").withColumn("var", F.col("var") + F.coalesce("x", F.lit(0.0))).drop("x")
    return found


def _finish(cube: Cube, cells: DataFrame, edges: DataFrame) -> Cube:
    samples = axis_of(edges, "target", "target_ord" if "target_ord" in edges.columns else None)
    had = {"t", "z", "p"} & set(cube.assays)
    out = cube.with_df(cells).with_(samples=samples)
    if had and "df" not in out.assays:
        z = V.divide(F.col("beta"), F.when(F.col("var") > 0, F.sqrt("var")))
        out = out.with_df(out.df.withColumn("z", z))
    return V.sync_derived(out) if had else out


def map_to(cube: Cube, edges: DataFrame, uncertainty: UncertaintyRule = UncertaintyRule(), combine: str | None = None) -> Cube:
    """Move the samples by a map common to all subjects.

    beta' = M beta and var' = M^2 var, plus correlated pairs under cov_provider
    (the correlation table lists each unordered pair of different sources once).
    Other assays are dropped; df survives by Satterthwaite's rule. ``combine``
    stouffer or fisher joins z or p instead.
    """
    if "subject" in edges.columns:
        raise ValueError("a map of each subject goes through align()")
    if uncertainty.mode not in ("independent", "cov_provider"):
        raise ValueError(f"map_to cannot propagate under {uncertainty.mode!r}")
    if combine:
        return _combine(cube, edges, combine)
    missing = {"beta", "var"} - set(cube.assays)
    cube = V.require(cube, missing)
    return _finish(cube, _propagate(cube, edges, uncertainty, False), edges)


def align(cube: Cube, family: MapFamily | str, uncertainty: UncertaintyRule | None = None) -> Cube:
    """Move each subject's samples by its own map, given or registered; anything but cov_provider propagates as independent."""
    if isinstance(family, str):
        family = registered.get(family)
    uncertainty = uncertainty or family.uncertainty
    cube = V.require(cube, {"beta", "var"} - set(cube.assays))
    return _finish(cube, _propagate(cube, family.edges, uncertainty, family.by_subject), family.edges)


def _combine(cube: Cube, edges: DataFrame, how: str) -> Cube:
    cells, degree = _joined(cube, edges, [])
    keys = ["target", "subject", "contrast"]
    w = F.col("w")
    if how == "stouffer":
        z = X.finite("z")
        sums = cells.groupBy(*keys).agg(F.sum(w * z).alias("a"), F.sum(w * w).alias("b"), F.count(z).alias("n")).join(degree, "target")
        cell = sums.select(F.col("target").alias("sample"), "subject", "contrast", F.when(F.col("n") == F.col("degree"), V.divide(F.col("a"), F.sqrt("b"))).alias("z"))
        cell = cell.withColumn("p", X.normal_p("z"))
    elif how == "fisher":
        p = F.greatest(F.least(X.finite("p"), F.lit(1 - 1e-16)), F.lit(1e-300))
        sums = cells.groupBy(*keys).agg((-2 * F.sum(F.ln(p))).alias("x"), F.count(p).alias("n")).join(degree, "target")
        whole = F.col("n") == F.col("degree")
        cell = sums.select(F.col("target").alias("sample"), "subject", "contrast", F.when(whole, F.col("x")).alias("chi2"), F.when(whole, 2.0 * F.col("n")).alias("df"), F.when(whole, X.chi2_p_even("x", "n")).alias("p"))
        cell = cell.withColumn("z", X.p_to_z(F.col("p") * 2, F.lit(1.0)))
    else:
        raise ValueError("combine is stouffer or fisher")
    return cube.with_df(cell).with_(samples=axis_of(edges, "target"))
