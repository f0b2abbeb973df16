"""Cohort examination: leave-one-out, surprise, agreement, influence, review queue, geometry, conclusions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import columns as X
from ..functions.shared import checkpoint
from ..registry import reducer
from . import posthoc as H
from . import reduce as R
from . import verbs as V

CELL = ["sample", "contrast"]
WHO = ["subject", "contrast"]
#: Rows that a task gives back at once.
CHUNK = 10_000


@dataclass(frozen=True)
class Control:
    """Settings of an examination. The defaults of thresholds, caps and tolerances."""

    surprise_energy: float = 2.5
    surprise_tail: float = 0.01
    residual: float = 3.0
    influence_energy: float = 1.0
    influence_max: float = 2.0
    coverage: float = 0.8
    min_stability: float = 0.7
    splits: int = 2
    cap: float = 8.0
    retain: int = 5
    degeneracy: float = 1e-12
    rank: int = 32
    oversample: int = 8


def split_of(control: Control) -> Column:
    """The part, from 0, that a (sample, contrast) belongs to when stability is assessed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", "sample", "contrast")), 26, 7), 16, 10).cast("long") % control.splits


def leave_one_out_fe(cube: Cube, min_subjects: int = 2) -> DataFrame:
    """Each subject against the fixed-effects mean of the others; all window sums of one shuffle.

    The mean of the others is taken as a sum over them minus the own term; it
    is evaluated only if at least ``min_subjects`` others remain.
    """
    over = Window.partitionBy(*CELL)
    rows = R.valid(cube.df).withColumn("w", 1 / F.col("v"))
    rows = rows.withColumn("sum_w", F.sum("w").over(over)).withColumn("sum_wy", F.sum(F.col("w") * F.col("y")).over(over)).withColumn("k", F.count(F.lit(1)).over(over))
    rest = F.col("sum_w") - F.col("w")
    ok = F.col("k") - 1 >= min_subjects
    on = lambda c: F.when(ok & (rest > 0), c)
    rows = rows.withColumn("expected", on((F.col("sum_wy") - F.col("w") * F.col("y")) / rest))
    rows = rows.withColumn("resid", on((F.col("y") - F.col("expected")) / F.sqrt(F.col("v") + 1 / rest)))
    full = F.col("sum_wy") / F.col("sum_w")
    return rows.select(
        *CELL, "subject", "y", "expected", "resid", on(1 / (F.col("v") + 1 / rest)).alias("pred_weight"), (F.col("w") / F.col("sum_w")).alias("leverage"),
        on(full - F.col("expected")).alias("delta_effect"), on(F.col("sum_wy") / F.sqrt("sum_w") - F.col("expected") * F.sqrt(rest)).alias("delta_stat"), on(F.col("expected") * F.sqrt(rest)).alias("deleted_stat"),
    )


def leave_one_out_re(cube: Cube, exact: bool = False) -> DataFrame:
    """The same under random effects: tau2 held at the full fit's, or (``exact``) estimated anew without the subject.

    Exact refits come from window sums too: without subject i, the sums of w,
    w^2, w y and w y^2 around the full mean give Q and so tau2.
    """
    over = Window.partitionBy(*CELL)
    rows = R.valid(cube.df).withColumn("w", 1 / F.col("v")).withColumn("sum_w", F.sum("w").over(over)).withColumn("k", F.count(F.lit(1)).over(over))
    rows = rows.withColumn("mu0", F.sum(F.col("w") * F.col("y")).over(over) / F.col("sum_w")).withColumn("d", F.col("y") - F.col("mu0"))
    rows = rows.withColumn("sum_w2", F.sum(F.col("w") * F.col("w")).over(over)).withColumn("sum_d2", F.sum(F.col("w") * F.col("d") * F.col("d")).over(over))
    if not exact:
        c = F.col("sum_w") - F.col("sum_w2") / F.col("sum_w")
        rows = rows.withColumn("tau2", F.greatest(F.lit(0.0), (F.col("sum_d2") - (F.col("k") - 1)) / F.greatest(c, F.lit(V.EPS)))).withColumn("u", 1 / (F.col("v") + F.col("tau2")))
        rows = rows.withColumn("sum_u", F.sum("u").over(over)).withColumn("sum_uy", F.sum(F.col("u") * F.col("y")).over(over))
        rest = F.col("sum_u") - F.col("u")
        on = lambda x: F.when((F.col("k") >= 2) & (rest > 0), x)
        rows = rows.withColumn("expected", on((F.col("sum_uy") - F.col("u") * F.col("y")) / rest))
        return rows.select(*CELL, "subject", "y", "tau2", "expected", on((F.col("y") - F.col("expected")) / F.sqrt(1 / F.col("u") + 1 / rest)).alias("resid"), (F.col("u") / F.col("sum_u")).alias("leverage"), on(F.col("sum_uy") / F.sqrt("sum_u") - F.col("expected") * F.sqrt(rest)).alias("delta_stat"), on(F.col("expected") * F.sqrt(rest)).alias("deleted_stat"))
    w1, w2 = F.col("sum_w") - F.col("w"), F.col("sum_w2") - F.col("w") * F.col("w")
    shift = -F.col("w") * F.col("d")  # the others' sum of w (y - mu0)
    q = F.col("sum_d2") - F.col("w") * F.col("d") * F.col("d") - shift * shift / w1
    tau2 = F.greatest(F.lit(0.0), (q - (F.col("k") - 2)) / F.greatest(w1 - w2 / w1, F.lit(V.EPS)))
    return rows.where("k >= 3").select(*CELL, "subject", "y", tau2.alias("tau2_without"), "k")


def leave_one_out_linear(cube: Cube, design, method: str = "ols:voxelwise", min_subjects: int | None = None, leverage: float = 1e-8, degeneracy: float = 1e-12) -> DataFrame:
    """Each subject against a linear fit without it, in NumPy blocks: OLS, or weighted by known variances.

    Random effects keep the full fit's tau2. A row has the expected effect, the
    predictive residual and its weight, the leverage, and for each term the change
    of its coefficient and of its statistic, and the statistic without the subject.
    A subject that did not enter a fit changes nothing: its row has zeros, the full
    statistic and no residual.
    """
    kind = {"ols:voxelwise": "ols", "meta:fe_reg": "fe", "meta:re_reg": "re"}[method]
    names = cube.ids("subject")
    place = {s: i for i, s in enumerate(design.subjects)}
    x = np.array([design.matrix[place[s]] if s in place else np.full(design.matrix.shape[1], np.nan) for s in names])
    known = np.isfinite(x).all(1)
    x, who = np.where(known[:, None], x, 0.0), np.array(names, object)
    p, terms = x.shape[1], design.terms
    least = max(min_subjects or p + 1, p + 1)
    assays = ["beta"] if kind == "ols" else ["beta", "var"]

    def run(batches):
        for pdf, got in R.stacks(batches, R.CELL, len(names), assays):
            y, ok = got[0], np.isfinite(got[0]) & known
            v = np.zeros_like(y)
            if kind != "ols":
                ok &= np.isfinite(got[1]) & (got[1] > 0)
                v = np.where(ok, got[1], 1.0)
            w = np.where(ok, 1.0 if kind == "ols" else 1 / np.maximum(v, V.EPS), 0.0)
            n = ok.sum(1)
            with np.errstate(all="ignore"):
                coef, inv, rss, good = R._solve(x, y, w)
                if kind == "re":
                    x2 = np.einsum("ci,ij,ik->cjk", w * w, x, x, optimize=True)
                    trace = w.sum(1) - np.einsum("cjk,ckj->c", inv, x2)
                    tau2 = np.maximum(0, (rss - (n - p)) / np.where(trace > 0, trace, np.nan))
                    good &= trace > 0
                    v = v + np.where(np.isfinite(tau2), tau2, 0.0)[:, None]
                    w = np.where(ok, 1 / np.maximum(v, V.EPS), 0.0)
                    coef, inv, rss, more = R._solve(x, y, w)
                    good &= more
                good &= n >= least
                residual = np.where(ok, y - coef @ x.T, 0.0)
                ax = np.einsum("cjk,ik->cij", inv, x)
                gram = np.einsum("cij,ij->ci", ax, x)
                h = w * gram
                rest = 1 - h
                step = np.where(rest > leverage, w * residual / rest, np.nan)
                delta = ax * step[:, :, None]
                inv_minus = np.einsum("cjj->cj", inv)[:, None] + (w / rest)[:, :, None] * ax**2  # its diagonal
                scale = (rss / np.maximum(n - p, 1)) if kind == "ols" else np.ones(len(y))
                full = coef / np.sqrt(np.einsum("cjj->cj", inv) * scale[:, None])
                expected = y - residual / rest
                if kind == "ols":
                    sse = np.maximum(rss[:, None] - residual * residual / rest, 0.0)
                    minus = np.where(sse > degeneracy, sse / np.maximum(n - 1 - p, 1)[:, None], np.nan)
                    resid, weight = residual / np.sqrt(minus * rest), rest / minus
                else:
                    minus = np.ones_like(y)
                    spread = v + gram / rest  # x' (A - w x x')^-1 x
                    resid, weight = (y - expected) / np.sqrt(spread), 1 / spread
                deleted = (coef[:, None] - delta) / np.sqrt(inv_minus * minus[:, :, None])
                can = ok & good[:, None] & (rest > leverage) & (n[:, None] - 1 >= least) & np.isfinite(resid)
            out = ~ok & good[:, None]
            keep = np.flatnonzero(can | out)
            pick = lambda a, none=np.nan: np.where(can, a, none)
            table = {"expected": pick(expected), "y": pick(y), "resid": pick(resid), "pred_weight": pick(weight), "leverage": pick(h)}
            for k, t in enumerate(terms):
                stat = np.broadcast_to(full[:, k, None], y.shape)
                table[f"delta_effect:{t}"] = np.where(can, delta[:, :, k], 0.0)
                table[f"delta_stat:{t}"] = np.where(can, stat - deleted[:, :, k], 0.0)
                table[f"deleted_stat:{t}"] = np.where(can, deleted[:, :, k], stat)
            for i in (keep[a : a + CHUNK] for a in range(0, len(keep), CHUNK)):
                line, at = np.divmod(i, len(who))
                made = pd.DataFrame({"sample": pdf["sample"].to_numpy()[line], "contrast": pdf["contrast"].to_numpy()[line], "subject": who[at], **{c: a.ravel()[i] for c, a in table.items()}})
                yield made.astype(object).where(made.notna(), None)

    measures = ["expected", "y", "resid", "pred_weight", "leverage", *(f"{m}:{t}" for t in terms for m in ("delta_effect", "delta_stat", "deleted_stat"))]
    return R.blocks(cube, assays, n=len(names)).mapInPandas(run, "sample string, contrast string, subject string, " + ", ".join(f"`{c}` double" for c in measures))


#: Upper edges of the influence histogram's bins, each with its edge; the last bin is open.
BINS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)


def _split_share(control: Control, tests) -> Column:
    """The share of the parts with data that pass; null if no part has any or stability isn't assessed."""
    if not control.splits:
        return F.lit(None).cast("double")
    passed = sum((F.coalesce(F.when(t, 1.0).otherwise(0.0), F.lit(0.0)) for _, t in tests), F.lit(0.0))
    known = sum((F.when(n > 0, 1.0).otherwise(0.0) for n, _ in tests), F.lit(0.0))
    return F.when(known > 0, passed / known)


def _surprise(control: Control):
    """(aggregates, columns made of them) of ``surprise``."""
    r = F.col("resid")
    capped, far = F.least(r * r, F.lit(control.cap**2)), (F.abs(r) >= control.residual).cast("double")
    own = [F.when(F.col("__part") == k, F.lit(True)) for k in range(control.splits)]
    sums = [F.count(r).alias("s_n"), F.sqrt(F.avg(capped)).alias("s_e"), F.avg(far).alias("s_t")]
    sums += [x for k, part in enumerate(own) for x in (F.count(part).alias(f"s_n{k}"), F.sqrt(F.avg(F.when(part, capped))).alias(f"s_e{k}"), F.avg(F.when(part, far)).alias(f"s_t{k}"))]
    tests = [(F.col(f"s_n{k}"), (F.col(f"s_e{k}") >= control.surprise_energy) & (F.col(f"s_t{k}") >= control.surprise_tail)) for k in range(control.splits)]
    return sums, [F.col("s_n").alias("n"), F.col("s_e").alias("energy"), F.col("s_t").alias("tail_extent"), _split_share(control, tests).alias("stability")]


def _agreement(control: Control):
    """(aggregates, columns made of them) of ``agreement``."""
    ok = F.col("expected").isNotNull() & F.col("y").isNotNull() & (F.col("pred_weight") > 0)
    w, y, e, c = F.when(ok, F.col("pred_weight")), F.col("y"), F.col("expected"), F.col
    named = {"sw": w, "sy": w * y, "se": w * e, "syy": w * y * y, "see": w * e * e, "sye": w * y * e, "sign": w * (F.signum(y) == F.signum(e)).cast("double")}
    cov, vy, ve = c("sye") - c("sy") * c("se") / c("sw"), c("syy") - c("sy") * c("sy") / c("sw"), c("see") - c("se") * c("se") / c("sw")
    low = lambda x: x <= control.degeneracy
    none = F.when(c("sw").isNull(), "insufficient_samples")
    status = lambda expected, observed: none.when(low(expected), "degenerate_expected").when(low(observed), "degenerate_observed").otherwise("available")
    return [F.sum(x).alias(k) for k, x in named.items()], [
        F.when(~low(ve) & ~low(vy), cov / F.sqrt(vy * ve)).alias("correlation"), status(ve, vy).alias("correlation_status"),
        F.when(~low(c("see")) & ~low(c("syy")), c("sye") / F.sqrt(c("syy") * c("see"))).alias("cosine"), status(c("see"), c("syy")).alias("cosine_status"),
        F.when(~low(c("see")), c("sye") / c("see")).alias("gain"), none.when(low(c("see")), "degenerate_expected").otherwise("available").alias("gain_status"), (c("sign") / c("sw")).alias("concordance"),
    ]


def _influence(control: Control, stability: str = "stability", count: str = "n"):
    """(aggregates, columns made of them) of ``influence``."""
    d = F.abs("delta_stat")
    squared, slot = F.least(d * d, F.lit(control.cap**2)), sum(((d > b).cast("int") for b in BINS), F.lit(0))
    own = [F.when((F.col("__part") == k) & d.isNotNull(), F.lit(True)) for k in range(control.splits)]
    names = [f"bin{i}" for i in range(len(BINS) + 1)]
    sums = [F.count(d).alias("i_n"), F.sqrt(F.avg(squared)).alias("influence_energy"), F.max(d).alias("influence_max"), *(F.count(F.when(slot == i, 1)).alias(b) for i, b in enumerate(names))]
    sums += [x for k, part in enumerate(own) for x in (F.count(part).alias(f"i_n{k}"), F.sqrt(F.avg(F.when(part, squared))).alias(f"i_e{k}"))]

    def quantile(share):
        upto, out, steps = F.lit(0), F.col("influence_max"), []
        for b, edge in zip(names, BINS):
            upto = upto + F.col(b)
            steps.append((upto >= share * F.col("i_n"), F.lit(edge)))
        for test, edge in reversed(steps):
            out = F.when(test, edge).otherwise(out)
        return F.when(F.col("i_n") > 0, out)

    tests = [(F.col(f"i_n{k}"), F.col(f"i_e{k}") >= control.influence_energy) for k in range(control.splits)]
    return sums, [F.col("i_n").alias(count), F.col("influence_energy"), F.col("influence_max"), *(F.col(b) for b in names), *(quantile(q / 100).alias(f"q{q}") for q in (90, 95, 99)), _split_share(control, tests).alias(stability)]


def _summed(loo: DataFrame, control: Control, *parts) -> DataFrame:
    """The columns of several summaries by (subject, contrast), from one aggregate over the deletions."""
    sums, columns = ([x for p in parts for x in p[k]] for k in (0, 1))
    rows = loo.where("resid is not null").withColumn("__part", split_of(control) if control.splits else F.lit(0))
    return rows.groupBy(*WHO).agg(*sums).select(*WHO, *columns)


def surprise(loo: DataFrame, control: Control = Control()) -> DataFrame:
    """(subject, contrast): root mean capped squared residual, share at or beyond the residual threshold, and stability.

    Stability is the share of the sample axis's parts in which both thresholds of a review are met.
    """
    return _summed(loo, control, _surprise(control))


def agreement(loo: DataFrame, control: Control = Control()) -> DataFrame:
    """(subject, contrast): weighted correlation, cosine, gain through the origin and sign concordance with the others' map.

    A status says why a measure is null: too few cells, or the expected or the observed map has no spread (or no size).
    """
    return _summed(loo, control, _agreement(control))


def influence(loo: DataFrame, control: Control = Control()) -> DataFrame:
    """(subject, contrast): root mean capped square and maximum of |delta_stat|, its histogram, quantiles read off it, and stability."""
    return _summed(loo, control, _influence(control))


def influence_map(loo: DataFrame) -> DataFrame:
    """(sample, contrast): the greatest |delta_stat|, the first subject that has it, and how many tie within 1e-12."""
    over = Window.partitionBy(*CELL)
    rows = loo.where("delta_stat is not null").withColumn("d", F.abs("delta_stat")).withColumn("top", F.max("d").over(over))
    tied = F.col("d") >= F.col("top") - 1e-12
    return rows.groupBy(*CELL).agg(F.first("top").alias("max_influence"), F.min(F.when(tied, F.col("subject"))).alias("subject"), F.count(F.when(tied, 1)).alias("ties"), F.count("*").alias("eligible"))


def contrast_table(cube: Cube, loo: DataFrame, control: Control = Control()) -> DataFrame:
    """(subject, contrast): coverage, mean standard error, surprise, agreement and influence, a row for every pair of the axes.

    Coverage is the share of all samples with a finite effect.
    """
    grid = cube.subjects.select(F.col("id").alias("subject")).crossJoin(F.broadcast(cube.contrasts.select(F.col("ord").alias("contrast_ord"), F.col("id").alias("contrast"))))  # the table's own rows
    beta = X.finite("beta")
    se = F.when(X.finite("var") > 0, F.sqrt("var")) if "var" in cube.assays else F.lit(None).cast("double")
    cells = cube.df.groupBy(*WHO).agg(F.count(beta).alias("n_beta"), F.avg(se).alias("mean_se"))
    parts = [_surprise(control)]
    parts += [_agreement(control)] if "pred_weight" in loo.columns else []
    parts += [_influence(control, "influence_stability", "influence_n")] if "delta_stat" in loo.columns else []
    made = _summed(loo, control, *parts)
    out = grid.join(cells, WHO, "left").join(made, WHO, "left")
    out = out.withColumn("coverage", F.coalesce("n_beta", F.lit(0)) / F.lit(float(cube.size("sample")))).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("surprise_status", F.when(F.col("n") > 0, "available").otherwise("insufficient_samples")).drop("n_beta")


def percentile(value: str) -> Column:
    """Average rank from 0 to 1 over all rows, of one row for each subject; 1 for a single value."""
    return H.average_rank_share(value, [F.lit(1)])


def review_queue(contrasts: DataFrame, influenced: DataFrame | None = None, control: Control = Control()) -> DataFrame:
    """Subjects by review priority, with what triggers a review, its source and reason, and whether they are retained.

    ``contrasts`` is a ``contrast_table``; ``influenced`` an ``influence`` table of several
    estimands, else the contrast table's own influence counts. The
    priority is the greatest percentile of quality (1 - coverage), surprise and
    influence. A review needs a criterion met in full: coverage at most its
    threshold; or energy, tail and stability of surprise in one contrast; or energy,
    maximum and stability of influence. The source is the met criterion of the
    greatest percentile, the reason names the first contrast that met it. Subjects
    under review and the first ``retain`` are retained. One row for each subject, so
    its ranks are one small window.
    """
    stable = lambda c: F.col(c).isNull() | (F.col(c) >= control.min_stability)
    surprising = F.coalesce((F.col("energy") >= control.surprise_energy) & (F.col("tail_extent") >= control.surprise_tail) & stable("stability"), F.lit(False))
    influential = lambda c: F.coalesce((F.col("influence_energy") >= control.influence_energy) & (F.col("influence_max") >= control.influence_max) & stable(c), F.lit(False))
    moved = lambda c: [F.max("influence_energy").alias("influence_score"), F.min(F.when(influential(c), F.struct("contrast_ord", "contrast"))).alias("__i")]
    gain = F.col("gain") if "gain" in contrasts.columns else F.lit(None).cast("double")
    named = F.struct("contrast_ord", "contrast", gain.alias("gain"))
    seen = [F.min("coverage").alias("coverage"), F.max("energy").alias("surprise_score"), F.min(F.when(surprising, named)).alias("__s")]
    if influenced is None:
        rows = contrasts.groupBy("subject").agg(*seen, *moved("influence_stability"))
    else:
        order = contrasts.select("contrast", "contrast_ord").distinct()
        own = influenced.join(F.broadcast(order), "contrast").groupBy("subject").agg(*moved("stability"))
        rows = contrasts.groupBy("subject").agg(*seen).join(own, "subject", "left")
    rows = rows.withColumn("quality_score", 1 - F.col("coverage"))
    for name in ("quality", "surprise", "influence"):
        rows = rows.withColumn(f"{name}_percentile", percentile(f"{name}_score"))
    rows = rows.withColumn("priority", F.greatest("quality_percentile", "surprise_percentile", "influence_percentile"))
    met = {"quality": F.coalesce(F.col("coverage") <= control.coverage, F.lit(False)), "surprise": F.col("__s").isNotNull(), "influence": F.col("__i").isNotNull()}
    score = {k: F.when(t, F.coalesce(f"{k}_percentile", F.lit(-1.0))).otherwise(-2.0) for k, t in met.items()}
    most = F.greatest(*score.values())
    rows = rows.withColumn("source", F.when(most > -2, F.when(score["quality"] == most, "quality").when(score["surprise"] == most, "surprise").otherwise("influence")))
    how = F.when(F.col("__s.gain") < 0, "negative gain in ").otherwise("surprise in ")
    reason = F.when(F.col("source") == "quality", "coverage").when(F.col("source") == "surprise", F.concat(how, F.col("__s.contrast"))).when(F.col("source") == "influence", F.concat(F.lit("influence in "), F.col("__i.contrast")))
    unknown = F.col("surprise_score").isNull() & F.col("influence_score").isNull() & F.col("coverage").isNull()
    rows = rows.withColumn("status", F.when(unknown, "insufficient").when(F.col("source").isNotNull(), "review").otherwise("none")).withColumn("reason", reason)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("priority"), "subject")))
    rows = rows.withColumn("retained", (F.col("status") == "review") | (F.col("place") <= control.retain))
    return rows.select("subject", "coverage", "surprise_score", "influence_score", "quality_percentile", "surprise_percentile", "influence_percentile", "priority", "status", "source", "reason", "place", "retained")


def coverage_of(cube: Cube) -> DataFrame:
    """(subject, coverage): the least share over contrasts of samples with a finite effect; a missing cell has none."""
    n = cube.df.groupBy(*WHO).agg(F.count(X.finite("beta")).alias("k")).groupBy("subject").agg(F.min("k").alias("k"), F.count("*").alias("c"))
    share = F.when(F.col("c") == cube.size("contrast"), F.col("k")).otherwise(0) / F.lit(float(cube.size("sample")))
    return cube.subjects.select(F.col("id").alias("subject")).join(n, "subject", "left").select("subject", F.coalesce(share, F.lit(0.0)).alias("coverage"))


def ranked_regions(loo: DataFrame, labels: DataFrame, subject: str, contrast: str, n: int = 10, delta: str = "delta_stat") -> DataFrame:
    """(label, mean_abs_residual, max_abs_delta_stat, eligible_n) of one subject's map, the n labels of the greater measure first.

    ``labels`` is (sample, label); samples without a label are left out.
    """
    r, d = F.col("resid"), F.col(f"`{delta}`")
    rows = loo.where((F.col("subject") == subject) & (F.col("contrast") == contrast)).join(labels.where("label is not null and label <> ''").select("sample", "label"), "sample")
    made = rows.groupBy("label").agg(F.avg(F.abs(r)).alias("mean_abs_residual"), F.max(F.abs(d)).alias("max_abs_delta_stat"), F.count(F.when(r.isNotNull() | d.isNotNull(), 1)).alias("eligible_n"))
    return made.orderBy(F.greatest("mean_abs_residual", "max_abs_delta_stat").desc_nulls_last(), "label").limit(n)


def placed(loo: DataFrame, subjects: DataFrame, control: Control = Control(), dimensions: int = 3) -> DataFrame:
    """(subject, d1, d2...): ``subjects`` (ord, subject) in the leading dimensions of their residual maps.

    The subjects' maps are summed in tasks by random signs of the samples (a sketch
    of rank + oversample numbers a subject). Tasks reduce the sketch, with a column
    of ones for its mean, to triangles of that width; their decomposition on the
    driver gives the directions, and tasks project the subjects on them.
    """
    width = control.rank + control.oversample
    r = F.greatest(F.least("resid", F.lit(control.cap)), F.lit(-control.cap))
    sign = lambda i: 1 - 2 * F.pmod(F.xxhash64("sample", "contrast", F.lit(i)), F.lit(2))
    sums = loo.where("resid is not null").groupBy("subject").agg(*[F.sum(r * sign(i)).alias(f"m{i}") for i in range(width)])
    sketch = checkpoint(subjects.join(sums, "subject", "left").select("ord", "subject", *[(F.coalesce(f"m{i}", F.lit(0.0)) / float(np.sqrt(width))).alias(f"m{i}") for i in range(width)]))
    columns = [f"m{i}" for i in range(width)]

    def triangle(batches):
        whole = np.zeros((0, width + 1))
        for pdf in batches:
            whole = np.linalg.qr(np.vstack([whole, np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(float)])]), mode="r")
        if len(whole):
            yield pd.DataFrame({"r": list(whole)})

    parts = [x.r for x in sketch.mapInPandas(triangle, "r array<double>").collect()]
    n = sketch.count()
    k = min(dimensions, n, width)
    whole = np.linalg.qr(np.array(parts, float).reshape(-1, width + 1), mode="r")
    mean = whole[0, 1:] / whole[0, 0] if n else np.zeros(width)
    axes = np.linalg.svd(np.vstack([whole[1:, 1:], np.zeros((k, width))]), full_matrices=False)[2][:k].T
    names = [f"d{i + 1}" for i in range(k)]

    def project(batches):
        for pdf in batches:
            yield pd.concat([pdf[["ord", "subject"]], pd.DataFrame((pdf[columns].to_numpy(float) - mean) @ axes, columns=names)], axis=1)

    scores = sketch.mapInPandas(project, ", ".join(["ord int", "subject string", *(f"{d} double" for d in names)]))
    if not k:
        return scores
    far = scores.agg(*[F.max(F.struct(F.abs(d).alias("size"), -F.col("ord"), F.col(d).alias("at"))).alias(d) for d in names]).first()  # the first of the farthest lies on the positive side
    return scores.select("ord", "subject", *[(F.col(d) * float(np.sign(far[d]["at"]))).alias(d) for d in names])


def geometry(loo: DataFrame, subjects: list[str], control: Control = Control(), dimensions: int = 3) -> pd.DataFrame:
    """``placed`` for a list of subjects, as a table on the driver in their order."""
    listed = loo.sparkSession.createDataFrame(list(enumerate(subjects, 1)), "ord int, subject string")
    return placed(loo, listed, control, dimensions).orderBy("ord").drop("ord").toPandas()


def conclusions(cube: Cube, loo: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per deleted subject: how many samples gain or lose significance after step-up correction of the deleted statistic."""
    full = H.step_up(R.meta_fe(cube).select(*CELL, "subject", "p"), "p", "q").select(*CELL, (F.col("q") <= alpha).alias("before"))
    deleted = loo.where("deleted_stat is not null").withColumn("p", X.normal_p("deleted_stat"))
    after = H.step_up(deleted, "p", "q", keys=WHO).select(*CELL, "subject", (F.col("q") <= alpha).alias("after"))
    both = after.join(full, CELL)
    n = lambda c: F.count(F.when(c, 1))
    return both.groupBy(*WHO).agg(n(F.col("after") & ~F.col("before")).alias("gained"), n(~F.col("after") & F.col("before")).alias("lost"), n(F.col("after") & F.col("before")).alias("kept"))


def examine_group(cube: Cube, method: str = "meta:fe", control: Control = Control(), alpha: float = 0.05, formula: str = "~ 1") -> dict[str, DataFrame]:
    """The tables of an examination, lazily: subject maps, group maps, contrasts, influence, queue, conclusions.

    Linear methods take a formula; their influence table has a row for each term (estimand).
    """
    own = reducer(method)
    if own.deletion == "unsupported":
        raise ValueError(f"{own.name} has no leave-one-out form here")
    out: dict[str, DataFrame] = {"coverage": coverage_of(cube)}
    if own.uses_design:
        design = R._design(cube, None, formula)
        loo = leave_one_out_linear(cube, design, own.name)
        of = lambda t: loo.withColumn("delta_stat", F.col(f"`delta_stat:{t}`"))
        tables = [(t, influence(of(t), control).withColumn("estimand", F.lit(t)), influence_map(of(t).where("resid is not null")).withColumn("estimand", F.lit(t))) for t in design.terms]
        out["influence"], out["influence_map"] = (reduce(DataFrame.unionAll, (x[k] for x in tables)) for k in (1, 2))
        out["group_maps"] = own.fun(cube, design)
    else:
        loo = leave_one_out_fe(cube) if own.name == "meta:fe" else leave_one_out_re(cube)
        out["influence"], out["influence_map"], out["group_maps"] = influence(loo, control), influence_map(loo), own.fun(cube)
        if own.name == "meta:fe":
            out["conclusions"] = conclusions(cube, loo, alpha)
    out["subject_maps"], out["contrasts"] = loo, contrast_table(cube, loo, control)
    out["queue"] = review_queue(out["contrasts"], out["influence"] if own.uses_design else None, control)
    return out
