"""Reducers over the subject axis. The sums run in the JVM; solves and searches run in NumPy blocks.

Cells reach NumPy sorted by (sample, contrast), in batches of a fixed size. A line,
the subjects of one (sample, contrast), becomes an array in the axis's order; so
many lines are solved at once that a stack's memory is known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import columns as X
from ..functions import formula as M
from ..functions import special as S
from ..registry import Reducer, reducer, reducers
from . import gram as G
from . import lmm as L
from . import permute as P
from . import verbs as V

CELL = ["sample", "contrast"]
META = "meta"


def _grid(cube: Cube) -> DataFrame:
    """Every (sample, contrast) of the axes; the contrast axis is small."""
    return cube.samples.select(F.col("id").alias("sample")).crossJoin(F.broadcast(cube.contrasts.select(F.col("id").alias("contrast"))))


def _full(cube: Cube, found: DataFrame) -> DataFrame:
    """A row for every (sample, contrast), with the subject axis reduced to one label."""
    out = _grid(cube).join(found, CELL, "left")
    if "n_eff" in found.columns:
        out = out.withColumn("n_eff", F.coalesce("n_eff", F.lit(0).cast("long")))
    return out.select("sample", F.lit(META).alias("subject"), "contrast", *[c for c in found.columns if c not in CELL])


def valid(df: DataFrame) -> DataFrame:
    """Cells that enter variance-weighted reducers: finite beta, finite positive var; var is floored."""
    y, v = X.finite("beta"), X.finite("var")
    return df.select(*CELL, "subject", y.alias("y"), F.greatest(v, F.lit(V.EPS)).alias("v")).where((F.col("v").isNotNull()) & (v > 0) & F.col("y").isNotNull())


def _ok(k, least):
    return lambda c: F.when(F.col(k) >= least, c)


def meta_fe(cube: Cube, design=None, min_subjects: int = 2, eps: float = V.EPS, alternative: str = "two.sided", p: bool = True) -> DataFrame:
    """Inverse-variance mean, Q and I2. Q is the second pass of a window over the same partitions."""
    w = F.lit(1.0) / F.greatest(F.col("v"), F.lit(eps))
    cells = valid(cube.df).withColumn("w", w)
    over = Window.partitionBy(*CELL)
    mu = F.sum(F.col("w") * F.col("y")).over(over) / F.sum("w").over(over)
    rows = cells.withColumn("mu", mu)
    sums = rows.groupBy(*CELL).agg(F.first("mu").alias("mu"), F.sum("w").alias("sw"), F.count("*").alias("n_eff"), F.sum(F.col("w") * F.pow(F.col("y") - F.col("mu"), 2)).alias("q"))
    ok = _ok("n_eff", min_subjects)
    df = F.col("n_eff") - 1
    out = sums.select(
        *CELL, ok(F.col("mu")).alias("beta"), ok(1 / F.col("sw")).alias("var"), ok(1 / F.sqrt("sw")).alias("se"), ok(F.col("mu") * F.sqrt("sw")).alias("z"),
        ok(F.col("q")).alias("Q"), ok(F.when(F.col("q") > eps, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q"))).otherwise(0.0)).alias("I2"), "n_eff",
    )
    return _full(cube, out.withColumn("p", X.normal_p("z", alternative)) if p else out)


def meta_re(cube: Cube, design=None, min_subjects: int = 2, eps: float = V.EPS, alternative: str = "two.sided", p: bool = True) -> DataFrame:
    """DerSimonian-Laird: tau2 from the fixed-effects Q, then the re-weighted mean; one shuffle."""
    over = Window.partitionBy(*CELL)
    rows = valid(cube.df).withColumn("w", 1 / F.greatest(F.col("v"), F.lit(eps)))
    rows = rows.withColumn("sw", F.sum("w").over(over)).withColumn("mu", F.sum(F.col("w") * F.col("y")).over(over) / F.col("sw"))
    rows = rows.withColumn("q", F.sum(F.col("w") * F.pow(F.col("y") - F.col("mu"), 2)).over(over)).withColumn("sw2", F.sum(F.col("w") * F.col("w")).over(over)).withColumn("n_eff", F.count(F.lit(1)).over(over))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    rows = rows.withColumn("tau2", F.greatest(F.lit(0.0), (F.col("q") - (F.col("n_eff") - 1)) / F.greatest(c, F.lit(eps)))).withColumn("u", 1 / (F.greatest(F.col("v"), F.lit(eps)) + F.col("tau2")))
    first = [F.first(x).alias(x) for x in ("q", "n_eff", "tau2")]
    sums = rows.groupBy(*CELL).agg(*first, F.sum("u").alias("su"), F.sum(F.col("u") * F.col("y")).alias("suy"))
    ok, df = _ok("n_eff", min_subjects), F.col("n_eff") - 1
    mu = F.col("suy") / F.col("su")
    out = sums.select(
        *CELL, ok(mu).alias("beta"), ok(1 / F.col("su")).alias("var"), ok(1 / F.sqrt("su")).alias("se"), ok(mu * F.sqrt("su")).alias("z"), ok(F.col("q")).alias("Q"),
        ok(F.when(F.col("q") > eps, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q"))).otherwise(0.0)).alias("I2"), ok(F.col("tau2")).alias("tau2"), "n_eff",
    )
    return _full(cube, out.withColumn("p", X.normal_p("z", alternative)) if p else out)


def stouffer(cube: Cube, design=None, min_subjects: int = 1, weights: DataFrame | None = None, alternative: str = "two.sided", p: bool = True) -> DataFrame:
    """Sum of w z over the root of the sum of w^2; ``weights`` is (subject, w)."""
    rows = cube.df.select(*CELL, "subject", X.finite("z").alias("z")).where("z is not null")
    rows = rows.join(F.broadcast(weights.select("subject", "w")), "subject") if weights is not None else rows.withColumn("w", F.lit(1.0))
    sums = rows.groupBy(*CELL).agg(F.sum(F.col("w") * F.col("z")).alias("a"), F.sum(F.col("w") * F.col("w")).alias("b"), F.count("*").alias("n_eff"))
    out = sums.select(*CELL, _ok("n_eff", min_subjects)(V.divide(F.col("a"), F.sqrt("b"))).alias("z"), "n_eff")
    return _full(cube, out.withColumn("p", X.normal_p("z", alternative)) if p else out)


def fisher(cube: Cube, design=None, min_subjects: int = 1) -> DataFrame:
    """-2 sum ln p on 2k degrees of freedom; the even-df tail has a closed form, so all of it stays in the JVM."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-16)), F.lit(1e-300))
    rows = cube.df.select(*CELL, X.finite("p").alias("p")).where("p is not null")
    sums = rows.groupBy(*CELL).agg((-2 * F.sum(F.ln(p))).alias("x"), F.count("*").alias("n_eff"))
    ok = _ok("n_eff", min_subjects)
    return _full(cube, sums.select(*CELL, ok(F.col("x")).alias("chi2"), ok(2.0 * F.col("n_eff")).alias("df"), ok(X.chi2_p_even("x", "n_eff")).alias("p"), "n_eff"))


def lancaster(cube: Cube, design=None, min_subjects: int = 1) -> DataFrame:
    """Sum of upper chi-squared quantiles with 2w degrees of freedom, w the rounded df of the cell or 1."""
    w = F.greatest(F.round(X.finite("df")), F.lit(1.0)) if "df" in cube.assays else F.lit(1.0)
    rows = cube.df.select(*CELL, X.finite("p").alias("p"), F.coalesce(w, F.lit(1.0)).alias("w")).where("p is not null")
    rows = rows.withColumn("p", F.greatest(F.least(F.col("p"), F.lit(1 - 1e-16)), F.lit(1e-300))).withColumn("x", X.chi2_quantile("p", 2 * F.col("w")))
    sums = rows.groupBy(*CELL).agg(F.sum("x").alias("x"), F.sum(2 * F.col("w")).alias("d"), F.count("*").alias("n_eff"))
    ok = _ok("n_eff", min_subjects)
    return _full(cube, sums.select(*CELL, ok(F.col("x")).alias("chi2"), ok(F.col("d")).alias("df"), ok(X.chi2_p("x", "d")).alias("p"), "n_eff"))


def welch(cube: Cube, design=None, group: str = "group", min_group: int = 2, alternative: str = "two.sided", p: bool = True) -> DataFrame:
    """Welch's t of the second level of a subject attribute minus the first (levels in sorted order)."""
    levels = [r[0] for r in cube.subjects.select(F.col(group).cast("string")).distinct().orderBy(group).collect() if r[0] is not None]
    if len(levels) != 2:
        raise ValueError(f"{group} must have two levels")
    own = F.broadcast(cube.subjects.select(F.col("id").alias("subject"), (F.col(group).cast("string") == levels[1]).alias("g")))
    rows = cube.df.join(own, "subject").select(*CELL, "g", X.finite("beta").alias("y")).where("y is not null and g is not null")
    y1, y0 = F.when(F.col("g"), F.col("y")), F.when(~F.col("g"), F.col("y"))
    sums = rows.groupBy(*CELL).agg(*(f(y).alias(f"{n}{i}") for i, y in enumerate((y0, y1)) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))))
    a0, a1 = F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")
    enough = (F.col("n0") >= max(2, min_group)) & (F.col("n1") >= max(2, min_group))
    has = enough & (a0 + a1 > 0)
    dof = (a0 + a1) * (a0 + a1) / (a0 * a0 / (F.col("n0") - 1) + a1 * a1 / (F.col("n1") - 1))
    effect = F.col("m1") - F.col("m0")
    out = sums.select(*CELL, F.when(enough, effect).alias("beta"), F.when(has, a0 + a1).alias("var"), F.when(has, F.sqrt(a0 + a1)).alias("se"), F.when(has, effect / F.sqrt(a0 + a1)).alias("t"), F.when(has, dof).alias("df"), "n0", "n1")
    if p:
        out = out.withColumn("z", X.t_to_z("t", "df")).withColumn("p", X.t_p("t", "df", alternative))
    return _full(cube, out)


# --- blocks


#: A longer subject axis is joined to the cells by a shuffle, not sent to every task.
SENT = 100_000
#: Numbers of an assay that are solved at once; a longer line is solved alone.
STACK = 1 << 18


def blocks(cube: Cube, assays, keys=CELL, n: int | None = None, attributes=()) -> DataFrame:
    """(keys, s, k, values, attributes of the subject): the cells dealt and sorted by key, with the subject's place and, if contrasts are repeats, theirs.

    A task reads each line of the subject axis whole, cell by cell: ``stacks``
    makes arrays of lines, ``starts`` finds where lines begin. ``n`` is the number
    of subjects, where the caller knows it.
    """
    ords = cube.subjects.select(F.col("id").alias("subject"), (F.col("ord") - 1).alias("s"), *attributes)
    rows = cube.df.join(F.broadcast(ords) if (cube.size("subject") if n is None else n) <= SENT else ords, "subject")
    if "contrast" not in keys:
        rows = rows.join(F.broadcast(cube.contrasts.select(F.col("id").alias("contrast"), (F.col("ord") - 1).alias("k"))), "contrast")
    else:
        rows = rows.withColumn("k", F.lit(0))
    return rows.select(*keys, "s", "k", *[X.finite(a).alias(a) for a in assays], *attributes).repartition(*keys).sortWithinPartitions(*keys)


def starts(columns) -> np.ndarray:
    """Where a new key begins in sorted columns of the same length, at least 1."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def stacks(batches, keys, n: int, assays, repeats: int = 1, most: int = STACK):
    """(keys, arrays) of as many lines as hold ``most`` numbers, one at least: a table of their keys and, for each assay, [line, subject * repeats + repeat], NaN where there is no value."""
    width = n * repeats
    lines, names, arrays = max(1, most // max(width, 1)), [], []
    table = lambda: (pd.DataFrame(names, columns=list(keys)), [x[: len(names)] for x in arrays])
    for pdf in batches:
        if not len(pdf):
            continue
        columns = [pdf[k].to_numpy() for k in keys]
        place = pdf["s"].to_numpy() * repeats + pdf["k"].to_numpy()
        values = [pdf[a].to_numpy(float) for a in assays]
        first = starts(columns)
        for a, b in zip(first, [*first[1:], len(pdf)]):
            own = tuple(c[a] for c in columns)
            if not names or own != names[-1]:
                if len(names) == lines:
                    yield table()
                    names = []
                if not names:
                    arrays = [np.full((lines, width), np.nan) for _ in assays]
                names.append(own)
            for x, v in zip(arrays, values):
                x[len(names) - 1, place[a:b]] = v[a:b]
    if names:
        yield table()


def _solve(x, y, w):
    """Batched weighted least squares: (coefficients, (X'WX)^-1, weighted RSS, rank ok) with rows of y and w as fits."""
    gram = np.einsum("ci,ij,ik->cjk", w, x, x, optimize=True)
    right = np.einsum("ci,ij,ci->cj", w, x, np.where(w > 0, y, 0.0), optimize=True)
    scale = np.sqrt(np.maximum(np.einsum("cjj->cj", gram), 1e-300))
    unit = gram / scale[:, :, None] / scale[:, None, :]
    good = np.linalg.cond(np.where(np.isfinite(unit), unit, 0.0)) < 1e12
    safe = np.where(good[:, None, None], unit, np.eye(x.shape[1]))
    inv = np.linalg.inv(safe) / scale[:, :, None] / scale[:, None, :]
    coef = np.einsum("cjk,ck->cj", inv, right)
    rss = (w * np.where(w > 0, y - coef @ x.T, 0.0) ** 2).sum(1)
    return coef, inv, rss, good


def _regression(cube: Cube, design: M.Design, kind: str, min_subjects: int = 2, return_cov: str = "none", eps: float = V.EPS) -> DataFrame:
    names = cube.ids("subject")
    place = {s: i for i, s in enumerate(design.subjects)}
    x = np.array([design.matrix[place[s]] if s in place else np.full(design.matrix.shape[1], np.nan) for s in names])
    known = ~np.isnan(x).any(1)
    x = np.where(known[:, None], x, 0.0)
    p, terms = x.shape[1], design.terms
    assays = ["beta"] if kind == "ols" else ["beta", "var"]
    stat = "t" if kind == "ols" else "z"
    extra = {"ols": ["sigma2", "df_res", "n_obs"], "fe": ["Q", "df_res"], "re": ["Q", "tau2", "df_res"]}[kind]
    tri = [(i, j) for i in range(p) for j in range(i, p)] if return_cov == "tri" else []
    columns = [f"{q}:{t}" for q in ("coef", "se_coef", f"{stat}_coef", "p_coef") for t in terms] + extra + [f"cov:{terms[i]}:{terms[j]}" for i, j in tri]
    ddl = "sample string, contrast string, " + ", ".join(f"`{c}` double" for c in columns)

    def run(batches):
        for pdf, got in stacks(batches, CELL, len(names), assays):
            y = got[0]
            ok = np.isfinite(y) & known
            if kind == "ols":
                w = ok.astype(float)
            else:
                ok &= np.isfinite(got[1]) & (got[1] > 0)
                w = np.where(ok, 1 / np.maximum(np.where(ok, got[1], 1.0), eps), 0.0)
            n = ok.sum(1)
            with np.errstate(all="ignore"):
                coef, inv, rss, good = _solve(x, y, w)
                q, tau2 = rss.copy(), np.zeros(len(y))
                if kind == "re":
                    x2 = np.einsum("ci,ij,ik->cjk", w * w, x, x, optimize=True)
                    trace = w.sum(1) - np.einsum("cjk,ckj->c", inv, x2)
                    good &= trace > 0
                    tau2 = np.maximum(0, (rss - (n - p)) / np.where(trace > 0, trace, 1))
                    w = np.where(ok, 1 / (np.maximum(np.where(ok, got[1], 1.0), eps) + tau2[:, None]), 0.0)
                    coef, inv, _, good2 = _solve(x, y, w)
                    good &= good2
                dof = n - p
                sigma2 = rss / np.maximum(dof, 1) if kind == "ols" else np.ones(len(y))
                cov = inv * sigma2[:, None, None]
                se = np.sqrt(np.maximum(np.einsum("cjj->cj", cov), 0))
                ratio = coef / np.where(se > 0, se, np.nan)
                pv = S.t_two_sided(ratio, np.broadcast_to(np.maximum(dof, 1)[:, None], ratio.shape).astype(float)) if kind == "ols" else S.tail_p(ratio)
            good &= n >= max(min_subjects, p + 1)
            parts = [coef, se, ratio, pv]
            parts += {"ols": [sigma2, dof, n], "fe": [q, dof], "re": [q, tau2, dof]}[kind]
            parts += [cov[:, i, j] for i, j in tri]
            table = np.column_stack([np.asarray(v, float) for v in parts])
            table[~good] = np.nan
            if kind == "ols":
                table[:, columns.index("n_obs")] = n
            out = pd.DataFrame(table, columns=columns).astype(object).where(~np.isnan(table), None)
            out.insert(0, "contrast", pdf["contrast"].to_numpy())
            out.insert(0, "sample", pdf["sample"].to_numpy())
            yield out

    if kind == "ols" and terms[0] == "(Intercept)" and p <= G.MOST_TERMS:
        return _full(cube, _least_squares(cube, names, x, known, terms, tri, columns, ddl, max(min_subjects, p + 1)))
    return _full(cube, blocks(cube, assays, n=len(names)).mapInPandas(run, ddl))


def _least_squares(cube: Cube, names, x, known, terms, tri, columns, ddl, least: int) -> DataFrame:
    """The OLS columns of ``_regression`` from sums that the JVM takes; the design is as long as the subject axis."""
    xs = [f"__x{i}" for i in range(1, len(terms))]
    axis = cube.df.sparkSession.createDataFrame([(s, *map(float, row[1:])) for s, row, ok in zip(names, x, known) if ok], "subject string" + "".join(f", {c} double" for c in xs))
    cells = cube.df.select(*CELL, "subject", X.finite("beta").alias("__y")).join(F.broadcast(axis), "subject")

    def run(batches):
        for pdf in batches:
            n, m, v = G.stacked(pdf, len(terms))
            got = G.solve(n, m, v)
            se, t, p = G.statistics(got)
            parts = [got["coef"], se, t, p, got["sigma2"], got["df"], n, *(got["cov"][:, i, j] for i, j in tri)]
            table = np.column_stack([np.asarray(a, float) for a in parts])
            table[~(got["good"] & (n >= least))] = np.nan
            table[:, columns.index("n_obs")] = n
            out = pd.DataFrame(table, columns=columns).astype(object).where(~np.isnan(table), None)
            out.insert(0, "contrast", pdf["contrast"].to_numpy())
            out.insert(0, "sample", pdf["sample"].to_numpy())
            yield out

    return G.sums(cells, CELL, "__y", xs).mapInPandas(run, ddl)


def coef_array(cube: Cube, prefix: str = "coef:") -> DataFrame:
    """(sample, contrast, term, value): the coefficient assays of a fit, one row for each term."""
    own = [a for a in cube.assays if a.startswith(prefix)]
    if not own:
        raise ValueError(f"no assays begin with {prefix!r}")
    made = F.explode(F.array(*[F.struct(F.lit(a.removeprefix(prefix)).alias("term"), F.col(f"`{a}`").alias("value")) for a in own])).alias("t")
    return cube.df.select("sample", "contrast", made).select("sample", "contrast", "t.term", "t.value")


def coef_cov_tri(cube: Cube, contrast: str | None = None) -> DataFrame:
    """(sample, contrast, term_a, term_b, cov): the packed upper triangle of a fit's covariances, of all contrasts or of one."""
    terms = [a.removeprefix("coef:") for a in cube.assays if a.startswith("coef:")]
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:] if f"cov:{a}:{b}" in cube.assays]
    if not pairs:
        raise ValueError("the fit has no covariances; ask for return_cov='tri'")
    made = F.explode(F.array(*[F.struct(F.lit(a).alias("term_a"), F.lit(b).alias("term_b"), F.col(f"`cov:{a}:{b}`").alias("cov")) for a, b in pairs])).alias("t")
    rows = cube.df if contrast is None else cube.df.where(F.col("contrast") == contrast)
    return rows.select("sample", "contrast", made).select("sample", "contrast", "t.*")


def _design(cube: Cube, design, formula):
    if isinstance(design, M.Design):
        return design
    rows = [r.asDict() for r in cube.subjects.orderBy("ord").collect()]
    return M.design(rows, "id", formula or "~ 1", cube.meta.get("levels"), cube.meta.get("na_action", "fail"))


def reduce(cube: Cube, method: str, formula: str | None = None, design=None, weights=None, by=None, **options) -> Cube:
    """Reduce the subjects of each (sample, contrast); the subject axis becomes one label.

    A formula on a reducer without a design is an error, and so are weights:
    each reducer has its own. ``by`` is recorded and not interpreted.
    """
    own: Reducer = reducer(method)
    if weights is not None and own.name != "combine:stouffer":
        raise ValueError(f"{own.name} has its own weights")
    if formula and not own.uses_design:
        raise ValueError(f"{own.name} takes no formula")
    if cube.meta.get("synthetic_variance") and own.synthetic_variance == "forbid":
        raise ValueError(f"{own.name} needs real variances; the source has none")
    cube = V.require(cube, own.requires)
    if weights is not None:
        options["weights"] = weights
    if own.uses_design:
        design = _design(cube, design, formula)
    made = own.fun(cube, design, **options)
    cells, attachments = made if isinstance(made, tuple) else (made, {})
    spark = cube.df.sparkSession
    subjects = spark.range(1).select(F.lit(1).alias("ord"), F.lit(META).alias("id"))
    contrasts = cube.contrasts
    if own.name.startswith("lmm:"):
        contrasts = spark.range(1).select(F.lit(1).alias("ord"), F.lit("model").alias("id"))
    out = cube.with_df(cells).with_(subjects=subjects, contrasts=contrasts)
    return out.with_(attachments={**cube.attachments, **{f"reduce/{own.name}/{k}": v for k, v in attachments.items()}}, meta={**cube.meta, "reduced": own.name, "by": by})


def coef_contrast(cube: Cube, c: dict[str, float], stat: str = "t", df_column: str | None = "df_res", alternative: str = "two.sided") -> DataFrame:
    """c'b, its standard error, t or z and p for a combination of coefficients; needs the packed covariance."""
    terms = list(c)
    missing = [t for t in terms if f"coef:{t}" not in cube.assays]
    if missing:
        raise ValueError(f"no such coefficients: {', '.join(missing)}")

    def cov(a, b):
        name = f"cov:{a}:{b}" if f"cov:{a}:{b}" in cube.assays else f"cov:{b}:{a}"
        if name not in cube.assays:
            raise ValueError("the fit has no covariances; ask for return_cov='tri'")
        return F.col(f"`{name}`")

    effect = sum((F.col(f"`coef:{t}`") * w for t, w in c.items()), F.lit(0.0))
    var = sum((cov(a, b) * (c[a] * c[b]) for a in terms for b in terms), F.lit(0.0))
    rows = cube.df.select("sample", "contrast", effect.alias("estimate"), F.when(var > 0, F.sqrt(var)).alias("se"), *([F.col(df_column).alias("df")] if stat == "t" else []))
    rows = rows.withColumn(stat, V.divide(F.col("estimate"), F.col("se")))
    return rows.withColumn("p", X.t_p("t", "df", alternative) if stat == "t" else X.normal_p("z", alternative))


def joint_test(cube: Cube, contrasts: list[dict[str, float]], df_column: str = "df_res") -> DataFrame:
    """F test that all combinations are zero: (sample, contrast, F, df1, df2, p), by a batched q x q solve."""
    terms = [a[5:] for a in cube.assays if a.startswith("coef:")]
    c = np.array([[x.get(t, 0.0) for t in terms] for x in contrasts])
    q = np.linalg.matrix_rank(c)
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    picked = cube.df.select("sample", "contrast", F.array(*[F.col(f"`coef:{t}`") for t in terms]).alias("b"), F.array(*[F.col(f"`cov:{terms[i]}:{terms[j]}`") for i, j in pairs]).alias("v"), F.col(df_column).cast("double").alias("df2"))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            b = np.array([[np.nan if x is None else x for x in r] for r in pdf["b"]], float)
            flat = np.array([[np.nan if x is None else x for x in r] for r in pdf["v"]], float)
            v = np.zeros((len(b), len(terms), len(terms)))
            for n, (i, j) in enumerate(pairs):
                v[:, i, j] = v[:, j, i] = flat[:, n]
            e, m = b @ c.T, c @ v @ c.T
            ok = np.isfinite(e).all(1) & np.isfinite(m).all((1, 2))
            f = np.full(len(b), np.nan)
            if ok.any():
                f[ok] = np.einsum("ci,cij,cj->c", e[ok], np.linalg.pinv(m[ok]), e[ok]) / q
            p = S.f_sf(f, float(q), pdf["df2"].to_numpy(float))
            out = pdf[["sample", "contrast"]].assign(F=f, df1=float(q), df2=pdf["df2"], p=p)
            yield out.astype(object).where(out.notna(), None)

    return picked.mapInPandas(run, "sample string, contrast string, F double, df1 double, df2 double, p double")


def group_ols(cube: Cube, formula: str = "~ 1", **options) -> Cube:
    return reduce(cube, "ols:voxelwise", formula, **options)


def one_sample(cube: Cube, where: str | None = None, **options) -> Cube:
    """OLS mean; ``where`` filters the subjects by a SQL expression, null counts as false."""
    if where:
        kept = cube.subjects.where(where).orderBy("ord").select("id").collect()
        cube = V.subset(cube, subject=[r.id for r in kept])
    return group_ols(cube, "~ 1", **options)


def two_sample(cube: Cube, group: str, baseline=None, level=None, **options) -> Cube:
    """OLS on a two-level attribute: the effect of ``level`` against ``baseline``."""
    levels = [baseline, level] if baseline is not None and level is not None else [r[0] for r in cube.subjects.select(group).distinct().orderBy(group).collect() if r[0] is not None]
    if baseline is not None and level is None:
        levels = [baseline, *(x for x in levels if x != baseline)]
    if len(levels) != 2:
        raise ValueError(f"{group} must have two levels")
    kept = cube.subjects.where(F.col(group).isin(levels)).orderBy("ord").select("id").collect()
    cube = V.subset(cube, subject=[r.id for r in kept]).with_(meta={**cube.meta, "levels": {**cube.meta.get("levels", {}), group: levels}})
    return group_ols(cube, f"~ {group}", **options)


def _add(name, fun, **more):
    reducers.register(name, Reducer(name, fun, **more), overwrite=True)


_VAR = {"requires": ("beta", "var"), "synthetic_variance": "forbid", "weight_mode": "inverse_variance"}
_add("meta:fe", meta_fe, **_VAR, estimands="intercept", deletion="closed_form", provides=("beta", "var", "se", "z", "Q", "I2", "n_eff", "p"))
_add("meta:re", meta_re, **_VAR, estimands="intercept", deletion="tau2_fixed_full", provides=("beta", "var", "se", "z", "Q", "I2", "tau2", "n_eff", "p"))
_add("meta:fe_reg", lambda c, d, **o: _regression(c, d, "fe", **o), **_VAR, uses_design=True, estimands="linear", deletion="hat_matrix")
_add("meta:re_reg", lambda c, d, **o: _regression(c, d, "re", **o), **_VAR, uses_design=True, estimands="linear", deletion="tau2_fixed_full")
_add("combine:stouffer", stouffer, requires=("z",), weight_mode="evidence", provides=("z", "n_eff", "p"))
_add("combine:fisher", fisher, requires=("p",), weight_mode="evidence", provides=("chi2", "df", "p", "n_eff"))
_add("combine:lancaster", lancaster, requires=("p",), weight_mode="evidence", provides=("chi2", "df", "p", "n_eff"))
_add("ttest:welch", welch, estimands="linear", provides=("beta", "var", "se", "t", "df", "n0", "n1", "z", "p"))
_add("ols:voxelwise", lambda c, d, **o: _regression(c, d, "ols", **o), uses_design=True, estimands="linear", deletion="hat_matrix")
_add("perm:onesample", P.one_sample, estimands="intercept", provides=("beta", "se", "t", "df", "p", "p_perm", "p_fwer"))
_add("perm:twosample", P.two_sample, estimands="linear", provides=("beta", "se", "t", "df", "p", "p_perm", "p_fwer"))
for _name, _slope, _known in (("lmm:ri", False, False), ("lmm:ri_slope1", True, False), ("lmm:ri_knownvar", False, True), ("lmm:ri_slope1_knownvar", True, True)):
    _add(_name, (lambda s, k: lambda c, d, **o: L.reduce_lmm(c, d, slope_model=s, known=k, **o))(_slope, _known), requires=("beta", "var") if _known else ("beta",), uses_design=True, estimands="linear", weight_mode="model_specific" if _known else "unweighted", synthetic_variance="forbid" if _known else "allow_effect_only")
