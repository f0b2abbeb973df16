"""Results and memory where an axis is long."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cubelark.functions import formula as M
from cubelark.functions import special as SP
from cubelark.operators import examine as E
from cubelark.operators import frames as N
from cubelark.operators import permute as P
from cubelark.operators import reduce as R
from cubelark.sources import tabular as T


def test_fisher_of_many_subjects(spark):
    """Beyond 700 subjects exp(-x / 2) is below the least double."""
    rng = np.random.default_rng(5)
    n = 2500
    p = np.stack([rng.uniform(size=n), rng.uniform(size=n) ** 1.04, rng.uniform(size=n) ** 2])
    rows = [(f"s{i}", f"u{j}", float(p[i, j])) for i in range(3) for j in range(n)]
    got = {r["sample"]: r.p for r in R.fisher(T.from_table(spark.createDataFrame(rows, "sample string, subject string, p double"), dedupe=False)).collect()}
    want = SP.chi2_sf(-2 * np.log(p).sum(1), 2.0 * n)
    assert 0.001 < want[0] < 0.999 and want[2] < 1e-12
    assert [got[f"s{i}"] for i in range(3)] == pytest.approx(want, rel=1e-8, abs=1e-12)


@pytest.fixture
def short_batches(spark):
    """Batches of 7 rows, so that no line of a cube lies in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def make(spark, y, var=None):
    """A cube of [sample, subject], two contrasts: the second is the first times 1 + sample / 10; NaN is no cell."""
    rows = [(f"s{i:02}", f"u{j:03}", c, float(y[i, j] * (1 + i * k / 10)), None if var is None else float(var[i, j])) for i in range(y.shape[0]) for j in range(y.shape[1]) for k, c in enumerate("ab") if np.isfinite(y[i, j])]
    return T.from_table(spark.createDataFrame(rows, "sample string, subject string, contrast string, beta double" + ", var double").drop(*([] if var is not None else ["var"])), dedupe=False)


def twenty():
    """A function of places for tasks; it fails if asked for more subjects than a batch may have."""

    def flips(places):
        if len(places) > 16:
            raise MemoryError("too many subjects at once")
        return np.where(np.bitwise_count((np.arange(5, 25)[:, None] * 37) & (np.asarray(places)[None] * 29 + 5)) % 2 == 0, 1.0, -1.0)

    return flips


def t_maps(y, mat):
    n = np.isfinite(y).sum(1)
    z = np.nan_to_num(y)
    return np.stack([P.t_of_sums(z @ m, (z * z).sum(1), n)[0] for m in mat])


def holed(rng, samples, subjects):
    y = rng.normal(0.3, 1, size=(samples, subjects))
    y[rng.uniform(size=y.shape) < 0.1] = np.nan
    return y


@pytest.mark.parametrize("spatial", ["cluster", "tfce"])
def test_spatial_null_takes_no_cells_to_the_driver(spark, short_batches, monkeypatch, spatial):
    y = holed(np.random.default_rng(3), 12, 40)
    y[2:5] += 1
    monkeypatch.setattr(P, "READ", 16)
    cube = make(spark, y)
    cube = cube.with_(samples=cube.samples.withColumn("i", F.col("ord")).withColumn("j", F.lit(0)).withColumn("k", F.lit(0)))
    got = R.reduce(cube, "perm:onesample", signs=twenty(), spatial=spatial, spatial_stat="t", cluster_threshold=1.0, most_cells=50).df.where("contrast = 'a'").toPandas().sort_values("sample")
    edges = np.stack([np.arange(11), np.arange(1, 12)], 1)

    def best(t):
        out = np.zeros(12)
        for side in (t, -t):
            if spatial == "tfce":
                out = np.maximum(out, P.tfce(side, edges))
                continue
            label = P.clusters(side, edges, 1.0)
            for c in range(1, label.max() + 1):
                out[label == c] = (side[label == c] - 1.0).sum()
        return out

    everyone = np.concatenate([twenty()(np.arange(a, min(a + 16, 40))) for a in range(0, 40, 16)], 1)
    null = np.array([best(t).max() for t in t_maps(y, everyone)])
    own = best(t_maps(y, np.ones((1, 40)))[0])
    assert got[f"p_{spatial}_fwer"].to_numpy() == pytest.approx(np.where(own > 0, (1 + (null[:, None] >= own - 1e-12).sum(0)) / 21, 1.0))


def test_places_of_subjects_are_made_in_tasks(spark, monkeypatch):
    """The same as a decomposition of the whole sketch; no table goes to the driver."""
    y = np.random.default_rng(8).normal(size=(15, 60)) * np.linspace(1, 3, 60)
    cube = make(spark, y, np.ones_like(y))
    loo = E.leave_one_out_fe(cube)
    with monkeypatch.context() as m:
        m.setattr(type(loo), "toPandas", lambda self: pytest.fail("a table went to the driver"))
        found = E.placed(loo, cube.subjects.select("ord", F.col("id").alias("subject")).union(spark.createDataFrame([(61, "none")], "ord int, subject string")))
        got = {r.subject: [r.d1, r.d2, r.d3] for r in found.collect()}
    rows = loo.select("subject", F.greatest(F.least("resid", F.lit(8.0)), F.lit(-8.0)).alias("r"), F.array(*[1 - 2 * F.pmod(F.xxhash64("sample", "contrast", F.lit(i)), F.lit(2)) for i in range(40)]).alias("s")).collect()
    names = [f"u{j:03}" for j in range(60)] + ["none"]
    m = np.zeros((61, 40))
    for r in rows:
        m[names.index(r.subject)] += r.r * np.array(r.s) / np.sqrt(40)
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    u = u[:, :3] * np.sign(u[np.abs(u[:, :3]).argmax(0), range(3)])
    assert np.array([got[x] for x in names]) == pytest.approx(u * s[:3], abs=1e-9)


def flat(df):
    """Whether a step sends plain rows to Python, which batches cut, and no row that holds a whole line."""
    return not any(isinstance(f.dataType, ArrayType) for f in df.schema)


@pytest.mark.parametrize("method", ["meta:re_reg", "meta:fe_reg", "ols:voxelwise"])
def test_deletion_reads_lines_in_pieces(spark, short_batches, method):
    """Lines that many batches carry, in stacks of one line, give what whole lines give."""
    rng = np.random.default_rng(4)
    cube = make(spark, holed(rng, 5, 30), rng.uniform(0.5, 2, size=(5, 30)))
    assert flat(R.blocks(cube, ["beta", "var"]))
    x = rng.normal(size=30)
    design = M.Design([f"u{j:03}" for j in range(30)], ["(Intercept)", "x"], np.column_stack([np.ones(30), x]))
    read = lambda: E.leave_one_out_linear(cube, design, method).toPandas().sort_values(["sample", "contrast", "subject"], ignore_index=True)
    pieces = read()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    whole = read()
    assert len(pieces) == 300
    pd.testing.assert_frame_equal(pieces, whole)


@pytest.mark.parametrize("name", ["perm:twosample", "perm:onesample"])
def test_permutations_by_a_function_of_places(spark, short_batches, monkeypatch, name):
    """A function asked for pieces gives what the whole matrix gives, and the driver has no matrix."""
    monkeypatch.setattr(P, "READ", 16)
    cube = make(spark, holed(np.random.default_rng(6), 6, 40))
    cube = cube.with_(subjects=cube.subjects.withColumn("group", F.col("ord") % 2))
    of = twenty()
    if name == "perm:onesample":
        key, given = "signs", of
    else:
        key, given = "group_mat", lambda places: (of(places) + 1) / 2
    everyone = np.concatenate([given(np.arange(a, min(a + 16, 40))) for a in range(0, 40, 16)], 1)
    read = lambda null: R.reduce(cube, name, **{key: null}).df.toPandas().sort_values(["sample", "contrast"], ignore_index=True)
    pd.testing.assert_frame_equal(read(given), read(everyone))


def test_frame_fits_read_features_in_pieces(spark, short_batches):
    """One feature after another from rows that batches cut, the same as whole features."""
    rng = np.random.default_rng(9)
    rows = [(f"o{j:02}", f"f{i}", float(rng.normal() + j % 3), float(rng.uniform(0.1, 0.4))) for i in range(3) for j in range(30)]
    frame = spark.createDataFrame(rows, "observation string, feature string, beta double, variance double")
    who = spark.createDataFrame([(f"o{j:02}", j / 10, j % 3) for j in range(30)], "observation string, x double, area int")
    read = lambda: N.fit_group(frame, who, "~ x", group="area").rows.toPandas().sort_values(["feature", "result_type", "term"], ignore_index=True)
    pieces = read()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert len(pieces) == 12 and pieces.n_obs.eq(30).all()
    pd.testing.assert_frame_equal(pieces, read())
    assert "collect_list" not in N.fit_group(frame, who, "~ x", group="area").rows._jdf.queryExecution().toString()


def test_mixed_models_read_lines_in_pieces(spark, short_batches):
    rng = np.random.default_rng(2)
    cube = make(spark, rng.normal(size=(3, 20)), rng.uniform(0.2, 0.5, size=(3, 20)))
    assert flat(R.blocks(cube, ["beta", "var"], ["sample"]))
    read = lambda: R.reduce(cube, "lmm:ri_knownvar", "~ 1").df.toPandas().sort_values("sample", ignore_index=True)
    pieces = read()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert len(pieces) == 3 and pieces["coef:(Intercept)"].notna().all()
    pd.testing.assert_frame_equal(pieces, read())
