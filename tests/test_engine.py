"""Verbs, reducers, corrections, examination, sources, plans: hand-computed cells, plain NumPy, round trips, failures."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelark.cube import Cube, Space
from cubelark.functions import formula as M
from cubelark.functions import special as S
from cubelark.operators import catalog as G
from cubelark.operators import examine as E
from cubelark.operators import export, lmm, maps, permute
from cubelark.operators import posthoc as H
from cubelark.operators import reduce as R
from cubelark.operators import verbs as V
from cubelark.plans import cli
from cubelark.plans import plan as P
from cubelark.sources import nifti
from cubelark.sources import tabular as T
from cubelark.streaming import incremental as I

LONG = "sample string, subject string, contrast string, beta double, var double"


def make(spark, beta, var=None) -> Cube:
    """A cube of arrays [sample, subject] or [sample, subject, contrast]; NaN is no value."""
    beta = np.asarray(beta, float)
    beta = beta[:, :, None] if beta.ndim == 2 else beta
    var = np.ones_like(beta) if var is None else np.asarray(var, float).reshape(beta.shape)
    val = lambda v: None if np.isnan(v) else float(v)
    rows = [(f"s{i}", f"u{j}", f"c{k}", val(beta[i, j, k]), val(var[i, j, k])) for i in range(beta.shape[0]) for j in range(beta.shape[1]) for k in range(beta.shape[2])]
    return T.from_table(spark.createDataFrame(rows, LONG), dedupe=False)


def table(df, *columns):
    return {r.sample: tuple(r[c] for c in columns) for r in df.collect()}


# --- sources


def test_tabular_coercion_first_wins_and_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("roi,subj,effect,var,at\n01,b,1.5,2,1\n01,a,junk,2,2\n01,b,9,2,3\n02,a,inf,1,4\n")
    cube = T.cube(spark, str(tmp_path / "t.csv"), sample="roi", subject="subj", assays={"beta": "effect", "var": "var"}, order="at")
    rows = {(r.sample, r.subject): r.beta for r in cube.df.collect()}
    assert rows == {("01", "b"): 1.5, ("01", "a"): None, ("02", "a"): None}
    assert cube.ids("subject") == ["b", "a"] and cube.ids("contrast") == ["all"]
    assert T.duplicates(spark.createDataFrame([("a", "b", "c"), ("a", "b", "c")], "sample string, subject string, contrast string")).count() == 1


def test_lift_constant_refuses_mixed_values(spark):
    good = spark.createDataFrame([("c1", 1), ("c1", 1), ("c2", None)], "contrast string, time int")
    assert T.lift_constant(good, "contrast", ["time"]).count() == 2
    for bad in ([("c1", 1), ("c1", 2)], [("c1", 1), ("c1", None)]):
        with pytest.raises(ValueError):
            T.lift_constant(spark.createDataFrame(bad, "contrast string, time int"), "contrast", ["time"])


def test_temporal_policies(spark):
    rows = spark.createDataFrame([("p", t, float(t), 1.0) for t in range(3)] + [("q", 0, 1.0, 1.0), ("q", 1, None, 1.0), ("q", 2, 1.0, 1.0)], "parcel string, t int, value double, v double")
    w = spark.createDataFrame([(0, "up", -1.0), (1, "up", 0.0), (2, "up", 1.0), (0, "all", 1.0), (1, "all", 1.0), (2, "all", 1.0)], "t int, contrast string, c double")
    got = {(r.parcel, r.contrast): (r.beta, r["var"]) for r in T.temporal_design(rows, ["parcel"], w, variance="v").collect()}
    assert got == {("p", "up"): (2.0, 2.0), ("p", "all"): (3.0, 3.0), ("q", "up"): (0.0, 2.0), ("q", "all"): (None, 3.0)}
    assert {r.parcel: r.beta for r in T.temporal_mean(rows, ["parcel"]).collect()} == {"p": 1.0, "q": 1.0}


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    affine = np.diag([2.0, 2, 3, 1])
    data = {s: rng.normal(size=(2, 3, 2)) for s in ("sub-01", "sub-02")}
    for s, v in data.items():
        raw = nifti.build(v, affine)
        (tmp_path / f"{s}_beta.nii.gz").write_bytes(gzip.compress(raw))
        (tmp_path / f"{s}_se.nii").write_bytes(nifti.build(np.abs(v), affine))
    cube = nifti.cube_from_images(spark, {"beta": [f"{tmp_path}/*_beta.nii.gz"], "se": [f"{tmp_path}/*_se.nii"]})
    assert cube.space.dims == (2, 3, 2) and cube.ids("subject") == ["sub-01", "sub-02"]
    for r in cube.df.collect():
        i, j, k = np.unravel_index(int(r.sample), (2, 3, 2), order="F")
        assert r.beta == data[r.subject][i, j, k] and r.se == abs(r.beta)
    manifest = export.write_images(cube, str(tmp_path / "out"), ["beta"]).collect()
    assert all(r.written for r in manifest) and len(manifest) == 2
    shape, back, values = nifti.parse(open(manifest[0].path, "rb").read())
    assert shape == (2, 3, 2) and np.allclose(back, affine) and np.allclose(values.reshape(shape, order="F"), data[manifest[0].subject])
    assert not any(r.written for r in export.write_images(cube, str(tmp_path / "out"), ["beta"]).collect())
    for bad in (b"", b"x" * 400):
        with pytest.raises(ValueError):
            nifti.parse(bad)


def test_subject_keys():
    assert nifti.subject_key("/a/b/sub-07_task-x_beta.nii.gz") == "sub-07"
    assert nifti.subject_key("anna_cope_se.nii") == "anna" and nifti.subject_key("b.ob-var.nii.gz") == "b.ob"


# --- verbs


def test_subset_order_repeats_and_errors(spark):
    cube = make(spark, [[1, 2], [3, 4], [5, 6]])
    got = V.subset(cube, sample=[3, 1, 3])
    assert got.ids("sample") == ["s2", "s0", "s2.1"] and got.df.count() == 6
    assert V.subset(cube, subject=[False, True]).ids("subject") == ["u1"]
    for bad in ({"sample": ["nope"]}, {"sample": [4]}, {"sample": [0]}, {"subject": [True]}):
        with pytest.raises(ValueError):
            V.subset(cube, **bad)
    assert V.preview(cube, 2).df.count() == 4


def test_derive_and_its_errors(spark):
    cube = make(spark, [[2.0, -3.0]], [[4.0, 9.0]])
    got = table(V.derive(cube, ["se", "t"]).df, "se", "t")
    assert got["s0"] in ((2.0, 1.0), (3.0, -1.0))
    assert "var" in V.derive(cube, "var").assays
    with pytest.raises(ValueError):
        V.derive(cube, "z")
    with pytest.raises(ValueError):
        V.derive(cube, "F")
    t = cube.with_df(cube.df.select("sample", "subject", "contrast", F.lit(-40.0).alias("t"), F.lit(5.0).alias("df")))
    z = [r.z for r in V.derive(t, "z").df.collect()]
    assert all(v == pytest.approx(float(S.t_to_z(-40.0, 5.0))) for v in z)


def test_masks(spark):
    b = np.array([[1.0, 2], [1, np.nan], [np.nan, np.nan]])
    cube = make(spark, b)
    kept = lambda *p: sorted({r.id for r in V.mask(cube, *p).samples.collect()})
    assert kept(V.MaskPolicy(rule="intersection")) == ["s0"]
    assert kept(V.MaskPolicy(rule="union")) == ["s0", "s1"]
    assert kept(V.MaskPolicy(rule="threshold", threshold=0.5)) == ["s0", "s1"]
    assert kept(V.MaskPolicy("subject", "union")) == ["s0"]
    assert kept(V.MaskPolicy(rule="union"), V.MaskPolicy(rule="intersection")) == ["s0"]
    with pytest.raises(ValueError, match="no sample"):
        V.mask(cube, V.MaskPolicy(rule="custom", custom=lambda df: df.where("beta > 10")))
    with pytest.raises(ValueError):
        V.MaskPolicy(rule="some")


def test_axis_data_relabel_and_split(spark):
    cube = make(spark, [[1, 2, 3.0]])
    data = spark.createDataFrame([("u0", "x"), ("u1", "y"), ("u2", "x"), ("u9", "x")], "who string, grp string")
    with_data = V.with_axis_data(cube, "subject", data, "who")
    assert {k: v.ids("subject") for k, v in V.split(with_data, "grp").items()} == {"x": ["u0", "u2"], "y": ["u1"]}
    with pytest.raises(ValueError, match="u0"):
        V.with_axis_data(cube, "subject", data.where("who <> 'u0'"), "who")
    with pytest.raises(ValueError, match="repeats"):
        V.with_axis_data(cube, "subject", data.union(data), "who")
    with pytest.raises(ValueError, match="unique"):
        V.relabel(cube, "subject", spark.createDataFrame([("u0", "u1")], "old string, new string"))


# --- maps


def test_map_weights_variance_df_and_nulls(spark):
    cube = make(spark, [[1.0, 2.0], [3.0, np.nan]], [[4.0, 1.0], [2.0, 1.0]])
    cube = cube.with_df(cube.df.withColumn("df", F.lit(10.0)))
    edges = spark.createDataFrame([("t", "s0", 0.6), ("t", "s1", 0.8), ("u", "s0", 1.0), ("u", "s1", 0.0)], "target string, source string, w double")
    got = {(r.sample, r.subject): r for r in maps.map_to(cube, edges).df.collect()}
    assert got["t", "u0"].beta == pytest.approx(3.0) and got["t", "u0"]["var"] == pytest.approx(2.72)
    a, b = 0.36 * 4, 0.64 * 2
    assert got["t", "u0"].df == pytest.approx((a + b) ** 2 / (a * a / 10 + b * b / 10))
    assert got["t", "u1"].beta is None and got["u", "u1"].beta == 2.0
    r = spark.createDataFrame([("s0", "s1", 0.5)], "source_a string, source_b string, r double")
    cov = {(x.sample, x.subject): x["var"] for x in maps.map_to(cube, edges, maps.UncertaintyRule("cov_provider", correlations=r)).df.collect()}
    assert cov["t", "u0"] == pytest.approx(2.72 + 2 * 0.5 * 0.6 * 2 * 0.8 * math.sqrt(2))
    with pytest.raises(ValueError):
        maps.map_to(cube, edges, maps.UncertaintyRule("kernel"))
    with pytest.raises(ValueError):
        maps.map_to(cube, edges.withColumn("subject", F.lit("u0")))


# --- reducers


def test_meta_fe_re_match_numpy_with_floor_and_gaps(spark):
    rng = np.random.default_rng(1)
    beta, var = rng.normal(size=(12, 7)), rng.uniform(0.1, 3, size=(12, 7))
    beta[0, :6] = np.nan
    beta[1, 2] = np.nan
    var[2, :] = [1e-20, 1e-12, 0, -1, 2, 1, 1]
    cube = make(spark, beta, var)
    fe, re = (table(R.reduce(cube, m).df, "beta", "var", "z", "p", "Q", "I2", "n_eff") for m in ("fixed", "random"))
    for i in range(12):
        ok = np.isfinite(beta[i]) & (var[i] > 0)
        y, v = beta[i][ok], np.maximum(var[i][ok], 1e-12)
        assert fe[f"s{i}"][6] == ok.sum()
        if ok.sum() < 2:
            assert fe[f"s{i}"][:6] == (None,) * 6
            continue
        w = 1 / v
        mu = (w * y).sum() / w.sum()
        q = (w * (y - mu) ** 2).sum()
        assert fe[f"s{i}"][:5] == pytest.approx((mu, 1 / w.sum(), mu * w.sum() ** 0.5, S.tail_p(mu * w.sum() ** 0.5), q), rel=1e-9)
        tau2 = max(0, (q - (len(y) - 1)) / (w.sum() - (w**2).sum() / w.sum()))
        u = 1 / (v + tau2)
        assert re[f"s{i}"][0] == pytest.approx((u * y).sum() / u.sum(), rel=1e-9) and re[f"s{i}"][4] == pytest.approx(q)


def test_evidence_combination(spark):
    p = np.array([[0.01, 0.2, 0.5], [1e-320, 1.0, 0.3]])
    cube = make(spark, p)
    cube = cube.with_df(cube.df.withColumnRenamed("beta", "p").drop("var"))
    f = table(R.reduce(cube, "fisher").df, "chi2", "df", "p")
    assert f["s0"] == pytest.approx((-2 * np.log(p[0]).sum(), 6, float(S.chi2_sf(-2 * np.log(p[0]).sum(), 6))), rel=1e-9)
    assert math.isfinite(f["s1"][0])
    lan = table(R.reduce(cube, "lancaster").df, "chi2", "df", "p")
    assert lan["s0"] == pytest.approx(f["s0"], rel=1e-6)  # w = 1 is Fisher's method
    z = cube.with_df(cube.df.withColumnRenamed("p", "z"))
    w = spark.createDataFrame([("u0", 1.0), ("u1", 2.0), ("u2", 0.5)], "subject string, w double")
    got = table(R.reduce(z, "stouffer", weights=w).df, "z")
    assert got["s0"][0] == pytest.approx((p[0] @ [1, 2, 0.5]) / math.sqrt(5.25))
    with pytest.raises(ValueError):
        R.reduce(cube, "fisher", weights=w)


def test_regressions_match_numpy(spark):
    rng = np.random.default_rng(3)
    age = rng.normal(size=9)
    y = rng.normal(size=(5, 9)) + 2 * age
    v = rng.uniform(0.5, 2, size=(5, 9))
    y[1, :2] = np.nan
    y[2, :7] = np.nan
    cube = make(spark, y, v)
    cov = spark.createDataFrame([(f"u{i}", float(a), "p" if i % 2 else "c") for i, a in enumerate(age)], "who string, age double, grp string")
    cube = V.with_axis_data(cube, "subject", cov, "who")
    ols = R.reduce(cube, "ols:voxelwise", "~ age + grp", return_cov="tri")
    fe = table(R.reduce(cube, "meta:fe_reg", "~ age").df, "coef:age", "se_coef:age", "Q")
    got = table(ols.df, "coef:age", "se_coef:age", "p_coef:grpp", "n_obs", "df_res")
    x = np.column_stack([np.ones(9), age, np.arange(9) % 2])
    for i in range(5):
        ok = np.isfinite(y[i])
        assert got[f"s{i}"][3] == ok.sum()
        if ok.sum() < 4:
            assert got[f"s{i}"][:3] == (None, None, None)
            continue
        b, *_ = np.linalg.lstsq(x[ok], y[i][ok], rcond=None)
        s2 = ((y[i][ok] - x[ok] @ b) ** 2).sum() / (ok.sum() - 3)
        se = np.sqrt(s2 * np.diag(np.linalg.inv(x[ok].T @ x[ok])))
        assert got[f"s{i}"][:2] == pytest.approx((b[1], se[1]), rel=1e-8)
        assert got[f"s{i}"][2] == pytest.approx(float(S.t_two_sided(b[2] / se[2], ok.sum() - 3)), rel=1e-8)
        w = 1 / v[i][ok]
        a = np.linalg.inv((x[ok, :2].T * w) @ x[ok, :2])
        c = a @ ((x[ok, :2].T * w) @ y[i][ok])
        assert fe[f"s{i}"] == pytest.approx((c[1], a[1, 1] ** 0.5, (w * (y[i][ok] - x[ok, :2] @ c) ** 2).sum()), rel=1e-8)
    est = table(R.coef_contrast(ols, {"age": 1.0, "grpp": -1.0}), "estimate", "p")
    assert est["s0"][0] == pytest.approx(table(ols.df, "coef:age")["s0"][0] - table(ols.df, "coef:grpp")["s0"][0])
    joint = table(R.joint_test(ols, [{"age": 1.0}]), "F")
    assert joint["s0"][0] == pytest.approx(table(ols.df, "t_coef:age")["s0"][0] ** 2)
    with pytest.raises(ValueError):
        R.coef_contrast(ols, {"height": 1.0})


def test_meta_regression_tau2_matches_formula(spark):
    rng = np.random.default_rng(8)
    y, v, g = rng.normal(size=6) * 2, rng.uniform(0.1, 0.4, 6), np.array([0, 0, 0, 1, 1, 1.0])
    cube = make(spark, y[None], v[None])
    cube = V.with_axis_data(cube, "subject", spark.createDataFrame([(f"u{i}", float(x)) for i, x in enumerate(g)], "who string, g double"), "who")
    got = table(R.reduce(cube, "meta:re_reg", "~ g").df, "tau2", "coef:g")["s0"]
    x, w = np.column_stack([np.ones(6), g]), np.diag(1 / v)
    p = w - w @ x @ np.linalg.inv(x.T @ w @ x) @ x.T @ w
    tau2 = max(0, (y @ p @ y - 4) / np.trace(p))
    u = np.diag(1 / (v + tau2))
    assert got == pytest.approx((tau2, np.linalg.solve(x.T @ u @ x, x.T @ u @ y)[1]))


def test_reduce_contract(spark):
    cube = make(spark, [[1.0, 2.0]])
    for bad in (lambda: R.reduce(cube, "nothing"), lambda: R.reduce(cube, "meta:fe", formula="~ x"), lambda: R.reduce(cube, "meta:fe", weights=1), lambda: R.reduce(cube.with_(meta={"synthetic_variance": True}), "meta:fe")):
        with pytest.raises((KeyError, ValueError)):
            bad()
    out = R.reduce(cube, "meta:fe")
    assert out.ids("subject") == ["meta"]


def test_permutation_counts(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(6, 8)) + 0.4
    y[3, 1] = np.nan
    signs = permute.drawn_signs(99, [f"u{i}" for i in range(8)], 4)
    got = table(R.reduce(make(spark, y), "perm:onesample", signs=signs).df, "t", "p_perm", "p_fwer")

    def t(row):
        ok = np.isfinite(row)
        return row[ok].mean() / (row[ok].std(ddof=1) / math.sqrt(ok.sum()))

    observed = np.array([t(r) for r in y])
    null = np.array([[t(r * s) for r in y] for s in signs])
    for i in range(6):
        assert got[f"s{i}"] == pytest.approx((observed[i], (1 + (np.abs(null[:, i]) >= abs(observed[i]) - 1e-12).sum()) / 100, (1 + (np.abs(null).max(1) >= abs(observed[i]) - 1e-12).sum()) / 100))
    assert np.array_equal(signs, permute.drawn_signs(99, [f"u{i}" for i in range(8)], 4))


def test_clusters_and_tfce_by_hand():
    coords = np.array([[i, 0, 0] for i in range(6)])
    near = permute.neighbours(coords)
    x = np.array([2.0, 3.0, 0.0, 2.5, 0.5, 0.0])
    assert permute.clusters(x, near, 1.0).tolist() == [1, 1, 0, 2, 0, 0]
    want = np.zeros(6)
    for i in range(1, 7):
        h = i * 0.5
        label = permute.clusters(x, near, h - 1e-12)
        for c in set(label) - {0}:
            want[label == c] += (label == c).sum() ** 0.5 * h**2 * 0.5
    assert permute.tfce(x, near, dh=0.5) == pytest.approx(want)
    rng = np.random.default_rng(2)
    cube = np.array([[i, j, k] for i in range(4) for j in range(4) for k in range(3)])
    near = permute.neighbours(cube, 26)
    x = rng.normal(size=len(cube)) * 2
    want = np.zeros(len(x))
    for i in range(1, int(np.floor(x.max() / 0.1 + 1e-10)) + 1):
        label = permute.clusters(x, near, i * 0.1 - 1e-9)
        for c in set(label) - {0}:
            want[label == c] += (label == c).sum() ** 0.5 * min(i * 0.1, x.max()) ** 2 * 0.1
    assert permute.tfce(x, near) == pytest.approx(want)


def test_cluster_table_by_mass_with_world_coordinates(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=(24, 12)) * 0.5
    y[2:6] += 3
    y[15:17] -= 4
    cube = make(spark, y)
    n = F.substring("id", 2, 3).cast("int")
    affine = ((2.0, 0, 0, 10), (0, 3.0, 0, 20), (0, 0, 4.0, 30), (0, 0, 0, 1))
    cube = cube.with_(samples=cube.samples.withColumn("i", n).withColumn("j", F.lit(1)).withColumn("k", F.lit(2)), space=Space("voxel", (24, 2, 3), affine))
    out = R.reduce(cube, "perm:onesample", n_perm=40, seed=1, spatial="cluster", cluster_threshold=3.0)
    rows = out.attachments["reduce/perm:onesample/clusters"].orderBy("cluster_id").collect()
    assert [r.mass for r in rows] == sorted((r.mass for r in rows), reverse=True) and {r.sign for r in rows[:2]} == {1, -1}
    ids = {r["sample"]: r.cluster_id for r in out.df.collect()}
    assert len({ids[f"s{i}"] for i in range(2, 6)}) == 1 and ids["s2"] != ids["s15"] == ids["s16"] and ids["s0"] == 0
    assert all((r.x, r.y, r.z) == (10 + 2 * r.i, 23, 38) for r in rows)
    assert {(r.x, r.i) for r in V.world(cube).collect()} == {(10.0 + 2 * i, i) for i in range(24)}
    flat = spark.range(12).select(*[c.alias(n) for n, c in zip("ijk", V.grid_index("id", (2, 3, 2)))]).collect()
    assert [tuple(r) for r in flat] == [tuple(int(x) for x in np.unravel_index(v, (2, 3, 2), order="F")) for v in range(12)]


def test_small_registries(spark):
    from cubelark import registry

    assert ("beta", "location") in registry.list_assays(reducer_name="fixed") and registry.list_assays(make(spark, [[1.0]]))
    edges = spark.createDataFrame([("t", "s0", 1.0), ("t", "s1", 1.0)], "target string, source string, w double")
    maps.register_map(maps.transport_family("ot1", edges), overwrite=True)
    assert "ot1" in maps.list_map_families() and maps.get_map_family("ot1").mass_preserving and maps.get_map_family("none") is None
    cube = make(spark, [[1.0, 2.0], [3.0, 4.0]], [[1.0, 1.0], [1.0, 1.0]])
    assert table(maps.align(cube, "ot1").df, "beta")["t"][0] in (4.0, 6.0)
    warp = maps.warp_family(spark, "w", {"u0": "x", "u1": "y"}, lambda path: [("t", "s0", 1.0 if path == "x" else 2.0)])
    assert {r.subject: r.beta for r in maps.align(cube, warp).df.collect()} == {"u0": 1.0, "u1": 4.0}
    with pytest.raises(ValueError):
        V.use_weight(cube, "no")
    loo = E.leave_one_out_fe(make(spark, np.arange(12.0).reshape(4, 3) ** 1.5, np.ones((4, 3))))
    labels = spark.createDataFrame([("s0", "a"), ("s1", "a"), ("s2", "b"), ("s3", None)], "sample string, label string")
    got = E.ranked_regions(loo, labels, "u2", "c0", 5).collect()
    own = {r["sample"]: r for r in loo.collect() if r.subject == "u2"}
    want = {"a": np.mean([abs(own["s0"].resid), abs(own["s1"].resid)]), "b": abs(own["s2"].resid)}
    assert {r.label: r.mean_abs_residual for r in got} == {k: pytest.approx(v) for k, v in want.items()} and got[0].label == "b"


def test_the_observed_labelling_is_no_null_value(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(size=(4, 8)) + 0.5
    cube = make(spark, y)
    drawn = permute.drawn_signs(19, [f"u{i}" for i in range(8)], 2)
    p = lambda **o: {k: v[0] for k, v in table(R.reduce(cube, "perm:onesample", **o).df, "p_perm").items()}
    assert p(signs=np.vstack([np.ones(8), drawn])) == p(signs=drawn)
    assert p(n_perm=19, seed=2, include_observed=True) == p(signs=permute.drawn_signs(19, [f"u{i}" for i in range(8)], 2)[1:])
    own = np.array([0.0, 1] * 4)
    two = cube.with_(subjects=cube.subjects.withColumn("group", (F.col("ord") + 1) % 2))
    mats = permute.drawn_groups(19, own, 1)
    q = lambda mat: {k: v[0] for k, v in table(R.reduce(two, "perm:twosample", group_mat=mat).df, "p_perm").items()}
    assert q(np.vstack([own, mats])) == q(mats) and all(round(v * 20, 6) == round(v * 20) for v in q(mats).values())


def test_frame_fits(spark):
    from cubelark.operators import frames

    rng = np.random.default_rng(3)
    n = 24
    a, groups = rng.normal(size=n), np.repeat(np.arange(6), 4)
    y = 1 + 2 * a + rng.normal(size=6)[groups] + rng.normal(size=n) * 0.3
    v = np.full(n, 0.05)
    frame = spark.createDataFrame([(f"o{i}", f, float(y[i] * (1 if f == "p" else -1)), float(v[i])) for i in range(n) for f in ("p", "q")] + [("o1", "few", 1.0, 1.0)], "observation string, feature string, beta double, variance double")
    axis = spark.createDataFrame([(f"o{i}", float(a[i]), int(groups[i])) for i in range(n)], "observation string, a double, g int")
    x = np.stack([np.ones(n), a], 1)
    got = {(r.feature, r.term): r for r in frames.fit_group(frame, axis, "~ a", method="ols:voxelwise").result_frame().collect()}
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = ((y - x @ b) ** 2).sum() / (n - 2)
    assert got["p", "a"].estimate == pytest.approx(b[1]) and got["p", "a"].std_error == pytest.approx(np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])) and got["few", "a"].estimate is None

    def value(tau2, sigma2):
        m = np.diag(v + sigma2) + tau2 * (groups[:, None] == groups)
        inv = np.linalg.inv(m)
        info = x.T @ inv @ x
        r = y - x @ np.linalg.solve(info, x.T @ inv @ y)
        return np.linalg.slogdet(m)[1] + r @ inv @ r + np.linalg.slogdet(info)[1]

    fit = frames.fit_group(frame, axis, "~ a", group="g")
    got = {(r.feature, r.term): r for r in fit.result_frame().collect()}
    tau2, sigma2 = got["p", "random_intercept"].estimate, got["p", "residual"].estimate
    best = value(tau2, sigma2)
    assert all(best <= value(tau2 * s, sigma2 * t) + 1e-6 for s in (0.9, 1, 1.1) for t in (0.9, 1, 1.1))
    assert {r.feature: r.log_likelihood for r in fit.diagnostics().collect()}["p"] == pytest.approx(-best / 2)
    assert got["q", "a"].estimate == pytest.approx(-got["p", "a"].estimate, rel=1e-4) and got["few", "residual"].estimate is None
    for bad in ({"group": "h"}, {"memory_budget": 10, "group": "g"}, {"method": "meta:fe"}, {"estimate": "no", "group": "g"}):
        with pytest.raises((ValueError, KeyError)):
            frames.fit_group(frame, axis, "~ a", **bad)


def test_mixed_model_equals_balanced_anova(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=(2, 10, 1)) * 1.5 + rng.normal(size=(2, 10, 4)) + 3
    got = table(R.reduce(make(spark, y, np.ones_like(y)), "lmm:ri").df, "coef:(Intercept)", "sigma2", "vc_intercept", "df_coef:(Intercept)")
    for i in range(2):
        m = y[i].mean(1)
        within = ((y[i] - m[:, None]) ** 2).sum() / 30
        assert got[f"s{i}"] == pytest.approx((m.mean(), within, (m.var(ddof=1) * 4 - within) / 4, 9), rel=1e-4)
    pooled = table(R.reduce(make(spark, y, np.ones_like(y)), "lmm:ri", theta_mode="pooled").df, "coef:(Intercept)")
    assert pooled["s0"][0] == pytest.approx(y[0].mean())


def test_known_variance_model_recovers_generalised_least_squares():
    rng = np.random.default_rng(9)
    n, k = 12, 3
    known = rng.uniform(0.2, 2, n * k)
    y = np.repeat(rng.normal(size=n) * 1.2, k) + rng.normal(size=n * k) * np.sqrt(known + 0.3) + 1
    x = np.ones((n * k, 1))
    f = lmm.fit(y, x, k, known=known)
    blocks = known.reshape(n, k)[:, :, None] * np.eye(k) + f["sigma2"] * np.eye(k) + f["g"][0, 0]
    inv = np.linalg.inv(blocks)
    assert f["coef"][0] == pytest.approx((inv @ y.reshape(n, k, 1)).sum() / inv.sum())
    for scale in (0.9, 1.1):
        other = known.reshape(n, k)[:, :, None] * np.eye(k) + f["sigma2"] * np.eye(k) + f["g"][0, 0] * scale
        assert lmm._profile(blocks, x, y, True, True)[0] <= lmm._profile(other, x, y, True, True)[0] + 1e-9
    assert lmm.between_within_df(np.column_stack([np.ones(36), np.repeat(np.arange(12), 3), np.tile([0, 1, 2], 12)]), 3) == [10, 10, 33]


# --- corrections


def bh(p, by=False):
    ok = np.isfinite(p)
    q = np.full(len(p), np.nan)
    m = ok.sum()
    order = np.argsort(p[ok], kind="stable")
    s = p[ok][order] * m / np.arange(1, m + 1) * ((1 / np.arange(1, m + 1)).sum() if by else 1)
    r = np.empty(m)
    r[order] = np.minimum(1, np.minimum.accumulate(s[::-1])[::-1])
    q[ok] = r
    return q


@pytest.mark.parametrize("partitions", [None, 5])
def test_step_up_matches_plain_with_ties_and_nulls(spark, partitions):
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(size=(60, 2)) ** 2, 2)
    p[3, 0] = np.nan
    cube = make(spark, p)
    cube = cube.with_df(cube.df.withColumnRenamed("beta", "p").drop("var"))
    for method, by in (("fdr:bh", False), ("fdr:by", True)):
        got = {(r.sample, r.subject): r.q for r in H.posthoc(cube, method, partitions=partitions).df.collect()}
        for j in range(2):
            q = bh(p[:, j], by)
            for i in range(60):
                assert got[f"s{i}", f"u{j}"] == (None if np.isnan(q[i]) else pytest.approx(q[i]))


def test_group_corrections(spark):
    p = np.array([[0.001], [0.9], [0.02], [0.04], [np.nan], [0.3]])
    cube = make(spark, p)
    cube = cube.with_df(cube.df.withColumnRenamed("beta", "p").drop("var"))
    groups = ["a", "a", "b", "b", "b", None]
    cube = cube.with_(samples=cube.samples.join(spark.createDataFrame([(f"s{i}", g) for i, g in enumerate(groups)], "id string, parcel string"), "id"))
    q = table(H.posthoc(cube, "fdr:spatial").df, "q")
    simes, w = {"a": 0.002, "b": 0.04}, {"a": 2 / 2.5, "b": 3 / 2.5}
    pw = {g: simes[g] / w[g] for g in simes}
    qb = pw["b"] * 2 / 2
    assert q["s2"][0] == pytest.approx(qb) and q["s0"][0] == pytest.approx(min(qb, pw["a"] * 2)) and q["s5"][0] is None and q["s4"][0] == q["s2"][0]
    s = table(H.posthoc(cube, "fdr:sabha").df, "pi0", "weight", "q")
    assert s["s0"][0] == pytest.approx(1.0) and s["s2"][0] == pytest.approx(0.05)
    assert H.efron_null(np.random.default_rng(1).normal(0.3, 1.4, 20000)) == pytest.approx((0.3, 1.4), abs=0.08)


# --- examination


def test_leave_one_out_is_a_refit(spark):
    rng = np.random.default_rng(6)
    y, v = rng.normal(size=(4, 6)), rng.uniform(0.2, 2, (4, 6))
    cube = make(spark, y, v)
    full = table(R.reduce(cube, "meta:fe").df, "z")
    loo = {(r.sample, r.subject): r for r in E.leave_one_out_fe(cube).collect()}
    for j in range(6):
        rest = [f"u{k}" for k in range(6) if k != j]
        refit = table(R.reduce(V.subset(cube, subject=rest), "meta:fe").df, "beta", "z") if j in (0, 3) else None
        if refit:
            for i in range(4):
                r = loo[f"s{i}", f"u{j}"]
                assert r.expected == pytest.approx(refit[f"s{i}"][0]) and r.delta_stat == pytest.approx(full[f"s{i}"][0] - refit[f"s{i}"][1])
    exact = {(r.sample, r.subject): r.tau2_without for r in E.leave_one_out_re(cube, exact=True).collect()}
    refit = table(R.reduce(V.subset(cube, subject=["u1", "u2", "u3", "u4", "u5"]), "meta:re").df, "tau2")
    assert all(exact[f"s{i}", "u0"] == pytest.approx(refit[f"s{i}"][0], abs=1e-9) for i in range(4))
    d = M.design([{"id": f"u{i}", "a": float(i * i)} for i in range(6)], "id", "~ a")
    x = d.matrix
    rows = {(r.sample, r.subject): r for r in E.leave_one_out_linear(cube, d).collect()}
    b = np.linalg.lstsq(x, y[0], rcond=None)[0]
    less = np.linalg.lstsq(np.delete(x, 2, 0), np.delete(y[0], 2), rcond=None)[0]
    assert rows["s0", "u2"]["delta_effect:a"] == pytest.approx(b[1] - less[1])
    kept = np.delete(x, 2, 0)
    for method, stat in (("ols:voxelwise", "t_coef:a"), ("meta:fe_reg", "z_coef:a")):
        own = {(r.sample, r.subject): r for r in E.leave_one_out_linear(cube, d, method).collect()}
        without = V.subset(cube, subject=[f"u{k}" for k in range(6) if k != 2])
        part = M.Design([f"u{k}" for k in range(6) if k != 2], d.terms, kept)
        fits = [table(R.reduce(c, method, design=m).df, stat) for c, m in ((cube, d), (without, part))]
        for i in range(4):
            got = own[f"s{i}", "u2"]
            assert got["deleted_stat:a"] == pytest.approx(fits[1][f"s{i}"][0]) and got["delta_stat:a"] == pytest.approx(fits[0][f"s{i}"][0] - fits[1][f"s{i}"][0])
    holes = cube.with_df(cube.df.where("not (sample = 's1' and subject = 'u4')"))
    zero = [r for r in E.leave_one_out_linear(holes, d).collect() if (r.sample, r.subject) == ("s1", "u4")]
    assert len(zero) == 1 and zero[0].resid is None and zero[0]["delta_stat:a"] == 0
    tables = E.examine_group(cube.with_(subjects=cube.subjects.withColumn("a", F.col("ord").cast("double"))), "meta:fe_reg", formula="~ a")
    assert {r.estimand for r in tables["influence"].collect()} == {"(Intercept)", "a"} and tables["queue"].count() == 6


def test_examination_finds_the_odd_subject(spark):
    rng = np.random.default_rng(11)
    truth = rng.normal(size=40)[:, None]
    y = truth + rng.normal(size=(40, 10)) * 0.3
    y[:, 4] = -3 * truth[:, 0]
    out = E.examine_group(make(spark, y, np.full((40, 10), 0.09)))
    queue = out["queue"].orderBy("place").collect()
    assert queue[0].subject == "u4" and queue[0].status == "review" and queue[0].priority == 1 and sum(r.retained for r in queue) >= 5
    agreed = {r.subject: r.correlation for r in out["contrasts"].collect()}
    assert agreed["u4"] < 0 < min(v for k, v in agreed.items() if k != "u4")
    assert out["conclusions"].count() == 10
    place = E.geometry(out["subject_maps"], [f"u{i}" for i in range(10)])
    assert place.d1.abs().idxmax() == 4
    assert "<table>" in export.report({"queue": out["queue"]})
    with pytest.raises(ValueError):
        E.examine_group(make(spark, y), "combine:fisher")


# --- catalogs, plans, command line, streams


def test_catalog(spark, tmp_path):
    paths = spark.createDataFrame([("/d/sub-01/ses-a/x_beta.nii",), ("/d/sub-02/x_se.nii",), ("/d/readme.txt",)], "file string")
    cat = G.catalog(paths, root="/d", pattern="**/*.nii")
    assert {r.relpath for r in cat.collect()} == {"sub-01/ses-a/x_beta.nii", "sub-02/x_se.nii"}
    got = {r.basename: (r.sub, r.ses) for r in G.extract_meta(cat, r"sub-(?P<sub>\d+)/(?:ses-(?P<ses>\w+))?").collect()}
    assert got == {"x_beta.nii": ("01", "a"), "x_se.nii": ("02", None)}
    meta = G.extract_meta(cat, r"sub-(?P<sub>\d+)/")
    assert {(r.group, r.issue, r.value) for r in G.consistency(meta, "sub").collect()} == {("02", "missing", "x_beta.nii"), ("02", "extra", "x_se.nii")}
    assert {(r.group, r.value) for r in G.consistency(meta, "sub", expect=["x_se.nii"]).collect()} == {("01", "x_se.nii")}
    assert G.subset(meta, "sub = '01'").count() == 1 and {r.sub for r in G.unique(meta, "sub").collect()} == {"01", "02"}
    tagged = G.map_assays(G.assign_meta(cat, "stat", r"x_(\w+)\.nii", "$1"), {"beta": "_beta", "se": "_se"})
    assert {(r.stat, r.assay) for r in tagged.collect()} == {("beta", "beta"), ("se", "se")}
    issues = {(r.group, r.issue, r.value) for r in G.validate(G.extract_meta(tagged, r"sub-(?P<sub>\d+)/"), "sub", "assay").collect()}
    assert issues == {("01", "missing", "se"), ("02", "missing", "beta")}
    with pytest.raises(ValueError):
        G.join_meta(cat, cat.union(cat), "file")
    joined = G.join_meta(cat, spark.createDataFrame([("x_se.nii", "n")], "basename string, relpath string"), "basename")
    assert "relpath.external" in joined.columns and joined.count() == 2
    G.write_catalog(cat, str(tmp_path / "c.json"))
    assert sorted(G.read_catalog(spark, str(tmp_path / "c.json")).collect()) == sorted(cat.collect())
    assert G.glob_regex("a/**/b?.*") == r"^a/(?:.*/)?b[^/]\.[^/]*$"


def test_bundle_and_tidy_round_trip(spark, tmp_path):
    cube = make(spark, [[1.0, np.nan], [2.0, 3.0]])
    cube = cube.with_(space=Space("voxel", (1, 1, 2), ((1.0, 0.0), (0.0, 1.0))))
    export.write_out(cube, str(tmp_path / "b"), "bundle")
    back = export.read_bundle(spark, str(tmp_path / "b"))
    assert sorted(back.df.collect()) == sorted(cube.df.collect()) and back.space == cube.space and back.ids("sample") == cube.ids("sample")
    gaps = cube.with_df(cube.df.where("beta is not null"))
    assert export.tidy(gaps, ["beta"]).count() == 4 and export.tidy(gaps, ["beta"], drop_na=True).count() == 3
    with pytest.raises(ValueError):
        export.write_out(cube, "x", "hdf")


def test_plan_is_lazy_ordered_and_saved(spark, tmp_path):
    source = str(tmp_path / "t.parquet")
    make(spark, [[1.0, 2, 3], [4, 5, 6]]).df.write.parquet(source)
    plan = P.plan(source).mask(V.MaskPolicy(rule="union")).reduce("meta:fe").posthoc("fdr:bh").write_out(str(tmp_path / "out"))
    assert len(plan.nodes) == 4 and not (tmp_path / "out").exists() and not plan.validate()
    got = plan.compute(spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and "q" in got.assays
    plan.save(str(tmp_path / "p.json"))
    again = P.load_plan(str(tmp_path / "p.json"))
    assert again.digest() == plan.digest() and sorted(again.compute(spark).df.collect()) == sorted(got.df.collect())
    changed = json.loads((tmp_path / "p.json").read_text())
    changed["nodes"][1][1]["method"] = "meta:re"
    (tmp_path / "p.json").write_text(json.dumps(changed))
    with pytest.warns(UserWarning, match="digest"):
        P.load_plan(str(tmp_path / "p.json"))
    with pytest.raises(KeyError):
        P.plan(source).reduce("no")
    with pytest.raises(TypeError):
        P.plan(source).mask(V.MaskPolicy(rule="custom", custom=len)).save(str(tmp_path / "q.json"))
    assert P.plan(source).reduce("meta:fe", formula="~ x").validate()
    assert plan.preview(spark, 1).df.count() == 1 and P.plan(plan) is plan


def test_command_line(spark, tmp_path, capsys):
    source = str(tmp_path / "t.parquet")
    make(spark, [[1.0, 2, 3], [4, 5, 6]]).df.write.parquet(source)
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr())
    code, said = run("probe", source, "--json")
    assert code == 0 and json.loads(said.out)["samples"] == 2
    code, said = run("run", source, "--subject", "u0", "--subject", "u2", "--reduce", "meta:fe", "--posthoc", "fdr:bh", "--json")
    assert code == 0 and {r["sample"]: r["n_eff"] for r in json.loads(said.out)} == {"s0": 2, "s1": 2}
    assert run("plan", source, "--reduce", "fixed", "--json")[0] == 0
    assert run("run", source, "--sample", "none")[0] == 1 and run("plan", source, "--reduce", "no")[0] == 1
    assert "meta:fe" in run("list", "reducers", "--json")[1].out


def test_stream_equals_batch_whatever_the_batches(spark, tmp_path):
    rng = np.random.default_rng(13)
    cube = make(spark, rng.normal(size=(5, 8)) + 100, rng.uniform(0.5, 2, (5, 8)))
    cube.df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cube.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = I.meta_fe_sums(stream, 100.0).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = table(I.finish(spark.table("sums"), 100.0), "beta", "z", "Q", "n_eff")
    want = table(R.meta_fe(cube), "beta", "z", "Q", "n_eff")
    assert all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)


def test_results_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(14)
    cube = make(spark, rng.normal(size=(9, 6)), rng.uniform(0.5, 2, (9, 6)))
    one = table(R.meta_re(cube), "beta", "tau2", "p")
    many = table(R.meta_re(cube.with_df(cube.df.repartition(11))), "beta", "tau2", "p")
    assert all(one[s] == pytest.approx(many[s]) for s in one)


def test_empty_cube(spark):
    cube = T.from_table(spark.createDataFrame([], LONG))
    assert R.meta_fe(cube).count() == 0 and H.posthoc(R.reduce(cube, "meta:fe"), "fdr:bh").df.count() == 0
    assert E.leave_one_out_fe(cube).count() == 0
