"""Every cube query against its SQL on the smallest tables, as multisets of rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cubelark import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(df):
    cell = lambda v: None if pd.isna(v) else str(v) if isinstance(v, (bool, str)) or str(v) in ("True", "False") else f"{float(v):.9g}"
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, tables, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(tables.execute(Q.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_permutations_cover_all_vectors(spark):
    """The same in NumPy over all vectors; a given first row for the observed labelling is no part of the null."""
    y = np.stack(pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id", key=lambda v: v.astype(str)).embedding).astype(float)
    n = len(y)
    one = lambda x: x.mean(0) / (x.std(0, ddof=1) / np.sqrt(n))
    got = Q.perm_onesample(spark, SF).toPandas().assign(d=lambda x: x["sample"].astype(int)).sort_values("d")
    flips = np.abs([one(np.array(s)[:, None] * y) for s in Q.sign_table(width=n)])
    limit = np.abs(one(y)) - 1e-12 * np.maximum(1, np.abs(one(y)))
    assert got.t.to_numpy() == pytest.approx(one(y), abs=2e-6)
    assert got.p_perm.to_numpy() == pytest.approx((1 + (flips >= limit).sum(0)) / 65, abs=1e-7)
    assert got.p_fwer.to_numpy() == pytest.approx((1 + (flips.max(1)[:, None] >= limit).sum(0)) / 65, abs=1e-7)
    assert Q.tfce_onesample(spark, SF).count() == Q.cluster_onesample(spark, SF).count() == y.shape[1]
    assert Q.embedding_cube(spark, SF).subjects.count() == n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_mixed_models_cover_all(spark):
    brands = pd.read_parquet(f"{SF}/part.parquet").p_brand.nunique()
    for name in ("lmm_ri", "lmm_ri_knownvar", "lmm_slope"):
        assert Q.QUERIES[name](spark, SF).count() == brands > 6
