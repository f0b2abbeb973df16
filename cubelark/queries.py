"""Registered queries of the cube engine and the same in DuckDB SQL.

The brand cube: samples are part brands, subjects suppliers, contrasts return
flags; beta is the mean extended price of a cell, var its squared standard error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .cube import KEYS, Cube, Space
from .functions import formula as M
from .operators import catalog as G
from .operators import examine as E
from .operators import export, maps
from .operators import frames as N
from .operators import posthoc as H
from .operators import reduce as R
from .operators import verbs as V
from .sources import tabular as S
from .streaming import incremental as I

CELL = ["sample", "contrast"]


def read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def brand_cells(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = F.col("l_extendedprice")
    cells = rows.groupBy(F.col("p_brand").alias("sample"), F.col("l_suppkey").cast("string").alias("subject"), F.col("l_returnflag").alias("contrast"))
    return cells.agg(F.avg(x).alias("beta"), (F.var_samp(x) / F.count(x)).alias("var"))


def brand_cube(spark, sf) -> Cube:
    cells = brand_cells(spark, sf)
    subjects = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("subject"), "s_acctbal", "s_nationkey")
    cube = S.from_table(cells, dedupe=False)
    return V.with_axis_data(cube, "subject", subjects, "subject")


def r(df, **digits):
    """Round the named columns, keep the others in order."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits[c]).alias(c) if c in digits else F.col(f"`{c}`") for c in df.columns])


def out(df, *columns):
    """(alias, column, digits) or a name, each as a double rounded to digits."""
    picked = []
    for c in columns:
        name, source, digits = c if isinstance(c, tuple) else (c, c, None)
        col = F.col(f"`{source}`") if isinstance(source, str) else source
        picked.append(F.round(col.cast("double"), digits).alias(name) if digits is not None else col.alias(name))
    return df.select(*picked)


# --- SQL building blocks

CELLS = """cells AS (SELECT p_brand AS sample, l_suppkey::VARCHAR AS subject, l_returnflag AS contrast, avg(l_extendedprice) AS beta,
  var_samp(l_extendedprice) / count(l_extendedprice) AS var FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
GRID = """grid AS (SELECT sample, contrast FROM (SELECT DISTINCT sample FROM cells), (SELECT DISTINCT contrast FROM cells))"""
VALID = """valid AS (SELECT sample, contrast, subject, beta AS y, greatest(var, 1e-12) AS v, 1 / greatest(var, 1e-12) AS w FROM cells WHERE var > 0)"""
SUBJECT = "supplier.s_suppkey::VARCHAR"
ZCELLS = """zs AS (SELECT sample, subject, contrast, (beta - 38000) / sqrt(var) / 10 AS z FROM cells WHERE var > 0)"""
PCELLS = """ps AS (SELECT sample, subject, contrast, 1 / (1 + ((beta - 38000) / sqrt(var)) ** 2) AS p FROM cells WHERE var > 0)"""


def z_cube(spark, sf):
    c = brand_cube(spark, sf)
    return c.with_df(c.df.where("var > 0").select(*KEYS, ((F.col("beta") - 38000) / F.sqrt("var") / 10).alias("z")))


def p_cube(spark, sf):
    c = brand_cube(spark, sf)
    return c.with_df(c.df.where("var > 0").select(*KEYS, (1 / (1 + F.pow((F.col("beta") - 38000) / F.sqrt("var"), 2))).alias("p")))


def family_edges(spark, sf):
    """Brand to its family (the digit after the hash), equal weights."""
    brands = read(spark, sf, "part").select(F.col("p_brand").alias("source")).distinct()
    edges = brands.withColumn("target", F.concat(F.lit("F"), F.substring("source", 7, 1)))
    n = edges.groupBy("target").agg(F.count("*").alias("n"))
    return edges.join(F.broadcast(n), "target").select("target", "source", (1.0 / F.col("n")).alias("w"))


EDGES = """edges AS (SELECT 'F' || substring(source, 7, 1) AS target, source, 1.0::DOUBLE / count(*) OVER (PARTITION BY substring(source, 7, 1)) AS w
  FROM (SELECT DISTINCT p_brand AS source FROM part))"""

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(fun):
        QUERIES[name] = fun
        if sql:
            SQL[name] = sql
        return fun

    return add


# --- sources and export


@query("scan_cube", f"WITH {CELLS} SELECT sample, subject, contrast, round(beta, 6) AS beta, round(var, 2) AS var FROM cells")
def scan_cube(spark, sf):
    return out(brand_cube(spark, sf).df, *KEYS, ("beta", "beta", 6), ("var", "var", 2))


@query("tidy_export", f"""WITH {CELLS}, s AS (SELECT DISTINCT sample FROM cells), u AS (SELECT DISTINCT subject FROM cells), c AS (SELECT DISTINCT contrast FROM cells)
SELECT sample, subject, contrast, round(beta, 6) AS beta, round(s_acctbal, 2) AS s_acctbal FROM (SELECT * FROM s, u, c) LEFT JOIN cells USING (sample, subject, contrast) JOIN supplier ON s_suppkey::VARCHAR = subject""")
def tidy_export(spark, sf):
    made = export.tidy(brand_cube(spark, sf), ["beta"], include_col_data=True)
    return out(made, *KEYS, ("beta", "beta", 6), ("s_acctbal", "s_acctbal", 2))


@query("dedupe_first", """SELECT event_type AS sample, user_id::VARCHAR AS subject, strftime(ts, '%Y-%m-%d') AS contrast, round(first(value ORDER BY event_id), 6) AS beta FROM events GROUP BY ALL""")
def dedupe_first(spark, sf):
    rows = read(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    cube = S.from_table(rows, "event_type", "user_id", "day", {"beta": "value"}, order="event_id")
    return out(cube.df, *KEYS, ("beta", "beta", 6))


@query("axis_order", """SELECT row_number() OVER (ORDER BY f, id)::INTEGER AS ord, id FROM (SELECT event_type AS id, min(event_id) AS f FROM events GROUP BY 1)""")
def axis_order(spark, sf):
    return S.from_table(read(spark, sf, "events"), "event_type", "user_id", "none", {"beta": "value"}, order="event_id").samples


@query("lift_constant", "SELECT o_custkey::VARCHAR AS subject, first(c_mktsegment) AS c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def lift_constant(spark, sf):
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("subject", F.col("o_custkey").cast("string"))
    return S.lift_constant(rows, "subject", ["c_mktsegment"]).join(rows.groupBy("subject").agg(F.count("*").alias("orders")), "subject")


@query("temporal_mean", "SELECT event_type, user_id, round(avg(value), 6) AS beta FROM events GROUP BY ALL")
def temporal_mean(spark, sf):
    return out(S.temporal_mean(read(spark, sf, "events"), ["event_type", "user_id"]), "event_type", "user_id", ("beta", "beta", 6))


@query("temporal_design", """WITH h AS (SELECT event_type, user_id % 10 AS cohort, hour(ts)::INTEGER % 4 AS t, avg(value) AS value, var_samp(value) / count(*) AS v FROM events GROUP BY ALL),
c AS (SELECT * FROM (VALUES (0, 'late', -1.0), (1, 'late', -1.0), (2, 'late', 1.0), (3, 'late', 1.0), (0, 'mean', 0.25), (1, 'mean', 0.25), (2, 'mean', 0.25), (3, 'mean', 0.25)) x(t, contrast, c))
SELECT event_type, cohort, contrast, round(CASE WHEN count(value) = 4 THEN sum(value * c) END, 6) AS beta, round(sum(v * c * c), 6) AS var FROM h JOIN c USING (t) GROUP BY ALL""")
def temporal_design(spark, sf):
    rows = read(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 10).alias("cohort"), (F.hour("ts") % 4).alias("t")).agg(F.avg("value").alias("value"), (F.var_samp("value") / F.count("*")).alias("v"))
    weights = [(t, "late", -1.0 if t < 2 else 1.0) for t in range(4)] + [(t, "mean", 0.25) for t in range(4)]
    made = S.temporal_design(rows, ["event_type", "cohort"], spark.createDataFrame(weights, "t int, contrast string, c double"), variance="v")
    return out(made, "event_type", "cohort", "contrast", ("beta", "beta", 6), ("var", "var", 6))


# --- subset, derive, masks, axes


@query("subset_label", f"WITH {CELLS} SELECT sample, subject, contrast, round(beta, 6) AS beta FROM cells WHERE sample IN ('Brand#11', 'Brand#22') AND contrast = 'R'")
def subset_label(spark, sf):
    return out(V.subset(brand_cube(spark, sf), sample=["Brand#22", "Brand#11"], contrast="R").df, *KEYS, ("beta", "beta", 6))


@query("subset_positional", f"""WITH {CELLS}, s AS (SELECT sample, row_number() OVER (ORDER BY sample) AS k FROM (SELECT DISTINCT sample FROM cells))
SELECT sample, subject, contrast, round(beta, 6) AS beta FROM cells JOIN s USING (sample) WHERE k IN (3, 1, 7)""")
def subset_positional(spark, sf):
    return out(V.subset(brand_cube(spark, sf), sample=[3, 1, 7]).df, *KEYS, ("beta", "beta", 6))


@query("subset_chain", f"""WITH {CELLS}, s AS (SELECT sample, row_number() OVER (ORDER BY sample) AS k FROM (SELECT DISTINCT sample FROM cells))
SELECT sample, subject, contrast, round(beta, 6) AS beta FROM cells JOIN s USING (sample) WHERE k IN (9, 2)""")
def subset_chain(spark, sf):
    return out(V.subset(V.subset(brand_cube(spark, sf), sample=[9, 5, 2]), sample=[1, 3]).df, *KEYS, ("beta", "beta", 6))


@query("derive_t", f"WITH {CELLS} SELECT sample, subject, contrast, round(sqrt(var), 4) AS se, round(CASE WHEN var > 0 THEN beta / sqrt(var) END, 5) AS t FROM cells")
def derive_t(spark, sf):
    return out(V.derive(brand_cube(spark, sf), ["se", "t"]).df, *KEYS, ("se", "se", 4), ("t", "t", 5))


@query("derive_var", f"WITH {CELLS} SELECT sample, subject, contrast, round(var, 2) AS var FROM cells")
def derive_var(spark, sf):
    c = V.derive(brand_cube(spark, sf), "se")
    c = c.with_df(c.df.drop("var"))
    return out(V.derive(c, "var").df, *KEYS, ("var", "var", 2))


def _mask_sql(scope, test):
    sizes = "(SELECT count(DISTINCT subject) FROM cells)", "(SELECT count(DISTINCT contrast) FROM cells)"
    if scope == "group":
        kept = f"SELECT sample FROM cells2 GROUP BY 1 HAVING {test.format(n='count(beta)', whole=f'{sizes[0]} * {sizes[1]}')}"
    else:
        kept = f"SELECT sample FROM (SELECT sample, subject FROM cells2 GROUP BY ALL HAVING {test.format(n='count(beta)', whole=sizes[1])}) GROUP BY 1 HAVING count(*) = {sizes[0]}"
    return f"WITH {CELLS}, cells2 AS (SELECT * FROM cells WHERE NOT (sample < 'Brand#25' AND subject::INT % 9 = 1 AND contrast = 'A') AND NOT (sample > 'Brand#50' AND subject = '3')), kept AS ({kept}) SELECT sample, count(*) AS cells FROM cells2 WHERE sample IN (FROM kept) GROUP BY 1"


def _mask(rule, scope):
    def run(spark, sf):
        c = brand_cube(spark, sf)
        holes = ((F.col("sample") < "Brand#25") & (F.col("subject").cast("int") % 9 == 1) & (F.col("contrast") == "A")) | ((F.col("sample") > "Brand#50") & (F.col("subject") == "3"))
        c = c.with_df(c.df.where(~holes))
        return V.mask(c, V.MaskPolicy(scope, rule, 0.6)).df.groupBy("sample").agg(F.count("*").alias("cells"))

    return run


for _scope in ("group", "subject"):
    for _rule, _test in (("intersection", "{n} = {whole}"), ("union", "{n} > 0"), ("threshold", "{n}::DOUBLE / ({whole}) >= 0.6")):
        if (_scope, _rule) != ("group", "intersection") and (_scope, _rule) != ("subject", "intersection"):
            query(f"mask_{_scope}_{_rule}", _mask_sql(_scope, _test))(_mask(_rule, _scope))


@query("mask_group_intersection", """WITH c AS (SELECT event_type AS sample, (user_id % 7)::VARCHAR AS subject, avg(CASE WHEN user_id % 7 = 3 AND event_type = (SELECT min(event_type) FROM events) THEN NULL ELSE value END) AS beta FROM events GROUP BY ALL)
SELECT sample, subject, round(beta, 6) AS beta FROM c WHERE sample IN (SELECT sample FROM c GROUP BY 1 HAVING count(beta) = (SELECT count(DISTINCT subject) FROM c))""")
def mask_group_intersection(spark, sf):
    rows = read(spark, sf, "events")
    first = rows.agg(F.min("event_type")).first()[0]
    value = F.when((F.col("user_id") % 7 == 3) & (F.col("event_type") == first), None).otherwise(F.col("value"))
    cells = rows.groupBy(F.col("event_type").alias("sample"), (F.col("user_id") % 7).alias("subject")).agg(F.avg(value).alias("beta"))
    return out(V.mask(S.from_table(cells, dedupe=False), V.MaskPolicy("group", "intersection")).df, "sample", "subject", ("beta", "beta", 6))


@query("mask_subject_intersection", """WITH c AS (SELECT event_type AS sample, (user_id % 5)::VARCHAR AS subject, (event_id % 3)::VARCHAR AS contrast, avg(value) AS beta FROM events
  WHERE NOT (event_type = (SELECT max(event_type) FROM events) AND user_id % 5 = 2 AND event_id % 3 = 1) GROUP BY ALL)
SELECT sample, subject, contrast, round(beta, 6) AS beta FROM c WHERE sample IN (SELECT sample FROM (SELECT sample, subject FROM c GROUP BY ALL HAVING count(beta) = 3) GROUP BY 1 HAVING count(*) = 5)""")
def mask_subject_intersection(spark, sf):
    rows = read(spark, sf, "events")
    last = rows.agg(F.max("event_type")).first()[0]
    rows = rows.where(~((F.col("event_type") == last) & (F.col("user_id") % 5 == 2) & (F.col("event_id") % 3 == 1)))
    cells = rows.groupBy(F.col("event_type").alias("sample"), (F.col("user_id") % 5).alias("subject"), (F.col("event_id") % 3).alias("contrast")).agg(F.avg("value").alias("beta"))
    return out(V.mask(S.from_table(cells, dedupe=False), V.MaskPolicy("subject", "intersection")).df, *KEYS, ("beta", "beta", 6))


@query("mask_custom", f"WITH {CELLS} SELECT sample, count(*) AS cells FROM cells GROUP BY 1 HAVING avg(beta) > 38000")
def mask_custom(spark, sf):
    big = V.MaskPolicy(rule="custom", custom=lambda df: df.groupBy("sample").agg(F.avg("beta").alias("m")).where("m > 38000"))
    return V.mask(brand_cube(spark, sf), big).df.groupBy("sample").agg(F.count("*").alias("cells"))


@query("axis_data", f"WITH {CELLS} SELECT subject, round(avg(beta), 6) AS beta, round(first(s_acctbal), 2) AS s_acctbal FROM cells JOIN supplier ON s_suppkey::VARCHAR = subject GROUP BY 1")
def axis_data(spark, sf):
    c = brand_cube(spark, sf)
    mean = c.df.groupBy("subject").agg(F.avg("beta").alias("beta"))
    return out(mean.join(c.subjects, mean["subject"] == c.subjects["id"]), "subject", ("beta", "beta", 6), ("s_acctbal", "s_acctbal", 2))


@query("common_mask", "WITH a AS (SELECT p_partkey AS voxel, row_number() OVER (ORDER BY p_partkey)::INTEGER AS ord FROM part WHERE p_size % 2 = 0), b AS (SELECT p_partkey AS voxel, row_number() OVER (ORDER BY p_partkey)::INTEGER AS ord FROM part WHERE p_size % 3 = 0) SELECT voxel, a.ord AS pos_a, b.ord AS pos_b FROM a FULL JOIN b USING (voxel)")
def common_mask(spark, sf):
    from pyspark.sql import Window

    part = read(spark, sf, "part")
    packed = lambda m: part.where(F.col("p_size") % m == 0).select(F.col("p_partkey").alias("voxel"), F.row_number().over(Window.orderBy("p_partkey")).alias("ord"))
    return V.common_mask(packed(2), packed(3), "union")


@query("relabel", f"WITH {CELLS} SELECT sample, coalesce(CASE WHEN subject::INT BETWEEN 1 AND 5 THEN 'S' || subject END, subject) AS subject, contrast, round(beta, 6) AS beta FROM cells")
def relabel(spark, sf):
    names = spark.range(1, 6).select(F.col("id").cast("string").alias("old"), F.concat(F.lit("S"), "id").alias("new"))
    return out(V.relabel(brand_cube(spark, sf), "subject", names).df, *KEYS, ("beta", "beta", 6))


@query("harmonise", "SELECT CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def harmonise(spark, sf):
    names = spark.createDataFrame([("F", "final"), ("O", "open")], "old string, new string")
    return G.harmonise(read(spark, sf, "orders"), "o_orderstatus", names).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# --- maps

_MAPPED = f"""WITH {CELLS}, {EDGES}, d AS (SELECT target, count(*) AS n FROM edges GROUP BY 1), m AS (SELECT target, subject, contrast, sum(w * beta) AS b, count(beta) AS nb, sum(w * w * var) AS v, count(var) AS nv FROM cells JOIN edges ON sample = source GROUP BY ALL)
SELECT target AS sample, subject, contrast, round(CASE WHEN nb = n THEN b END, 6) AS beta, round(CASE WHEN nv = n THEN v END, 2) AS var FROM m JOIN d USING (target)"""


@query("map_to", _MAPPED)
def map_to(spark, sf):
    return out(maps.map_to(brand_cube(spark, sf), family_edges(spark, sf)).df, *KEYS, ("beta", "beta", 6), ("var", "var", 2))


@query("map_cov_provider", f"""WITH {CELLS}, {EDGES}, d AS (SELECT target, count(*) AS n FROM edges GROUP BY 1), x AS (SELECT target, subject, contrast, source, w, beta, var FROM cells JOIN edges ON sample = source),
m AS (SELECT target, subject, contrast, count(var) AS nv, sum(w * w * var) AS v FROM x GROUP BY ALL),
p AS (SELECT a.target, a.subject, a.contrast, sum(a.w * sqrt(a.var) * b.w * sqrt(b.var) * 0.3) AS e FROM x a JOIN x b ON a.target = b.target AND a.subject = b.subject AND a.contrast = b.contrast AND a.source <> b.source GROUP BY ALL)
SELECT target AS sample, subject, contrast, round(CASE WHEN nv = n THEN v + coalesce(e, 0) END, 2) AS var FROM m JOIN d USING (target) LEFT JOIN p USING (target, subject, contrast)""")
def map_cov_provider(spark, sf):
    edges = family_edges(spark, sf)
    a, b = edges.select("target", F.col("source").alias("source_a")), edges.select("target", F.col("source").alias("source_b"))
    pairs = a.join(b, "target").where("source_a < source_b").select("source_a", "source_b", F.lit(0.3).alias("r"))
    made = maps.map_to(brand_cube(spark, sf), edges, maps.UncertaintyRule("cov_provider", correlations=pairs))
    return out(made.df, *KEYS, ("var", "var", 2))


@query("align", f"""WITH {CELLS}, {EDGES}, e AS (SELECT target, source, s_suppkey::VARCHAR AS subject, w * (1 + s_suppkey % 2) AS w FROM edges, supplier), d AS (SELECT target, subject, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT target, c.subject, contrast, sum(w * beta) AS b, count(beta) AS nb, sum(w * w * var) AS v, count(var) AS nv FROM cells c JOIN e ON sample = source AND c.subject = e.subject GROUP BY ALL)
SELECT target AS sample, subject, contrast, round(CASE WHEN nb = n THEN b END, 6) AS beta, round(CASE WHEN nv = n THEN v END, 2) AS var FROM m JOIN d USING (target, subject)""")
def align(spark, sf):
    who = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("subject"), (1 + F.col("s_suppkey") % 2).alias("f"))
    edges = family_edges(spark, sf).crossJoin(F.broadcast(who)).select("target", "source", "subject", (F.col("w") * F.col("f")).alias("w"))  # a map of each subject is what is asked for
    return out(maps.align(brand_cube(spark, sf), maps.MapFamily("by subject", edges)).df, *KEYS, ("beta", "beta", 6), ("var", "var", 2))


@query("satterthwaite", f"""WITH {CELLS}, {EDGES} SELECT target, contrast, round(sum(w * w * var) ** 2 / sum((w * w * var) ** 2 / 4), 5) AS df FROM cells JOIN edges ON sample = source WHERE var > 0 GROUP BY ALL""")
def satterthwaite(spark, sf):
    rows = brand_cube(spark, sf).df.where("var > 0").join(family_edges(spark, sf), F.col("sample") == F.col("source")).withColumn("df", F.lit(4.0))
    return out(V.satterthwaite(rows, ["target", "contrast"]), "target", "contrast", ("df", "df", 5))


@query("map_stouffer", f"""WITH {CELLS}, {ZCELLS}, {EDGES}, d AS (SELECT target, count(*) AS n FROM edges GROUP BY 1), m AS (SELECT target, subject, contrast, sum(w * z) / sqrt(sum(w * w)) AS z, count(*) AS k FROM zs JOIN edges ON sample = source GROUP BY ALL)
SELECT target AS sample, subject, contrast, round(CASE WHEN k = n THEN z END, 5) AS z FROM m JOIN d USING (target)""")
def map_stouffer(spark, sf):
    return out(maps.map_to(z_cube(spark, sf), family_edges(spark, sf), combine="stouffer").df, *KEYS, ("z", "z", 5))


@query("map_fisher", f"""WITH {CELLS}, {PCELLS}, {EDGES}, d AS (SELECT target, count(*) AS n FROM edges GROUP BY 1), m AS (SELECT target, subject, contrast, -2 * sum(ln(p)) AS x, count(*) AS k FROM ps JOIN edges ON sample = source GROUP BY ALL)
SELECT target AS sample, subject, contrast, round(CASE WHEN k = n THEN x END, 5) AS chi2, CASE WHEN k = n THEN 2.0::DOUBLE * k END AS df FROM m JOIN d USING (target)""")
def map_fisher(spark, sf):
    return out(maps.map_to(p_cube(spark, sf), family_edges(spark, sf), combine="fisher").df, *KEYS, ("chi2", "chi2", 5), "df")


# --- reducers

FE = """mu AS (SELECT sample, contrast, sum(w * y) / sum(w) AS mu, sum(w) AS sw, count(*) AS k FROM valid GROUP BY ALL),
q AS (SELECT sample, contrast, first(mu) AS mu, first(sw) AS sw, first(k) AS k, sum(w * (y - mu) ** 2) AS q, sum(w * w) AS sw2 FROM valid JOIN mu USING (sample, contrast) GROUP BY ALL)"""


@query("meta_fe", f"""WITH {CELLS}, {GRID}, {VALID}, {FE}
SELECT sample, contrast, round(CASE WHEN k >= 2 THEN mu END, 6) AS beta, round(CASE WHEN k >= 2 THEN 1 / sw END, 3) AS var, round(CASE WHEN k >= 2 THEN mu * sqrt(sw) END, 5) AS z, round(CASE WHEN k >= 2 THEN q END, 4) AS Q,
  round(CASE WHEN k >= 2 THEN CASE WHEN q > 1e-12 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END END, 6) AS I2, coalesce(k, 0) AS n_eff FROM grid LEFT JOIN q USING (sample, contrast)""")
def meta_fe(spark, sf):
    return out(R.meta_fe(brand_cube(spark, sf), p=False), *CELL, ("beta", "beta", 6), ("var", "var", 3), ("z", "z", 5), ("Q", "Q", 4), ("I2", "I2", 6), "n_eff")


@query("meta_re", f"""WITH {CELLS}, {GRID}, {VALID}, {FE}, t AS (SELECT *, greatest(0, (q - (k - 1)) / greatest(sw - sw2 / sw, 1e-12)) AS tau2 FROM q),
u AS (SELECT sample, contrast, first(tau2) AS tau2, first(k) AS k, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu, sum(1 / (v + tau2)) AS su FROM valid JOIN t USING (sample, contrast) GROUP BY ALL)
SELECT sample, contrast, round(CASE WHEN k >= 2 THEN mu END, 3) AS beta, round(CASE WHEN k >= 2 THEN mu * sqrt(su) END, 5) AS z, round(CASE WHEN k >= 2 THEN tau2 END / 1e6, 5) AS tau2_m, coalesce(k, 0) AS n_eff FROM grid LEFT JOIN u USING (sample, contrast)""")
def meta_re(spark, sf):
    return out(R.meta_re(brand_cube(spark, sf), p=False), *CELL, ("beta", "beta", 3), ("z", "z", 5), ("tau2_m", F.col("tau2") / 1e6, 5), "n_eff")


@query("combine_stouffer", f"WITH {CELLS}, {GRID}, {ZCELLS}, s AS (SELECT sample, contrast, sum(z) / sqrt(count(*)) AS z, count(*) AS k FROM zs GROUP BY ALL) SELECT sample, contrast, round(z, 5) AS z, coalesce(k, 0) AS n_eff FROM grid LEFT JOIN s USING (sample, contrast)")
def combine_stouffer(spark, sf):
    return out(R.stouffer(z_cube(spark, sf), p=False), *CELL, ("z", "z", 5), "n_eff")


@query("combine_fisher", f"""WITH {CELLS}, {GRID}, {PCELLS}, s AS (SELECT sample, contrast, -2 * sum(ln(p)) AS x, count(*) AS k FROM ps GROUP BY ALL)
SELECT sample, contrast, round(x, 5) AS chi2, 2.0::DOUBLE * k AS df, round(least(1, list_sum(list_transform(range(k), lambda i: exp(i * ln(x / 2) - lgamma(i + 1) - x / 2)))), 8) AS p, coalesce(k, 0) AS n_eff FROM grid LEFT JOIN s USING (sample, contrast)""")
def combine_fisher(spark, sf):
    return out(R.fisher(p_cube(spark, sf)), *CELL, ("chi2", "chi2", 5), "df", ("p", "p", 8), "n_eff")


@query("ttest_welch", """WITH c AS (SELECT event_type AS sample, user_id AS u, avg(value) AS y FROM events GROUP BY ALL), g AS (SELECT sample, avg(y) FILTER (u % 2 = 1) AS m1, avg(y) FILTER (u % 2 = 0) AS m0, var_samp(y) FILTER (u % 2 = 1) AS v1, var_samp(y) FILTER (u % 2 = 0) AS v0, count(*) FILTER (u % 2 = 1) AS n1, count(*) FILTER (u % 2 = 0) AS n0 FROM c GROUP BY 1)
SELECT sample, round(m1 - m0, 6) AS beta, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 5) AS df, n0, n1 FROM g""")
def ttest_welch(spark, sf):
    cells = read(spark, sf, "events").groupBy(F.col("event_type").alias("sample"), F.col("user_id").cast("string").alias("subject")).agg(F.avg("value").alias("beta"))
    c = S.from_table(cells, dedupe=False)
    c = c.with_(subjects=c.subjects.withColumn("group", F.col("id").cast("long") % 2))
    return out(R.welch(c, p=False), "sample", ("beta", "beta", 6), ("t", "t", 6), ("df", "df", 5), "n0", "n1")


_LINE = f"""WITH {CELLS}, x AS (SELECT sample, contrast, beta AS y, s_acctbal / 1000 AS x, var FROM cells JOIN supplier ON s_suppkey::VARCHAR = subject)"""


def account_cube(spark, sf):
    c = brand_cube(spark, sf)
    return c.with_(subjects=c.subjects.withColumn("acct", F.col("s_acctbal") / 1000))


@query("ols_simple", f"""{_LINE} SELECT sample, contrast, round(regr_intercept(y, x), 3) AS b0, round(regr_slope(y, x), 4) AS b1, round(regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 5) AS t1, count(*)::DOUBLE AS n_obs FROM x GROUP BY ALL""")
def ols_simple(spark, sf):
    made = R.reduce(account_cube(spark, sf), "ols:voxelwise", "~ acct").df
    return out(made, *CELL, ("b0", "coef:(Intercept)", 3), ("b1", "coef:acct", 4), ("t1", "t_coef:acct", 5), "n_obs")


@query("fe_reg", f"""{_LINE}, s AS (SELECT sample, contrast, sum(1 / var) AS s0, sum(x / var) AS sx, sum(x * x / var) AS sxx, sum(y / var) AS sy, sum(x * y / var) AS sxy, count(*) AS k FROM x WHERE var > 0 GROUP BY ALL)
SELECT sample, contrast, round((sxx * sy - sx * sxy) / (s0 * sxx - sx * sx), 2) AS b0, round((s0 * sxy - sx * sy) / (s0 * sxx - sx * sx), 3) AS b1, round((s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) / sqrt(s0 / (s0 * sxx - sx * sx)), 5) AS z1, (k - 2)::DOUBLE AS df_res FROM s""")
def fe_reg(spark, sf):
    made = R.reduce(account_cube(spark, sf), "meta:fe_reg", "~ acct").df
    return out(made, *CELL, ("b0", "coef:(Intercept)", 2), ("b1", "coef:acct", 3), ("z1", "z_coef:acct", 5), "df_res")


@query("re_reg", f"""{_LINE}, v AS (SELECT *, 1 / var AS w FROM x WHERE var > 0), s AS (SELECT sample, contrast, sum(w) AS s0, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * w) AS t0, sum(w * w * x) AS tx, sum(w * w * x * x) AS txx, count(*) AS k FROM v GROUP BY ALL),
c AS (SELECT *, s0 * sxx - sx * sx AS det, (sxx * sy - sx * sxy) / (s0 * sxx - sx * sx) AS b0, (s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) AS b1 FROM s),
q AS (SELECT sample, contrast, first(s0 - (sxx * t0 - 2 * sx * tx + s0 * txx) / det) AS tr, first(k) AS k, sum(w * (y - b0 - b1 * x) ** 2) AS q FROM v JOIN c USING (sample, contrast) GROUP BY ALL)
SELECT sample, contrast, round(greatest(0, (q - (k - 2)) / tr) / 1e6, 4) AS tau2_m, round(q, 4) AS Q FROM q""")
def re_reg(spark, sf):
    made = R.reduce(account_cube(spark, sf), "meta:re_reg", "~ acct").df
    return out(made, *CELL, ("tau2_m", F.col("tau2") / 1e6, 4), ("Q", "Q", 4))


@query("coef_contrast", f"""{_LINE} SELECT sample, contrast, round(regr_intercept(y, x) + 2 * regr_slope(y, x), 3) AS estimate, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) * (1.0 / count(*) + (2 - regr_avgx(y, x)) ** 2 / regr_sxx(y, x))), 3) AS se FROM x GROUP BY ALL""")
def coef_contrast(spark, sf):
    fit = R.reduce(account_cube(spark, sf), "ols:voxelwise", "~ acct", return_cov="tri")
    return out(R.coef_contrast(fit, {"(Intercept)": 1.0, "acct": 2.0}), *CELL, ("estimate", "estimate", 3), ("se", "se", 3))


@query("joint_test", f"""{_LINE} SELECT sample, contrast, round(regr_sxy(y, x) ** 2 / regr_sxx(y, x) / ((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2)), 4) AS F FROM x GROUP BY ALL""")
def joint_test(spark, sf):
    fit = R.reduce(account_cube(spark, sf), "ols:voxelwise", "~ acct", return_cov="tri")
    return out(R.joint_test(fit, [{"acct": 1.0}]), *CELL, ("F", "F", 4))


@query("coef_array", f"""{_LINE}, f AS (SELECT sample, contrast, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM x GROUP BY ALL)
SELECT sample, contrast, '(Intercept)' AS term, round(b0, 3) AS value FROM f UNION ALL SELECT sample, contrast, 'acct', round(b1, 3) FROM f""")
def coef_array(spark, sf):
    return out(R.coef_array(R.reduce(account_cube(spark, sf), "ols:voxelwise", "~ acct")), *CELL, "term", ("value", "value", 3))


@query("coef_cov_tri", f"""{_LINE}, f AS (SELECT sample, contrast, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) AS s2, regr_sxx(y, x) AS sxx, regr_avgx(y, x) AS mx, count(*) AS n FROM x GROUP BY ALL)
SELECT sample, contrast, '(Intercept)' AS term_a, '(Intercept)' AS term_b, round(s2 * (1.0 / n + mx * mx / sxx) / 1e6, 5) AS cov FROM f UNION ALL SELECT sample, contrast, '(Intercept)', 'acct', round(-s2 * mx / sxx / 1e6, 5) FROM f
UNION ALL SELECT sample, contrast, 'acct', 'acct', round(s2 / sxx / 1e6, 5) FROM f""")
def coef_cov_tri(spark, sf):
    fit = R.reduce(account_cube(spark, sf), "ols:voxelwise", "~ acct", return_cov="tri")
    return out(R.coef_cov_tri(fit), *CELL, "term_a", "term_b", ("cov", F.col("cov") / 1e6, 5))


def brand_frame(spark, sf):
    """(frame, observations): suppliers as observations, brand and flag as feature."""
    c = account_cube(spark, sf)
    frame = c.df.select(F.col("subject").alias("observation"), F.concat_ws(":", "sample", "contrast").alias("feature"), "beta", F.when(F.col("var") > 0, F.col("var")).alias("variance"))
    return frame, c.subjects.select(F.col("id").alias("observation"), "acct", (F.col("s_nationkey") % 5).alias("area"))


@query("frame_ols", f"""{_LINE}, f AS (SELECT sample || ':' || contrast AS feature, count(*) AS n, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, regr_sxx(y, x) AS sxx, regr_avgx(y, x) AS mx, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) AS s2 FROM x GROUP BY ALL)
SELECT feature, '(Intercept)' AS term, round(b0, 3) AS estimate, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 3) AS std_error, round(b0 / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 5) AS statistic FROM f
UNION ALL SELECT feature, 'acct', round(b1, 3), round(sqrt(s2 / sxx), 3), round(b1 / sqrt(s2 / sxx), 5) FROM f""")
def frame_ols(spark, sf):
    made = N.fit_group(*brand_frame(spark, sf), "~ acct", method="ols:voxelwise").result_frame()
    return out(made, "feature", "term", ("estimate", "estimate", 3), ("std_error", "std_error", 3), ("statistic", "statistic", 5))


@query("frame_random_intercept")
def frame_random_intercept(spark, sf):
    frame, observations = brand_frame(spark, sf)
    scaled = frame.withColumn("beta", F.col("beta") / 1000).withColumn("variance", F.col("variance") / 1e6)
    return out(N.fit_group(scaled, observations, "~ acct", group="area").result_frame(), "feature", "term", ("estimate", "estimate", 2))


@query("two_sample", f"""WITH {CELLS}, x AS (SELECT sample, contrast, beta AS y, s_nationkey < 12 AS low FROM cells JOIN supplier ON s_suppkey::VARCHAR = subject) SELECT sample, contrast, round(avg(y) FILTER (low) - avg(y) FILTER (NOT low), 3) AS effect FROM x GROUP BY ALL""")
def two_sample(spark, sf):
    c = brand_cube(spark, sf)
    c = c.with_(subjects=c.subjects.withColumn("side", F.when(F.col("s_nationkey") < 12, "low").otherwise("high")))
    return out(R.two_sample(c, "side", "high", "low").df, *CELL, ("effect", "coef:sidelow", 3))


def embedding_cube(spark, sf) -> Cube:
    """Dimensions as samples, all vectors as subjects; centred components as the measure."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("subject"), F.posexplode("embedding").alias("sample", "x"))
    return S.from_table(rows.select(F.col("sample").cast("string").alias("sample"), "subject", F.col("x").cast("double").alias("beta")), dedupe=False)


def sign_table(n: int = 64, width: int = 16):
    """Flip i of subject j: the parity of the ones of (i * 37 + 11) & (j * 29 + 5)."""
    return [[1.0 if bin((i * 37 + 11) & (j * 29 + 5)).count("1") % 2 == 0 else -1.0 for j in range(width)] for i in range(n)]


def signs_at(places):
    """Columns of ``sign_table()`` at an array of subjects' places."""
    ones = np.bitwise_count((np.arange(64)[:, None] * 37 + 11) & (np.asarray(places, np.int64)[None] * 29 + 5))
    return np.where(ones % 2 == 0, 1.0, -1.0)


def labels_at(places):
    """The same as labels: 1 for plus, 0 for minus."""
    return (signs_at(places) + 1) / 2


@query("perm_onesample", """WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS y FROM embeddings),
f AS (SELECT i, vec_id, CASE WHEN bit_count(((i * 37 + 11) & (k * 29 + 5))::INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM range(64) t(i), (SELECT vec_id, row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS k FROM (SELECT DISTINCT vec_id FROM x))),
o AS (SELECT d, sum(y) AS t, sum(y * y) AS q, count(*)::DOUBLE AS n FROM x GROUP BY 1), ot AS (SELECT d, q, n, (t / n) / sqrt((q - t * t / n) / (n - 1) / n) AS t FROM o),
z AS (SELECT i, d, sum(s * y) AS t FROM x JOIN f USING (vec_id) GROUP BY ALL), zt AS (SELECT i, d, ot.t AS obs, (z.t / n) / sqrt((q - z.t * z.t / n) / (n - 1) / n) AS t FROM z JOIN ot USING (d)), m AS (SELECT i, max(abs(t)) AS m FROM zt GROUP BY 1)
SELECT d::VARCHAR AS sample, round(obs, 6) AS t, round((1 + count(*) FILTER (abs(zt.t) >= abs(obs) - 1e-12 * greatest(1, abs(obs)))) / 65.0, 8) AS p_perm, round((1 + count(*) FILTER (m >= abs(obs) - 1e-12 * greatest(1, abs(obs)))) / 65.0, 8) AS p_fwer FROM zt JOIN m USING (i) GROUP BY d, obs""")
def perm_onesample(spark, sf):
    made = R.reduce(embedding_cube(spark, sf), "perm:onesample", signs=signs_at).df
    return out(made, "sample", ("t", "t", 6), ("p_perm", "p_perm", 8), ("p_fwer", "p_fwer", 8))


@query("perm_twosample", """WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS y FROM embeddings), o AS (SELECT d, vec_id % 2 = 1 AS g, y FROM x),
f AS (SELECT i, vec_id, bit_count(((i * 37 + 11) & (k * 29 + 5))::INTEGER) % 2 = 0 AS g FROM range(64) t(i), (SELECT vec_id, row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS k FROM (SELECT DISTINCT vec_id FROM x))),
ot AS (SELECT d, (avg(y) FILTER (g) - avg(y) FILTER (NOT g)) / sqrt(var_samp(y) FILTER (g) / count(*) FILTER (g) + var_samp(y) FILTER (NOT g) / count(*) FILTER (NOT g)) AS obs FROM o GROUP BY 1),
zt AS (SELECT i, d, (avg(y) FILTER (g) - avg(y) FILTER (NOT g)) / sqrt(var_samp(y) FILTER (g) / count(*) FILTER (g) + var_samp(y) FILTER (NOT g) / count(*) FILTER (NOT g)) AS t FROM x JOIN f USING (vec_id) GROUP BY ALL), m AS (SELECT i, max(abs(t)) AS m FROM zt GROUP BY 1)
SELECT d::VARCHAR AS sample, round(obs, 6) AS t, round((1 + count(*) FILTER (abs(t) >= abs(obs) - 1e-12 * greatest(1, abs(obs)))) / 65.0, 8) AS p_perm, round((1 + count(*) FILTER (m >= abs(obs) - 1e-12 * greatest(1, abs(obs)))) / 65.0, 8) AS p_fwer FROM zt JOIN ot USING (d) JOIN m USING (i) GROUP BY d, obs""")
def perm_twosample(spark, sf):
    c = embedding_cube(spark, sf)
    c = c.with_(subjects=c.subjects.withColumn("group", F.col("id").cast("int") % 2))
    return out(R.reduce(c, "perm:twosample", group_mat=labels_at).df, "sample", ("t", "t", 6), ("p_perm", "p_perm", 8), ("p_fwer", "p_fwer", 8))


def _grid(c: Cube) -> Cube:
    n = F.col("id").cast("int")
    return c.with_(samples=c.samples.withColumn("i", n % 4).withColumn("j", (n / 4).cast("int") % 4).withColumn("k", (n / 16).cast("int")), space=Space("voxel", (4, 4, 16)))


@query("tfce_onesample")
def tfce_onesample(spark, sf):
    c = _grid(embedding_cube(spark, sf))
    made = R.reduce(c, "perm:onesample", signs=signs_at, spatial="tfce").df
    return out(made, "sample", ("tfce", "tfce", 5), ("p", "p_tfce_fwer", 8))


@query("cluster_onesample")
def cluster_onesample(spark, sf):
    c = _grid(embedding_cube(spark, sf))
    made = R.reduce(c, "perm:onesample", signs=signs_at, spatial="cluster", cluster_threshold=1.5).df
    return out(made, "sample", "cluster_id", ("p", "p_cluster_fwer", 8))


@query("combine_lancaster")
def combine_lancaster(spark, sf):
    return out(R.lancaster(p_cube(spark, sf)), *CELL, ("chi2", "chi2", 4), "df", "n_eff")


def repeated_cube(spark, sf):
    c = brand_cube(spark, sf)
    return c.with_df(c.df.withColumn("beta", F.col("beta") / 1000).withColumn("var", F.col("var") / 1e6))


@query("lmm_ri", f"""WITH {CELLS}, k AS (SELECT DISTINCT sample FROM cells), c AS (SELECT sample, subject, beta / 1000 AS y FROM cells), n AS (SELECT count(DISTINCT subject) AS n, (SELECT count(DISTINCT contrast) FROM cells) AS k FROM cells),
o AS (SELECT sample FROM c GROUP BY 1 HAVING count(y) = (SELECT n * k FROM n)), m AS (SELECT sample, subject, avg(y) AS m, sum(y * y) - count(*) * avg(y) ** 2 AS within FROM c WHERE sample IN (FROM o) GROUP BY ALL),
a AS (SELECT sample, avg(m) AS mean, var_samp(m) AS vb, sum(within) AS ssw, count(*) AS n FROM m GROUP BY 1)
SELECT k.sample, round(mean, 3) AS b0, round(sqrt(CASE WHEN vb * kk > ssw / (a.n * (kk - 1)) THEN vb / a.n ELSE ((a.n - 1) * kk * vb + ssw) / (a.n * kk - 1) / (a.n * kk) END), 3) AS se FROM k LEFT JOIN a ON a.sample = k.sample, (SELECT k AS kk FROM n)""")
def lmm_ri(spark, sf):
    made = R.reduce(repeated_cube(spark, sf), "lmm:ri").df
    return out(made, "sample", ("b0", "coef:(Intercept)", 3), ("se", "se_coef:(Intercept)", 3))


@query("lmm_ri_knownvar")
def lmm_ri_knownvar(spark, sf):
    c = repeated_cube(spark, sf)
    return out(R.reduce(c, "lmm:ri_knownvar").df, "sample", ("b0", "coef:(Intercept)", 2))


@query("lmm_slope")
def lmm_slope(spark, sf):
    c = repeated_cube(spark, sf)
    c = c.with_(contrasts=c.contrasts.withColumn("time", F.col("ord").cast("double")))
    return out(R.reduce(c, "lmm:ri_slope1", slope="time").df, "sample", ("b0", "coef:(Intercept)", 2), ("b1", "coef:time", 2))


# --- corrections


def _bh_sql(by: bool) -> str:
    factor = "list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i))" if by else "1"
    return f"""WITH {CELLS}, {PCELLS}, k AS (SELECT *, count(*) OVER (PARTITION BY subject, contrast) AS m, rank() OVER (PARTITION BY subject, contrast ORDER BY p) + count(*) OVER (PARTITION BY subject, contrast, p) - 1 AS r FROM ps)
SELECT sample, subject, contrast, round(least(1, min(p * m / r * {factor}) OVER (PARTITION BY subject, contrast ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 10) AS q FROM k"""


@query("fdr_bh", _bh_sql(False))
def fdr_bh(spark, sf):
    return out(H.posthoc(p_cube(spark, sf), "fdr:bh").df, *KEYS, ("q", "q", 10))


@query("fdr_by", _bh_sql(True))
def fdr_by(spark, sf):
    return out(H.posthoc(p_cube(spark, sf), "fdr:by").df, *KEYS, ("q", "q", 10))


@query("fdr_bh_ranges", _bh_sql(False))
def fdr_bh_ranges(spark, sf):
    return out(H.posthoc(p_cube(spark, sf), "fdr:bh", partitions=8).df, *KEYS, ("q", "q", 10))


def grouped_p_cube(spark, sf):
    c = p_cube(spark, sf)
    return c.with_(samples=c.samples.withColumn("parcel", F.substring("id", 7, 1)))


@query("fdr_spatial", f"""WITH {CELLS}, {PCELLS}, z AS (SELECT substring(sample, 7, 1) AS grp, count(*) AS size FROM (SELECT DISTINCT sample FROM cells) GROUP BY 1),
g AS (SELECT *, substring(sample, 7, 1) AS grp, row_number() OVER (PARTITION BY subject, contrast, substring(sample, 7, 1) ORDER BY p) AS r, count(*) OVER (PARTITION BY subject, contrast, substring(sample, 7, 1)) AS m FROM ps),
s AS (SELECT subject, contrast, grp, min(p * m / r) AS simes FROM g GROUP BY ALL), w AS (SELECT *, simes * (SELECT avg(size) FROM z) / size AS pw FROM s JOIN z USING (grp)),
k AS (SELECT *, row_number() OVER (PARTITION BY subject, contrast ORDER BY pw, grp) AS r FROM w), q AS (SELECT *, least(1, min((SELECT count(*) FROM z) * pw / r) OVER (PARTITION BY subject, contrast ORDER BY r DESC)) AS q FROM k)
SELECT sample, subject, contrast, round(q, 10) AS q FROM g JOIN q USING (subject, contrast, grp)""")
def fdr_spatial(spark, sf):
    return out(H.posthoc(grouped_p_cube(spark, sf), "fdr:spatial").df, *KEYS, ("q", "q", 10))


@query("fdr_sabha", f"""WITH {CELLS}, {PCELLS}, g AS (SELECT *, substring(sample, 7, 1) AS grp FROM ps), pi AS (SELECT subject, contrast, grp, least(1, greatest(0.05, least(1, count(*) FILTER (p > 0.5) / (0.5 * count(*))))) AS pi0 FROM g GROUP BY ALL),
w AS (SELECT g.*, pi0, (1 / pi0) * count(*) OVER f / sum(1 / pi0) OVER f AS wt FROM g JOIN pi USING (subject, contrast, grp) WINDOW f AS (PARTITION BY subject, contrast)), k AS (SELECT *, least(1, p / wt) AS pw, count(*) OVER (PARTITION BY subject, contrast) AS m FROM w),
r AS (SELECT *, rank() OVER (PARTITION BY subject, contrast ORDER BY pw) + count(*) OVER (PARTITION BY subject, contrast, pw) - 1 AS r FROM k)
SELECT sample, subject, contrast, round(pi0, 10) AS pi0, round(wt, 10) AS weight, round(least(1, min(pw * m / r) OVER (PARTITION BY subject, contrast ORDER BY pw DESC RANGE UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def fdr_sabha(spark, sf):
    return out(H.posthoc(grouped_p_cube(spark, sf), "fdr:sabha").df, *KEYS, ("pi0", "pi0", 10), ("weight", "weight", 10), ("q", "q", 9))


# --- examination

_LOO = f"""WITH {CELLS}, {VALID}, a AS (SELECT *, sum(w) OVER f AS sw, sum(w * y) OVER f AS s, count(*) OVER f AS k FROM valid WINDOW f AS (PARTITION BY sample, contrast)),
l AS (SELECT sample, contrast, subject, y, CASE WHEN k >= 3 THEN (s - w * y) / (sw - w) END AS expected, w / sw AS leverage, v + 1 / (sw - w) AS pv, sw - w AS rest, s / sqrt(sw) AS z FROM a),
loo AS (SELECT *, (y - expected) / sqrt(pv) AS resid, z - expected * sqrt(rest) AS delta_stat FROM l)"""


@query("loo_fe", f"{_LOO} SELECT sample, contrast, subject, round(expected, 3) AS expected, round(resid, 6) AS resid, round(leverage, 8) AS leverage, round(delta_stat, 5) AS delta_stat FROM loo")
def loo_fe(spark, sf):
    return out(E.leave_one_out_fe(brand_cube(spark, sf)), *CELL, "subject", ("expected", "expected", 3), ("resid", "resid", 6), ("leverage", "leverage", 8), ("delta_stat", "delta_stat", 5))


@query("loo_re", f"""WITH {CELLS}, {VALID}, {FE}, t AS (SELECT sample, contrast, k, greatest(0, (q - (k - 1)) / greatest(sw - sw2 / sw, 1e-12)) AS tau2 FROM q), a AS (SELECT valid.*, tau2, k, 1 / (v + tau2) AS u FROM valid JOIN t USING (sample, contrast)),
b AS (SELECT *, sum(u) OVER f AS su, sum(u * y) OVER f AS s FROM a WINDOW f AS (PARTITION BY sample, contrast))
SELECT sample, contrast, subject, round(tau2 / 1e6, 5) AS tau2_m, round((y - (s - u * y) / (su - u)) / sqrt(1 / u + 1 / (su - u)), 6) AS resid, round(s / sqrt(su) - (s - u * y) / sqrt(su - u), 5) AS delta_stat FROM b WHERE k >= 2""")
def loo_re(spark, sf):
    made = E.leave_one_out_re(brand_cube(spark, sf))
    return out(made, *CELL, "subject", ("tau2_m", F.col("tau2") / 1e6, 5), ("resid", "resid", 6), ("delta_stat", "delta_stat", 5))


_PART = "('0x' || right(md5(sample || '|' || contrast), 7))::BIGINT % 2"
_SURPRISE = f"""parts AS (SELECT *, {_PART} AS part FROM loo WHERE resid IS NOT NULL),
half AS (SELECT subject, contrast, part, sqrt(avg(least(resid * resid, 64))) >= 2.5 AND avg((abs(resid) >= 3)::INT) >= 0.01 AS passed FROM parts GROUP BY ALL), halves AS (SELECT subject, contrast, avg(passed::INT) AS stability FROM half GROUP BY ALL),
sur AS (SELECT subject, contrast, count(*) AS n, sqrt(avg(least(resid * resid, 64))) AS energy, avg((abs(resid) >= 3)::INT) AS tail_extent FROM parts GROUP BY ALL), surprise AS (SELECT * FROM sur JOIN halves USING (subject, contrast))"""
_AGREE = """p AS (SELECT *, 1 / pv AS pw FROM loo WHERE resid IS NOT NULL), s AS (SELECT subject, contrast, sum(pw) AS sw, sum(pw * y) AS sy, sum(pw * expected) AS se, sum(pw * y * y) AS syy, sum(pw * expected * expected) AS see, sum(pw * y * expected) AS sye,
  sum(pw * (sign(y) = sign(expected))::INT) AS sg FROM p GROUP BY ALL), v AS (SELECT *, syy - sy * sy / sw AS vy, see - se * se / sw AS ve FROM s),
agreement AS (SELECT subject, contrast, CASE WHEN ve > 1e-12 AND vy > 1e-12 THEN (sye - sy * se / sw) / sqrt(vy * ve) END AS correlation, CASE WHEN ve <= 1e-12 THEN 'degenerate_expected' WHEN vy <= 1e-12 THEN 'degenerate_observed' ELSE 'available' END AS correlation_status,
  CASE WHEN see > 1e-12 AND syy > 1e-12 THEN sye / sqrt(syy * see) END AS cosine, CASE WHEN see > 1e-12 THEN sye / see END AS gain, sg / sw AS concordance FROM v)"""
_INFLUENCE = f"""moved AS (SELECT *, abs(delta_stat) AS d, {_PART} AS part FROM loo WHERE delta_stat IS NOT NULL), ihalf AS (SELECT subject, contrast, part, sqrt(avg(least(d * d, 64))) >= 1 AS passed FROM moved GROUP BY ALL),
ihalves AS (SELECT subject, contrast, avg(passed::INT) AS stability FROM ihalf GROUP BY ALL), edges AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 4, 8, 16])::DOUBLE AS edge),
upto AS (SELECT subject, contrast, edge, count(*) FILTER (d <= edge) AS below, count(*) AS n FROM moved, edges GROUP BY ALL), quant AS (SELECT subject, contrast, min(edge) FILTER (below >= 0.9 * n) AS q90, min(edge) FILTER (below >= 0.95 * n) AS q95, min(edge) FILTER (below >= 0.99 * n) AS q99 FROM upto GROUP BY ALL),
inf AS (SELECT subject, contrast, count(*) AS n, sqrt(avg(least(d * d, 64))) AS energy, max(d) AS most, count(*) FILTER (d <= 0.01) AS bin0, count(*) FILTER (d > 2 AND d <= 4) AS bin8, count(*) FILTER (d > 16) AS bin11 FROM moved GROUP BY ALL),
influence AS (SELECT inf.*, coalesce(q90, most) AS q90, coalesce(q95, most) AS q95, coalesce(q99, most) AS q99, stability FROM inf JOIN quant USING (subject, contrast) JOIN ihalves USING (subject, contrast))"""
_COVERAGE = """share AS (SELECT subject, contrast, count(beta)::DOUBLE / (SELECT count(DISTINCT sample) FROM cells) AS c FROM cells GROUP BY ALL),
coverage AS (SELECT subject, CASE WHEN count(*) = (SELECT count(DISTINCT contrast) FROM cells) THEN min(c) ELSE 0 END AS coverage FROM share GROUP BY 1)"""


@query("surprise_summary", f"{_LOO}, {_SURPRISE} SELECT subject, contrast, n, round(energy, 6) AS energy, round(tail_extent, 8) AS tail_extent, round(stability, 8) AS stability FROM surprise")
def surprise_summary(spark, sf):
    return out(E.surprise(E.leave_one_out_fe(brand_cube(spark, sf))), "subject", "contrast", "n", ("energy", "energy", 6), ("tail_extent", "tail_extent", 8), ("stability", "stability", 8))


@query("agreement_summary", f"{_LOO}, {_AGREE} SELECT subject, contrast, round(correlation, 6) AS correlation, correlation_status, round(cosine, 6) AS cosine, round(gain, 6) AS gain, round(concordance, 6) AS concordance FROM agreement")
def agreement_summary(spark, sf):
    made = E.agreement(E.leave_one_out_fe(brand_cube(spark, sf)))
    return out(made, "subject", "contrast", ("correlation", "correlation", 6), "correlation_status", ("cosine", "cosine", 6), ("gain", "gain", 6), ("concordance", "concordance", 6))


@query("influence_summary", f"{_LOO}, {_INFLUENCE} SELECT subject, contrast, n, round(energy, 6) AS energy, round(most, 6) AS most, bin0, bin8, bin11, round(q90, 6) AS q90, round(q95, 6) AS q95, round(q99, 6) AS q99, round(stability, 8) AS stability FROM influence")
def influence_summary(spark, sf):
    made = E.influence(E.leave_one_out_fe(brand_cube(spark, sf)))
    return out(made, "subject", "contrast", "n", ("energy", "influence_energy", 6), ("most", "influence_max", 6), "bin0", "bin8", "bin11", *((q, q, 6) for q in ("q90", "q95", "q99")), ("stability", "stability", 8))


@query("influence_map", f"{_LOO}, m AS (SELECT *, max(abs(delta_stat)) OVER (PARTITION BY sample, contrast) AS top FROM loo WHERE delta_stat IS NOT NULL) SELECT sample, contrast, round(first(top), 6) AS top, min(subject) FILTER (abs(delta_stat) >= top - 1e-12) AS subject, count(*) AS eligible FROM m GROUP BY ALL")
def influence_map(spark, sf):
    return out(E.influence_map(E.leave_one_out_fe(brand_cube(spark, sf))), *CELL, ("top", "max_influence", 6), "subject", "eligible")


@query("review_queue", f"""{_LOO}, {_SURPRISE}, {_AGREE}, {_INFLUENCE}, {_COVERAGE},
sx AS (SELECT subject, max(energy) AS score, min(struct_pack(contrast := contrast, gain := gain)) FILTER (energy >= 2.5 AND tail_extent >= 0.01 AND stability >= 0.7) AS hit FROM surprise LEFT JOIN agreement USING (subject, contrast) GROUP BY 1),
ix AS (SELECT subject, max(energy) AS score, min(contrast) FILTER (energy >= 1 AND most >= 2 AND stability >= 0.7) AS hit FROM influence GROUP BY 1),
aa AS (SELECT coverage.subject, coverage, 1 - coverage AS q, sx.score AS s, ix.score AS i, sx.hit AS shit, ix.hit AS ihit FROM coverage LEFT JOIN sx USING (subject) LEFT JOIN ix USING (subject)),
rr AS (SELECT *, {', '.join(f"CASE WHEN {c} IS NULL THEN NULL WHEN count({c}) OVER () = 1 THEN 1 ELSE (count({c}) OVER (ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 1)::DOUBLE / (count({c}) OVER () - 1) END AS p{c}" for c in "qsi")} FROM aa),
tt AS (SELECT *, greatest(pq, ps, pi) AS priority, CASE WHEN coverage <= 0.8 THEN pq ELSE -2 END AS tq, CASE WHEN shit IS NOT NULL THEN ps ELSE -2 END AS ts, CASE WHEN ihit IS NOT NULL THEN pi ELSE -2 END AS ti FROM rr),
uu AS (SELECT *, greatest(tq, ts, ti) AS m, row_number() OVER (ORDER BY priority DESC NULLS LAST, subject) AS place FROM tt),
ww AS (SELECT *, CASE WHEN m = -2 THEN NULL WHEN tq = m THEN 'quality' WHEN ts = m THEN 'surprise' ELSE 'influence' END AS source FROM uu)
SELECT subject, round(coverage, 8) AS coverage, round(priority, 8) AS priority, CASE WHEN source IS NULL THEN 'none' ELSE 'review' END AS status, source,
  CASE source WHEN 'quality' THEN 'coverage' WHEN 'surprise' THEN CASE WHEN shit.gain < 0 THEN 'negative gain in ' ELSE 'surprise in ' END || shit.contrast WHEN 'influence' THEN 'influence in ' || ihit END AS reason, source IS NOT NULL OR place <= 5 AS retained FROM ww""")
def review_queue(spark, sf):
    c = brand_cube(spark, sf)
    made = E.review_queue(E.contrast_table(c, E.leave_one_out_fe(c)))
    return out(made, "subject", ("coverage", "coverage", 8), ("priority", "priority", 8), "status", "source", "reason", "retained")


@query("coverage", f"WITH {CELLS}, {_COVERAGE} SELECT subject, round(coverage, 8) AS coverage FROM coverage")
def coverage(spark, sf):
    return out(E.coverage_of(brand_cube(spark, sf)), "subject", ("coverage", "coverage", 8))


@query("conclusions")
def conclusions(spark, sf):
    c = brand_cube(spark, sf)
    return E.conclusions(c, E.leave_one_out_fe(c))


@query("geometry")
def geometry(spark, sf):
    c = brand_cube(spark, sf)
    return E.placed(E.leave_one_out_fe(c), c.subjects.select("ord", F.col("id").alias("subject"))).drop("ord")


_DELETE = """t AS (SELECT *, sum(w) OVER f AS s0, sum(w * x) OVER f AS sx, sum(w * x * x) OVER f AS sxx, sum(w * y) OVER f AS sy, sum(w * x * y) OVER f AS sxy, sum(w * y * y) OVER f AS syy, count(*) OVER f AS n FROM v WINDOW f AS (PARTITION BY sample, contrast)),
m AS (SELECT *, s0 - w AS m0, sx - w * x AS mx, sxx - w * x * x AS mxx, sy - w * y AS my, sxy - w * x * y AS mxy, syy - w * y * y AS myy FROM t), d AS (SELECT *, m0 * mxx - mx * mx AS dm, s0 * sxx - sx * sx AS ds FROM m),
b AS (SELECT *, (sxx * sy - sx * sxy) / ds AS b0, (s0 * sxy - sx * sy) / ds AS b1, (mxx * my - mx * mxy) / dm AS c0, (m0 * mxy - mx * my) / dm AS c1, w * (sxx - 2 * x * sx + x * x * s0) / ds AS h, (mxx - 2 * x * mx + x * x * m0) / dm AS g FROM d),
q AS (SELECT *, (syy - b0 * sy - b1 * sxy) / (n - 2) AS k2, (myy - c0 * my - c1 * mxy) / (n - 3) AS k1 FROM b),
every AS (SELECT sample, contrast, subject FROM (SELECT DISTINCT sample, contrast FROM v), (SELECT DISTINCT subject FROM cells))"""
_POINTS = f"WITH {CELLS}, x AS (SELECT sample, contrast, subject, beta AS y, s_acctbal / 1000 AS x, var FROM cells JOIN supplier ON s_suppkey::VARCHAR = subject)"


def _loo_linear(method):
    def run(spark, sf):
        c = account_cube(spark, sf)
        rows = [x.asDict() for x in c.subjects.orderBy("ord").collect()]
        made = E.leave_one_out_linear(c, M.design(rows, "id", "~ acct"), method)
        return out(made, *CELL, "subject", ("resid", "resid", 5), ("leverage", "leverage", 7), ("delta_stat", "delta_stat:acct", 5))

    return run


query("loo_ols", f"""{_POINTS}, v AS (SELECT *, 1.0::DOUBLE AS w FROM x WHERE y IS NOT NULL), {_DELETE}
SELECT sample, contrast, subject, round((y - c0 - c1 * x) * sqrt((1 - h) / k1), 5) AS resid, round(h, 7) AS leverage, round(coalesce(b1 / sqrt(k2 * s0 / ds) - c1 / sqrt(k1 * m0 / dm), 0), 5) AS delta_stat FROM every LEFT JOIN q USING (sample, contrast, subject)""")(_loo_linear("ols:voxelwise"))
query("loo_fe_reg", f"""{_POINTS}, v AS (SELECT *, 1 / var AS w FROM x WHERE var > 0), {_DELETE}
SELECT sample, contrast, subject, round((y - c0 - c1 * x) / sqrt(var + g), 5) AS resid, round(h, 7) AS leverage, round(coalesce(b1 / sqrt(s0 / ds) - c1 / sqrt(m0 / dm), 0), 5) AS delta_stat FROM every LEFT JOIN q USING (sample, contrast, subject)""")(_loo_linear("meta:fe_reg"))
query("loo_re_reg", f"""{_POINTS}, u AS (SELECT *, 1 / var AS w FROM x WHERE var > 0), a AS (SELECT sample, contrast, sum(w) AS s0, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * w) AS t0, sum(w * w * x) AS tx, sum(w * w * x * x) AS txx, count(*) AS k FROM u GROUP BY ALL),
e AS (SELECT *, s0 * sxx - sx * sx AS det FROM a), o AS (SELECT u.sample, u.contrast, first(k) AS k, first(s0 - (sxx * t0 - 2 * sx * tx + s0 * txx) / det) AS tr, sum(w * (y - (sxx * sy - sx * sxy) / det - (s0 * sxy - sx * sy) / det * x) ** 2) AS q FROM u JOIN e ON u.sample = e.sample AND u.contrast = e.contrast GROUP BY ALL),
v AS (SELECT u.* EXCLUDE (w, var), var + greatest(0, (q - (k - 2)) / tr) AS var, 1 / (var + greatest(0, (q - (k - 2)) / tr)) AS w FROM u JOIN o USING (sample, contrast)), {_DELETE.replace("q AS (SELECT *, (syy", "z AS (SELECT *, (syy")}
SELECT sample, contrast, subject, round((y - c0 - c1 * x) / sqrt(var + g), 5) AS resid, round(h, 7) AS leverage, round(coalesce(b1 / sqrt(s0 / ds) - c1 / sqrt(m0 / dm), 0), 5) AS delta_stat FROM every LEFT JOIN z USING (sample, contrast, subject)""")(_loo_linear("meta:re_reg"))


# --- catalogs, streams

_URL = r"^https?://([^/]+)/"


@query("catalog_extract", r"SELECT url AS file, regexp_extract(url, '([^/]*)$', 1) AS basename, nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS host FROM pages")
def catalog_extract(spark, sf):
    cat = G.catalog(read(spark, sf, "pages"), "url")
    return G.extract_meta(cat, r"^https?://(?<host>[^/]+)/", "file").select("file", "basename", "host")


@query("catalog_validate", r"""WITH c AS (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS g, (page_id % 4)::VARCHAR AS v FROM pages WHERE regexp_matches(url, '^https?://([^/]+)/')), s AS (SELECT g, v, count(*) AS n FROM c GROUP BY ALL)
SELECT a.g AS "group", 'missing' AS issue, b.v AS value FROM (SELECT DISTINCT g FROM s) a, (SELECT DISTINCT v FROM s) b ANTI JOIN s ON s.g = a.g AND s.v = b.v UNION ALL SELECT g, 'repeated', v FROM s WHERE n > 1""")
def catalog_validate(spark, sf):
    pages = read(spark, sf, "pages")
    cat = pages.where(F.col("url").rlike(_URL)).select(F.regexp_extract("url", _URL, 1).alias("host"), (F.col("page_id") % 4).cast("string").alias("part"))
    return G.validate(cat, "host", "part")


@query("join_meta", "SELECT o_orderkey, o_orderstatus, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_meta(spark, sf):
    right = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return G.join_meta(read(spark, sf, "orders"), right, "o_custkey").select("o_orderkey", "o_orderstatus", "c_mktsegment")


@query("map_assays", r"SELECT CASE WHEN regexp_matches(url, '/a') THEN 'first' WHEN regexp_matches(url, '/[0-9]') THEN 'number' END AS assay, count(*) AS n FROM pages GROUP BY 1")
def map_assays(spark, sf):
    cat = G.catalog(read(spark, sf, "pages"), "url")
    return G.map_assays(cat, {"first": "/a", "number": "/[0-9]"}, "file").groupBy("assay").agg(F.count("*").alias("n"))


@query("incremental_fe", f"""WITH {CELLS}, {VALID}, m AS (SELECT sample, contrast, sum(w * y) / sum(w) AS mu, count(*) AS k FROM valid GROUP BY ALL) SELECT sample, contrast, k AS n_eff, round(first(mu), 3) AS beta, round(sum(w * (y - mu) ** 2), 3) AS Q FROM valid JOIN m USING (sample, contrast) GROUP BY ALL""")
def incremental_fe(spark, sf):
    return out(I.finish(I.meta_fe_sums(brand_cells(spark, sf), 38000.0), 38000.0), *CELL, "n_eff", ("beta", "beta", 3), ("Q", "Q", 3))


@query("frame_projection", "SELECT user_id::VARCHAR || ':' || event_type AS observation, strftime(ts, '%H') AS feature, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def frame_projection(spark, sf):
    rows = read(spark, sf, "events").groupBy(F.date_format("ts", "HH").alias("sample"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("contrast")).agg(F.avg("value").alias("beta"))
    return out(S.unstack_frame(S.from_table(rows, dedupe=False)), "observation", "feature", ("value", "value", 6))
