"""File catalogs: patterns, captured metadata, joins, validation."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ** any folders, * and ? within one name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
            i += 1
    return f"^{out}$"


def catalog(paths: DataFrame, column: str = "file", root: str = "", pattern: str | None = None) -> DataFrame:
    """(file, basename, relpath) of a table of paths, those that match the glob below ``root``."""
    file = F.col(column)
    rel = F.when(file.startswith(root), F.substring(file, len(root) + 1, 1 << 30)).otherwise(file) if root else file
    out = paths.select(file.alias("file"), F.regexp_extract(file, r"([^/]*)$", 1).alias("basename"), F.regexp_replace(rel, "^/", "").alias("relpath"))
    return out.where(F.col("relpath").rlike(glob_regex(pattern))) if pattern else out


def list_files(spark: SparkSession, root: str, pattern: str = "**") -> DataFrame:
    """A catalog of the files below a folder, listed by Spark so that any store will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("file"))
    return catalog(files, root=re.sub("^file:/+", "/", root), pattern=pattern)


def extract_meta(cat: DataFrame, regex: str, source: str = "relpath") -> DataFrame:
    """A column for each named group of a regular expression; no match or an empty capture is null."""
    names = re.findall(r"\(\?P?<([A-Za-z]\w*)>", regex)
    if not names:
        raise ValueError("the expression names no group")
    java = re.sub(r"\(\?P<", "(?<", regex)
    order = {m: i for i, m in enumerate(re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", java)).groupindex.values())}
    index = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", java)).groupindex
    assert len(order) == len(names)
    hit = F.col(source).rlike(java)
    return cat.select("*", *[F.when(hit, F.nullif(F.regexp_extract(source, java, index[n]), F.lit(""))).alias(n) for n in names])


def assign_meta(cat: DataFrame, name: str, regex: str, replacement: str, source: str = "basename") -> DataFrame:
    """A column from a pattern and a replacement with back-references ($1); no match is null."""
    return cat.withColumn(name, F.when(F.col(source).rlike(regex), F.regexp_replace(F.regexp_extract(source, f"({regex})", 1), regex, replacement)))


def join_meta(cat: DataFrame, table: DataFrame, by, suffix: str = ".external") -> DataFrame:
    """Left join with a table of unique keys; clashing columns of the table get the suffix."""
    by = [by] if isinstance(by, str) else list(by)
    if not table.groupBy(*by).count().where("count > 1").isEmpty():
        raise ValueError("the keys of the joined table repeat")
    for c in table.columns:
        if c not in by and c in cat.columns:
            table = table.withColumnRenamed(c, f"{c}{suffix}")
    return cat.join(table, by, "left")


def map_assays(cat: DataFrame, rules: dict[str, str], source: str = "basename") -> DataFrame:
    """An ``assay`` column: the first rule whose expression matches, else null."""
    out = F.lit(None).cast("string")
    for name, regex in reversed(rules.items()):
        out = F.when(F.col(source).rlike(regex), F.lit(name)).otherwise(out)
    return cat.withColumn("assay", out)


def _lacking(groups: DataFrame, seen: DataFrame, wanted: DataFrame) -> DataFrame:
    """(group, value): wanted values that a group lacks. Only values that some group lacks meet the groups."""
    n = groups.count()
    short = wanted.join(seen.join(groups, "group", "left_semi").groupBy("value").agg(F.count_distinct("group").alias("n")), "value", "left").where(F.coalesce("n", F.lit(0)) < n).select("value")
    return groups.crossJoin(short).join(seen, ["group", "value"], "left_anti")  # at least one row in each value's column is a finding


def validate(cat: DataFrame, by: str, expect: str) -> DataFrame:
    """Issues (group, issue, value): values of ``expect`` that a group lacks against all groups' union, or repeats."""
    seen = cat.where(F.col(by).isNotNull() & F.col(expect).isNotNull()).groupBy(F.col(by).alias("group"), F.col(expect).alias("value")).count()
    lacking = _lacking(seen.select("group").distinct(), seen, seen.select("value").distinct()).select("group", F.lit("missing").alias("issue"), "value")
    return lacking.unionByName(seen.where("count > 1").select("group", F.lit("repeated").alias("issue"), "value"))


def consistency(cat: DataFrame, by: str = "subject", value: str = "basename", expect: list[str] | None = None) -> DataFrame:
    """Issues (group, issue, value) against a reference: the expected values, else those of the least group.

    ``missing`` are reference values that a group lacks; without ``expect``, ``extra`` are values that the reference lacks.
    """
    if by not in cat.columns:
        raise ValueError(f"no column {by}")
    seen = cat.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(F.col(by).cast("string").alias("group"), F.col(value).cast("string").alias("value")).distinct()
    groups = seen.select("group").distinct()
    if expect is not None:
        wanted = cat.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(expect)], "value string")
        return _lacking(groups, seen, wanted).select("group", F.lit("missing").alias("issue"), "value")
    first = groups.agg(F.min("group").alias("group"))
    wanted = seen.join(F.broadcast(first), "group", "left_semi").select("value")
    extra = seen.join(wanted, "value", "left_anti").select("group", F.lit("extra").alias("issue"), "value")
    return _lacking(groups, seen, wanted).select("group", F.lit("missing").alias("issue"), "value").unionByName(extra)


def subset(cat: DataFrame, condition) -> DataFrame:
    """The rows for which a condition (SQL text or a column) is true; null counts as false."""
    return cat.where(condition)


def unique(cat: DataFrame, column: str = "subject") -> DataFrame:
    """The distinct values of a metadata column."""
    if column not in cat.columns:
        raise ValueError(f"no column {column} in the catalog")
    return cat.select(column).distinct()


def summary(cat: DataFrame, by: str) -> DataFrame:
    return cat.groupBy(by).agg(F.count("*").alias("files"))


def write_catalog(cat: DataFrame, path: str) -> None:
    with open(path, "w") as f:
        json.dump({"version": "1.0.0", "columns": cat.columns, "rows": [list(r) for r in cat.collect()]}, f)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    with open(path) as f:
        found = json.load(f)
    if found["version"].split(".")[0] != "1":
        raise ValueError(f"catalog version {found['version']} is not read")
    return spark.createDataFrame([tuple(r) for r in found["rows"]], ", ".join(f"`{c}` string" for c in found["columns"]))


def harmonise(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Replace values by a table (old, new); others stay."""
    pairs = names.select(F.col("old").cast("string").alias("__old"), F.col("new").cast("string").alias("__new"))
    return df.join(pairs, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")
