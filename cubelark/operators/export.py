"""Sinks: tidy tables, CSV, Parquet, bundles (Parquet and JSON), images, reports."""

from __future__ import annotations

import html
import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import AXIS, KEYS, Cube, Space
from ..sources import nifti


def tidy(cube: Cube, assays=None, drop_na: bool = False, include_col_data: bool = False) -> DataFrame:
    """Every cell of the axes' grid; ``drop_na`` drops those with all measures null, and then no grid is built."""
    assays = list(assays or cube.assays)
    if drop_na:
        out = cube.df.select(*KEYS, *[f"`{a}`" for a in assays]).na.drop(how="all", subset=[a for a in assays])
    else:
        out = cube.dense([f"`{a}`" for a in assays]).select(*KEYS, *[f"`{a}`" for a in assays])
    if include_col_data:
        rest = [c for c in cube.subjects.columns if c != "ord" and c not in out.columns]
        out = out.join(F.broadcast(cube.subjects.select(F.col("id").alias("subject"), *[c for c in rest if c != "id"])), "subject", "left")
    return out


def write_bundle(cube: Cube, path: str) -> None:
    """A folder: assays/, axes/*/ as Parquet and meta/ as one JSON row, so that any shared store will do."""
    cube.df.write.mode("overwrite").parquet(f"{path}/assays")
    for key, name in AXIS.items():
        cube.axis(key).write.mode("overwrite").parquet(f"{path}/axes/{name}")
    for name, table in cube.attachments.items():
        table.write.mode("overwrite").parquet(f"{path}/attachments/{re.sub(r'[^A-Za-z0-9]+', '_', name)}")
    head = {"schema": "1.0", "assays": list(cube.assays), "space": {"kind": cube.space.kind, "dims": cube.space.dims, "affine": cube.space.affine}, "meta": {k: v for k, v in cube.meta.items() if isinstance(v, (str, int, float, bool, list, dict, type(None)))}}
    cube.df.sparkSession.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_bundle(spark: SparkSession, path: str) -> Cube:
    head = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if head["schema"].split(".")[0] != "1":
        raise ValueError(f"bundle schema {head['schema']} is not read")
    space = head["space"]
    axes = {name: spark.read.parquet(f"{path}/axes/{name}") for name in AXIS.values()}
    return Cube(spark.read.parquet(f"{path}/assays"), **axes, assays=tuple(head["assays"]), space=Space(space["kind"], tuple(space["dims"]), tuple(map(tuple, space["affine"]))), meta=head["meta"])


def write_out(cube: Cube, path: str, format: str = "parquet", **options) -> None:
    if format == "parquet":
        tidy(cube, **options).write.mode("overwrite").parquet(path)
    elif format == "csv":
        tidy(cube, **options).write.mode("overwrite").csv(path, header=True)
    elif format == "bundle":
        write_bundle(cube, path)
    elif format == "nifti":
        write_images(cube, path, **options)
    else:
        raise ValueError("format is parquet, csv, bundle or nifti")


def sanitise(name: str) -> str:
    """A name fit for a file: runs of other characters become one dash."""
    return re.sub(r"[^A-Za-z0-9]+", "-", name).strip("-") or "x"


def write_images(cube: Cube, path: str, assays=None, prefix: str = "map", overwrite: bool = False) -> DataFrame:
    """An image of each (assay, subject, contrast), written by tasks to a shared folder; returns the manifest.

    Names that collide after sanitising are an error; existing files are skipped unless ``overwrite``.
    """
    if cube.space.kind != "voxel":
        raise ValueError("images need a voxel space")
    assays = list(assays or cube.assays)
    names = [(a, s, c, f"{prefix}_sub-{sanitise(s)}_con-{sanitise(c)}_{sanitise(a)}.nii") for a in assays for s in cube.ids("subject") for c in cube.ids("contrast")]
    if len({n[3] for n in names}) != len(names):
        raise ValueError("file names collide after sanitising")
    os.makedirs(path, exist_ok=True)
    dims, affine = cube.space.dims, np.array(cube.space.affine or np.eye(4))
    place = {(s, c): f for _, s, c, f in names}
    cells = cube.df.join(cube.samples.select(F.col("id").alias("sample"), "voxel"), "sample")

    def run(key, pdf):
        import pandas as pd

        rows = []
        for a in assays:
            name = re.sub(r"_[^_]*\.nii$", f"_{sanitise(a)}.nii", place[(key[0], key[1])])
            target = f"{path}/{name}"
            skip = os.path.exists(target) and not overwrite
            if not skip:
                volume = np.zeros(int(np.prod(dims)))
                volume[pdf["voxel"].to_numpy(int)] = pdf[a].to_numpy(float)
                with open(target, "wb") as f:
                    f.write(nifti.build(np.nan_to_num(volume).reshape(dims, order="F"), affine))
            rows.append((a, key[0], key[1], target, not skip, "exists" if skip else None))
        return pd.DataFrame(rows, columns=["assay", "subject", "contrast", "path", "written", "skipped_reason"])

    return cells.groupBy("subject", "contrast").applyInPandas(run, "assay string, subject string, contrast string, path string, written boolean, skipped_reason string")


def report(tables: dict[str, DataFrame], title: str = "Examination", rows: int = 50) -> str:
    """A self-contained HTML page of the first rows of small tables."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, table in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in table.limit(rows).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)
