"""NIfTI-1 images as cells, from Spark's binary files: a header of 348 bytes, then the voxels."""

from __future__ import annotations

import gzip
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube, Space
from .tabular import from_table

#: Data types by code.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: Trailing tokens of a file name that tell the statistic.
STATISTICS = ("beta", "cope", "varcope", "var", "variance", "effect", "se", "stderr", "sterr", "sigma", "std")


def parse(raw: bytes) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """(shape, affine, values in file order) of an image, gzipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) < 348:
        raise ValueError("not an image: shorter than its header")
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(end + "i", raw[:4])[0] != 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 image")
    dim = struct.unpack(end + "8h", raw[40:56])
    code = struct.unpack(end + "h", raw[70:72])[0]
    pixdim = struct.unpack(end + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(end + "3f", raw[108:120])
    sform = struct.unpack(end + "h", raw[254:256])[0]
    if code not in TYPES:
        raise ValueError(f"data type {code} is not read")
    if sform > 0:
        affine = np.vstack([np.array(struct.unpack(end + "12f", raw[280:328])).reshape(3, 4), [0, 0, 0, 1]])
    else:
        affine = np.diag([*pixdim[1:4], 1.0])
    shape = tuple(max(1, d) for d in dim[1 : 1 + max(3, dim[0])])
    values = np.frombuffer(raw, end + TYPES[code], int(np.prod(shape)), int(offset)).astype(float)
    if slope not in (0.0, 1.0) or inter:
        values = values * (slope or 1.0) + inter
    return shape, affine, values


def build(values: np.ndarray, affine: np.ndarray) -> bytes:
    """An image of an array of three or four dimensions, 64-bit floats."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((affine[:3, :3] ** 2).sum(0)), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype("<f8").tobytes(order="F")


def subject_key(path: str) -> str:
    """The sub-XXX entity of a file name, else the name without extensions and trailing statistic tokens."""
    name = re.sub(r"\.nii(\.gz)?$", "", path.rpartition("/")[2])
    entity = re.search(r"sub-[A-Za-z0-9]+", name)
    if entity:
        return entity[0]
    while (cut := re.fullmatch(r"(.*)[_.-]([A-Za-z]+)", name)) and cut[2].lower() in STATISTICS:
        name = cut[1]
    return name.rstrip("_.-")


def read_images(spark: SparkSession, paths, mask: np.ndarray | None = None) -> DataFrame:
    """(path, subject, voxel, i, j, k, frame, value, dims, affine): finite voxels of each image, inside the mask if given."""
    shared = spark.sparkContext.broadcast(None if mask is None else np.flatnonzero(np.asarray(mask).ravel(order="F")))

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                shape, affine, values = parse(bytes(content))
                n = int(np.prod(shape[:3]))
                inside = np.arange(n) if shared.value is None else shared.value
                i, j, k = np.unravel_index(inside, shape[:3], order="F")
                for frame in range(len(values) // n):
                    v = values[frame * n : (frame + 1) * n][inside]
                    ok = np.isfinite(v)
                    yield pd.DataFrame({"path": path, "subject": subject_key(path), "voxel": inside[ok], "i": i[ok], "j": j[ok], "k": k[ok], "frame": frame, "value": v[ok], "dims": ",".join(map(str, shape[:3])), "affine": ",".join(f"{x:.6g}" for x in affine.ravel())})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, subject string, voxel long, i int, j int, k int, frame int, value double, dims string, affine string")


def cube_from_images(spark: SparkSession, assays: dict[str, list[str]], mask=None, contrasts: list[str] | None = None) -> Cube:
    """A voxel cube of image files by assay (beta, se, var, t, df, ...); files of different assays pair by subject.

    Grids and affines must agree to 1e-4, and each assay must have the same subjects. Frames are contrasts.
    """
    parts = None
    for name, paths in assays.items():
        own = read_images(spark, paths, mask)
        kinds = own.select("dims", "affine").distinct().collect()
        seen = {r.subject for r in own.select("subject").distinct().collect()}
        cells = own.select("subject", "voxel", "i", "j", "k", "frame", F.col("value").alias(name))
        if parts is None:
            parts, first, subjects = cells, kinds, seen
        else:
            if seen != subjects:
                raise ValueError(f"{name} lacks or adds subjects: {sorted(seen ^ subjects)[:5]}")
            parts = parts.join(cells.drop("i", "j", "k"), ["subject", "voxel", "frame"], "left")
        affines = [np.array(r.affine.split(","), float) for r in [*first, *kinds]]
        if len({r.dims for r in [*first, *kinds]}) != 1 or any(np.abs(a - affines[0]).max() > 1e-4 for a in affines):
            raise ValueError("the images' grids differ")
    names = F.create_map(*[x for i, c in enumerate(contrasts) for x in (F.lit(i), F.lit(c))])[F.col("frame")] if contrasts else F.col("frame").cast("string")
    rows = parts.withColumn("contrast", names).withColumn("sample", F.col("voxel").cast("string"))
    grid = rows.select(F.col("sample").alias("id"), "voxel", "i", "j", "k").distinct()
    out = from_table(rows, assays={a: a for a in assays}, space=Space("voxel", tuple(int(d) for d in first[0].dims.split(",")), tuple(tuple(r) for r in affines[0].reshape(4, 4).tolist())))
    return out.with_(samples=out.samples.join(grid, "id"))


def find_maps(spark: SparkSession, root: str, pattern: str = "**", subject_fun=None, contrast_fun=None) -> DataFrame:
    """(file, subject, contrast) of the images below a folder; the functions turn a path into a label, else it is null."""
    from ..operators import catalog

    label = lambda fun: F.lit(None).cast("string") if fun is None else F.udf(fun, "string")("file")  # noqa: E731  a listing, not data
    found = catalog.list_files(spark, root, pattern).where(F.col("file").rlike(r"\.nii(\.gz)?$"))
    return found.select("file", label(subject_fun).alias("subject"), label(contrast_fun).alias("contrast")).orderBy("file")


def cube_from_maps(maps: DataFrame, mask=None) -> Cube:
    """A cube of one contrast from a table of map files (file, and subject or contrast labels if known).

    The contrast's label must be one; several are an error, as each is a cube of its
    own. There are no variances, so the cube has var 1 and says that it is synthetic.
    """
    spark = maps.sparkSession
    rows = maps.collect()  # a row for each file
    given = {r["contrast"] for r in rows if "contrast" in maps.columns and r["contrast"] is not None}
    if len(given) > 1:
        raise ValueError("maps of several contrasts; make a cube of each")
    cube = cube_from_images(spark, {"beta": [r["file"] for r in rows]}, mask, [next(iter(given), "map")])
    names = {subject_key(r["file"]): r["subject"] for r in rows if "subject" in maps.columns and r["subject"] is not None}
    cube = cube.with_df(cube.df.withColumn("var", F.lit(1.0))).with_(meta={**cube.meta, "synthetic_variance": True})
    if not names:
        return cube
    from ..operators import verbs

    return verbs.relabel(cube, "subject", spark.createDataFrame(list(names.items()), "old string, new string"))


def cube_from_scalar_maps(spark: SparkSession, files: dict[str, str], contrast: str = "map", mask=None) -> Cube:
    """``cube_from_maps`` of one file for each subject."""
    rows = [(path, subject, contrast) for subject, path in files.items()]
    return cube_from_maps(spark.createDataFrame(rows, "file string, subject string, contrast string"), mask)
