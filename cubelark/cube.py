"""The cube: one long table of cells and a small table for each of its three axes.

A cell is (sample, subject, contrast, assays...). Axis tables are (ord, id,
attributes...); ``ord`` counts from 1 in the axis's order. A missing cell is a
missing row and a missing value is null, so shares of an axis are always taken
of the axis table's count.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("sample", "subject", "contrast")
AXIS = {"sample": "samples", "subject": "subjects", "contrast": "contrasts"}


@dataclass(frozen=True)
class Space:
    """What the sample axis stands for: voxel (grid, affine, mask), parcels, surface, basis or sample_labels."""

    kind: str = "sample_labels"
    dims: tuple[int, ...] = ()
    affine: tuple[tuple[float, ...], ...] = ()
    extra: dict = field(default_factory=dict)

    KINDS = ("voxel", "parcels", "surface", "basis", "sample_labels")

    def __post_init__(self):
        if self.kind not in self.KINDS:
            raise ValueError(f"unknown space {self.kind!r}")
        if self.kind == "voxel" and len(self.dims) != 3:
            raise ValueError("a voxel space has three grid dimensions")

    def compatible(self, other: "Space", tolerance: float = 1e-4) -> bool:
        flat = lambda s: [x for row in s.affine for x in row]
        return self.kind == other.kind and self.dims == other.dims and len(flat(self)) == len(flat(other)) and all(abs(a - b) <= tolerance for a, b in zip(flat(self), flat(other)))


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    samples: DataFrame
    subjects: DataFrame
    contrasts: DataFrame
    assays: tuple[str, ...]
    space: Space = Space()
    meta: dict = field(default_factory=dict)
    attachments: dict = field(default_factory=dict)

    def axis(self, key: str) -> DataFrame:
        return getattr(self, AXIS[key])

    def with_(self, **changes) -> "Cube":
        return replace(self, **changes)

    def with_df(self, df: DataFrame) -> "Cube":
        """The cube with other cells; its assays are the columns that aren't keys."""
        return replace(self, df=df, assays=tuple(c for c in df.columns if c not in KEYS))

    def size(self, key: str) -> int:
        return self.axis(key).count()

    def ids(self, key: str) -> list[str]:
        """An axis's ids in order; for subjects and contrasts, or a sample axis known to be small."""
        return [r.id for r in self.axis(key).orderBy("ord").select("id").collect()]

    def dense(self, assays=None) -> DataFrame:
        """Every (sample, subject, contrast) of the axes, null where there is no cell."""
        s, u, c = (self.axis(k).select(F.col("id").alias(k), F.col("ord").alias(f"{k}_ord")) for k in KEYS)
        grid = s.crossJoin(F.broadcast(u)).crossJoin(F.broadcast(c))  # the grid is the result itself
        return grid.join(self.df.select(*KEYS, *(assays or self.assays)), list(KEYS), "left")


def axis_of(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(ord, id) of a key column: by the least ``order`` of each id, or by id."""
    from pyspark.sql import Window

    first = F.min(order) if order else F.first(F.lit(0))
    ids = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(first.alias("first"))
    return ids.select(F.row_number().over(Window.orderBy("first", "id")).cast("int").alias("ord"), "id")


def cube_schema(assays) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField(a, T.DoubleType()) for a in assays])
