"""Bounded, reproducible samples for fitting: the rows whose ids have small hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 1 << 40


def hash_bound(rows: int, most: int) -> int:
    """Hashes below it, of HASHES, belong to about ``most`` of so many rows: a filter, with nothing to sort."""
    return HASHES if rows <= most else HASHES * most // rows


def sample_ids(ids: DataFrame, most: int, seed: str) -> DataFrame:
    """About ``most`` distinct non-null ids (column doc_id), all if there are fewer, the same at each run."""
    own = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    drawn = own.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(HASHES)) < hash_bound(own.count(), most)).distinct().toArrow()
    return ids.sparkSession.createDataFrame(drawn) if drawn.num_rows else own.limit(0)


def sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, a table that ``sample_ids`` bounds, so it can be broadcast."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")
