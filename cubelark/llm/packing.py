"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into full sequences
and a rest. The other pieces are dealt by a hash into shards of about
``shard_items`` and packed shard by shard, longest first: a piece goes to the
open bin that it fills best; if none has room, a bin is opened whose size has
the least cost for each token it can expect to hold, given the pieces still to
come. At the end each bin shrinks to the least permitted size that holds it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIZES = (512, 1024, 2048, 4096, 8192)


def cost(size: int, fixed: float = 32.0, square: float = 16384.0) -> float:
    """Cost of a sequence: its start, its tokens, and attention over pairs of them."""
    return fixed + size + size * size / square


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece, size of each bin) for pieces in descending order of length."""
    sizes = sorted(sizes)
    n = len(lengths)
    after = [0] * (n + 1)  # tokens of the pieces from each on
    for i in range(n - 1, -1, -1):
        after[i] = after[i + 1] + lengths[i]
    rising = [-x for x in lengths]
    where, offset, used, room = [], [], [], []
    free: dict[int, deque] = {}  # open bins by room left
    mask = 0
    for i, length in enumerate(lengths):
        fits = mask >> length
        if fits:
            left = (fits & -fits).bit_length() - 1 + length
            own = free[left]
            b = own.popleft()
            if not own:
                mask &= ~(1 << left)
        else:
            options = []
            for size in sizes:
                if size >= length:
                    coming = after[max(i + 1, bisect_left(rising, length - size))] if size > length else 0
                    options.append((cost(size) / min(size, length + coming), size))
            b = len(used)
            used.append(0)
            left = min(options)[1]
            room.append(left)
        where.append(b)
        offset.append(used[b])
        used[b] += length
        left -= length
        if left:
            free.setdefault(left, deque()).append(b)
            mask |= 1 << left
    return where, offset, [sizes[bisect_left(sizes, u)] for u in used]


_LENGTH = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64())])
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64()), ("bin_size", pa.int64())])
DDL = "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_size long"


def token_lengths(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, th, n): words of the text and one end token."""

    def run(batches):
        for b in batches:
            yield C.batch(_LENGTH, b.column(0), b.column(1), [len(C.blank_words(t)) + 1 for t in b.column(2).to_pylist()])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, n long")


def place(docs: DataFrame, id_col="doc_id", text_col="text", sizes: Sequence[int] = SIZES, shard_items: int = 4096) -> DataFrame:
    """Where each piece of each row stands: see ``DDL``. bin_id tells bins apart over all shards.

    Tokens are blank-separated words and one end token, so null and empty texts
    are one token. Pieces of a document are numbered from 0 and ``start`` counts
    its tokens before the piece. Repeated rows are packed each for itself, and
    numbered before they are dealt, so that many of them fill many shards. The
    result does not depend on how the rows are partitioned.
    """
    sizes = sorted(set(sizes))
    most = sizes[-1]
    shards = max(1, round(docs.count() / shard_items))
    counted = token_lengths(docs, id_col, text_col).groupBy("doc_id", "th", "n").agg(F.count("*").alias("copies"))
    items = counted.select("doc_id", "th", "n", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "th", "copy"), F.lit(shards))).drop("copy")

    def run(table: pa.Table) -> pa.Table:
        ids, ths, n = (table.column(i).to_pylist() for i in range(3))
        shard = table.column(3)[0].as_py()
        bins = 0
        out: list[list] = [[] for _ in range(7)]

        def emit(*row):
            for column, value in zip(out, row):
                column.append(value)

        rest = []
        for i in sorted(range(len(n)), key=lambda i: (ids[i] is None, ids[i] or 0, ths[i])):
            whole = n[i] // most
            for p in range(whole):
                emit(ids[i], p, p * most, most, (shard << 32) + bins, 0, most)
                bins += 1
            if n[i] % most:
                rest.append((n[i] % most, len(rest), ids[i], whole))
        rest.sort(key=lambda r: (-r[0], r[1]))
        where, offset, size = pack([r[0] for r in rest], sizes)
        for (length, _, doc, piece), b, at in zip(rest, where, offset):
            emit(doc, piece, piece * most, length, (shard << 32) + bins + b, at, size[b])
        return pa.Table.from_batches([C.batch(_PLACED, *out)])

    return items.groupBy("shard").applyInArrow(run, DDL)


def materialise(placed: DataFrame, docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(bin_id, bin_size, texts): each sequence's pieces, in order, as arrays of words; ids must be unique and not null."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    piece = F.slice("words", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))
    rows = placed.join(texts, "doc_id").select("bin_id", "bin_size", F.struct("bin_offset", "doc_id", piece.alias("words")).alias("p"))
    return rows.groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list("p")).alias("pieces"))


def query(spark, sf_dir: str) -> DataFrame:
    return place(C.read(spark, sf_dir, "documents"))

