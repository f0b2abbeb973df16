"""Shared pieces: exact tokenisers on UTF-8 bytes, rolling hashes, checkpoints.

Text travels to Python as binary, so no decoding happens unless an operator
needs code points, and a text that is not valid UTF-8 cannot fail a task.
"""

from __future__ import annotations

import tempfile
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Lower-cases A-Z and turns 00-2F, 3A-60 and 7B-7F (after lower-casing) into blanks.
ALNUM = bytes(
    LOWER[b] if 0x30 <= b <= 0x39 or 0x61 <= LOWER[b] <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK_WORDS = 500_000
#: Whether a query's shuffle files go once its action has ended; a query has the value under which it was made.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def blank_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes.split() cuts at exactly those six bytes."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


def in_fold(doc_id, modulus: int, rest: int) -> bool:
    """Whether crc32 of the id's decimal text leaves ``rest``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == rest


def fold_column(id_col: str, modulus: int):
    """``in_fold``'s remainder as a Spark column."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


class WordHasher(dict):
    """64-bit hashes of words, with a bounded cache of the words met so far."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Lower-cases A-Z and turns 09-0D into blanks.
_LOWER_BLANK = bytes(0x20 if 9 <= b <= 13 else LOWER[b] for b in range(256))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)  # a 64-bit value for each byte
_BLOCK = 1 << 18  # bytes of text whose arrays stay in a core's cache
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, x)))) for x in (BASE, back)]
    return _POWERS[0], _POWERS[1]


def lower_word_hashes(texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the blank-separated words of all texts with A-Z lower-cased, ``end`` after each text; tokens of each).

    No word becomes an object: polynomials of the bytes are summed once over a
    block of texts. Equal words have equal hashes.
    """
    hashes, lengths, block, size = [], [], [], 0

    def one():
        data = b" ".join([*block, b""]).translate(_LOWER_BLANK)
        solid = np.frombuffer(data, np.uint8) != 0x20
        edge = np.flatnonzero(np.diff(solid, prepend=False))
        start, stop = edge[::2], edge[1::2]  # data ends in a blank
        power, back = _powers(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * power[: len(data)], dtype=np.uint64)))
        own = mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))
        last = np.cumsum([len(t) + 1 for t in block])
        upto = np.searchsorted(start, last)  # words before the end of each text
        out = np.full(len(own) + len(block), np.uint64(end))
        ends = upto + np.arange(len(block))
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = own
        hashes.append(out)
        lengths.append(np.diff(ends, prepend=-1))

    for text in texts:
        block.append(text or b"")
        size += len(block[-1])
        if size >= _BLOCK:
            one()
            block, size = [], 0
    if block:
        one()
    return np.concatenate(hashes), np.concatenate(lengths)


def order_of(values: np.ndarray) -> np.ndarray:
    """The stable ascending order of uint64 values, by one sort of values and places packed together."""
    n = len(values)
    if not n:
        return np.empty(0, np.int64)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    shift = np.uint64(max(0, int(values.max()).bit_length() + int(bits) - 64))
    code = values >> shift << bits | np.arange(n, dtype=np.uint64)
    code.sort()
    order = (code & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if shift:  # values that differ only in their lowest bits
        ranked = values[order]
        wrong = np.flatnonzero(ranked[1:] < ranked[:-1])
        top = ranked >> shift if len(wrong) else None
        for a, b in {(np.searchsorted(top, top[w], "left"), np.searchsorted(top, top[w], "right")) for w in wrong}:
            order[a:b] = order[a:b][np.argsort(ranked[a:b], kind="stable")]
    return order


def distinct_places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, the place of each value among them)."""
    order = order_of(values)
    ranked = values[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(values)]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ranked[fresh], place


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes, by doubling; empty if there are fewer words."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    power = lambda n: np.uint64(pow(int(BASE) + 2 * seed, n, 1 << 64))
    have, out = 1, words
    for bit in bin(k)[3:]:
        out = out[: len(out) - have] * power(have) + out[have:]
        have *= 2
        if bit == "1":
            out = out[: len(out) - 1] * power(1) + words[have : have + len(out) - 1]
            have += 1
    return mix(out)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so a lost executor loses nothing.

    The session's ``spark.checkpoint.dir`` names it. Where that is unset, a local
    session takes a temporary folder; on a cluster it is an error. The shuffle
    files behind the result go once it stands there; else they would stay until
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoints"))
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        df = df.select("*")
    finally:
        spark.conf.set(RELEASE, before)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, text as bytes): the columns an operator uses, whatever else the table has.

    ``th`` hashes the text, so that two rows with one id but different texts stay apart.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("th"),
        F.col(text_col).cast("binary").alias("text"),
    )


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema
    )


def chunks(texts: list, tokens, most: int = CHUNK_WORDS):
    """Cut a batch into runs of documents of about ``most`` words: (first row, [words of each])."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(tokens(text))
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held
