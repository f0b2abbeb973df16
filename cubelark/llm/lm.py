"""LM scoring by deleted interpolation of word trigrams, bigrams and unigrams.

Maximum-likelihood estimates of three orders over all training words are mixed:

    P = a F3(w | h2 h1) + (1 - a) (b F2(w | h1) + (1 - b) (c F1(w) + (1 - c) F0(w)))

F0 gives words never seen the share that words seen once have, as one event, and
spreads the rest evenly over the known words. The weights a, b and c depend on
the bucket of how often h1 and h2 h1 were seen; an estimate whose context was
never seen has none. Expectation-maximisation learns them, the lowest order
first, on held-out counts: each training token is predicted from all counts but
those of its own chunk of documents.

No table of n-grams is gathered, and none is left out. Documents form chunks. A
chunk sends each of its distinct n-grams once, as a sorted, packed run of hashes
with training counts, to the n-grams' buckets, and each bucket sends back the
sums over all chunks in the chunk's own order. Meanwhile the chunk's words travel
as places in its vocabulary and meet the sums. A frequent n-gram costs one number
a chunk, whatever its count; the driver sees only tables of fixed size.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The hash of a text's end, which also stands before its first word.
END = 0x5DEECE66D1CE4E5B
UNI_BITS = 58
LEVELS, OCTAVE, FAR = 20, 8, 60


# --- packed numbers


def _squeeze(raw: bytes) -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
    return made.compress(raw) + made.flush()


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of bytes, as many as the greatest needs."""
    values = values.astype(np.uint64, copy=False)
    planes = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    parts = [_squeeze((values >> np.uint64(8 * k) if k else values).astype(np.uint8).tobytes()) for k in range(planes)]
    return np.array([len(values), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unpack(data: bytes) -> np.ndarray:
    """The numbers of one ``pack``, as uint64."""
    n, planes, lengths = int.from_bytes(data[:8], "little"), 0, []
    left = len(data) - 8
    while left:
        lengths.append(int.from_bytes(data[8 + 8 * planes : 16 + 8 * planes], "little"))
        left -= 8 + lengths[-1]
        planes += 1
    at, out = 8 + 8 * planes, np.zeros(n, np.uint64)
    for k, length in enumerate(lengths):
        plane = np.frombuffer(zlib.decompress(data[at : at + length], -15), np.uint8)
        out = out + (plane.astype(np.uint64) << np.uint64(8 * k)) if k else plane.astype(np.uint64)
        at += length
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as the bytes of their steps; only the upper, uneven planes are worth compressing."""
    steps = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    raw = np.ascontiguousarray(steps, np.uint64).view(np.uint8).reshape(-1, 8)
    usual = int(np.median(steps[1:])).bit_length() // 8 if len(steps) > 1 else 8  # planes of even bytes
    low = np.ascontiguousarray(raw[:, :usual].T).tobytes()
    return np.array([len(values), usual], np.int32).tobytes() + low + zlib.compress(np.ascontiguousarray(raw[:, usual:].T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    n, usual = np.frombuffer(data[:8], np.int32).tolist()
    raw = np.empty((n, 8), np.uint8)
    raw[:, :usual] = np.frombuffer(data[8 : 8 + n * usual], np.uint8).reshape(usual, n).T
    raw[:, usual:] = np.frombuffer(zlib.decompress(data[8 + n * usual :]), np.uint8).reshape(8 - usual, n).T
    return np.cumsum(raw.view(np.uint64).ravel(), dtype=np.uint64)


# --- chunks


class Plan:
    """Sizes that follow from the bytes of all texts: bytes of a chunk, buckets of n-grams, bits of their hashes.

    A bucket holds the n-grams of about 16 MB of text. Hashes have some 17 bits
    more than the number of n-grams has, so that about one in 10^5 meets another.
    """

    def __init__(self, total: int, size: int = 8_000_000, bucket: int = 16_000_000):
        self.size = min(size, max(100_000, total // 64))
        self.bits = max(2, math.ceil(math.log2(max(total, 1) / bucket)) if total > bucket else 0)
        self.gram_bits = min(62, 45 + max(0, math.ceil(math.log2(max(total, 1) / 1e9))))
        self.uni = max(0, self.bits - 3)

    def cuts(self, values: np.ndarray, unigrams: bool) -> list[tuple[int, int, int]]:
        """(bucket, first, past the end) of ascending values; buckets without any are left out."""
        have, own, start = (self.uni, UNI_BITS, 1 << self.bits) if unigrams else (self.bits, self.gram_bits, 0)
        at = np.searchsorted(values >> np.uint64(own - have), np.arange((1 << have) + 1, dtype=np.uint64))
        return [(start + i, a, b) for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())) if a < b]


_SALT = [np.uint64(0x9E3779B97F4A7C15 + 2 * i) for i in range(5)]


def unigram_ids(hashes: np.ndarray) -> np.ndarray:
    return C.mix(hashes * _SALT[0]) >> np.uint64(64 - UNI_BITS)


def gram_ids(hashes: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bigram and the trigram that end at each token of texts laid end to end."""
    last = np.cumsum(lengths) - 1
    first, end = last - lengths + 1, hashes[last[:1]]
    h1 = np.concatenate((end, hashes[:-1]))
    h1[first] = end
    h2 = np.concatenate((end, h1[:-1]))
    h2[first] = end
    two = C.mix(h1 * _SALT[1] + hashes) ^ _SALT[2]
    return C.mix(two) >> np.uint64(64 - bits), C.mix(C.mix(h2 * _SALT[3] + _SALT[4]) + two) >> np.uint64(64 - bits)


def distinct(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, how many training tokens have each)."""
    code = values << np.uint64(1)
    code |= train
    code.sort()
    fresh = np.ones(len(code), bool)
    np.greater(code[1:] ^ code[:-1], 1, out=fresh[1:])
    starts = np.flatnonzero(fresh)
    code_of = code[starts] >> np.uint64(1)
    return code_of, np.add.reduceat(code & np.uint64(1), starts)


class Chunk:
    """The documents of a chunk: ids, marks, lengths and word hashes; the key tells it from every other chunk."""

    def __init__(self, key: int, rows: list[tuple]):
        self.key = key
        self.ids, texts, self.train, self.ask = map(list, zip(*rows))
        self.hashes, self.lengths = C.lower_word_hashes(texts, END)
        self.of_train = np.repeat(np.array(self.train, bool), self.lengths)


def chunks_of(batches, size: int):
    """Chunks of about ``size`` bytes of rows (doc_id, text, train, ask), in the order of a task's rows.

    A chunk's key is made of its place and its texts, so a second pass over the
    same rows makes the same keys, and other rows make other keys.
    """
    held, have, crc, nth = [], 0, 0, 0
    part = TaskContext.get().partitionId() if TaskContext.get() else 0

    def made():
        key = xxhash.xxh3_64_intdigest(repr((part, nth, crc, have, [r[0] for r in held])).encode()) >> 1
        return Chunk(key, held)

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4))):
            held.append(row)
            text = row[1] or b""
            have, crc = have + len(text) + 8, zlib.crc32(text, crc)
            if have >= size:
                yield made()
                held, have, crc, nth = [], 0, 0, nth + 1
    if held:
        yield made()


_DDL = {"int64": "long", "int32": "int", "binary": "binary", "bool": "boolean", "double": "double", "list<item: int64>": "array<long>", "list<item: bool>": "array<boolean>"}
ddl = lambda schema: ", ".join(f"{f.name} {_DDL[str(f.type)]}" for f in schema)
_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("n", pa.binary())])
_SUMS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.binary()), ("total", pa.int64()), ("words", pa.int64()), ("once", pa.int64())])
_DOCS = [("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("ask", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("places", pa.binary())]
_WORDS = pa.schema([("chunk", pa.int64()), *_DOCS, ("often", pa.binary()), ("once", pa.binary())])
_STATS = -1  # the key of the rows that carry totals
_HELD = pa.schema([("chunk", pa.int64()), *_DOCS, *((x, pa.binary()) for x in ("n1", "own1", "n2", "own2", "n3", "own3")), ("total", pa.int64()), ("words", pa.int64()), ("once", pa.int64())])


def _send(plan: Plan):
    def run(batches):
        for chunk in chunks_of(batches, plan.size):
            every = np.concatenate(gram_ids(chunk.hashes, chunk.lengths, plan.gram_bits))
            out = [[], [], [], []]
            for unigrams, (values, n) in ((True, distinct(unigram_ids(chunk.hashes), chunk.of_train)), (False, distinct(every, np.concatenate((chunk.of_train, chunk.of_train))))):
                for bucket, a, b in plan.cuts(values, unigrams):
                    for column, value in zip(out, (bucket, chunk.key, pack_sorted(values[a:b]), pack(n[a:b]))):
                        column.append(value)
            yield C.batch(_SENT, *out)

    return run


def _words(plan: Plan):
    def run(batches):
        for chunk in chunks_of(batches, plan.size):
            vocabulary, places = C.distinct_places(chunk.hashes)
            n = np.bincount(places)
            order = np.argsort(-n, kind="stable")  # frequent words get small places; words seen once come last, by hash
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            often = int((n > 1).sum())
            words = vocabulary[order[:often]].tobytes(), pack_sorted(vocabulary[order[often:]])
            yield C.batch(_WORDS, [chunk.key], [chunk.ids], [chunk.train], [chunk.ask], [chunk.lengths.tolist()], [pack(rank[places])], *([x] for x in words))

    return run


def _summed(bits: int):
    """The sums over all chunks of the n-grams of a bucket, for each chunk in its own order."""

    def run(key, table):
        values = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
        n = np.concatenate([unpack(x) for x in table.column("n").to_pylist()])
        every = np.concatenate(values)
        order = C.order_of(every)
        ranked = every[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        sums = np.add.reduceat(n[order], starts)
        back = np.empty(len(every), np.uint64)
        back[order] = np.repeat(sums, np.diff(np.append(starts, len(every))))
        parts = np.split(back, np.cumsum([len(v) for v in values])[:-1])
        bucket, chunks = key[0].as_py(), table.column("chunk").to_pylist()
        out = [chunks, [bucket] * len(parts), [pack(p) for p in parts], *([None] * len(parts) for _ in range(3))]
        if bucket >= 1 << bits:  # unigrams: totals
            for column, value in zip(out, (_STATS, bucket, None, int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()))):
                column.append(value)
        return pa.Table.from_batches([C.batch(_SUMS, *out)])

    return run


def _met(plan: Plan):
    """A chunk's words and sums: the counts at each word of its vocabulary and each token, and its own share of them."""

    def run(key, words, sums):
        if key[0].as_py() == _STATS:
            whole = [sum(sums.column(c).to_pylist()) for c in ("total", "words", "once")]
            return pa.Table.from_batches([C.batch(_HELD, [_STATS], *([None] for _ in range(11)), *([x] for x in whole))])
        if words.num_rows != 1 or not sums.num_rows:
            raise RuntimeError("the rows came in another order at the second pass; checkpoint them first")
        row = words.to_pylist()[0]
        lengths, places = np.array(row["lengths"], np.int64), unpack(row["places"]).astype(np.int64)
        vocabulary = np.concatenate((np.frombuffer(row["often"], np.uint64), unpack_sorted(row["once"])))
        train = np.repeat(np.array(row["train"], bool), lengths)
        buckets, packed = sums.column("bucket").to_numpy(), sums.column("n").to_pylist()
        order = np.argsort(buckets, kind="stable").tolist()
        of = lambda large: np.concatenate([unpack(packed[i]) for i in order if (buckets[i] >= 1 << plan.bits) == large])
        at = C.distinct_places(unigram_ids(vocabulary))[1]
        n1, own1 = of(True)[at], np.bincount(places[train], minlength=len(vocabulary))
        at = C.distinct_places(np.concatenate(gram_ids(vocabulary[places], lengths, plan.gram_bits)))[1]
        n, own = of(False), np.bincount(at[np.tile(train, 2)], minlength=int(at.max()) + 1)
        if len(n) != len(own):
            raise RuntimeError("n-grams and sums of a chunk differ")
        two, three = np.split(at, 2)
        kept = [row["doc_id"]], [row["train"]], [row["ask"]], [row["lengths"]], [row["places"]]
        return pa.Table.from_batches([C.batch(_HELD, [row["chunk"]], *kept, *([pack(x)] for x in (n1, own1, n[two], own[two], n[three], own[three])), *([None] for _ in range(3)))])

    return run


def counted(rows: DataFrame, **sizes) -> DataFrame:
    """Chunks of rows (doc_id, text as bytes, train, ask) with the training counts of all their n-grams, and a row of totals.

    The rows are read twice and must come in the same order both times, as those
    of tables and checkpoints do; else an error is raised. The result is in the
    checkpoint folder.
    """
    rows = rows.select("doc_id", "text", "train", "ask")
    plan = Plan(rows.agg(F.sum(F.length("text") + 8)).first()[0] or 0, **sizes)
    sums = rows.mapInArrow(_send(plan), ddl(_SENT)).groupBy("bucket").applyInArrow(_summed(plan.bits), ddl(_SUMS))
    words = rows.mapInArrow(_words(plan), ddl(_WORDS))
    return C.checkpoint(words.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_met(plan), ddl(_HELD)))


# --- the mixture


def levels(s: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 and up by the logarithm of its count; the last level is open."""
    exponent = (s.astype(np.float64).view(np.int64) >> 52) - 1022  # of the binary form; far below 0 for 0
    return np.clip(exponent, 0, LEVELS - 1)


def steps(r: np.ndarray) -> np.ndarray:
    """The cell of a ratio: 0 for none, else by its logarithm."""
    return np.where(r > 0, 1 + FAR * OCTAVE + np.clip(np.round(np.log2(np.maximum(r, 1e-300)) * OCTAVE), -FAR * OCTAVE, FAR * OCTAVE), 0).astype(np.int64)


def buckets(s2: np.ndarray, s3: np.ndarray) -> np.ndarray:
    return levels(s2) * LEVELS + levels(s3)


def weights_of(bucket: np.ndarray, cell: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The weight of the higher order in each bucket by expectation-maximisation, from n held-out tokens of each ratio cell.

    The ratio is that of the higher order's estimate to the lower orders' mixture.
    A bucket starts with one token's worth of even odds.
    """
    r = np.where(cell > 0, 2.0 ** ((cell - 1 - FAR * OCTAVE) / OCTAVE), 0.0)
    seen, out = np.bincount(bucket, n, LEVELS * LEVELS), np.full(LEVELS * LEVELS, 0.5)
    for _ in range(rounds):
        w = out[bucket]
        part = w * r / np.maximum(w * r + 1 - w, 1e-300)
        new = (np.bincount(bucket, n * part, len(out)) + 0.5) / (seen + 1)
        done = np.abs(new - out).max() < 1e-9
        out = new
        if done:
            break
    return out


class Model:
    """Totals of the training tokens and the mixture weights by bucket."""

    def __init__(self, total: int = 0, words: int = 0, once: int = 0):
        self.total, self.words = total, words
        self.new = min(0.5, max(once, 0.5) / total) if total else 1.0
        self.weights: list[np.ndarray] = []  # of unigrams, bigrams and trigrams, as far as learned
        self.norm = math.log10(total + 0.5 * (words + 1))

    def lowest(self, n1):
        """F0 of words seen n1 times."""
        return np.where(n1 > 0, (1 - self.new) / max(self.words, 1), self.new)

    def probability(self, n1, n2, n3, s2, s3, total: int, bucket=None):
        """The mixture of the orders learned so far; ``total``: training tokens that the counts n and s come from."""
        bucket = buckets(s2, s3) if bucket is None else bucket
        p = self.lowest(n1)
        for w, n, s in zip(self.weights, (n1, n2, n3), (np.int64(total), s2, s3)):
            p += np.where(s > 0, w[bucket], 0.0) * (n / np.maximum(s, 1) - p)
        return p


class Counts:
    """The counts at each token of a chunk; ``own`` of them are the chunk's."""

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], np.int64)
        self.places = unpack(row["places"]).astype(np.int64)
        self.train = np.repeat(np.array(row["train"], bool), self.lengths)
        self.row, self.last = row, np.cumsum(self.lengths) - 1

    def at_tokens(self, left_out: bool):
        """(n1, n2, n3, count of the word before, count of the two words before); ``left_out``: without the chunk's own."""
        get = lambda k: unpack(self.row[f"n{k}"]).astype(np.int64) - (unpack(self.row[f"own{k}"]).astype(np.int64) if left_out else 0)
        n1, n2, n3 = get(1)[self.places], get(2), get(3)
        first, texts = self.last - self.lengths + 1, n1[self.last]
        s2, s3 = np.concatenate((n1[:1], n1[:-1])), np.concatenate((n2[:1], n2[:-1]))
        s2[first] = s3[first] = texts  # a text's beginning is seen as often as an end
        return n1, n2, n3, s2, s3


def slices(n: int, width: int = 1 << 15):
    """Slices of n tokens whose arrays stay in a core's cache."""
    return (slice(a, a + width) for a in range(0, n, width))


_CELL = pa.schema([("cell", pa.int64()), ("n", pa.int64())])


def learn(held: DataFrame) -> Model:
    """Totals and weights from the chunks of ``counted``; three passes, the lowest order first."""
    stats = held.where(F.col("chunk") == _STATS).select("total", "words", "once").first()
    model = Model(*stats) if stats else Model()
    if not model.total:
        return model

    wide = 2 * FAR * OCTAVE + 2

    def cells(order: int, model: Model):
        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    own = Counts(row)
                    if not own.train.any():
                        continue
                    total = model.total - int(own.train.sum())
                    n1, n2, n3, s2, s3 = (x[own.train] for x in own.at_tokens(True))
                    m = np.zeros(LEVELS * LEVELS * wide, np.int64)
                    for k in slices(len(n1)):
                        counts = n1[k], n2[k], n3[k], s2[k], s3[k]
                        n, s = counts[order], (np.full(len(n1[k]), total), s2[k], s3[k])[order]
                        bucket = buckets(s2[k], s3[k])
                        ratio = n / np.maximum(s, 1) / model.probability(*counts, total, bucket)
                        np.add.at(m, (bucket * wide + steps(ratio))[s > 0], 1)
                    code = np.flatnonzero(m)
                    yield C.batch(_CELL, code, m[code])

        return run

    chunks = held.where(F.col("chunk") != _STATS)
    for order in range(3):
        table = chunks.mapInArrow(cells(order, model), ddl(_CELL)).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        code, n = table.column(0).to_numpy(), table.column(1).to_numpy()
        by = np.argsort(code)
        model.weights.append(weights_of(code[by] // wide, code[by] % wide, n[by].astype(float)))
    return model


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scores(held: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of the rows of ``counted`` that ask, a row for each."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                own, ask = Counts(row), np.array(row["ask"], bool)
                n1, n2, n3, s2, s3 = own.at_tokens(False)
                p, base = np.empty(len(n1)), np.empty(len(n1))
                for k in slices(len(n1)):
                    p[k] = np.log10(model.probability(n1[k], n2[k], n3[k], s2[k], s3[k], model.total))
                    base[k] = np.log10(n1[k] + 0.5) - model.norm
                of = np.repeat(np.arange(len(ask)), own.lengths)
                per = lambda v: np.bincount(of, v, len(ask))[ask]
                ids = [x for x, y in zip(row["doc_id"], row["ask"]) if y]
                yield C.batch(_SCORED, ids, own.lengths[ask], per(n1 > 0).astype(np.int64), per(base), per(p))

    return held.where(F.col("chunk") != _STATS).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def scored(rows: DataFrame, **sizes) -> tuple[DataFrame, Model]:
    """(scores, model) of rows (doc_id, text, train, ask): rows with ``train`` count, rows with ``ask`` are scored."""
    held = counted(rows, **sizes)
    model = learn(held)
    return scores(held, model), model


def score(docs: DataFrame, train: DataFrame, id_col="doc_id", text_col="text", **sizes) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of ``docs`` after the rows of ``train``.

    A row for each row of ``docs``, repeated or not; other columns are not used.
    Null and empty texts are the end alone. Without training words every token
    has probability 1. Both tables are read twice, see ``counted``.
    """
    part = lambda rows, train: C.keyed(rows, id_col, text_col).select("doc_id", "text", F.lit(train).alias("train"), F.lit(not train).alias("ask"))
    return scored(part(docs, False).unionAll(part(train, True)), **sizes)[0]


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.keyed(C.read(spark, sf_dir, "documents"))
    fold = C.fold_column("doc_id", 5) == 1
    found, model = scored(docs.select("doc_id", "text", (~fold).alias("train"), F.lit(True).alias("ask")))
    return found.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")
