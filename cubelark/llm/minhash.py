"""Near-duplicates by ProbMinHash over weighted five-word shingles.

A shingle of weight w (how often the document has it) sends arrivals of a
Poisson process of rate w, each to a random register; a register keeps the
shingle of its first arrival. A shingle stops once its next arrival is later
than every register's first one. Two signatures agree in a register with the
documents' probability Jaccard similarity. Rows of registers form bands.

Documents with the same words are one node. In a bucket each node first meets
two pivots: the most central node (the one with most bucket mates over all
bands) and one drawn for the bucket. The pivot that it meets in most bands is
compared with it exactly, and components follow; this settles most of a group,
however large, in as many rows as it has nodes. Then every pair of a bucket that
is in different components is compared: one of the two is a stray, a node outside
the bucket's main component. Strays of small buckets form pairs with the rest.
In large buckets strays and all nodes are dealt into blocks, and a task compares
one block of strays with one of nodes, forming no rows but links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

REGISTERS, ROWS, SHINGLE, SIMILAR = 128, 5, 5, 0.8
#: In blocks, pairs whose signatures agree in a lower share of registers aren't compared exactly. Registers estimate a
#: similarity of 0.8 with a deviation of 0.035, so one link in 10^8 is this far off; 0 turns it off.
SIFT = 0.6
#: Buckets up to this size form pairs; larger ones are compared in blocks of about this many nodes.
SMALL, BLOCK = 32, 512


def shingles(words: list[bytes], hasher: C.WordHasher, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending; how often each occurs). Fewer words than ``size`` make one shingle."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64), np.ones(1, np.int64)
    return np.unique(C.gram_hashes(hasher.array(words), size), return_counts=True)


def signatures(elements: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of each weighted set: the low 32 bits of the shingle first to arrive at each register."""
    n = len(elements)
    state = np.full(n * registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    e = np.concatenate([x for x, _ in elements]) if n else np.empty(0, np.uint64)
    w = np.concatenate([c for _, c in elements]).astype(float) if n else np.empty(0)
    doc = np.repeat(np.arange(n), [len(x) for x, _ in elements])
    t = np.zeros(len(e))
    for r in range(1 << 20):
        if not len(e):
            break
        draw = C.mix(e + np.uint64((r * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(float) * 2.0**-53) / w
        early = t.astype(np.float32).view(np.uint32).astype(np.uint64)
        at = doc * registers + (draw & np.uint64(registers - 1)).astype(np.int64)
        np.minimum.at(state, at, (early << np.uint64(32)) | (e & np.uint64(0xFFFFFFFF)))
        own, back = np.unique(doc, return_inverse=True)
        latest = state.reshape(n, registers)[own].max(1) >> np.uint64(32)
        go = early <= latest[back]
        e, w, doc, t = e[go], w[go], doc[go], t[go]
    return (state.reshape(n, registers) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def similarity(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray) -> float:
    """Probability Jaccard: over common d, 1 / sum over all d' of max(x[d'] / x[d], y[d'] / y[d])."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = cx[i].astype(float), cy[j].astype(float)
    if (a == b).all() and (a == 1).all():
        return float(len(i) / (cx.sum() + cy.sum() - len(i)))
    ratio, back = np.unique(a / b, return_inverse=True)
    rest_x, rest_y = cx.sum() - a.sum(), cy.sum() - b.sum()
    whole = np.array([rest_x + r * rest_y + np.maximum(a, r * b).sum() for r in ratio])
    return float((a / whole[back]).sum())


_SIGN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.binary()), ("sig", pa.binary())])


def sign(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, th, node, sig): a hash of the text, 128 bits of hash of its words, and the words' signature.

    Of the rows of one batch with the same words only the first is signed. A text
    without words has a node for each id and no signature. Null ids are left out.
    """

    def run(batches):
        hasher = C.WordHasher()
        for b in batches:
            ids, ths, texts = (b.column(i).to_pylist() for i in range(3))
            order = [i for i in range(len(ids)) if ids[i] is not None]
            seen: set[bytes] = set()
            for first, words in C.chunks([texts[i] for i in order], C.alnum_words):
                rows = order[first : first + len(words)]
                nodes = [xxhash.xxh3_128_digest(b" ".join(w) if w else b" %d" % ids[i]) for w, i in zip(words, rows)]
                own = [i for i, (w, h) in enumerate(zip(words, nodes)) if w and not (h in seen or seen.add(h))]
                made = dict(zip(own, signatures([shingles(words[i], hasher) for i in own])))
                yield C.batch(_SIGN, [ids[i] for i in rows], [ths[i] for i in rows], nodes, [made[i].tobytes() if i in made else None for i in range(len(rows))])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, node binary, sig binary")


_BAND = pa.schema([("band", pa.int64()), ("nth", pa.int32()), ("node", pa.binary())])


def bands(signed: DataFrame, rows: int = ROWS) -> DataFrame:
    """(band, nth, node): a row for each band of each signature (node, sig); nth counts bands from 0."""

    def run(batches):
        for b in batches:
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1).astype(np.uint64)
            count = sigs.shape[1] // rows if b.num_rows else 0
            if not count:
                continue
            keys = np.tile(np.arange(1, count + 1, dtype=np.uint64) * C.BASE, (len(sigs), 1))
            for k in range(rows):
                keys = C.mix(keys ^ sigs[:, k : count * rows : rows])
            yield C.batch(_BAND, keys.ravel().view(np.int64), np.tile(np.arange(count, dtype=np.int32), len(sigs)), b.column(0).take(pa.array(np.repeat(np.arange(len(sigs)), count))))

    return signed.select("node", "sig").mapInArrow(run, "band long, nth int, node binary")


_ELEMENTS = pa.schema([("node", pa.binary()), ("x", pa.binary()), ("c", pa.binary())])


def elements(docs: DataFrame) -> DataFrame:
    """(node, x, c): shingle hashes and counts of (node, text) rows; c is null if every count is 1."""

    def run(batches):
        hasher = C.WordHasher()
        for b in batches:
            xs, cs = [], []
            for text in b.column(1).to_pylist():
                x, c = shingles(C.alnum_words(text), hasher)
                xs.append(x.tobytes())
                cs.append(None if (c == 1).all() else c.astype(np.uint32).tobytes())
            yield C.batch(_ELEMENTS, b.column(0), xs, cs)

    return docs.select("node", "text").mapInArrow(run, "node binary, x binary, c binary")


_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
_counts = lambda c, n: np.ones(n, np.int64) if c is None else np.frombuffer(c, np.uint32).astype(np.int64)


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least ``similar``, with it."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("x").alias(f"x{s}"), F.col("c").alias(f"c{s}"))

    def run(batches):
        for b in batches:
            kept = [[], [], []]
            for one, two, xa, ca, xb, cb in zip(*(b.column(i).to_pylist() for i in range(6))):
                x, y = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                s = similarity(x, _counts(ca, len(x)), y, _counts(cb, len(y)))
                if s >= similar - 1e-12:
                    for column, value in zip(kept, (one, two, s)):
                        column.append(value)
            yield C.batch(_LINK, *kept)

    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "xa", "ca", "xb", "cb").mapInArrow(run, "a binary, b binary, similarity double")


def block_links(blocks: DataFrame, similar: float, least: float, rows: int = ROWS) -> DataFrame:
    """Links between components, of rows (band, i, j, side, nth, node, root, stray, sig, x, c) that meet by (band, i, j).

    Nodes of side 0 are strays and meet those of side 1; two strays are compared
    as the lesser with the greater. A pair is compared only in the first band that
    it shares. Links found are joined within the task, so pairs that they connect
    aren't compared again.
    """

    def compare(group: list[dict]):
        one, two = ([g for g in group if g["side"] == k] for k in (0, 1))
        if not one or not two:
            return
        nth = group[0]["nth"]
        sig = lambda own: np.frombuffer(b"".join(g["sig"] for g in own), np.uint32).reshape(len(own), -1)
        banded = lambda s: s[:, : nth * rows].reshape(len(s), nth, rows)
        s1, s2 = sig(one), sig(two)
        b1, b2 = banded(s1), banded(s2)
        names = {r: i for i, r in enumerate(sorted({g["root"] for g in group}))}
        r1, r2 = (np.array([names[g["root"]] for g in own]) for own in (one, two))
        nodes = np.array([g["node"] for g in two], object)
        strays = np.array([g["stray"] for g in two], bool)
        load = lambda g: (x := np.frombuffer(g["x"], np.uint64), _counts(g["c"], len(x)))
        for k, own in enumerate(one):
            near = ((s2 == s1[k]).mean(1) >= least) & (r2 != r1[k]) & ~(strays & (nodes <= own["node"]))
            mine = load(own) if near.any() else None
            for m in np.flatnonzero(near).tolist():
                if r1[k] == r2[m] or (b1[k] == b2[m]).all(1).any():
                    continue
                s = similarity(*mine, *load(two[m]))
                if s >= similar - 1e-12:
                    old = r2[m]
                    r2[r2 == old] = r1[k]
                    r1[r1 == old] = r1[k]
                    yield own["node"], two[m]["node"], s

    def run(batches):
        held: list[dict] = []
        key = lambda r: (r["band"], r["i"], r["j"])
        for b in batches:
            links = []
            for row in b.to_pylist():
                if held and key(held[0]) != key(row):
                    links += compare(held)
                    held = []
                held.append(row)
            yield C.batch(_LINK, *(zip(*links) if links else [[]] * 3))
        if held and (links := list(compare(held))):
            yield C.batch(_LINK, *zip(*links))

    return blocks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side", "node").mapInArrow(run, "a binary, b binary, similarity double")


def _ids_of_many(every: DataFrame) -> DataFrame | None:
    """(a, b): the nodes of an id that rows with different words share, tied to one of them; None if there is no such id."""
    ends = every.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("e")).where("b <> e").select("doc_id", "b")
    ends = C.checkpoint(ends)
    return None if ends.isEmpty() else every.join(ends, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b").distinct()


def classes(docs: DataFrame, id_col="doc_id", text_col="text", similar: float = SIMILAR, sift: float = SIFT) -> DataFrame:
    """(doc_id, class_id): the least id of the documents joined to it by links of at least ``similar``.

    Rows with the same words are always in one class. Rows that share an id are in
    one class, with the links of all their texts. A text without words has no
    links; a null id has a null class and takes no part. One row for each input row.
    """
    every = C.checkpoint(sign(docs, id_col, text_col))
    nodes = C.checkpoint(every.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.max("sig").alias("sig")).select("node", "first.doc_id", "first.th", "sig"))
    signed = nodes.where("sig is not null").select("node", "sig")
    rows = bands(signed)
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = C.checkpoint(rows.join(sizes, "band"))
    central = C.checkpoint(met.groupBy("node").agg(F.sum("n").alias("mates")))
    texts = C.keyed(docs, id_col, text_col).join(nodes.join(central, "node", "left_semi").select("node", "doc_id", "th"), ["doc_id", "th"])
    sets = C.checkpoint(elements(texts).dropDuplicates(["node"]))
    pivots = met.join(central, "node").groupBy("band").agg(F.max_by("node", F.struct("mates", "node")).alias("p1"), F.min_by("node", F.xxhash64("node", "band")).alias("p2"))
    meetings = met.join(pivots, "band").select("node", F.explode(F.array("p1", "p2")).alias("pivot")).where("node <> pivot")
    first = meetings.groupBy("node", "pivot").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("b")).select(F.col("node").alias("a"), "b")
    links = verified(first, sets, similar).select("a", "b")
    shared = _ids_of_many(every)
    roots = components(links if shared is None else links.union(shared))
    more = _other_links(met, roots, signed, sets, similar, sift)
    final = roots if more is None else components(roots.toDF("a", "b").union(more))
    own = final.join(nodes.select("node", "doc_id"), "node")
    least = own.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = nodes.select("node", "doc_id").join(own.join(least, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "doc_id").alias("class_id"))
    found = every.select("doc_id", "node").join(named, "node").select("doc_id", "class_id")
    nulls = docs.where(F.col(id_col).cast("long").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return found.unionAll(nulls)


def _other_links(met: DataFrame, roots: DataFrame, signed: DataFrame, sets: DataFrame, similar: float, sift: float) -> DataFrame | None:
    """Links of the pairs of a bucket that are in different components; None if no bucket has two."""
    placed = C.checkpoint(met.join(roots, "node", "left").select("band", "nth", "n", "node", F.coalesce("root", "node").alias("root")))
    main = placed.groupBy("band", "root").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("k"), F.count("*").alias("roots")).where("roots > 1")
    mixed = C.checkpoint(placed.join(main.drop("roots"), "band").withColumn("stray", F.col("root") != F.col("main")).drop("main"))
    large = mixed.where(F.col("n") > SMALL)
    many = not large.isEmpty()
    if not many and mixed.isEmpty():
        return None
    small = mixed.where(F.col("n") <= SMALL)
    one = small.where("stray").select("band", F.col("node").alias("a"), F.col("root").alias("ra"))
    two = small.select("band", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("stray").alias("sb"))
    pairs = one.join(two, "band").where("ra <> rb and (not sb or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verified(pairs, sets, similar).select("a", "b")
    if not many:
        return links
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("int")
    dealt = large.withColumn("pi", blocks(F.col("n") - F.col("k"))).withColumn("pj", blocks(F.col("n")))
    place = lambda n: F.pmod(F.xxhash64("node", "band"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ("band", "nth", "node", "root", "stray")
    strays = dealt.where("stray").withColumn("i", place("pi")).withColumn("j", upto("pj")).select(*names, "i", "j", F.lit(0).alias("side"))
    rest = dealt.withColumn("j", place("pj")).withColumn("i", upto("pi")).select(*names, "i", "j", F.lit(1).alias("side"))
    full = strays.union(rest).join(signed, "node").join(sets, "node")
    return links.union(block_links(full, similar, sift).select("a", "b"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all their columns, whose id is its class's id; null ids stay."""
    gone = classes(docs, id_col, text_col, similar).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(C.read(spark, sf_dir, "documents"))
