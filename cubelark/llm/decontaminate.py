"""Benchmark decontamination: one Aho-Corasick automaton, one scan of the text.

Every distinct benchmark word becomes one symbol, so a window of ten words is a
pattern of ten symbols and a document is a string of as many symbols as words
(one shared symbol for words that no item has). All windows of all items sit in
one automaton; a document passes it once. Word places lead back to code points
of the original text, because normalising keeps the byte length.

A worker builds the automaton once and keeps it for its next tasks. It takes some
80 bytes a byte of item text, so it is bounded: benchmarks of up to ``block_bytes``
of text, 16 MB by default, have one automaton and one scan. Larger ones are dealt
into blocks, each block is scanned by itself, and a document's spans from several
blocks are joined by its id.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_SCAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("froms", pa.list_(pa.int64())), ("tos", pa.list_(pa.int64()))])
_SCAN_DDL = "doc_id long, th long, n_words long, starts array<int>, ends array<int>, items array<string>, froms array<long>, tos array<long>"
_OTHER = "\x01"


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; the words themselves if they are fewer; none if there are none."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def automaton(items: list[tuple[str, bytes]], size: int):
    """(symbols of words, automaton whose values are (length, item ids)) for (item id, text) pairs."""
    symbols: dict[bytes, str] = {}
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        for window in windows(C.alnum_words(text), size):
            for word in window:
                if word not in symbols:  # code points from 2 on, without the surrogates
                    symbols[word] = chr(len(symbols) + 2 if len(symbols) < 0xD000 else len(symbols) + 0x2000)
            key = "".join(map(symbols.__getitem__, window))
            found.setdefault(key, (len(window), set()))[1].add(item)
    machine = ahocorasick.Automaton()
    for key, (length, ids) in found.items():
        machine.add_word(key, (length, tuple(sorted(ids))))
    if found:
        machine.make_automaton()
    return symbols, machine if found else None


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_BUILT: dict = {}  # of this worker: the automaton of the items that it met last


def built(items: list[tuple[str, bytes]], size: int):
    """``automaton`` of the items, kept by the worker."""
    key = size, xxhash.xxh3_128_hexdigest(repr(items).encode())
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(items, size)
    return _BUILT[key]


def _scanner(shared, size):
    def scan(batches):
        symbols, machine = built(shared.value, size)
        get = symbols.get
        for b in batches:
            out = [[] for _ in range(6)]
            for text in b.column(2).to_pylist():
                words = C.alnum_words(text)
                spans, ids = [], set()
                if machine is not None and words:
                    for end, (length, items) in machine.iter("".join([get(w, _OTHER) for w in words])):
                        spans.append((end - length + 1, end + 1))
                        ids.update(items)
                    spans = merge(spans)
                starts, ends = [s for s, _ in spans], [e for _, e in spans]
                places = original_spans(text, starts, ends) if spans else []
                for column, value in zip(out, (len(words), starts, ends, sorted(ids), [s for s, _ in places], [e for _, e in places])):
                    column.append(value)
            yield C.batch(_SCAN, b.column(0), b.column(1), *out)

    return scan


def scan(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window: int = 10, block_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, th, n_words, starts, ends, items, froms, tos): hit word spans, the items found, and the spans' places
    in the original text in code points; a row for each document.

    Items that are null, have a null id or no words match nothing; with no items
    no document is hit. Null and empty documents have no words. Repeated rows
    and ids give a row each. Item ids are compared and sorted as strings.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text")).where("id is not null and text is not null")
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 1) // block_bytes)
    keyed, parts = C.keyed(docs, id_col, text_col), []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast([(r.id, bytes(r.text)) for r in own])
        parts.append(keyed.mapInArrow(_scanner(shared, window), _SCAN_DDL))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  bounded by the document's own words
    every = every.groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"), flat("starts"), flat("ends"), flat("items"), flat("froms"), flat("tos"), (F.count("*") / blocks).cast("int").alias("copies"))
    return every.select("doc_id", "th", "n_words", "starts", "ends", F.array_sort(F.array_distinct("items")).alias("items"), "froms", "tos", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


_HIT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))

    def digest(batches):
        for b in batches:
            hits, shas = [], []
            for s, e, ids in zip(*(b.column(k).to_pylist() for k in (3, 4, 5))):
                hits.append(sum(y - x for x, y in merge(list(zip(s, e)))))
                shas.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            yield C.batch(_HIT, b.column(0), b.column(2), hits, [len(x) for x in b.column(5).to_pylist()], shas, [h > 0 for h in hits])

    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def original_spans(text: bytes, starts, ends) -> list[tuple[int, int]]:
    """Code-point spans in the original text of word spans found by ``scan``."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(C.ALNUM))]
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[places[s][0]]), int(before[places[e - 1][1]])) for s, e in zip(starts, ends)]


def clean(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs."""
    hit = scan(docs, items, id_col, text_col, **options).where(F.size("starts") > 0).select(F.col("doc_id").alias("__hit_id"), F.col("th").alias("__hit_th")).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.xxhash64(F.col(text_col)) == F.col("__hit_th")), "left_anti")


SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low),
p AS (SELECT DISTINCT item_id, k, n FROM (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0))),
g AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT doc_id, s, g.n, item_id FROM g JOIN p ON g.k = p.k AND g.n = p.n),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
