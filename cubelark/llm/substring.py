"""Exact substring dedup: winnowed anchors are joined, matches grow both ways.

A window of ``min_words`` words holds ``min_words - anchor + 1`` runs of
``anchor`` words. The one with the least hash (leftmost on ties) is the
window's anchor; it depends on the window's words alone, so equal windows in two
documents have equal anchors at equal offsets. Rows meet by anchor. From an
anchor a window reaches some words to the left and the rest to the right, and
two rows match in it if both stretches are equal; adjoining matches merge into
maximal repeats. A stretch is compared by 32 bits of hash, so that 128 bits of
anchor and stretches decide on a match. No pair of documents is ever formed: the
work is linear in the corpus, however often a passage occurs.

Anchors are joined twice, by the same rule: first within a chunk of a map task,
where the words of a match are compared as well, so that a passage of a third of
all documents sends about one row a chunk; then over all chunks. Within an
anchor's rows, sorted by doc_id, a task holds only the distinct stretches seen so
far. Anchors that a sample finds in many documents are split by their windows'
stretches into ``SPLIT`` parts; which anchors are split has no bearing on results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_ROW = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("w", pa.binary())])
_SPAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
#: Parts of an anchor in many documents; the share of sampled documents, one in SAMPLE, that makes it one.
SPLIT, SHARE, SAMPLE = np.uint64(256), 0.002, 16
_INVERSE = np.uint64(pow(int(C.BASE), -1, 1 << 64))


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the leftmost minimum of ``width`` values."""
    at, have = np.arange(len(values), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        left, right = values[: len(values) - step], values[step:]
        less = right < left
        at = np.where(less, at[step:], at[: len(at) - step])
        values = np.where(less, right, left)
        have += step
    return at


def _runs(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end index of runs, where breaks[i] says that i + 1 begins a new one."""
    first = np.concatenate(([0], np.flatnonzero(breaks) + 1)) if n else np.empty(0, np.int64)
    return first, np.append(first[1:], n) if n else first


def join_anchors(anchor: np.ndarray, stretch: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the first one (of the least id) with its anchor and stretches; and the distinct ones' first rows."""
    by = np.lexsort((ids, stretch, anchor))
    firsts, ends = _runs((stretch[by][1:] != stretch[by][:-1]) | (anchor[by][1:] != anchor[by][:-1]), len(by))
    source = np.empty(len(by), np.int64)
    source[by] = np.repeat(by[firsts], ends - firsts)
    return source, by[firsts]


class Windows:
    """All windows of documents laid end to end: start, document, anchor and stretches of each."""

    def __init__(self, words: list[list[bytes]], hasher: C.WordHasher, min_words: int, anchor: int):
        lengths = np.array([len(w) for w in words], np.int64)
        self.hashes = hashes = np.concatenate([hasher.array(w) for w in words])
        of = np.repeat(np.arange(len(words)), lengths)
        self.begin = np.cumsum(lengths) - lengths
        n = max(0, len(hashes) - min_words + 1)
        self.at = at = np.flatnonzero(of[:n] == of[min_words - 1 : min_words - 1 + n])
        self.own = of[at]
        grams = C.gram_hashes(hashes, anchor, seed=1)
        place = _leftmost_minima(grams, min_words - anchor + 1)[at] if n else at
        self.anchor = grams[place]
        power, back = (np.cumprod(np.full(len(hashes) + 1, x)) * pow(int(x), -1, 1 << 64) for x in (C.BASE, _INVERSE))
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)))
        hashed = lambda a, b: C.mix((before[b] - before[a]) * back[a] + (b - a).astype(np.uint64)) >> np.uint64(32)
        self.stretch = hashed(at, place) << np.uint64(32) | hashed(place + anchor, at + min_words)

    def same_words(self, one: np.ndarray, two: np.ndarray, min_words: int) -> np.ndarray:
        """Whether windows ``one`` and ``two`` have the same words, word by word."""
        a, b, same = self.at[one], self.at[two], np.ones(len(one), bool)
        for k in range(min_words):
            same &= self.hashes[a + k] == self.hashes[b + k]
        return same


def _find(min_words: int, anchor: int, hot: np.ndarray):
    def anchors(batches):
        hasher = C.WordHasher()
        for b in batches:
            ids, ths, texts = (b.column(i).to_pylist() for i in range(3))
            order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=ids.__getitem__)
            for first, words in C.chunks([texts[i] for i in order], C.blank_words):
                if not any(len(w) >= min_words for w in words):
                    continue
                rows = order[first : first + len(words)]
                doc, th = (np.array([column[i] for i in rows], np.int64) for column in (ids, ths))
                win = Windows(words, hasher, min_words, anchor)
                at, own = win.at, win.own
                source, _ = join_anchors(win.anchor, win.stretch, doc[own])
                known = doc[own[source]] < doc[own]
                which = np.flatnonzero(known)
                known[which] = win.same_words(which, source[which], min_words)
                off = win.begin

                def row(lo, hi, h, packed):
                    s, e = at[lo] - off[own[lo]], at[hi - 1] + min_words - off[own[lo]]
                    return C.batch(_ROW, h, doc[own[lo]], th[own[lo]], s.astype(np.int32), e.astype(np.int32), packed)

                cut = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (known[1:] != known[:-1])
                lo, hi = _runs(cut, len(at))
                lo, hi = lo[known[lo]], hi[known[lo]]
                yield row(lo, hi, doc[own[lo]], pa.nulls(len(lo), pa.binary()))  # settled spans
                h = win.anchor
                if len(hot):
                    many = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                    h = np.where(many, C.mix(h + (win.stretch % SPLIT + np.uint64(1)) * C.BASE), h)
                lo, hi = _runs(cut | (h[1:] != h[:-1]), len(at))
                lo, hi = lo[~known[lo]], hi[~known[lo]]
                raw = win.stretch.astype("<u8").tobytes()
                yield row(lo, hi, h[lo].view(np.int64), [raw[8 * x : 8 * y] for x, y in zip(lo.tolist(), hi.tolist())])

    def extend(batches):
        held = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))  # anchor, stretches, least id
        for b in batches:
            h, doc, th, s, e = (b.column(i).to_numpy() for i in range(5))
            raw = b.column(5)
            settled = raw.is_null().to_numpy(zero_copy_only=False)
            if settled.any():
                yield C.batch(_SPAN, doc[settled], th[settled], s[settled], e[settled])
            rows = np.flatnonzero(~settled)
            if not len(rows):
                continue
            counts = (e[rows] - s[rows] - min_words + 1).astype(np.int64)
            row = np.repeat(rows, counts)
            start = s[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            skip = len(held[0])
            own = np.concatenate((held[0], h[row]))
            stretch = np.concatenate((held[1], np.frombuffer(b"".join(x for x in raw.to_pylist() if x is not None), "<u8")))
            ids = np.concatenate((held[2], doc[row]))
            source, firsts = join_anchors(own, stretch, ids)
            last = firsts[own[firsts] == h[rows[-1]]]
            hit = np.flatnonzero(ids[skip:] > ids[source[skip:]])
            held = (own[last], stretch[last], ids[last])
            if len(hit):
                r, at = row[hit], start[hit]
                lo, hi = _runs((r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1), len(hit))
                yield C.batch(_SPAN, doc[r[lo]], th[r[lo]], at[lo].astype(np.int32), (at[hi - 1] + min_words).astype(np.int32))

    return anchors, extend


def frequent_anchors(keyed: DataFrame, min_words: int, anchor: int) -> np.ndarray:
    """Anchors of many documents, ascending, by a sample of (doc_id, th, text): at most a few thousand. They only guide the split."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        hasher = C.WordHasher()
        for b in batches:
            for _, words in C.chunks(b.column(2).to_pylist(), C.blank_words):
                win = Windows(words, hasher, min_words, anchor)
                first = np.concatenate(([True], (win.anchor[1:] != win.anchor[:-1]) | (win.own[1:] != win.own[:-1])))[: len(win.at)]
                h, n = np.unique(win.anchor[first], return_counts=True)
                many = n > max(1, len(words) * SHARE / 2)
                yield C.batch(schema, [*h[many].view(np.int64).tolist(), None], [*n[many].tolist(), 0], [*[0] * int(many.sum()), len(words)])

    drawn = keyed.where(F.pmod(F.xxhash64("doc_id", F.lit("anchors")), F.lit(SAMPLE)) == 0)
    sums = drawn.mapInArrow(run, "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = C.checkpoint(sums)
    least = max(8, SHARE * (sums.agg(F.sum("docs")).first()[0] or 0))
    return np.sort(sums.where("h is not null").where(F.col("n") >= least).select("h").toArrow().column(0).to_numpy().view(np.uint64))


def repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 50, anchor: int = 16) -> DataFrame:
    """Word spans [s, e) of repeats that a document with a smaller id has too: (doc_id, th, s, e).

    Spans of one document may adjoin or overlap; their union is the maximal
    repeats. Null ids take no part, null and short texts have no window.
    """
    if not 0 < anchor <= min_words:
        raise ValueError("anchor must be from 1 to min_words")
    keyed = C.keyed(docs, id_col, text_col)
    anchors, extend = _find(min_words, anchor, frequent_anchors(keyed, min_words, anchor))
    found = keyed.mapInArrow(anchors, "h long, doc_id long, th long, s int, e int, w binary")
    return found.repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(extend, "doc_id long, th long, s int, e int")


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_repeats", pa.int64()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 50, anchor: int = 16) -> DataFrame:
    """(doc_id, n_words, n_removed, n_repeats, kept): kept is the words left, joined by one blank.

    Of a passage's occurrences, those in the document with the least id stay.
    A passage repeated only inside one document stays. Null and empty texts have
    no words. Rows that repeat an id are judged each by its own text; a row with
    a null id keeps all its words. Other columns of the input are not used.
    """
    spans = repeated_spans(docs, id_col, text_col, min_words, anchor)
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def cut(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            spans = b.column(2)
            flat, offsets = spans.flatten(), [0, *np.cumsum([0 if x is None else x for x in pc.list_value_length(spans).to_pylist()]).tolist()]
            s, e = (flat.field(i).to_numpy() for i in range(2))
            out = [[], [], [], []]
            for i, text in enumerate(texts):
                words = C.blank_words(text)
                n, removed, repeats = len(words), 0, 0
                if offsets[i] < offsets[i + 1]:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, s[offsets[i] : offsets[i + 1]], 1)
                    np.add.at(depth, e[offsets[i] : offsets[i + 1]], -1)
                    keep = np.cumsum(depth)[:n] == 0
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                    removed = n - len(words)
                    repeats = int((np.diff(np.concatenate(([True], keep)).astype(np.int8)) == -1).sum())
                for column, value in zip(out, (n, removed, repeats, b" ".join(words))):
                    column.append(value)
            yield C.batch(_KEPT, ids, *out)

    keyed = C.keyed(docs, id_col, text_col).alias("d")
    joined = keyed.join(spans.alias("r"), (F.col("d.doc_id") == F.col("r.doc_id")) & (F.col("d.th") == F.col("r.th")), "left")
    return joined.select("d.doc_id", "d.text", "r.spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, n_repeats long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(C.read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window as its joined words; its least document; the words that later documents' windows cover.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN m USING (k) WHERE least < doc_id),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(ps, x)), lambda x: w[x]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
