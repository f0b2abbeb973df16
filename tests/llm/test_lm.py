"""The language model against a plain version: dictionaries of counts, one token at a time."""

import collections
import math
import random

import numpy as np
import pytest

from cubelark.llm import common as C
from cubelark.llm import lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so", "ta", "vi") for b in ("ba", "de", "fi", "go", "hu", "la", "ra", "ti")]


def corpus():
    rng = random.Random(4)
    after = {w: [rng.choice(WORDS) for _ in range(2)] for w in WORDS}
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "KA lo"), (5, "one"), (None, "ka ba"), (None, None), (7, "x " * 500), (7, "x " * 500), (7, "other text"), (8, "\u00c9\x00\x1c a\xa0b")]
    for i in range(20, 300):
        w = [rng.choice(WORDS)]
        while len(w) < rng.randrange(30, 90):
            w.append(rng.choice(after.get(w[-1], WORDS)) if rng.random() < 0.8 else f"rare{rng.randrange(3000)}")
        rows.append((i, " ".join(w)))
    return rows


def low(text):
    return [*(text or "").encode().translate(C.LOWER).split(), b" end"]


def counts(texts):
    """Counts of n-grams of three orders and of their contexts; the end stands before a text."""
    grams, contexts = collections.Counter(), collections.Counter()
    for words in texts:
        line = [b" end", b" end", *words]
        for i in range(2, len(line)):
            for n in (1, 2, 3):
                grams[tuple(line[i - n + 1 : i + 1])] += 1
                contexts[tuple(line[i - n + 1 : i])] += 1
    return grams, contexts


def plain(rows, groups):
    """(training tokens, [(n_tokens, n_known, base, score)]) with weights learned on the given groups of row numbers."""
    words = [low(t) for _, t in rows]
    train = [not C.in_fold(d, 5, 1) for d, _ in rows]
    grams, contexts = counts(w for w, t in zip(words, train) if t)
    total = contexts[()]
    known = {g[0]: n for g, n in grams.items() if len(g) == 1}
    new = min(0.5, max(sum(n == 1 for n in known.values()), 0.5) / total)
    level = lambda s: 0 if s <= 0 else min(1 + int(math.log2(s)), lm.LEVELS - 1)
    weights = [collections.defaultdict(lambda: 0.5) for _ in range(3)]

    def mixture(line, i, grams, contexts, orders):
        s = [contexts[tuple(line[i - n + 1 : i])] for n in (1, 2, 3)]
        bucket = level(s[1]), level(s[2])
        p = (1 - new) / len(known) if grams[(line[i],)] > 0 else new
        estimates = [grams[tuple(line[i - n + 1 : i + 1])] / max(s[n - 1], 1) for n in (1, 2, 3)]
        for k in range(orders):
            w = weights[k][bucket] if s[k] > 0 else 0.0
            p = w * estimates[k] + (1 - w) * p
        return p, bucket, s, estimates

    for order in range(3):
        data = []
        for group in groups:
            own = counts(words[i] for i in group if train[i])
            rest = [collections.Counter(dict(a)) for a in (grams, contexts)]
            for a, b in zip(rest, own):
                a.subtract(b)
            for i in group:
                if train[i]:
                    line = [b" end", b" end", *words[i]]
                    for at in range(2, len(line)):
                        p, bucket, s, f = mixture(line, at, *rest, order)
                        if s[order] > 0:
                            cell = lm.steps(np.array([f[order] / p]))[0]
                            data.append((bucket, 0.0 if cell == 0 else 2.0 ** ((cell - 1 - lm.FAR * lm.OCTAVE) / lm.OCTAVE)))
        by = collections.defaultdict(list)
        for bucket, r in data:
            by[bucket].append(r)
        for bucket, rs in by.items():
            w, rs = 0.5, np.array(rs)
            for _ in range(100):
                w = ((w * rs / (w * rs + 1 - w)).sum() + 0.5) / (len(rs) + 1)
            weights[order][bucket] = w
    out = []
    for own in words:
        line = [b" end", b" end", *own]
        n = [known.get(w, 0) for w in own]
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (len(known) + 1))) for c in n)
        out.append((len(own), sum(c > 0 for c in n), base, sum(math.log10(mixture(line, i, grams, contexts, 3)[0]) for i in range(2, len(line)))))
    return total, out


def test_query_matches_plain(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = lm.query(spark, str(tmp_path)).collect()
    docs = C.keyed(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    order = [r.doc_id for r in docs.collect()]
    assert order == [i for i, _ in rows]
    plan = lm.Plan(sum(len((t or "").encode()) + 8 for _, t in rows))
    groups, held, size = [], [], 0
    for i, (_, t) in enumerate(rows):
        held.append(i)
        size += len((t or "").encode()) + 8
        if size >= plan.size:
            groups, held, size = [*groups, held], [], 0
    total, want = plain(rows, [*groups, held] if held else groups)
    key = lambda r: (-1 if r[0] is None else r[0], *(round(x, 6) for x in r[1:]))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in found), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-7)
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-6)
    assert {r.train_tokens for r in found} == {total}
    assert all(r.held_out == C.in_fold(r.doc_id, 5, 1) for r in found)


def test_small_chunks_and_many_tasks_match_plain(spark):
    """The counts do not depend on how rows are dealt; with small chunks and buckets the weights come from several chunks."""
    rows = corpus()
    docs = C.keyed(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5))
    fold = C.fold_column("doc_id", 5) == 1
    marked = docs.select("doc_id", "text", (~fold).alias("train"), fold.alias("ask"))
    held = lm.counted(C.checkpoint(marked), bucket=2_000)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(low(t))
    grams, contexts = counts(w for d, own in texts.items() for w in own if not C.in_fold(d, 5, 1))
    chunks = [r.asDict() for r in held.where("chunk >= 0").collect()]
    assert len(chunks) >= 5 and sum(len(r["doc_id"]) for r in chunks) == len(rows)
    for row in chunks:
        own, at = lm.Counts(row), 0
        values = [x.tolist() for x in own.at_tokens(False)]
        for d, n in zip(row["doc_id"], own.lengths.tolist()):
            fits = [w for w in texts[d] if len(w) == n and [grams[(x,)] for x in w] == values[0][at : at + n]]
            line = [b" end", b" end", *fits[0]]
            for k in range(2, len(line)):
                want = *(grams[tuple(line[k - m + 1 : k + 1])] for m in (1, 2, 3)), *(contexts[tuple(line[k - m + 1 : k])] for m in (2, 3))
                assert tuple(v[at + k - 2] for v in values) == want
            at += n
    out = lm.scores(held, lm.learn(held)).collect()
    assert len(out) == sum(C.in_fold(d, 5, 1) for d, _ in rows)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_each_context_has_a_distribution():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 12, 400).tolist()
    grams, contexts = counts([[bytes([65 + w]) for w in words]])
    known = sorted({g for g in grams if len(g) == 1})
    model = lm.Model(contexts[()], len(known), sum(grams[g] == 1 for g in known))
    model.weights = [rng.random(lm.LEVELS**2) for _ in range(3)]
    for h2, h1 in ((known[0][0], known[3][0]), (b"?", known[2][0]), (b"?", b"!"), (b" end", b" end")):
        every = [*(k[0] for k in known), b"never"]
        n = [np.array([grams[(*h, w)] for w in every]) for h in ((), (h1,), (h2, h1))]
        s = [np.full(len(every), contexts[h]) for h in ((h1,), (h2, h1))]
        assert model.probability(*n, *s, contexts[()]).sum() == pytest.approx(1)


def test_word_pairs_far_below_the_frequent_ones_count(spark):
    rng = random.Random(8)
    words = [f"w{i}x" for i in range(2400)]
    after = dict(zip(words, rng.sample(words, len(words))))

    def text(paired):
        return " ".join(f"{w} {after[w] if paired else rng.choice(words)}" for w in (rng.choice(words) for _ in range(60)))

    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score(frame([(1000 + i, text(i % 2 == 0)) for i in range(40)]), frame([(i, text(True)) for i in range(400)])).collect()
    per = lambda odd: np.mean([r.score / r.n_tokens for r in got if r.doc_id % 2 == odd])
    assert len(got) == 40 and per(0) > per(1) + 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm.score(none, none).count() == 0 and lm.score(none, some).count() == 0
    assert [(r.n_known, r.score) for r in lm.score(some, none).collect()] == [(0, 0.0)] * 2


def test_word_hashes_are_equal_for_equal_words_only():
    rng = random.Random(2)
    texts = [None, b"", b" \t\n", *("".join(chr(rng.choice([*range(0, 0x180), 0x2028])) for _ in range(rng.randrange(80))).encode() for _ in range(200)), b"a " * 700_000, b"x" * 1_500_000]
    hashes, lengths = C.lower_word_hashes(texts, 7)
    want = [w for t in texts for w in [*((t or b"").translate(C.LOWER).split()), b" end"]]
    assert lengths.tolist() == [len((t or b"").split()) + 1 for t in texts] and len(hashes) == len(want)
    of: dict = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(want, hashes.tolist()))
    assert len(set(of.values())) == len(of) and of[b" end"] == 7


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for values in (np.empty(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 1 << 40, 1000).astype(np.uint64), np.array([3], np.uint64)):
        assert (lm.unpack(lm.pack(values)) == values).all()
        ranked = np.sort(values)
        assert (lm.unpack_sorted(lm.pack_sorted(ranked)) == ranked).all()
