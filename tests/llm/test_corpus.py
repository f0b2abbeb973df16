"""Corpus operators against plain versions on small fixtures, with the odd rows that tables have."""

import collections
import hashlib
import pathlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelark.llm import common as C
from cubelark.llm import decontaminate, langid, licenses, media, minhash, packing, pii, substring, toxicity
from cubelark.llm.boosting import Boosted, isotonic
from cubelark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so", "ta", "vi") for b in ("ba", "de", "fi", "go", "hu", "la", "ra", "ti")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, long, repeated rows and ids, null ids, shared passages."""
    rng = random.Random(5)
    passage, long = prose(rng, 70), prose(rng, 6000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Mit"), (5, long), (6, long), (7, long), (7, long), (8, prose(rng, 30) + " " + passage), (9, passage + "\x0b" + prose(rng, 20)), (9, passage), (None, passage), (None, None), (10, "x " * 120), (11, "x " * 60), (12, "É" * 3 + "\x00\x1c\x85 a\xa0b")]
    return rows, frame(spark, rows)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokenisers_match_their_patterns():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([*range(0, 0x180), 0x2028, 0x3000, 0x1F600])) for _ in range(60))
        assert [w.decode() for w in C.blank_words(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", text)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        assert [w.decode() for w in C.alnum_words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_gram_hashes_are_equal_for_equal_runs_only():
    words = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    for k in range(1, 7):
        grams = C.gram_hashes(words, k)
        assert len(grams) == 8 - k
        for i in range(len(grams)):
            for j in range(len(grams)):
                assert (grams[i] == grams[j]) == (words[i : i + k] == words[j : j + k]).all()


# --- substring dedup


def plain_repeats(rows, n=50):
    low = {}
    for d, t in rows:
        w = C.blank_words(t.encode() if t else None)
        for i in range(len(w) - n + 1):
            if d is not None:
                low[tuple(w[i : i + n])] = min(d, low.get(tuple(w[i : i + n]), d))
    out = []
    for d, t in rows:
        w = C.blank_words(t.encode() if t else None)
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and low[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), b" ".join(kept)))
    return sorted(out, key=repr)


def test_substring_matches_plain(spark, odd):
    rows, docs = odd
    rng = random.Random(9)
    shared = [prose(rng, n) for n in (49, 50, 51, 80)]
    rows = rows + [(100 + i, " ".join(rng.choice([prose(rng, rng.randrange(40)), rng.choice(shared)]) for _ in range(6))) for i in range(60)]
    for parts in (1, 7):
        got = substring.remove_repeats(frame(spark, rows).repartition(parts).withColumn("th", F.lit("clash")).withColumn("s", F.lit(1))).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got], key=repr) == plain_repeats(rows)
    assert substring.remove_repeats(empty(spark)).count() == 0


# --- media


def test_media_round_trip_and_alignment(spark, odd):
    rows, docs = odd
    for n in (0, 1, 63, 64, 65, 5000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and payload and media.decode(media.encode(payload)) == payload
    with pytest.raises(ValueError):
        media.decode(media.encode(bytes(64))[:-20] + b"x" * 20)
    store = media.build_store(docs)
    assert store.count() == len({t or "" for _, t in rows})
    found = media.resolve(media.parse_pages(media.document_pages(docs)), media.read_store(store)).where("kind = 'media'").collect()
    want = collections.Counter((d, len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for d, t in rows)
    assert collections.Counter((r.page_id, r.n_bytes, r.payload_sha256) for r in found) == want
    assert all(r.caption == f"text of {'none' if r.page_id is None else r.page_id}" for r in found)
    assert media.read_store(media.build_store(empty(spark))).count() == 0


def test_sequence_keeps_order_and_captions():
    page = "<p>one <b>two</b></p><figure><img src='sha256:ab'><img src='c.png' alt='own'><figcaption>cap</figcaption></figure><script>no</script>tail<img src=x alt=y><figcaption>loose"
    assert [p[1:] for p in media.sequence(page)] == [
        ("text", "one two", None, None), ("media", None, "sha256:ab", "cap"), ("media", None, "c.png", "cap"), ("text", "tail", None, None), ("media", None, "x", "y"), ("text", "loose", None, None),
    ]
    assert media.sequence(None) == media.sequence("") == []
    assert [p[0] for p in media.sequence(page)] == list(range(6))


# --- toxicity


def toxic_rows():
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = prose(rng, 30) + (" " + rng.choice(["vileness", "vilely", "scumbag"]) if bad else "")
        rows.append((i, text))
        if i % 2 == 0 or bad:
            marks.append((i, int(bad)))
    return rows, marks


def test_toxicity_finds_held_out_and_handles_odd_rows(spark, odd):
    rows, marks = toxic_rows()
    labels = spark.createDataFrame(marks + [(None, 1), (5000, None), (0, 0)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(*toxicity.training_rows(docs, labels), prior=1 / 6)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if C.in_fold(i, 5, 0)]
    assert np.mean([(got[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    scored = toxicity.score(odd[1], model).collect()
    assert len(scored) == len(odd[0]) and all(0 <= r.score <= 1 for r in scored)
    kept = {r.doc_id for r in toxicity.clean(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5} and toxicity.clean(docs, model).columns == docs.columns
    bare = toxicity.fit(empty(spark), labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(odd[1], bare).collect())
    assert toxicity.score(empty(spark), bare).count() == 0


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    y = np.r_[np.ones(200, int), np.zeros(2000, int)]
    truth = np.r_[np.ones(200, bool), rng.random(2000) < 0.15]
    x = rng.random((2200, 20)) < np.where(truth[:, None], 0.6, 0.05)
    w, b = toxicity.train(x, y, 0.15)
    assert ((x[200:] @ w + b > 0) == truth[200:]).mean() > 0.97


# --- packing


@pytest.mark.parametrize("seed", range(8))
def test_pack_is_valid_and_downsized(seed):
    rng = random.Random(seed)
    sizes = (16, 32, 64, 128)
    lengths = sorted((rng.randrange(1, 129) for _ in range(rng.randrange(1, 200))), reverse=True)
    where, offset, size = packing.pack(lengths, sizes)
    filled = collections.defaultdict(list)
    for n, b, o in zip(lengths, where, offset):
        filled[b].append((o, o + n))
    assert sorted(filled) == list(range(len(size)))
    for b, spans in filled.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert size[b] == min(s for s in sizes if s >= spans[-1][1])
    assert sum(map(packing.cost, size)) <= sum(packing.cost(min(s for s in sizes if s >= n)) for n in lengths)


def test_pack_small_cases_by_hand():
    assert packing.pack([], (8,)) == ([], [], [])
    assert packing.pack([8, 5, 3], (8,)) == ([0, 1, 1], [0, 0, 5], [8, 8])
    assert packing.pack([3], (4, 8))[2] == [4]


def test_place_covers_every_token(spark, odd):
    rows, docs = odd
    placed = packing.place(docs, sizes=(512, 2048), shard_items=5).collect()
    want = collections.Counter(d for d, t in rows for _ in range(len(C.blank_words((t or "").encode())) + 1))
    got = collections.Counter()
    for r in placed:
        got[r.doc_id] += r.n_tokens
    assert got == want
    bins = collections.defaultdict(list)
    for r in placed:
        bins[r.bin_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert len({r.bin_size for r in own}) == 1 and sum(r.n_tokens for r in own) <= own[0].bin_size
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(own, own[1:]))
    again = packing.place(docs.repartition(5), sizes=(512, 2048), shard_items=5).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, placed))
    assert packing.place(empty(spark)).count() == 0
    one = frame(spark, [(1, "a b c"), (2, "d")])
    made = packing.materialise(packing.place(one), one).collect()
    assert sorted(tuple(p["words"]) for r in made for p in r.pieces) == [("a", "b", "c"), ("d",)]


# --- language ID


def test_language_of_held_out_mixed_and_odd_texts(spark, odd):
    rng = random.Random(3)
    made = {"aa": "the of and ing tion er", "bb": "lich schaft und der ein zu", "cc": "eau ment les que oux re"}
    text = lambda lang, n: " ".join("".join(rng.choice(made[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(8, 60)), lang) for i, lang in enumerate(random.Random(1).choices(list(made), k=400))]
    docs = spark.createDataFrame(rows + [(900, "the", None), (901, None, "aa")], "doc_id long, text string, lang string")
    model = langid.fit(docs.where(C.fold_column("doc_id", 4) != 2))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if C.in_fold(i, 4, 2)]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    mixed, _ = model.proportions((text("aa", 60) + " " + text("bb", 30)).encode())
    assert set(mixed) == {"aa", "bb"} and 0.5 < mixed["aa"] < 0.85
    out = langid.predict(odd[1], model).collect()
    assert len(out) == len(odd[0]) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.predict(empty(spark), langid.fit(empty(spark))).count() == 0
    assert langid.fit(empty(spark)).proportions(b"word") == ({}, 0.0)


# --- licenses


def test_license_base_places_match_plain(spark, odd):
    rng = random.Random(7)
    parts = ["MIT License", "apache-license", "General Public License", "mit", "license", "public", "general", *WORDS[:6]]
    rows = list(odd[0]) + [(100 + i, " ".join(rng.choice(parts) for _ in range(40))) for i in range(60)] + [(300, "mit license mit license mit license")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(frame(spark, rows)).collect())
    want = collections.Counter()
    for d, t in rows:
        w = [x.decode() for x in C.alnum_words((t or "").encode())]
        at = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == want
    assert licenses.scan(empty(spark)).count() == 0


def test_license_rules_and_suppression():
    scan = licenses.Scanner()
    assert len(licenses.rules()) > 300
    labels = lambda text: sorted({x[4] for x in scan(C.alnum_words(text.encode()))[0]})
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl-3.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("nothing here mit und ohne") == []
    found, base = scan(C.alnum_words(b"this is under the mit license ok"))
    assert base == [(4, "mit")] and [(x[0], x[1], x[4]) for x in found] == [(2, 6, "mit")]
    assert licenses.suppress([(0, 5, 1, 0.9, "a"), (1, 3, 4, 0.7, "b"), (4, 8, 4, 0.7, "c"), (0, 5, 4, 0.7, "d")]) == [(0, 5, 1, 0.9, "a"), (4, 8, 4, 0.7, "c")]


def branches(tree):
    """A sample of each branch of a parsed pattern."""
    out = [""]
    for op, value in tree:
        own = {
            "LITERAL": lambda v: [chr(v)], "IN": lambda v: [chr(v[0][1])] if str(v[0][0]) == "LITERAL" else [chr(v[0][1][0])] if str(v[0][0]) == "RANGE" else ["x"], "ANY": lambda v: ["x"], "ASSERT": lambda v: [""],
            "SUBPATTERN": lambda v: branches(v[3]), "BRANCH": lambda v: [x for b in v[1] for x in branches(b)],
            "MAX_REPEAT": lambda v: [""] * (v[0] == 0) + branches(v[2]), "MIN_REPEAT": lambda v: [""] * (v[0] == 0) + branches(v[2]),
        }[str(op)](value)
        out = [a + b for a in out for b in own]
    return out


def test_license_gates_occur_in_each_branch_of_their_rules():
    for _, _, label, gate, pattern in licenses.rules():
        for text in branches(re._parser.parse(pattern.pattern.decode())):
            assert any(f" {g} " in f" {text} " for g in gate.split("|")), (label, text)
    scan = licenses.Scanner()
    labels = lambda text: {x[4] for x in scan(C.alnum_words(text.encode()))[0]}
    assert labels("see opensource.org/license/mit for it") == {"mit"}
    assert labels("the FreeBSD license holds") == {"bsd-2-clause"}
    assert labels("a 0BSD license file") == {"0bsd"}
    assert labels("is Creative Commons Zero here") == {"cc0-1.0"}
    assert labels("the PNG reference library license") == {"libpng-2.0"}


# --- decontamination


def plain_hits(rows, items, size=10):
    out = collections.Counter()
    every = collections.defaultdict(set)
    for item, text in items:
        w = C.alnum_words(text.encode()) if text else []
        for win in [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []:
            if item is not None:
                every[win].add(str(item))
    for d, t in rows:
        w = C.alnum_words(t.encode() if t else None)
        hit, ids = set(), set()
        for win, own in every.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids |= own
        out[d, len(w), len(hit), ",".join(sorted(ids))] += 1
    return out


@pytest.mark.parametrize("block", [2_000_000, 200])
def test_decontamination_matches_plain(spark, odd, block):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([0, 3, 9, 10, 11, 25]))) for i in range(12)] + [(3, prose(rng, 12)), (None, prose(rng, 12)), (50, None), (51, "Mit")]
    texts = [t for _, t in items if t]
    rows = list(odd[0]) + [(200 + i, " ".join(rng.choice([prose(rng, 8), rng.choice(texts).upper(), rng.choice(texts)[:40]]) for _ in range(5)).replace(" ", rng.choice([" ", "-", "\n"]))) for i in range(40)]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows).withColumn("items", F.lit(1))
    found = decontaminate.scan(docs, table, block_bytes=block).collect()
    got = collections.Counter((r.doc_id, r.n_words, sum(e - s for s, e in decontaminate.merge(list(zip(r.starts, r.ends)))), ",".join(r["items"])) for r in found)
    assert got == plain_hits(rows, items)
    kept = decontaminate.clean(docs, table, block_bytes=block)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, _, hit, _), n in got.items() if not hit)
    assert decontaminate.scan(empty(spark), table).count() == 0
    assert all(not r.starts for r in decontaminate.scan(docs, table.limit(0)).collect())


def test_original_spans_are_code_points():
    text = "Ä, one TWO—x! é three"
    raw = text.encode()
    words = C.alnum_words(raw)
    spans = decontaminate.original_spans(raw, range(len(words)), range(1, len(words) + 1))
    assert [text[s:e] for s, e in spans] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) or [text[s:e].lower() for s, e in spans] == [w.decode().lower() for w in words]


# --- personal data


def test_pii_base_rules():
    card = "4111 1111 1111 1111"
    text = f"write a.b@c.example.com, ip 10.0.0.255 or 1.2.3.256, card {card} or 4111111111111112, call +1 (017) 555-7713 now"
    base = pii.base_spans(text)
    assert [(text[s:e], k) for s, e, k in base] == [("a.b@c.example.com", "email"), ("10.0.0.255", "ip"), (card, "card"), ("+1 (017) 555-7713", "phone")]
    assert pii.base_spans("1" * 6000 + ".1.1.1") == [] and pii.base_spans("") == []
    assert pii.octets("000000255.0.0.1") and not pii.octets("256.1.1.1")
    assert pii.redact_text("x a@b.c y", [(2, 7, "email"), (3, 6, "ip")]) == "x [EMAIL] y"


def test_pii_model_adds_and_never_drops(spark, odd):
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = list(odd[0])
    for i in range(300):
        rows.append((1000 + i, f'{prose(rng, 10)} token = "{hexes(40)}" {prose(rng, 5)} {rng.randrange(1900, 2030)} version {rng.randrange(9)}.{rng.randrange(9)} {"".join(rng.choice(WORDS) for _ in range(9))}'))
    docs = frame(spark, rows)
    model = pii.fit(docs)
    text = f'hold "{hexes(40)}" and {"".join(WORDS[:9])} in 1999 é a@b.example.org'
    base, every = model.spans(text)
    assert set(base) <= set(every) and any(k == "secret" for _, _, k in every) and len(every) == 2
    got = pii.detect(docs, model).collect()
    assert len(got) == len(rows)
    red = pii.redact(docs, model)
    assert red.columns == docs.columns and red.count() == len(rows)
    assert [r.text for r in red.where("doc_id = 1").collect()] == [None]
    assert all("[SECRET]" in r.text for r in red.where("doc_id >= 1000").collect())
    assert pii.detect(empty(spark), pii.fit(empty(spark))).count() == 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = Boosted().fit(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    at, p = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert list(at) == [0, 1, 3] and list(p) == [0, 0.5, 1]


# --- near-duplicates


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    for trial in range(6):
        ids = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        cut = 40 + 20 * trial
        x, y = ids[: 300 - cut], ids[cut:]
        cx, cy = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
        exact = minhash.similarity(x, cx, y, cy)
        a, b = minhash.signatures([(x, cx), (y, cy)], 1024)
        assert abs((a == b).mean() - exact) < 5 * np.sqrt(exact * (1 - exact) / 1024)
    assert minhash.similarity(x, cx, x, cx * 5) == pytest.approx(1)
    plain = sum(1 / sum(max(dict(zip(x.tolist(), cx)).get(e, 0) / dict(zip(x.tolist(), cx))[d], dict(zip(y.tolist(), cy)).get(e, 0) / dict(zip(y.tolist(), cy))[d]) for e in set(x.tolist()) | set(y.tolist())) for d in set(x.tolist()) & set(y.tolist()))
    assert minhash.similarity(x, cx, y, cy) == pytest.approx(plain)


def plain_classes(rows, similar=0.8):
    hasher, sets = C.WordHasher(), {}
    for d, t in rows:
        if d is not None and C.alnum_words((t or "").encode()):
            sets.setdefault((d, t), minhash.shingles(C.alnum_words(t.encode()), hasher))
    root = {d: d for d, _ in rows if d is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = list(sets)
    for i, p in enumerate(keys):
        for q in keys[:i]:
            if minhash.similarity(*sets[p], *sets[q]) >= similar:
                a, b = find(p[0]), find(q[0])
                root[max(a, b)] = min(a, b)
    return collections.Counter((d, None if d is None else find(d)) for d, _ in rows)


@pytest.mark.parametrize("small", [32, 3])
def test_classes_match_plain(spark, odd, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(6)
    rows = list(odd[0])
    base = prose(rng, 120).split()
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((500 + i, " ".join(w)))
    rows += [(700, "one two"), (701, "One, two"), (702, "one three")]
    docs = frame(spark, rows).withColumn("class_id", F.lit(0)).withColumn("node", F.lit(1))
    got = collections.Counter((r.doc_id, r.class_id) for r in minhash.classes(docs).collect())
    assert got == plain_classes(rows)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for (d, c) in got if d == c}
    assert minhash.classes(empty(spark)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in dirs for p in pathlib.Path(d).rglob("shuffle_*")}


def test_checkpoint_releases_its_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(C.RELEASE)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).repartition(3, "n")
    cut = C.checkpoint(rows)
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(C.RELEASE) == setting
    assert sorted(cut.collect()) == sorted(rows.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


# --- pipeline


def test_pipeline_matches_its_stages_on_plain_data(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    item = prose(rng, 15)
    rows, marks = toxic_rows()
    clean = prose(rng, 80)
    rows += [(2000, clean), (2001, clean), (2002, clean + " end"), (2003, prose(rng, 20) + " " + item), (2004, prose(rng, 20) + " mail me a.b@example.com"), (2005, None), (2006, "")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = C.checkpoint(stage(spark, docs, str(tmp_path)))
        seen[name] = docs
    texts = {n: {r.doc_id: r.text for r in d.collect()} for n, d in list(seen.items())[:-1]}
    assert sum(i % 6 == 0 for i in texts["toxicity"] if i < 900) < 10 and sum(i % 6 != 0 for i in texts["toxicity"] if i < 900) > 740
    near = texts["near-duplicates"]
    assert 2000 in near and 2001 not in near and 2002 not in near and {2005, 2006} <= set(near)
    assert set(near) - set(texts["benchmark decontamination"]) == {2003}
    last = texts["personal data"]
    assert last[2004].endswith("[EMAIL]") and last[2005] is None and set(last) == set(texts["benchmark decontamination"])
    assert {r.doc_id for r in seen["packing"].collect()} == set(last)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(map(tuple, run.collect())) == collections.Counter(map(tuple, seen["packing"].collect()))


def test_folds_are_crc32_of_the_decimal_id(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 123456789, -4)], "doc_id long")
    for r in rows.select("doc_id", C.fold_column("doc_id", 5).alias("f")).collect():
        assert r.f == zlib.crc32(str(r.doc_id).encode()) % 5
