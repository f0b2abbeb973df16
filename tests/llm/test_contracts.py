"""The registered queries, over whole small tables, against plain versions of their contracts."""

import collections
import hashlib
import random
import re
import struct
import zlib
from bisect import bisect_left

import pytest

from cubelark.llm import common as C
from cubelark.llm import decontaminate, langid, licenses, media, minhash, packing, pii, queries, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so", "ta", "vi") for b in ("ba", "de", "fi", "go", "hu", "la", "ra", "ti")]
LANGS = {"aa": "the of and ing tion er", "bb": "lich schaft und der ein zu", "cc": "eau ment les que oux re"}


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, rows, marks, items): documents with all sorts of contents, labels and benchmark."""
    rng, folder = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    item, passage = prose(rng, 14), prose(rng, 70)
    rows = [(0, None), (1, ""), (2, " \t\x0b"), (3, "Éé \x00x\x1cy"), (4, "one"), (4, "one"), (4, "other"), (None, passage), (None, None)]
    notes = ["MIT License", "licensed under the Apache License, Version 2.0", "GNU General Public License v3", "all rights reserved", "SPDX-License-Identifier: BSD-3-Clause", "mit license mit license"]
    marks = []
    for i in range(10, 400):
        lang = rng.choice(list(LANGS))
        text = prose(rng, rng.randrange(5, 60), LANGS[lang].split() + WORDS[:6])
        bad = i % 7 == 0
        text += rng.choice(["", " ", "\n"]) + (rng.choice(["vileness", "vilely scumbag"]) if bad else "")
        for extra, odds in ((passage, 0.1), (item.upper(), 0.1), (rng.choice(notes), 0.3), (f"mail a.{i}@b{i}.example.org,", 0.2), (f"10.2.{i % 256}.{i}", 0.2), ("4111 1111 1111 1111", 0.1), (f"+49 (30) 555-{i:04d} x", 0.2), (f'token = "{hashlib.md5(str(i).encode()).hexdigest()}"', 0.2)):
            if rng.random() < odds:
                text += " " + extra
        rows.append((i, text, lang))
        if bad or i % 2:
            marks.append((i, int(bad)))
    rows = [(*r, None)[:3] for r in rows]
    spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, item), (2, "one"), (3, None), (10, prose(rng, 12))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    html = [(1, "<figure><figcaption>cap</figcaption><img src='sha256:%s'></figure>" % hashlib.sha256(b"one").hexdigest()), (2, None), (3, "<p>a<p>b")]
    spark.createDataFrame(html, "page_id long, html string").selectExpr("page_id", "'u' AS url", "html").write.parquet(f"{folder}/pages.parquet")
    return folder, [(i, t) for i, t, _ in rows], dict(marks), items, {i: lang for i, _, lang in rows}


def found(spark, tables, name, *columns):
    got = queries.QUERIES[name](spark, tables[0]).select(*columns).collect()
    return collections.Counter(tuple(r) for r in got)


def test_op1(spark, tables):
    low = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for d, t in tables[1]:
        w = split(t)
        for i in range(len(w) - 49):
            if d is not None:
                low[tuple(w[i : i + 50])] = min(d, low.get(tuple(w[i : i + 50]), d))
    want = collections.Counter()
    for d, t in tables[1]:
        w, gone = split(t), set()
        for i in range(len(w) - 49):
            if d is not None and low[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        want[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert sum(n for (_, _, gone, _), n in want.items() if gone) > 20
    assert found(spark, tables, "op1_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op2(spark, tables):
    def png(payload):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        lines = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")

    want = collections.Counter()
    for d, t in tables[1]:
        data = (t or "").encode()
        payload = data + bytes(64 if not data else -len(data) % 64)
        n, total = len(payload), sum(payload)
        columns = [sum(payload[k::64]) for k in range(64)]
        bits = sum((c * 64 >= total) << (63 - k) for k, c in enumerate(columns))
        feature = f"64x{n // 64} mean={total * 1000 // n} var={(sum(b * b for b in payload) * n - total * total) * 1000 // (n * n)} min={min(payload)} max={max(payload)} hash={bits:016x}"
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[d, len(data), n, sha(payload), zlib.crc32(payload[-64:]), len(png(payload)), sha(png(payload)), feature] += 1
    assert found(spark, tables, "op2_media_columns", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == want


def test_media_pages(spark, tables):
    digest = hashlib.sha256(b"one").hexdigest()
    payload = hashlib.sha256(b"one" + bytes(61)).hexdigest()
    assert found(spark, tables, "media_pages", "page_id", "position", "kind", "text", "reference", "caption", "payload_sha256") == collections.Counter([(1, 0, "media", None, f"sha256:{digest}", "cap", payload), (3, 0, "text", "a", None, None, None), (3, 1, "text", "b", None, None, None)])


def test_op3(spark, tables):
    got = queries.QUERIES["op3_toxicity"](spark, tables[0]).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in tables[1])
    assert all(r.held_out == C.in_fold(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 10]
    assert sum(r.predicted == int(r.doc_id % 7 == 0) for r in held) / len(held) > 0.95
    docs = C.read(spark, tables[0], "documents")
    model = toxicity.fit(*toxicity.training_rows(docs, C.read(spark, tables[0], "labels")))
    texts = collections.defaultdict(set)
    for d, t in tables[1]:
        texts[d].add(model.score((t or "").encode()))
    assert all(any(r.score == pytest.approx(s) for s in texts[r.doc_id]) for r in got)


def plain_pack(lengths, sizes):
    """Best fit by looking at every open bin; a new bin has the size of least cost for each token that it can expect."""
    bins, where, offset = [], [], []
    for i, n in enumerate(lengths):
        fits = [(b[0] - b[1], k) for k, b in enumerate(bins) if b[0] - b[1] >= n]
        left = min((x for x, _ in fits), default=None)
        if left is not None:
            k = min((b for b in range(len(bins)) if bins[b][0] - bins[b][1] == left), key=lambda b: bins[b][2])
        else:
            choice = []
            for size in sizes:
                if size >= n:
                    coming = sum(x for x in lengths[i + 1 :] if x <= size - n)
                    choice.append((packing.cost(size) / min(size, n + coming), size))
            bins.append([min(choice)[1], 0, i])
            k = len(bins) - 1
        where.append(k)
        offset.append(bins[k][1])
        bins[k][1] += n
        bins[k][2] = i  # among equals the one that has been so the longest
    return where, offset, [sizes[bisect_left(sizes, b[1])] for b in bins]


def test_op4(spark, tables):
    sizes = list(packing.SIZES)
    rows = C.keyed(C.read(spark, tables[0], "documents")).collect()
    whole = [(r.doc_id, r.th, len((bytes(r.text) if r.text else b"").split()) + 1) for r in rows]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rest = sorted(((n, k, d) for k, (d, _, n) in enumerate(whole)), key=lambda r: (-r[0], r[1]))
    assert all(n < sizes[-1] for n, _, _ in rest)
    where, offset, size = plain_pack([n for n, _, _ in rest], sizes)
    pieces = collections.Counter((d, 0, 0, n, b, at, size[b]) for (n, _, d), b, at in zip(rest, where, offset))
    assert found(spark, tables, "op4_packing", "doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_size") == pieces


def test_identical_rows_fill_many_shards(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 60 + [(None, None)] * 20, "doc_id long, text string")
    placed = packing.place(docs, sizes=(8, 16), shard_items=5).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in placed) == {(1, 4): 60, (None, 1): 20}
    assert len({r.bin_id >> 32 for r in placed if r.doc_id == 1}) > 8


def test_op6(spark, tables):
    got = queries.QUERIES["op6_language_id"](spark, tables[0]).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in tables[1])
    assert all(r.held_out == C.in_fold(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 10]
    assert sum(r.lang_pred == tables[4][r.doc_id] for r in held) / len(held) > 0.95
    assert len({round(r.score, 6) for r in got}) > 20


def test_op7(spark, tables):
    want = collections.Counter()
    for d, t in tables[1]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        base = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        line = (" " + " ".join(w) + " ").encode()
        hits = [(line.count(b" ", 0, m.start()) - 1, line.count(b" ", 0, m.end()), kind, weight, label) for kind, weight, label, _, pattern in licenses.rules() for m in pattern.finditer(line)]
        kept = []
        for one in sorted(hits, key=lambda x: (x[2], x[0] - x[1], x[0], x[4])):
            if not any(k[0] <= one[0] and one[1] <= k[1] for k in kept):
                kept.append(one)
        own = {label for _, label in base}
        score = max([k[3] for k in kept] + [licenses.SHAPES[-1][1]] * bool(base), default=0.0)
        at = [i for i, _ in base]
        want[d, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {k[4] for k in kept})), score] += 1
    assert found(spark, tables, "op7_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == want


def test_op8(spark, tables):
    items = {}
    for i, t in tables[3]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            items.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = collections.Counter()
    for d, t in tables[1]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hit, ids = set(), set()
        for window, own in items.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    ids |= own
        want[d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    assert found(spark, tables, "op8_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_op9(spark, tables):
    got = queries.QUERIES["op9_pii"](spark, tables[0]).collect()
    want = collections.Counter()
    for d, t in tables[1]:
        base = plain_base(t or "")
        want[d, *(sum(k == kind for _, _, k in base) for kind in BASE), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    texts = {d: t for d, t in tables[1]}
    unique = [d for d, n in collections.Counter(d for d, _ in tables[1]).items() if n == 1]
    for r in got:
        if r.doc_id in unique:
            assert {f"{k}:{s}:{e}" for s, e, k in plain_base(texts[r.doc_id] or "")} <= set(r.spans.split(","))
    assert any("secret:" in r.spans for r in got)


def test_op10(spark, tables):
    hasher, sets = C.WordHasher(), []
    for d, t in tables[1]:
        w = C.alnum_words((t or "").encode())
        if d is not None:
            sets.append((d, minhash.shingles(w, hasher) if w else None))
    root = {d: d for d, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and minhash.similarity(*x, *y) >= 0.8:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    want = collections.Counter((d, None if d is None else find(d)) for d, _ in tables[1])
    assert found(spark, tables, "op10_minhash_dedup", "doc_id", "class_id") == want


# --- scans take time linear in a text


def test_base_spans_equal_the_patterns_leftmost_matches():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@-+ 2_é(45") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_base(text)


def test_long_texts():
    for text in ("1" * 1_000_000, "1" * 400_000 + ".1", "a" * 400_000 + " b@c.de", "@" * 200_000, "1." * 200_000, "+1 " * 200_000, "x@" * 100_000, "a" * 500_000 + " token = "):
        base = pii.base_spans(text)
        assert len(pii.candidates(text)) >= 0 and len(base) == {"a" * 5: 1, "1." * 2: 50_000}.get(text[:5] if text[0] == "a" and "@" in text else text[:4], 0)
    scan = licenses.Scanner()
    detections, base = scan(C.alnum_words(b"mit license a " * 100_000))
    assert len(detections) == len(base) == 100_000 and base[-1] == (299_997, "mit")


def test_rules_with_their_gates_find_what_they_find_without():
    """Each branch of each rule, in a text of its own, through the scanner and through every rule."""
    from test_corpus import branches

    scan = licenses.Scanner()
    for kind, _, label, _, pattern in licenses.rules():
        for text in branches(re._parser.parse(pattern.pattern.decode())):
            words = C.alnum_words(f"xx {text} xx".encode())
            spans = [(s, e, k, x) for s, e, k, _, x in scan(words)[0]]
            assert spans and any(k <= kind and s <= 1 and e >= len(words) - 1 for s, e, k, _ in spans), (label, text)


# --- anchors


def test_spans_come_from_the_join_of_anchors(spark):
    """Each document in a task of its own: nothing is settled in a chunk, every span comes from anchors that met."""
    rng = random.Random(5)
    shared = prose(rng, 90)
    own = lambda i: prose(rng, 30, [f"d{i}w{k}" for k in range(40)])  # noqa: E731  words of no other document
    rows = [(i, f"{own(i)} {shared} {own(i)}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24, "doc_id")
    anchors, _ = substring._find(50, 16, substring.np.empty(0, substring.np.uint64))
    sent = C.keyed(docs).mapInArrow(anchors, "h long, doc_id long, th long, s int, e int, w binary").collect()
    spread = collections.Counter(r.w is None for r in sent)
    got = {r.doc_id: (r.n_removed, r.n_repeats) for r in substring.remove_repeats(docs).collect()}
    assert spread[False] > 24 and got == {i: (90, 1) if i else (0, 0) for i in range(24)}
    hot = substring.frequent_anchors(C.keyed(spark.createDataFrame([(i, t) for k in range(20) for i, t in [(1000 * k + j, rows[j][1]) for j in range(24)]], "doc_id long, text string")), 50, 16)
    assert len(hot) and (hot[1:] > hot[:-1]).all()
    parts = substring._find(50, 16, hot)
    made = C.keyed(docs).mapInArrow(parts[0], "h long, doc_id long, th long, s int, e int, w binary").repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(parts[1], "doc_id long, th long, s int, e int")
    covered = collections.defaultdict(set)
    for r in made.collect():
        covered[r.doc_id].update(range(r.s, r.e))
    assert {d: len(c) for d, c in covered.items()} == {i: 90 for i in range(1, 24)}


# --- near-duplicates


def test_texts_of_one_id_keep_their_links(spark):
    rng = random.Random(6)
    a, b = prose(rng, 100), prose(rng, 100)
    for rows, want in (
        ([(5, a), (5, b), (7, a + " end"), (8, b + " end")], {5: 5, 7: 5, 8: 5}),
        ([(5, a), (5, b), (7, a + " end"), (8, b + " end"), (3, b)], {3: 3, 5: 3, 7: 3, 8: 3}),
        ([(5, a), (5, None), (5, ""), (2, None), (9, a)], {2: 2, 5: 5, 9: 5}),
    ):
        for parts in (1, 4):
            got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
            assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter((d, want[d]) for d, _ in rows)


@pytest.mark.parametrize("sift", [minhash.SIFT, 0.0])
def test_recall_against_brute_force(spark, sift, monkeypatch):
    """Pairs of all similarities around the threshold, in small and in large buckets."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = prose(rng, 150, [w + x for w in WORDS for x in WORDS[:8]]).split()
        for k in range(16):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(w)))
    hasher = C.WordHasher()
    sets = {d: minhash.shingles(C.alnum_words(t.encode()), hasher) for d, t in rows}
    links = [(p, q) for p in sets for q in sets if p < q and minhash.similarity(*sets[p], *sets[q]) >= 0.8]
    of = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), sift=sift).collect()}
    assert len(links) > 200 and sum(of[p] == of[q] for p, q in links) / len(links) > 0.999


def test_captions_before_open_and_without_media():
    show = lambda page: [p[1:] for p in media.sequence(page)]
    assert show("<figure><figcaption>cap</figcaption><img src=a><img src=b alt=own></figure>") == [("media", None, "a", "cap"), ("media", None, "b", "cap")]
    assert show("<figure><img src=a><figcaption>open<div>next</div></figure>more") == [("media", None, "a", "open"), ("text", "next", None, None), ("text", "more", None, None)]
    assert show("<figure><figcaption>alone</figcaption></figure>tail") == [("text", "alone", None, None), ("text", "tail", None, None)]
    assert show("<picture><source srcset='b.webp 1x, c 2x'><img src=a alt=x></picture>") == [("media", None, "a", "x")]
    assert show("<picture><source srcset='b.webp 1x, c 2x'></picture>") == [("media", None, "b.webp", None)]
    assert show("<img srcset='d 2x'>") == [("media", None, "d", None)]


def test_language_rows_are_drawn_for_each_language(spark):
    rows = [(i, "the of and", "aa") for i in range(3000)] + [(5000 + i, "eau ment les", "rare") for i in range(5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=50)
    assert model.languages == ["aa", "rare"] and list(model.proportions(b"eau ment eau ment les")[0]) == ["rare"]


def test_original_places_of_hits(spark):
    docs = spark.createDataFrame([(1, "Ä one-TWO é three")], "doc_id long, text string")
    got = decontaminate.scan(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string")).first()
    assert (got.froms, got.tos) == ([2], [9])
