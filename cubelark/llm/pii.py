"""Personal data: generated candidates, boosted trees, calibrated thresholds.

Generators propose overlapping spans of each kind with high recall. Trees score
each candidate from its format and context. There are no hand labels. Positives
are spans that pass a base rule and, in their real surroundings, spans rewritten
so that no base rule finds them: addresses with "at" and "dot", phone numbers
without their plus, card numbers in dotted groups, defanged addresses of hosts.
Negatives are candidates that fail their base rule where no word nearby speaks
for the kind; with such a word they are left out. Secrets are those assigned to a
key word. Isotonic calibration on held-out documents turns margins into
probabilities; a kind's threshold is the least at which its held-out precision
reaches ``precision``. What passes the fixed base rules is always redacted.

All scans take time linear in the text: they start at a span's first character
only, or grow from an "@", and never look at a stretch twice.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .boosting import Boosted, isotonic
from .sample import HASHES, hash_bound

KINDS = ("email", "ip", "card", "phone", "secret")
WIDTH = 24  # features
#: The base patterns. Runs are possessive and begin where they can; base_spans() grows addresses from "@".
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_GENERATORS = (
    ("email", ("@",), re.compile(r"(?<![^\s@<>\"'])[^\s@<>\"']++@[^\s@<>\"']++")),
    ("email", ("at", "dot"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z]{2,}+")),
    ("ip", (".",), re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+")),
    ("ip", ("[.]",), re.compile(r"(?<![0-9\]])[0-9]++(?:\[\.\][0-9]++){3,}+")),
    ("card", (), re.compile(r"(?<![0-9])[0-9]{12,19}+(?![0-9])")),
    ("card", (), re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._-][0-9]{4}){2,3}(?:[ ._-][0-9]{1,4})?(?![0-9])")),
    ("phone", (), re.compile(r"(?<![0-9])(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("secret", (), re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")),
)
_DIGIT = re.compile(r"[0-9]")
_CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|credit|visa|master|payment|account", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|key|auth|bearer", re.I),
}
_ASSIGNED = re.compile(r"(?:token|secret|passwd|password|pwd|key|auth|bearer)\W{1,4}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def octets(span: str) -> bool:
    """Whether all dotted parts are at most 255; int() is kept from endless digits."""
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in span.split("."))


def _digits(span: str) -> str:
    return "".join(_DIGIT.findall(span))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, each grown both ways from its "@"."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))  # the run of local characters since the last "@" or match
        if domain and start < at:
            out.append((start, domain.end()))
            low = domain.end()
        else:
            low = at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, by start, then kind as listed."""
    out = [(*span, "email") for span in emails(text)]
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if octets(m[0])] if "." in text else []
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):  # 19 digits have 18 gaps
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping spans that the generators propose."""
    return [(*m.span(), kind) for kind, needs, pattern in _GENERATORS if all(n in text for n in needs) for m in pattern.finditer(text)]


def passes(span: str, kind: str) -> bool:
    """Whether a whole span passes its kind's base rule."""
    if kind == "email":
        return emails(span) == [(0, len(span))]
    if kind == "ip":
        return IP.fullmatch(span) is not None and octets(span)
    if kind == "card":
        return CARD.fullmatch(span) is not None and 12 <= len(d := _digits(span)) <= 19 and luhn(d)
    return PHONE.fullmatch(span) is not None and 9 <= len(_digits(span)) <= 15


def rewritten(span: str, kind: str, way: int) -> str:
    """A form of a span that people write and no base rule finds; ``way`` picks one."""
    if kind == "email":
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"))[way % 3]
        local, _, domain = span.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{local}{at}{host.replace('.', '-')}{dot}{top}"
    if kind == "ip":
        return span.replace(".", "[.]")
    if kind == "card":
        digits = _digits(span)
        return "._"[way % 2].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return ("00" if way % 2 else "") + span[1:]


def examples(text: str) -> list[tuple[tuple[int, int, str], str, float]]:
    """(candidate, the text that it stands in, label) of all candidates that a label can be given."""
    out = []
    for s, e, kind in candidates(text):
        if kind == "secret":
            label = _ASSIGNED.search(text[max(0, s - 16) : s]) is not None and _DIGIT.search(text, s, e) is not None
            out.append(((s, e, kind), text, float(label)))
        elif passes(text[s:e], kind):
            out.append(((s, e, kind), text, 1.0))
            form = rewritten(text[s:e], kind, zlib.crc32(text[s:e].encode()))
            near = text[max(0, s - 64) : s] + form + text[e : e + 8]  # as far as features look
            at = min(s, 64)
            if (at, at + len(form), kind) in candidates(near):
                out.append(((at, at + len(form), kind), near, 1.0))
        elif not _CONTEXT[kind].search(text[max(0, s - 40) : s]):
            out.append(((s, e, kind), text, 0.0))
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    n = len(span)
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    upper = sum(c.isupper() for c in span)
    counts = [span.count(c) for c in set(span)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
    last = before[-1:]
    return [
        float(KINDS.index(kind)), n, digits, letters, upper / n, digits / n, entropy, len(groups), max(groups), min(groups),
        span.count("."), span.count("-"), span.count(" "), span.count("("), span.count("@"), span.count("["), turns,
        sum(not c.isalnum() for c in span), len(span.rpartition(".")[2]),
        float(_CONTEXT[kind].search(before) is not None), float(last.isspace() or not last), float(last in "\"'=:" and bool(last)), float(after.isspace() or not after), float(after in ".,;:!?" and bool(after)),
    ]


class Model:
    """Fitted trees, calibration and thresholds by kind; ``spans`` gives a text's spans."""

    def __init__(self, precision: float = 0.9):
        self.precision, self.trees, self.curves, self.thresholds = precision, None, {}, {}

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> "Model":
        if len(y) and 0 < y[~held].sum() < (~held).sum():
            self.trees = Boosted().fit(x[~held], y[~held])
            margin = self.trees.margin(x)
            for k, kind in enumerate(KINDS):
                own = held & (x[:, 0] == k)
                if not y[own].any():
                    continue
                at, p = isotonic(margin[own], y[own])
                below = [margin[own][margin[own] < a].max() for a in at[1:]]
                at[1:] = (at[1:] + below) / 2  # a step lies midway between the margins on its two sides
                self.curves[kind] = at, p
                good = p >= self.precision
                if good.any():
                    self.thresholds[kind] = float(p[good][0])
        return self

    def added(self, text: str, base: list) -> list[tuple[int, int, str]]:
        """Candidates that pass their kind's threshold, overlap no likelier one, and contain whole the base spans that they overlap."""
        if not self.thresholds:
            return []
        found = [c for c in candidates(text) if c[2] in self.thresholds and not any(s < c[1] and c[0] < e and (not (c[0] <= s and e <= c[1]) or (s, e) == c[:2]) for s, e, _ in base)]
        if not found:
            return []
        margin = self.trees.margin(np.array([features(text, *c) for c in found], float))
        scored = []
        for one, m in zip(found, margin):
            at, p = self.curves[one[2]]
            chance = p[max(0, np.searchsorted(at, m, side="right") - 1)]
            if chance >= self.thresholds[one[2]]:
                scored.append((-chance, one[0] - one[1], one))
        kept: list = []
        for _, _, one in sorted(scored):
            if not any(k[0] < one[1] and one[0] < k[1] for k in kept):
                kept.append(one)
        return kept

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans), by start, then kind as listed."""
        base = base_spans(text)
        return base, sorted(base + self.added(text, base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_ROW = pa.schema([("held", pa.bool_()), ("y", pa.float64()), ("x", pa.list_(pa.float64()))])


def fit(docs: DataFrame, id_col="doc_id", text_col="text", documents: int = 20_000, per_kind: int = 8, precision: float = 0.9) -> Model:
    """Learn from about ``documents`` documents, drawn by the hashes of their ids, and of each kind in each of them
    from ``per_kind`` examples, drawn by the hashes of their places; every fourth document calibrates.
    Detection itself has no such bounds.
    """
    key = F.pmod(F.xxhash64(F.col(id_col), F.lit("pii")), F.lit(HASHES))

    def extract(batches):
        for b in batches:
            held, y, x = [], [], []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = (raw or b"").decode("utf-8", "replace")
                drawn: dict[str, list] = {}
                for nth, one in enumerate(examples(text)):
                    drawn.setdefault(one[0][2], []).append((zlib.crc32(f"{k}:{nth}:{one[0]}".encode()), one))
                for own in drawn.values():
                    for _, (span, near, label) in heapq.nsmallest(per_kind, own, key=lambda o: o[0]):
                        held.append(k % 4 == 0)
                        y.append(label)
                        x.append(features(near, *span))
            yield C.batch(_ROW, held, y, x)

    picked = docs.where(key < hash_bound(docs.count(), documents)).select(key.alias("k"), F.col(text_col).cast("binary"))
    rows = picked.mapInArrow(extract, "held boolean, y double, x array<double>").toArrow()
    x = np.array(rows.column(2).to_pylist(), float).reshape(-1, WIDTH)
    y, held = (rows.column(i).to_numpy().astype(t) for i, t in ((1, float), (0, bool)))
    by = np.lexsort((*x.T, y, held))  # the result must not depend on the order in which tasks end
    return Model(precision).fit(x[by], y[by], held[by])


_OUT = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS[:4]] + [("base_sha256", pa.string()), ("spans", pa.string())])


def _listed(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def detect(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """Counts of base spans, their digest and all spans of each row, in code points.

    Null and empty texts have no spans; repeated rows give a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            out = [[] for _ in range(6)]
            for raw in b.column(2).to_pylist():
                base, every = model.spans((raw or b"").decode("utf-8", "replace"))
                for column, kind in zip(out, KINDS[:4]):
                    column.append(sum(k == kind for _, _, k in base))
                out[4].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                out[5].append(_listed(every))
            yield C.batch(_OUT, b.column(0), *out)

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans) -> str:
    """The text with each group of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """The rows with all their columns, the text redacted; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    place = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            texts = [None if t is None else redact_text(t, model.spans(t)[1]) for t in b.column(place).to_pylist()]
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return detect(docs, fit(docs))
