"""Language ID as mixture inference.

Each language is a distribution over hashed byte n-grams of the letters. A text
is taken as drawn from a mixture of languages; expectation-maximisation finds
the proportions. Candidate sets are the likeliest single language and the full
mixture's leading languages, two, three and so on, each refitted; a further
language must raise the log-likelihood by more than its penalty. The answer is
the language of the greatest proportion in the chosen set.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .sample import HASHES, hash_bound

GRAM, BITS = 4, 17
UNKNOWN = "und"
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def grams(raw: bytes | None) -> np.ndarray | None:
    """Buckets of all n-grams of the lower-cased letters, blanks between words; None if there is no letter."""
    text = (raw or b"").decode("utf-8", "replace")
    if not _LETTER.search(text):
        return None
    line = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b"  "
    x = np.frombuffer(line, np.uint8).astype(np.uint32)
    code = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


_COUNT = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])


class Model:
    """Smoothed gram distributions by language, and the languages' shares in training."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5, penalty: float = 3.0):
        self.languages, self.penalty = languages, penalty
        self.theta = ((counts + smooth) / (counts.sum(0) + smooth * len(counts))).astype(np.float32)
        self.prior = (counts.sum(0) + 1.0) / (counts.sum() + len(languages)) if languages else np.zeros(0)

    @staticmethod
    def mixture(p: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
        """(proportions, log-likelihood) by expectation-maximisation."""
        pi = (start / start.sum()).astype(np.float32)
        for _ in range(rounds):
            new = pi * (p.T @ (1 / (p @ pi))) / np.float32(len(p))
            done = np.abs(new - pi).max() < 1e-3
            pi = new
            if done:
                break
        return pi, float(np.log(p @ pi).sum())

    def proportions(self, raw: bytes | None) -> tuple[dict[str, float], float]:
        """(chosen languages and their proportions, the first one's proportion among all languages).

        Nothing and 0 if the text has no letter or nothing was learned.
        """
        b = grams(raw)
        if b is None or not self.languages:
            return {}, 0.0
        p = self.theta[b]
        single = np.log(p).sum(0) + np.log(self.prior)
        lead = int(single.argmax())
        if len(self.languages) == 1:
            return {self.languages[0]: 1.0}, 1.0
        cost = self.penalty * np.log(len(b) + 1)
        chosen, shares, best = [lead], np.ones(1), float(single[lead] - np.log(self.prior[lead]))
        full, _ = self.mixture(p, self.prior)
        order = [lead, *(i for i in np.argsort(-full, kind="stable").tolist() if i != lead)]
        for k in range(2, len(order) + 1):
            own = order[:k]
            pi, value = self.mixture(p[:, own], np.maximum(full[own], 1e-3))
            if value - cost <= best:
                break
            chosen, shares, best = own, pi, value - cost
        found = {self.languages[i]: float(s) for i, s in zip(chosen, shares / shares.sum())}
        first = min(found, key=lambda x: (-found[x], x))
        return found, float(full[self.languages.index(first)])


def fit(docs: DataFrame, most: int = 10_000, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Learn from about ``most`` rows of each language, all if it has fewer, drawn by the hash of their ids."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text")).where("lang is not null and text is not null")
    sizes = own.groupBy("lang").count().toArrow().to_pylist()  # a row for each language
    bounds = [(r["lang"], hash_bound(r["count"], most)) for r in sizes]
    drawn = own.join(F.broadcast(own.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(HASHES)) < F.col("bound"))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (g := grams(raw)) is not None:
                    held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    held[lang] += np.bincount(g, minlength=1 << BITS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield C.batch(_COUNT, [lang] * len(at), at.astype(np.int32), n[at])

    rows = drawn.select("lang", "text").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = rows.column(0).to_pylist()
    languages = sorted(set(langs))
    counts = np.zeros((1 << BITS, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    if languages:
        counts[rows.column(1).to_numpy(), [place[x] for x in langs]] = rows.column(2).to_numpy()
    return Model(languages, counts)


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, lang_pred, score, languages) of each row; languages lists the set as name:proportion.

    The score is the language's proportion when all languages may take part, before any is struck out.
    A null text, or one without a letter, is ``und`` with score 0. Repeated rows give a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            out = [[], [], []]
            for raw in b.column(2).to_pylist():
                found, share = model.proportions(raw)
                found = sorted(found.items(), key=lambda x: (-x[1], x[0]))
                lang = found[0][0] if found else UNKNOWN
                for column, value in zip(out, (lang, min(1.0, share), ",".join(f"{k}:{v:.3f}" for k, v in found))):
                    column.append(value)
            yield C.batch(_OUT, b.column(0), *out)

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    fold = C.fold_column("doc_id", 4) == 2
    found = predict(docs, fit(docs.where(~fold)))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "languages")

