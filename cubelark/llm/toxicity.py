"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts is unlabelled.
With the share pi of toxic texts, the risk of a scorer g under the loss l is

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

where the second term, the risk on negatives, cannot truly be below zero: when
a step finds it so, the step goes up its gradient instead of down. The scorer
is linear in whether a feature occurs, a word or the beginning of one, so a text's
score is a sum over its distinct words that a task looks up word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .sample import sample_ids, sampled

PREFIXES = (4, 5, 6, 7)


def word_features(word: bytes) -> list[int]:
    """Hashes (63 bits) of the word and of its beginnings, counted in bytes."""
    return [xxhash.xxh3_64_intdigest(b"=" + word) >> 1, *(xxhash.xxh3_64_intdigest(b"^" + word[:n]) >> 1 for n in PREFIXES if len(word) >= n)]


def text_features(raw: bytes | None) -> np.ndarray:
    """Distinct feature hashes of all words."""
    found: set[int] = set()
    for word in set(C.alnum_words(raw)):
        found.update(word_features(word))
    return np.fromiter(found, np.int64, len(found))


def train(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk under the sigmoid loss (Adam, whole sample).

    y: 1 positive, 0 unlabelled; x: 0/1 rows. The sigmoid loss is bounded, so a
    few confident positives in the unlabelled part cannot outweigh the rest.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    mean = lambda d, rows: np.append(d @ rows, d.sum()) / len(rows)
    xp, xu = x[y == 1].astype(np.float32), x[y == 0].astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        lp, lu = sigmoid(xp @ w[:-1] + w[-1]), sigmoid(xu @ w[:-1] + w[-1])  # l(-g)
        slope = lambda s: (s * (1 - s)).astype(np.float32)
        up = prior * mean(slope(lp), xp)
        down = mean(slope(lu), xu) - up
        grad = (down - up if lu.mean() >= prior * lp.mean() else -down).astype(float)
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = (w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w[:-1].astype(float), float(w[-1])


class Model:
    """Weights by feature hash and a bias; without training data every text scores ``prior``."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.weights, self.bias = {int(h): float(w) for h, w in zip(hashes, weights) if w}, bias
        self.cache: dict[bytes, list[int]] = {}

    def score(self, raw: bytes | None) -> float:
        found: set[int] = set()
        cache, weights = self.cache, self.weights
        for word in set(C.alnum_words(raw)):
            own = cache.get(word)
            if own is None:
                if len(cache) >= 200_000:
                    cache.clear()
                own = cache[word] = [b for b in word_features(word) if b in weights]
            if own:
                found.update(own)
        z = self.bias + sum(weights[b] for b in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


_DF = pa.schema([("feature", pa.int64()), ("p", pa.int64()), ("u", pa.int64())])
_ROW = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 5_000, unlabelled: int = 10_000, features: int = 2_000, significant: float = 4.5, prior: float | None = None) -> Model:
    """Learn from at most ``positives`` toxic and ``unlabelled`` other draws of (doc_id, text), by hash of the id.

    ``labels`` is (doc_id, toxic) with 0, 1 or null; an id with any 1 is toxic.
    The features are the ``features`` whose frequencies differ most, at least ``significant`` deviations.
    ``prior`` defaults to the toxic share of the labelled ids, 0.1 if none is labelled 0.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null and text is not null")
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if prior is None:
        toxic, known = marks.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count("*")).first()
        prior = toxic / known if 0 < toxic < known else 0.1
    groups = [(1, sample_ids(marks.where("toxic = 1"), positives, "toxic")), (0, sample_ids(own, unlabelled, "any"))]
    rows = [sampled(own, ids).select("doc_id", "text", F.lit(y).alias("y")) for y, ids in groups]
    both = rows[0].union(rows[1])

    def count(batches):
        for b in batches:
            of = b.column(2).to_numpy()
            rows = [text_features(raw) for raw in b.column(1).to_pylist()]
            found, at = np.unique(np.concatenate([*rows, np.empty(0, np.int64)]), return_inverse=True)
            y = np.repeat(of, [len(r) for r in rows])
            yield C.batch(_DF, found, np.bincount(at[y == 1], minlength=len(found)), np.bincount(at[y == 0], minlength=len(found)))

    sums = both.mapInArrow(count, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p + u >= 5")
    total = both.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in total}
    if not n.get(1) or not n.get(0):
        return Model(np.empty(0), np.empty(0), float(np.log(prior / (1 - prior))))
    share = (F.col("p") + F.col("u")) / (n[0] + n[1])
    strength = F.abs(F.col("p") / n[1] - F.col("u") / n[0]) / F.sqrt((share * (1 - share) + 1e-9) * (1 / n[0] + 1 / n[1]))
    chosen = np.sort(sums.where(strength >= significant).orderBy(F.desc(strength), "feature").limit(features).select("feature").toArrow().column(0).to_numpy())
    if not len(chosen):
        return Model(chosen, chosen, float(np.log(prior / (1 - prior))))

    def project(batches):
        for b in batches:
            xs = []
            for raw in b.column(1).to_pylist():
                mask = np.zeros(len(chosen), bool)
                f = text_features(raw)
                at = np.minimum(np.searchsorted(chosen, f), len(chosen) - 1)
                mask[at[chosen[at] == f]] = True
                xs.append(np.packbits(mask).tobytes())
            yield C.batch(_ROW, b.column(0), b.column(2), xs)

    got = both.mapInArrow(project, "doc_id long, y int, x binary").toArrow()
    ids, y = got.column(0).to_numpy(), got.column(1).to_numpy()
    x = np.unpackbits(np.frombuffer(b"".join(got.column(2).to_pylist()), np.uint8).reshape(len(y), -1), axis=1)[:, : len(chosen)]
    by = np.lexsort((*x.T[:8], ids, y))
    weights, bias = train(x[by], y[by], prior)
    return Model(chosen, weights, bias)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score) of each row, from the text alone; null and empty texts have the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            yield C.batch(_OUT, b.column(0), [model.score(raw) for raw in b.column(2).to_pylist()])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and labels outside the held-out fold."""
    learn = C.fold_column("doc_id", 5) != 0
    return docs.where(learn), labels.where(learn)


def clean(docs: DataFrame, model: Model, text_col="text", threshold: float = 0.5) -> DataFrame:
    """The rows, all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column(place).to_pylist()
            yield b.filter(pa.array([model.score(None if t is None else t.encode()) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, C.read(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", (C.fold_column("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

