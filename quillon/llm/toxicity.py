"""Toxicity categories by a classifier chain of linear models.

The categories are predicted one after another.  Each is a logistic regression over the
words a text holds and over the probabilities of all earlier categories.  In training
those probabilities are out-of-fold predictions, so a later model learns from earlier
ones as good, or as bad, as they are on new texts; in prediction they come from the
earlier models fitted to all training rows.

The chain is low_quality, toxic, toxic_low_quality: the labels hold the first two, and the
last is that both hold.

Training uses at most SAMPLE labelled rows, those of the least hash, and of these as many,
in that order, as hold SAMPLE_WORDS distinct words together (the first one in any case), on
the driver; prediction reads the whole of every text.  Words are runs without white space and ASCII
punctuation, A-Z lower-cased.

Defined results: a null or empty text has no words and gets the models' base rates;
labels that are null don't count, and of repeated labels the largest counts; of several
texts with a labelled doc_id that with the least word hashes is trained with; with no
labelled rows, or one class only, a category's probability is that class's share (0
without rows); repeated rows and rows without doc_id are predicted each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._io import saved

#: Labelled rows, and distinct words of all of them, that train the chain: a bound on the driver's memory.
SAMPLE, SAMPLE_WORDS = 6000, 8_000_000
FOLDS, STEPS, RATE, RIDGE = 4, 300, 0.15, 0.5
#: Training rows that must hold a word, and standard errors its log odds must differ by.
LEAST_ROWS, LEAST_Z = 5, 3.0
#: Share of the best F1 that a cut must reach.
NEAR_BEST = 0.95
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")


def distinct_words(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of each document, and offsets."""
    flat = w.hashes.copy()
    first = w.first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        flat[a:b].sort()
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[first]


FEATURES = pa.schema([("doc_id", pa.int64()), ("words", pa.binary())])


def features(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
    flat, off = distinct_words(w)
    yield {"doc_id": rows.column("doc_id"), "words": [flat[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]}


class Rows:
    """A sparse 0/1 matrix by rows, with dense extra columns."""

    def __init__(self, col: np.ndarray, off: np.ndarray, n_cols: int, extra: np.ndarray) -> None:
        self.col, self.off, self.n_cols, self.extra = col, off, n_cols, extra
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(off))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], len(self.off) - 1) + self.extra @ w[self.n_cols :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, r[self.row], self.n_cols), self.extra.T @ r])

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.off)[rows]
        return Rows(self.col[tx.ragged(self.off[:-1][rows], n)], np.concatenate([[0], np.cumsum(n)]), self.n_cols, self.extra[rows])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: Rows, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge, by Adam on all rows; the last weight is the constant."""
    n = len(y)
    w = np.zeros(x.n_cols + x.extra.shape[1])
    share = y.mean()
    if share in (0.0, 1.0):
        w[-1] = 40.0 if share else -40.0
        return w
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        ridge = RIDGE * w / n
        ridge[-1] = 0
        g = x.back(sigmoid(x.dot(w)) - y) / n + ridge
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def telling(col: np.ndarray, row: np.ndarray, y: np.ndarray, n_cols: int) -> np.ndarray:
    """z score of every word's log odds between the two classes."""
    on = np.bincount(col, y[row], n_cols)
    off = np.bincount(col, 1 - y[row], n_cols)
    p, q = y.sum(), (1 - y).sum()
    odds = np.log((on + 0.5) / (p - on + 0.5)) - np.log((off + 0.5) / (q - off + 0.5))
    z = odds / np.sqrt(1 / (on + 0.5) + 1 / (off + 0.5))
    z[on + off < LEAST_ROWS] = 0
    return z


@dataclass
class Link:
    """One category's model: words with their weights, weights of earlier categories, constant, threshold."""

    category: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float
    threshold: float

    def predict(self, flat: np.ndarray, off: np.ndarray, before: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flat) + 1)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            total[1:] = np.cumsum(np.where(self.words[at] == flat, self.weights[at], 0.0))
        score = total[off[1:]] - total[off[:-1]] + self.constant
        return sigmoid(score + before @ self.earlier)


def threshold_of(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap of logits among the cuts whose F1, out of fold, is near the best.

    Labels may be wrong here and there; the best cut alone would follow them into the
    crowd of clean rows.
    """
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    score = np.log(np.clip(p[order], 1e-9, 1 - 1e-9) / np.clip(1 - p[order], 1e-9, 1))
    gap = np.append(score[:-1] - score[1:], 0.0)
    gap[f1 < NEAR_BEST * f1.max()] = -1.0
    k = int(np.argmax(gap))
    return float(sigmoid(score[k] - gap[k] / 2))


def train_chain(flat: np.ndarray, off: np.ndarray, labels: dict[str, np.ndarray]) -> tuple[list[Link], dict[str, np.ndarray]]:
    """The chain's models, and the out-of-fold probabilities it was trained with."""
    n = len(off) - 1
    words, col = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(off))
    fold = np.arange(n) % FOLDS
    before = np.empty((n, 0))
    chain, oof = [], {}
    for category in CATEGORIES:
        y = labels[category] if category in labels else labels["toxic"] * labels["low_quality"]
        z = telling(col, row, y, len(words))
        chosen = np.flatnonzero(np.abs(z) >= LEAST_Z)
        place = np.full(len(words), -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[col] >= 0
        own = Rows(place[col][keep], np.concatenate([[0], np.cumsum(keep)])[off], len(chosen), np.column_stack([before, np.ones(n)]))
        p = np.zeros(n)
        for k in range(FOLDS):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(inside) and len(outside):
                p[outside] = sigmoid(own.take(outside).dot(fit(own.take(inside), y[inside])))
        w = fit(own, y)
        chain.append(Link(category, words[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1]), threshold_of(p, y)))
        oof[category] = p
        before = np.column_stack([before, p])
    return chain, oof


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Link]:
    """Models from at most ``sample`` labelled rows."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    words = texts.mapInArrow(tx.mapper(features, FEATURES, fold=True, space=tx.PUNCTUATION), "doc_id long, words binary")
    words = saved(words.groupBy("doc_id").agg(F.min("words").alias("words")), "toxic-words", narrow=True)
    size = {r["doc_id"]: r["n"] for r in words.select("doc_id", (F.octet_length("words") / 8).cast("long").alias("n")).collect()}
    rows, total = [], 0
    for r in some.collect():
        if r["doc_id"] in size and (not rows or total + size[r["doc_id"]] <= SAMPLE_WORDS):
            rows.append(r)
            total += size[r["doc_id"]]
    rows.sort(key=lambda r: r["doc_id"])
    wanted = {r["doc_id"] for r in rows}
    found = {r["doc_id"]: r["words"] for r in words.toLocalIterator() if r["doc_id"] in wanted}
    parts = [np.frombuffer(found[r["doc_id"]], tx.U64) for r in rows]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    flat = np.concatenate([np.empty(0, tx.U64), *parts])
    if not rows:
        none = np.empty(0, tx.U64)
        return [Link(c, none, np.empty(0), np.zeros(k), -40.0, 0.5) for k, c in enumerate(CATEGORIES)]
    toxic = np.array([float(r["toxic"] > 0) for r in rows])
    low = np.array([float(r["quality"] <= 0) for r in rows])
    return train_chain(flat, off, {"low_quality": low, "toxic": toxic})[0]


SCORES = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in CATEGORIES), ("toxic", pa.bool_())])


def predict(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """doc_id, the probability of every category, and toxic: the verdict at the chain's threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def score(rows: pa.RecordBatch, w: tx.Words) -> Iterator[dict]:
        flat, off = distinct_words(w)
        before = np.empty((len(rows), 0))
        out = {"doc_id": rows.column("doc_id")}
        for link in sent.value:
            p = link.predict(flat, off, before)
            before = np.column_stack([before, p])
            out[f"p_{link.category}"] = np.round(p, 6)
            if link.category == "toxic":
                out["toxic"] = p >= link.threshold
        yield out

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return own.mapInArrow(tx.mapper(score, SCORES, fold=True, space=tx.PUNCTUATION), ddl)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, train(docs, labels))
