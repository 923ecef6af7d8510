"""Operator 9, toxicity by a classifier chain.

The categories come from ``labels``, in the order of ``CATEGORIES``. Each category's model is a logistic regression on the
words and word beginnings of a text, which are weighted by their log count ratio, on how many it has, and on the probabilities
of all earlier categories; in training these are out-of-fold predictions, so a later model sees them as wrong as they are on new
texts. It is fitted on a bounded sample of labelled rows, about ``SAMPLE`` of each combination of labels.

Null text counts as empty; null labels and labels of unknown documents are not trained on; of repeated labels of a document the
maximum of each category counts; a category without both
values has their share as probability. Rows repeat as they come; an empty table gives an empty table; other columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, texts

SAMPLE, FOLDS, LEAST_DOCS, STEM, STEPS = 2000, 3, 8, 5, 80
#: Words whose log count ratio is less than this say nothing; a document is marked from this probability on.
LEAST_RATIO, THRESHOLD = 1.0, 0.8
_EDGE = ".,;:!?()[]{}\"'"


def categories() -> dict[str, Column]:
    """Each category as a Boolean expression over ``labels``, in the order of the chain."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def features(text: str) -> set[str]:
    words = {w.strip(_EDGE) for w in set(text.lower().split())}
    return words | {f"^{w[:STEM]}" for w in words if len(w) > STEM}


class Rows:
    """A sparse matrix of ones: the columns of all rows, and where each row begins."""

    def __init__(self, rows: list[list[int]]):
        self.n = np.array([len(r) for r in rows], np.int64)
        self.flat = np.fromiter((i for r in rows for i in r), np.int64, int(self.n.sum()))
        self.owner = np.repeat(np.arange(len(rows)), self.n)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.flat], len(self.n))

    def back(self, e: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.flat, e[self.owner], size)

    def take(self, at: np.ndarray) -> Rows:
        out = Rows([])
        out.n = self.n[at]
        begin = np.cumsum(self.n) - self.n
        out.owner = np.repeat(np.arange(len(at)), out.n)
        out.flat = self.flat[np.repeat(begin[at] - (np.cumsum(out.n) - out.n), out.n) + np.arange(int(out.n.sum()))]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: Rows, dense: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the sparse columns; then of the dense ones and the constant."""
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        p = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return np.zeros(size), np.r_[np.zeros(dense.shape[1]), np.log(p / (1 - p))]
    yes, no = x.back(y, size) + 0.5, x.back(1 - y, size) + 0.5
    ratio = np.log(yes / (y.sum() + 1)) - np.log(no / (len(y) - y.sum() + 1))
    ratio[np.abs(ratio) < LEAST_RATIO] = 0
    extra = np.c_[dense, np.ones(len(y))]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    v, u = np.full(size, 0.1), np.zeros(extra.shape[1])
    m = [np.zeros_like(v), np.zeros_like(u)]
    s = [np.zeros_like(v), np.zeros_like(u)]
    for step in range(1, STEPS + 1):
        e = (_sigmoid(x.dot(ratio * v) + extra @ u) - y) * weight / len(y)
        grads = [ratio * x.back(e, size) + 1e-4 * v, extra.T @ e]
        for i, (g, w) in enumerate(zip(grads, (v, u), strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            w -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-9)
    return ratio * v, u


class Chain:
    def __init__(self, names: list[str], sets: list[set[str]], labels: np.ndarray, folds: np.ndarray):
        """labels: by row and category, NaN where unknown."""
        seen: dict[str, int] = {}
        for s in sets:
            for f in s:
                seen[f] = seen.get(f, 0) + 1
        self.names = names
        self.column = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_DOCS))}
        x = Rows([[self.column[f] for f in sorted(s) if f in self.column] for s in sets])
        size = len(self.column)
        self.sparse, self.dense = np.zeros((size, len(names))), []
        earlier = np.log1p(x.n)[:, None]  # long texts have more words of any kind
        for c in range(len(names)):
            y = labels[:, c]
            known = np.flatnonzero(~np.isnan(y))
            out = np.zeros(len(sets))
            for k in range(FOLDS):
                train, rest = known[folds[known] != k], np.flatnonzero(folds == k)
                w, u = fit(x.take(train), earlier[train], y[train], size)
                out[rest] = _sigmoid(x.take(rest).dot(w) + earlier[rest] @ u[:-1] + u[-1])
            w, u = fit(x.take(known), earlier[known], y[known], size)
            self.sparse[:, c] = w
            self.dense.append(u)
            earlier = np.c_[earlier, out]

    def predict(self, docs: list[str]) -> np.ndarray:
        get = self.column.get
        x = Rows([[i for f in sorted(features(t)) if (i := get(f)) is not None] for t in docs])
        p = np.log1p(x.n)[:, None]
        for c, u in enumerate(self.dense):
            p = np.c_[p, _sigmoid(x.dot(self.sparse[:, c]) + p @ u[:-1] + u[-1])]
        return p[:, 1:]


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    bound_batches(docs.sparkSession)
    cats = categories()
    names = list(cats)
    marks = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), *(c.cast("int").alias(k) for k, c in cats.items())).groupBy("label_id").agg(*(F.max(k).alias(k) for k in names))
    kinds = marks.groupBy(*names).count().collect()  # a row a combination
    share = F.lit(0.0)
    for r in kinds:
        same = F.lit(True)
        for k in names:
            same = same & F.col(k).eqNullSafe(F.lit(r[k]))
        share = F.when(same, F.lit(min(1.0, SAMPLE / r["count"]))).otherwise(share)
    at = F.pmod(F.xxhash64(F.lit("toxic"), "label_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.where(at < share)  # at most about SAMPLE rows of each combination
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(features(t)) for t in b.column(1).to_pylist()], pa.list_(pa.string())), *(b.column(i + 2) for i in range(len(names)))], ["doc_id", "words", *names])

    got = rows.select("doc_id", "text", *names).mapInArrow(run, "doc_id long, words array<string>, " + ", ".join(f"{k} int" for k in names)).toArrow().sort_by("doc_id")
    labels_of = np.column_stack([np.array([np.nan if v is None else v for v in got.column(k).to_pylist()], float) for k in names])
    folds = np.array([(i * 2654435761 >> 7) % FOLDS for i in got.column("doc_id").to_pylist()], int)
    return Chain(names, [set(w) for w in got.column("words").to_pylist()], labels_of, folds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id`` and the probability of each category, ``p_<category>``, of every whole text."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(chain)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1]))], ["doc_id", *(f"p_{k}" for k in model.value.names)])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{k} double" for k in chain.names))
