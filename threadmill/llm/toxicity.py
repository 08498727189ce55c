"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over which words (and 5- and 6-letter beginnings of
words) a text holds; each model also gets the earlier categories' probabilities.  In training those are out-of-fold
predictions, so a later model learns from probabilities as good as it will see.  The labels know one class, so the
categories before the last are found in the data: the toxic documents of the sample are clustered by the features that
set them apart, and a cluster is a category.  The last category is `toxic`, the label itself.

The models are fitted on the driver on a bounded sample of labelled documents; every document is scored over its whole
text, however long.  Defined results: null or empty text has the chain's base probability, without words; null labels and
labels of unknown documents teach nothing, a document with both labels counts as toxic; without both classes nothing is
toxic (score 0); repeated rows are scored alike; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import give_back, per_batch, small_batches, top_by_hash, utf8, xxh

#: Labelled documents in the sample: toxic ones, others.
TOXIC, OTHERS = 2500, 5000
#: Features that the models look at, and cells in which features are counted to choose them.
FEATURES, CELLS = 1024, 1 << 22
THRESHOLD = 0.25
#: Words whose features a task remembers.
REMEMBERED = 50_000
FOLDS = 5
#: Categories before the last, and by how many standard deviations a feature's rates in either class differ at least.
CATEGORIES, APART = 3, 3.0
_LETTERS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(_LETTERS).split())


def features(word: bytes) -> list[int]:
    w = word.decode("utf-8", "replace")
    return [xxh(word) % CELLS, *(xxh(b"^" + w[:n].encode()) % CELLS for n in (5, 6) if len(w) >= n)]


@dataclass
class Chain:
    """weights: for each category a row over the chosen cells, the earlier categories' log-odds and the constant."""

    cells: dict[int, int]
    weights: list[np.ndarray]
    seen: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def active(self, text: bytes) -> np.ndarray:
        out: set[int] = set()
        for w in words_of(text):
            got = self.seen.get(w)
            if got is None:
                if len(self.seen) > REMEMBERED:
                    self.seen.clear()
                got = self.seen[w] = tuple(self.cells[c] for c in features(w) if c in self.cells)
            if got:
                out.update(got)
        return np.fromiter(out, np.int64, len(out))

    def predict(self, text: bytes) -> list[float]:
        at, earlier = self.active(text), []
        if not len(at):  # nothing is known of it, so it is not toxic
            return [0.0] * len(self.weights)
        n = len(self.cells)
        for w in self.weights:
            z = w[at].sum() + w[-1] + float(np.dot(w[n:-1], earlier))
            earlier.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return [float(p) for p in earlier]


def fit_logistic(x: np.ndarray, y: np.ndarray, l1: float = 2e-4, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Accelerated proximal gradient; the last column of x is the constant and is not shrunk."""
    n, w = len(y), np.zeros(x.shape[1], np.float32)
    v, t = w.copy(), 1.0
    u = np.random.default_rng(1).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(12):
        u = x.T @ (x @ u)
        u /= np.linalg.norm(u) + 1e-12
    rate = 1 / (0.25 * float(np.linalg.norm(x @ u)) ** 2 * 1.1 / n + l2)
    shrink = np.full(x.shape[1], l1 * rate, np.float32)
    shrink[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = v - rate * (x.T @ (p - y) / n + l2 * v)
        new = np.sign(step) * np.maximum(np.abs(step) - shrink, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def clusters(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Number of each row's cluster by direction: the centres start with the row nearest to all and then those farthest from
    the centres so far, and move to their rows' mean."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.maximum(norm, 1e-12)
    centres = x[[int((x @ x.sum(0)).argmax())]]
    while len(centres) < k:
        far = np.where(norm[:, 0] > 0, (x @ centres.T).max(1), 2.0)
        centres = np.vstack([centres, x[int(far.argmin())]])
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.stack([x[of == j].sum(0) for j in range(k)])
        new = np.where(sums.any(1, keepdims=True), sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centres)
        if np.allclose(new, centres):
            break
        centres = new
    return of


def fit_chain(rows: list[tuple[np.ndarray, int]], categories: int = CATEGORIES) -> Chain | None:
    """rows: (cells of the text, toxic)."""
    y = np.array([t for _, t in rows], np.float32)
    if not 0 < y.sum() < len(y):
        return None
    df = [np.zeros(CELLS, np.int32), np.zeros(CELLS, np.int32)]
    for cells, t in rows:
        df[t][cells] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    both = df[0] + df[1]
    used = np.flatnonzero(both >= 3)  # most cells are empty: nothing else is made for all of them
    pooled = both[used] / len(y)
    z = np.abs(df[1][used] / n1 - df[0][used] / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    top = np.argsort(-z, kind="stable")[:FEATURES]
    top = np.sort(top[z[top] >= APART])
    chosen, z = used[top], z[top]
    index = {int(c): i for i, c in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (cells, _) in enumerate(rows):
        x[i, [index[c] for c in cells.tolist() if c in index]] = 1
    # what sets toxic documents apart: features that are more frequent in them
    marks = np.where(df[1][chosen] / n1 > df[0][chosen] / n0, z, 0).astype(np.float32)
    of = np.full(len(rows), -1)
    of[y == 1] = clusters(x[y == 1] * marks, categories)
    goals = [(of == j).astype(np.float32) for j in range(categories)] + [y]
    fold, one = np.arange(len(rows)) % FOLDS, np.ones((len(rows), 1), np.float32)
    earlier, weights = np.empty((len(rows), 0), np.float32), []
    for goal in goals:
        full = np.hstack([x, earlier, one])
        weights.append(fit_logistic(full, goal))
        out = np.zeros(len(rows), np.float32)
        for f in range(FOLDS):
            w = fit_logistic(full[fold != f], goal[fold != f], steps=60)
            out[fold == f] = 1 / (1 + np.exp(-np.clip(full[fold == f] @ w, -30, 30)))
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(index, weights)


def sample_rows(docs: DataFrame, labels: DataFrame, toxic: int, others: int) -> list[tuple[np.ndarray, int]]:
    """The first labelled documents of either class in hash order, as feature cells; ids of the sample are broadcast."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = top_by_hash(known.filter("toxic = 1"), toxic, "doc_id").union(top_by_hash(known.filter("toxic = 0"), others, "doc_id"))

    def read(batch):
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "cells": [sorted({c for w in words_of(t) for c in features(w)}) for t in utf8(batch)]}

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    rows = per_batch(picked, "doc_id long, toxic int, cells array<int>", read).toLocalIterator()
    return [(c, t) for _, c, t in sorted(((r["doc_id"], np.array(r["cells"], np.int32), r["toxic"]) for r in rows), key=lambda r: (r[0], len(r[1])))]


def without_toxic(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, others: int = OTHERS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose text the chain does not call toxic; they are read once and not shuffled.  A null text and one
    without any feature score 0 and stay."""
    chain = docs.sparkSession.sparkContext.broadcast(fit_chain(sample_rows(docs, labels, toxic, others)))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold dots or quotes
    text = f"c{docs.columns.index('text')}"

    def keep(batches):
        for batch in batches:
            yield batch if chain.value is None else batch.filter(pa.array([chain.value.predict(t)[-1] < threshold for t in utf8(batch, text)], pa.bool_()))
        if chain.value:  # workers serve later stages too
            chain.value.seen.clear()
        give_back()

    small_batches(docs.sparkSession)
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, categories: int = CATEGORIES, toxic: int = TOXIC, others: int = OTHERS, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of `docs` (doc_id, text): a probability per category, score (the chain's last) and toxic (boolean)."""
    chain = docs.sparkSession.sparkContext.broadcast(fit_chain(sample_rows(docs, labels, toxic, others), categories))
    names = [*(f"category_{j + 1}" for j in range(categories)), "score"]

    def score(batch):
        got = [chain.value.predict(t) if chain.value else [0.0] * len(names) for t in utf8(batch)]
        return {"doc_id": batch.column("doc_id"), **{n: [p[i] for p in got] for i, n in enumerate(names)}}

    schema = ", ".join(["doc_id long", *(f"{n} double" for n in names)])
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, score).withColumn("toxic", F.col("score") >= threshold)
