"""Operator 3: toxicity, a linear classifier on naive-Bayes-scaled character n-grams.

A text, lower-cased and reduced to letters, has as features the presence of its
hashed character (byte) n-grams of lengths ``ORDERS``.  Each feature is scaled by
its log-count ratio r = log(p/|p|) - log(q/|q|) between toxic and clean labelled
texts, and a logistic regression is fitted on the scaled features.

Cases: null and empty texts have no feature and are clean; labels that are null
or of unknown ids aren't used; without labels of both classes nothing is toxic;
repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LETTER_BYTE, labelled_sample, lower, sampled_texts, slices, small_batches, squeeze, text_bytes

BITS = 18
ORDERS = (4, 5)
PER_CLASS = 2000  #: labelled rows that are fitted, of each class
MIN_SCORE = 0.5


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # log-count ratio times fitted weight, for each feature

    def score(self, grams: list[np.ndarray]) -> np.ndarray:
        s = np.array([self.weight[g].sum(dtype=np.float64) for g in grams]) + self.bias
        return np.where([len(g) > 0 for g in grams], 1 / (1 + np.exp(-np.clip(s, -30, 30))), 0.0)


def grams(texts: pa.Array) -> list[np.ndarray]:
    """Per text, its distinct features in ascending order."""
    data, offs = squeeze(*text_bytes(lower(texts)), LETTER_BYTE)
    found = []
    for n in ORDERS:
        h = np.full(max(0, len(data) - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ data[j : len(data) - n + 1 + j]) * np.uint32(0x01000193) if len(data) >= n else h
            h ^= h >> np.uint32(15)
        found.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    out = []
    for a, b in zip(offs.tolist(), offs[1:].tolist()):
        parts = [h[a : max(a, b - n + 1)] for n, h in zip(ORDERS, found)]
        x = np.sort(np.concatenate(parts))
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = 8, rate: float = 0.02, l2: float = 1e-2, seed: int = 5) -> Model:
    size = 1 << BITS
    y = np.array([k for _, k in rows], float)
    if len(set(y)) < 2:
        return Model(-30.0, np.zeros(size, np.float32))
    p, q = np.ones(size), np.ones(size)
    for g, k in rows:
        (p if k else q)[g] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    cost = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b, gw, gb, rnd = np.zeros(size), 0.0, np.full(size, 1e-6), 1e-6, np.random.default_rng(seed)
    for _ in range(epochs):
        order = rnd.permutation(len(rows))
        for at in range(0, len(rows), 64):
            pick = order[at : at + 64]
            idx = np.concatenate([rows[k][0] for k in pick])
            of = np.repeat(np.arange(len(pick)), [len(rows[k][0]) for k in pick])
            x = ratio[idx]
            s = np.bincount(of, x * w[idx], minlength=len(pick)) + b
            d = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[pick]) * cost[pick] / len(pick)
            g = np.bincount(idx, d[of] * x, minlength=size)
            used = np.flatnonzero(g)
            step = g[used] + l2 * w[used]
            gw[used] += step * step
            w[used] -= rate * step / np.sqrt(gw[used])
            gb += d.sum() ** 2
            b -= rate * d.sum() / np.sqrt(gb)
    return Model(float(b), (w * ratio).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits ``labels`` (doc_id, toxic 0 or 1) on a sample of at most about ``per_class`` rows of each class."""
    small_batches(docs)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([g.tobytes() for g in grams(part.column("text"))], pa.binary())], names=["doc_id", "label", "grams"])

    sample = sampled_texts(docs, labelled_sample(labels, "toxic", per_class), ["cast(text as string) text"])
    got = sample.mapInArrow(run, "doc_id long, label int, grams binary").toArrow().to_pydict()
    return fit([(np.frombuffer(g, np.uint32), int(k > 0)) for _, g, k in sorted(zip(got["doc_id"], got["grams"], got["label"]))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id and the probability that it is toxic."""
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers, whatever the data

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.score(grams(part.column("text"))), pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")


def find_toxic(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, score) of the rows that are toxic."""
    return score(docs, model).where(f"score >= {min_score}")
