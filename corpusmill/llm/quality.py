"""Operator 6: quality classifier, a factorisation machine.

Features of a text: its distinct words, hashed; structure statistics; metadata
(language, source, size class), hashed.  The score is linear plus all pairwise
interactions through ``FACTORS``-wide vectors, in time linear in the features:
sum over pairs <v_i, v_j> x_i x_j = ((sum v_i x_i)^2 - sum v_i^2 x_i^2) / 2.

Cases: a null text counts as an empty one, whose features are structure and
metadata alone, and is scored as such; a null language, source or id has no
feature; labels that are null or of unknown ids aren't used; without labels of
both classes every score is 0.5 and everything is accepted; repeated rows score
alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, lower, sampled_texts, slices, small_batches, span_hashes, text_bytes, words

BITS = 16
FACTORS = 8
PER_CLASS = 3000  #: labelled rows that are fitted, of each class
MIN_SCORE = 0.3
STATS = ("upper", "digit", "symbol", "space", "words", "mean word", "distinct words", "repeated lines", "line length", "bars", "closing symbols", "empty")
META = 1 << 10
_UPPER, _DIGIT, _SPACE, _ALPHA = (np.zeros(256, bool) for _ in range(4))
_UPPER[[*range(65, 91)]] = _DIGIT[[*range(48, 58)]] = _SPACE[[*b" \n\t\r"]] = True
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # [features]
    factor: np.ndarray  # [features, FACTORS]

    def score(self, idx: np.ndarray, val: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(of, self.weight[idx] * val, minlength=n)
        s = np.zeros(n)
        for f in range(self.factor.shape[1]):
            vx = self.factor[idx, f] * val
            s += np.bincount(of, vx, minlength=n) ** 2 - np.bincount(of, vx * vx, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + s / 2, -30, 30)))


N_FEATURES = (1 << BITS) + META + len(STATS)


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return np.diff(c[offs])


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, row) of a batch with text, lang and source."""
    n = batch.num_rows
    data, offs = text_bytes(batch.column("text"))
    size = np.maximum(np.diff(offs), 1)
    low, low_offs = text_bytes(lower(batch.column("text")))
    a, b, of = words(low, low_offs)
    h = (span_hashes(low, a, b) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique((of << BITS) | h)
    w_of, w_idx = key >> BITS, key & ((1 << BITS) - 1)
    n_words, distinct = np.bincount(of, minlength=n), np.bincount(w_of, minlength=n)
    chars = np.bincount(of, b - a, minlength=n)
    symbol = ~(_ALPHA[data] | _DIGIT[data] | _SPACE[data])
    line_end = data == 10
    starts = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], np.flatnonzero(line_end) + 1]))
    starts = starts[starts < len(data)]
    l_of = np.searchsorted(offs, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), offs[l_of + 1])
    lines = np.bincount(l_of, minlength=n)
    lh = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    lu = np.bincount(np.unique(np.stack([l_of.astype(np.uint64), lh]), axis=1)[0].astype(np.int64), minlength=n) if len(starts) else np.zeros(n)
    follow = np.zeros(len(data), bool)
    follow[1:] = symbol[1:] & symbol[:-1]
    w1 = np.maximum(n_words, 1)
    stats = np.stack([
        _per_text(_UPPER[data], offs) / size * 2, _per_text(_DIGIT[data], offs) / size * 4, _per_text(symbol, offs) / size * 4, _per_text(_SPACE[data], offs) / size * 2,
        np.log1p(n_words) / 8, chars / w1 / 10, distinct / w1, 1 - lu / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)) / 8,
        _per_text(data == 124, offs) / w1, _per_text(follow, offs) / w1, (n_words == 0) * 1.0,
    ], axis=1)
    meta_i, meta_o = [], []
    for name in ("lang", "source"):
        for k, v in enumerate(batch.column(name).to_pylist()):
            if v is not None:
                meta_i.append(zlib.crc32(f"{name}={v}".encode()) % META), meta_o.append(k)
    sizes = np.log2(size).astype(np.int64)
    meta_i += [zlib.crc32(f"size={v}".encode()) % META for v in sizes.tolist()]
    meta_o += range(n)
    idx = np.concatenate([w_idx, (1 << BITS) + np.asarray(meta_i, np.int64), (1 << BITS) + META + np.tile(np.arange(len(STATS)), n)])
    val = np.concatenate([1 / np.sqrt(np.maximum(distinct, 1))[w_of], np.full(len(meta_i), 0.3), stats.ravel()])
    row = np.concatenate([w_of, np.asarray(meta_o, np.int64), np.repeat(np.arange(n), len(STATS))])
    return idx, val, row


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.08, l2: float = 1e-5, seed: int = 7) -> Model:
    """AdaGrad over mini-batches; both classes have the same total weight."""
    rnd = np.random.default_rng(seed)
    m = Model(0.0, np.zeros(N_FEATURES), rnd.normal(0, 0.02, (N_FEATURES, FACTORS)))
    y = np.array([r[2] for r in rows], float)
    if len(set(y)) < 2:
        return Model(0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, FACTORS)))
    cost = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    gw, gv, gb = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rnd.permutation(len(rows))
        for at in range(0, len(rows), 128):
            pick = order[at : at + 128]
            idx, val = (np.concatenate([rows[k][c] for k in pick]) for c in (0, 1))
            of = np.repeat(np.arange(len(pick)), [len(rows[k][0]) for k in pick])
            p = m.score(idx, val, of, len(pick))
            g = (p - y[pick]) * cost[pick] / len(pick)
            used, back = np.unique(idx, return_inverse=True)
            db = g.sum()
            gb += db * db
            m.bias -= rate * db / np.sqrt(gb)
            dw = np.bincount(back, g[of] * val) + l2 * m.weight[used]
            dv = np.empty((len(used), FACTORS))
            for f in range(FACTORS):
                v = m.factor[idx, f]
                total = np.bincount(of, v * val, minlength=len(pick))
                dv[:, f] = np.bincount(back, g[of] * val * (total[of] - v * val))
            dv += l2 * m.factor[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.weight[used] -= rate * dw / np.sqrt(gw[used])
            m.factor[used] -= rate * dv / np.sqrt(gv[used])
    return m


def _columns(docs: DataFrame) -> list[str]:
    return [f"cast({c} as string) {c}" if c in docs.columns else f"cast(null as string) {c}" for c in ("text", "lang", "source")]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits ``labels`` (doc_id, quality 0 or 1) on a sample of at most about ``per_class`` rows of each class."""
    small_batches(docs)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                idx, val, row = features(part)
                at = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[at], np.arange(1, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([x.astype(np.int32).tobytes() for x in np.split(idx[at], cut)], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in np.split(val[at], cut)], pa.binary())], names=["doc_id", "label", "idx", "val"])

    sample = sampled_texts(docs, labelled_sample(labels, "quality", per_class), _columns(docs))
    got = sample.mapInArrow(run, "doc_id long, label int, idx binary, val binary").toArrow().to_pydict()
    rows = sorted(zip(got["doc_id"], got["idx"], got["val"], got["label"]))
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(float), int(k > 0)) for _, i, v, k in rows])


def score(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of ``docs``: doc_id, the probability of good quality, and whether it is accepted."""
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES x (1 + FACTORS) numbers, whatever the data

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = sent.value.score(*features(part), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(p >= min_score)], names=["doc_id", "score", "accepted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", *_columns(docs)).mapInArrow(run, "doc_id long, score double, accepted boolean")


def keep_good(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that are accepted, all columns as they are."""
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, lang, source], names=["text", "lang", "source"])
        parts = [sent.value.score(*features(x), x.num_rows) >= min_score for x in slices(batch, "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(good(*(docs[c].cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("text", "lang", "source"))))
