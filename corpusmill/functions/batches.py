"""Texts of an Arrow batch as one array of bytes: tokens, counts and hashes without a Python loop over them.

``slices`` cuts a batch into pieces of a bounded number of bytes, so memory follows
``SLICE_BYTES`` or the longest single text, never the batch; texts stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch at most: texts are long, and the JVM and the worker hold a batch each.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches are cut to BATCH_ROWS if they are larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets, from 0; nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    else:
        offs = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
    offs = offs.astype(np.int64)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``limit`` bytes in ``column`` (or one row)."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("mul", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("mul", MULTIPLIER), ("inv", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _pow[name] = a
    return _pow["mul"][:n], _pow["inv"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, whatever the number of spans: polynomial prefix sums."""
    mul, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * mul[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts])


_DIGIT_OR_LETTER = np.zeros(256, bool)
_DIGIT_OR_LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_SYMBOL = np.ones(256, bool)  # the first byte of a character that is a token by itself
_SYMBOL[[*b" \t\n\x0b\f\r", *range(128, 192)]] = False
_SYMBOL &= ~_DIGIT_OR_LETTER


def _token_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    inner = _DIGIT_OR_LETTER[data]
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    first = offs[:-1][np.diff(offs) > 0]
    starts[first] = inner[first]
    return starts | _SYMBOL[data]


def token_counts(texts: pa.Array) -> np.ndarray:
    """Tokens (runs of ASCII letters or digits, else single characters that aren't white space) of each text."""
    data, offs = text_bytes(texts)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_token_starts(data, offs), out=total[1:])
    return np.diff(total[offs])


def token_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the tokens."""
    starts = np.flatnonzero(_token_starts(data, offs))
    of = np.searchsorted(offs, starts, side="right") - 1
    inner = _DIGIT_OR_LETTER[data]
    breaks = np.append(np.flatnonzero(~inner), len(data))
    leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    ends = np.where(inner[starts], breaks[np.searchsorted(breaks, starts)], leads[np.minimum(np.searchsorted(leads, starts + 1), len(leads) - 1)]) if len(starts) else starts
    return starts, np.minimum(ends, offs[of + 1]), of


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The distinct hashes of each text's token n-grams; none if it has fewer tokens."""
    data, offs = text_bytes(texts)
    a, b, of = token_spans(data, offs)
    h = span_hashes(data, a, b)
    k = max(0, len(h) - n + 1)
    g = np.zeros(k, np.uint64)
    for j in range(n if k else 0):
        g = (g + h[j : k + j]) * MULTIPLIER
    whole = of[:k] == of[n - 1 :] if k else np.zeros(0, bool)
    g, of = mix(g[whole]).view(np.int64), of[:k][whole]
    return [np.unique(x) for x in np.split(g, np.searchsorted(of, np.arange(1, len(texts))))]
