"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of ``WINDOW`` words of the benchmark texts, normalised:
lower case, words of ASCII letters, digits and non-ASCII characters, single
spaces; an item of fewer words is one pattern if it has ``MIN_WORDS``.  With m the
shortest pattern's length, a shift table over hashed blocks of ``BLOCK`` bytes says
how far the window may skip; at shift 0 the buckets of the block's hash and a
hash of the first bytes select patterns, and a direct comparison confirms them.
The search runs in many lanes of a batch at once, each skipping on its own.

The tables of a benchmark are made on the driver and sent to every task; its size is
asked first, and beyond ``TABLE_BYTES`` its items are spread over several tables, one
search after the other, so none that is sent grows with the benchmark.

Cases: null and empty texts contain nothing; null or empty benchmark texts, and
those of fewer than MIN_WORDS words, give no pattern (their number is logged); items
with the same passage are all reported; a null item_id or doc_id is carried as null;
repeated rows are reported each; other columns are ignored; with no pattern nothing
is found.
"""

from __future__ import annotations

import logging
import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, lower, slices, small_batches, squeeze, text_bytes

LOG = logging.getLogger(__name__)
WINDOW = 10
TABLE_BYTES = 8 << 20
MIN_WORDS = 5
BLOCK = 6
TABLE_BITS = 22
LANE = 2048
_K = np.uint64(0x9E3779B97F4A7C15)


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return squeeze(*text_bytes(lower(texts)), WORD_BYTE)


def windows(text: bytes, window: int, min_words: int) -> set[bytes]:
    """Patterns of one normalised text, with the spaces around them."""
    w = text.split()
    if len(w) < window:
        return {b" " + b" ".join(w) + b" "} if len(w) >= min_words else set()
    return {b" " + b" ".join(w[k : k + window]) + b" " for k in range(len(w) - window + 1)}


@dataclass
class Patterns:
    texts: list[bytes]
    items: list[list[int | None]]
    m: int
    block: int
    shift: np.ndarray
    buckets: dict[tuple[int, int], list[int]]

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]], window: int = WINDOW, min_words: int = MIN_WORDS) -> Patterns:
        data, offs = normalise(pa.array([t for _, t in rows], pa.string()))
        raw, by = data.tobytes(), defaultdict(list)
        for (item, _), a, b in zip(rows, offs.tolist(), offs[1:].tolist()):
            for p in windows(raw[a:b], window, min_words):
                if item not in by[p]:
                    by[p].append(item)
        texts = sorted(by)
        m = min(map(len, texts), default=0)
        block = min(BLOCK, max(m, 1), 8)
        shift = np.full(1 << TABLE_BITS, min(m - block + 1, 32767), np.int16) if texts else np.zeros(0, np.int16)
        buckets: dict[tuple[int, int], list[int]] = defaultdict(list)
        if texts:
            heads = np.frombuffer(b"".join(t[:m].ljust(m + 8, b"\0") for t in texts), np.uint8)
            row = (m + 8) * np.arange(len(texts))
            for at in range(m - block + 1):
                np.minimum.at(shift, cls._hash(heads, row + at, block), m - block - at)
            last, first = cls._hash(heads, row + m - block, block), cls._first(heads, row, m)
            for k, key in enumerate(zip(last.tolist(), first.tolist())):
                buckets[key].append(k)
        return cls(texts, [by[t] for t in texts], m, block, shift, dict(buckets))

    @staticmethod
    def _words(data: np.ndarray) -> np.ndarray:
        """Eight bytes from each position; data must have eight bytes to spare."""
        return np.ndarray(len(data) - 7, "<u8", data, 0, (1,))

    @classmethod
    def _hash(cls, data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
        return ((cls._words(data)[at] << np.uint64(64 - 8 * block)) * _K >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    @classmethod
    def _first(cls, data: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        return cls._words(data)[at] & np.uint64((1 << 8 * min(m, 8)) - 1)

    def search(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(position, pattern) of every occurrence in normalised bytes."""
        n = len(data) - self.m
        if not self.texts or n < 0:
            return []
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        pos = np.arange(0, n + 1, LANE)
        end = np.minimum(pos + LANE, n + 1)
        found, tail = [], self.m - self.block
        while len(pos):
            s = self.shift[self._hash(padded, pos + tail, self.block)]
            if not s.all():
                found.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        if not found:
            return []
        at = np.sort(np.concatenate(found))
        raw, out = data.tobytes(), []
        for p, key in zip(at.tolist(), zip(self._hash(padded, at + tail, self.block).tolist(), self._first(padded, at, self.m).tolist())):
            out += [(p, k) for k in self.buckets.get(key, ()) if raw.startswith(self.texts[k], p)]
        return out


def build(benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, table_bytes: int = TABLE_BYTES) -> list[Patterns]:
    """The tables of a benchmark; all rows of an item are in one of them."""
    rows = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, out, short = max(1, math.ceil(total / table_bytes)), [], 0
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect() if parts > 1 else rows.collect()
        short += sum(0 < len(r[1].split()) < min_words for r in got)
        out.append(Patterns.build(sorted(((r[0], r[1]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1])), window, min_words))
    if short:
        LOG.warning("%d benchmark texts of fewer than %d words aren't searched for", short, min_words)
    return out


def _hits(texts: pa.Array, patterns: Patterns) -> list[tuple[int, int]]:
    """(text number, pattern), without repeats."""
    data, offs = normalise(texts)
    found = patterns.search(data)
    of = np.searchsorted(offs, [p for p, _ in found], side="right") - 1
    return sorted({(int(d), k) for d, (_, k) in zip(of, found)})


def _found(docs: DataFrame, patterns: Patterns) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(patterns)  # TABLE_BYTES of texts

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                count: dict[tuple, int] = defaultdict(int)
                for d, k in _hits(part.column("text"), sent.value):
                    for item in sent.value.items[k]:
                        count[d, item] += 1
                if count:
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in count], pa.int64()), pa.array([i for _, i in count], pa.int64()), pa.array(count.values(), pa.int64())], names=["doc_id", "item_id", "windows"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, item_id long, windows long")


def find_contaminated(docs: DataFrame, tables: list[Patterns]) -> DataFrame:
    """(doc_id, item_id, windows): for each row of ``docs`` and item, how many different windows of the item it contains."""
    docs = small_batches(docs)
    return reduce(DataFrame.unionAll, (_found(docs, t) for t in tables))


def _is_clean(docs: DataFrame, patterns: Patterns):
    sent = docs.sparkSession.sparkContext.broadcast(patterns)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            ok = np.ones(part.num_rows, bool)
            ok[[d for d, _ in _hits(part.column("text"), sent.value)]] = False
            out.append(ok)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return clean(docs["text"].cast("string"))


def drop_contaminated(docs: DataFrame, tables: list[Patterns]) -> DataFrame:
    """The rows of ``docs`` that contain no pattern, all columns as they are."""
    docs = small_batches(docs)
    return reduce(lambda df, t: df.where(_is_clean(docs, t)), tables, docs)


#: The same by SQL: windows by list functions, an equi-join on the window.
ORACLE = f"""
with words as (
  select 'd' as kind, doc_id as id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents
  union all
  select 'b', item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda x: x <> '') from benchmark),
short as (select id, array_to_string(w, ' ') as p, len(w) as n from words where kind = 'b' and len(w) between {MIN_WORDS} and {WINDOW - 1}),
grams as (
  select kind, id, unnest(list_distinct(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i+{WINDOW - 1}], ' ')))) as p
  from words where len(w) >= {WINDOW})
select d.id as doc_id, b.id as item_id, count(*) as windows from grams d join grams b on d.p = b.p where d.kind = 'd' and b.kind = 'b' group by 1, 2
union all
select w.id, s.id, 1 from words w join short s on contains(' ' || array_to_string(w.w, ' ') || ' ', ' ' || s.p || ' ') where w.kind = 'd'
"""
