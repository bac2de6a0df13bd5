"""Shared pieces: table access, the shared work folder, vectorised text hashing.

Text is handled in Arrow batches, cut into slices of a bounded number of bytes; every
text is still processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_ROWS, MULTIPLIER, mix, slices, small_batches, span_hashes, text_bytes, token_counts  # noqa: F401
from ..storage import Workspace, shared_dir  # noqa: F401

#: Unicode-free token count: runs of letters or digits, else single symbols.
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# hashing:
#: ASCII letters and digits and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", *range(128, 256)]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the words of concatenated texts: maximal runs of WORD_BYTE within a text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = WORD_BYTE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | first[:-1]))
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def gram_hashes(word: np.ndarray, owner: np.ndarray, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams with their text numbers, in order; a text of 1 to n-1 words has one gram, all of it."""
    count = np.bincount(owner, minlength=n_texts)
    k = len(word)
    with np.errstate(over="ignore"):
        g = np.zeros(max(0, k - n + 1), np.uint64)
        for j in range(n):
            g = (g + word[j : k - n + 1 + j]) * MULTIPLIER if k >= n else g
        ok = owner[: k - n + 1] == owner[n - 1 :] if k >= n else np.zeros(0, bool)
        grams, of = mix(g[ok]), owner[: max(0, k - n + 1)][ok]
        first = np.cumsum(count) - count
        extra_h, extra_o = [], []
        for m in range(1, n):
            short = np.flatnonzero(count == m)
            if len(short):
                h = np.full(len(short), m, np.uint64)
                for j in range(m):
                    h = (h + word[first[short] + j]) * MULTIPLIER
                extra_h.append(mix(h))
                extra_o.append(short)
    if extra_h:
        grams, of = np.concatenate([grams, *extra_h]), np.concatenate([of, *extra_o])
        at = np.argsort(of, kind="stable")
        grams, of = grams[at], of[at]
    return grams, of


def lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(col, ""))


LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True


def squeeze(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as its runs of ``keep`` bytes, one space before, between and after them (a text without any: one space)."""
    n = len(offs) - 1
    of = np.repeat(np.arange(n), np.diff(offs))
    wide = np.full(len(data) + 2 * n, 32, np.uint8)
    wide[np.arange(len(data)) + 2 * of + 1] = np.where(keep[data], data, np.uint8(32))
    starts = offs[:-1] + 2 * np.arange(n)
    space = wide == 32
    again = np.zeros(len(wide), bool)
    again[1:] = space[1:] & space[:-1]
    again[starts] = False
    count = np.zeros(len(wide) + 1, np.int64)
    np.cumsum(~again, out=count[1:])
    return wide[~again], np.append(count[starts], count[-1])


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label): about ``per_class`` rows of each class at most, chosen by a hash of the id.

    A class's share is set by its count, so the choice doesn't depend on partitions.
    Rows with a null id or label are not used; of a repeated id, the smallest label.
    """
    known = labels.selectExpr("cast(doc_id as long) doc_id", f"cast({label} as int) label").where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = F.lit(False)
    for k, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("label") == k) & (F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000)) < int(1e6 * min(1.0, per_class / n))))
    return known.where(chosen)


def sampled_texts(docs: DataFrame, sample: DataFrame, columns: list[str]) -> DataFrame:
    """The sampled rows of ``docs`` with their labels; the sample is bounded, so it is the side that is sent."""
    return docs.selectExpr("cast(doc_id as long) doc_id", *columns).join(F.broadcast(sample), "doc_id")


def n_tokens(text: str = "text"):
    """Tokens by TOKEN_PATTERN; null and empty text: 0.  The JVM's regexp_count makes an array of all of them first."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(token_counts(p.column("text")) for p in parts)]))

    return counted(F.col(text).cast("string"))
