"""Operator 9: language identification by compression.

Each language has a raw-content zstandard dictionary of its own text.  A text,
lower-cased and reduced to letters, is cut into blocks of ``BLOCK`` bytes; every
block is compressed with every dictionary, and the language with the smallest
total wins.  Blocks are compressed apart, so that a long text is judged by all of
its parts and its margin doesn't shrink with its length.  A text is rejected if
the second smallest total is less than ``MIN_MARGIN`` above the smallest.

With one known language its dictionary is held against none: the margin is what it
saves.  Without any, as where no row has a ``lang``, there is nothing to judge by:
every text with letters is accepted, without a language and with margin 0, and a
warning is logged, so a corpus without labels isn't lost.

Cases: a null or empty text, or one without letters, is rejected with margin 0;
of equal totals the first language in alphabetical order is named, with margin 0,
so rejected; a table without a ``lang`` column has no known language; an empty table
gives an empty result; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTER_BYTE, lower, slices, small_batches, squeeze, text_bytes

LOG = logging.getLogger(__name__)
BLOCK = 4096
DICTIONARY_BYTES = 256 << 10
TEXTS_PER_LANGUAGE = 400
LEVEL = 3
#: Of the labelled documents of sf0.1 (dictionaries from the other half), 1.7 % have less; random words of another language, and random letters, don't reach it.
MIN_MARGIN = 0.05
SCHEMA = "doc_id long, language string, margin double, accepted boolean"


def letters(texts: pa.Array) -> tuple[bytes, list[int]]:
    data, offs = squeeze(*text_bytes(lower(texts)), LETTER_BYTE)
    return data.tobytes(), offs.tolist()


def dictionaries(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Per language, up to ``size`` bytes of about ``per_language`` texts labelled with it, chosen by a hash of the id.

    These bounds don't grow with the corpus; a language's share is set by its count.
    """
    if "lang" not in docs.columns:
        return {}
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(text as string) text").where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for k, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == k) & (F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < int(1e6 * min(1.0, per_language / n))))
    # a text gives a dictionary no more than its size, so what reaches the driver is bounded as well
    sample = rows.where(chosen).select("lang", F.xxhash64("doc_id", F.lit("lang")).alias("h"), F.substring("text", 1, size).alias("text")).distinct().toPandas()
    out = {}
    for k, g in sample.sort_values(["h", "text"]).groupby("lang"):
        data, _ = letters(pa.array(g["text"].tolist(), pa.string()))
        if out_data := data[:size].strip():
            out[str(k)] = out_data
    return out


def compressors(model: dict[str, bytes]) -> list[tuple[str | None, object]]:
    """A compressor of each language; beside a single one, one without a dictionary."""
    import zstandard as z

    out = []
    for k in sorted(model):
        p = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0)
        d = z.ZstdCompressionDict(model[k], dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out.append((k, z.ZstdCompressor(dict_data=d, compression_params=p)))
    return [*out, (None, z.ZstdCompressor(compression_params=p))] if len(out) == 1 else out


def classify(texts: pa.Array, tools: list[tuple[str, object]], min_margin: float) -> tuple[list, list, list]:
    data, offs = letters(texts)
    names, margins, accepted = [], [], []
    for a, b in zip(offs, offs[1:]):
        blocks = [data[i : min(i + BLOCK, b)] for i in range(a, b, BLOCK)]
        if b - a < 2 or not tools:
            names.append(None), margins.append(0.0), accepted.append(b - a >= 2)
            continue
        sizes = [sum(len(c.compress(x)) for x in blocks) for _, c in tools]
        best = int(np.argmin(sizes))
        second = min([s for k, s in enumerate(sizes) if k != best], default=sizes[best])
        m = (second - sizes[best]) / sizes[best]
        names.append(tools[best][0]), margins.append(m), accepted.append(m >= min_margin and tools[best][0] is not None)
    return names, margins, accepted


def identify(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of ``docs``: the best language (null without letters), the margin, and whether it is accepted."""
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DICTIONARY_BYTES a language

    def run(batches):
        tools = compressors(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                n, m, a = classify(part.column("text"), tools, min_margin)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.string()), pa.array(m, pa.float64()), pa.array(a, pa.bool_())], names=["doc_id", "language", "margin", "accepted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def is_identified(model: dict[str, bytes], spark, min_margin: float = MIN_MARGIN):
    """A predicate on a text column, for use in a filter: true where ``identify`` accepts."""
    sent = spark.sparkContext.broadcast(model)
    memo: list = []

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        if not memo:
            memo.append(compressors(sent.value))
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([x for part in slices(batch, "text") for x in classify(part.column("text"), memo[0], min_margin)[2]], pa.bool_())

    return lambda text: accepted(F.col(text) if isinstance(text, str) else text)


def keep_identified(docs: DataFrame, model: dict[str, bytes] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns as they are."""
    small_batches(docs)
    model = dictionaries(docs) if model is None else model
    if len(model) < 2:
        LOG.warning("%s: %s", "one language is known" if model else "no language is known", "it is held against none" if model else "all texts with letters stay")
    predicate: Column = is_identified(model, docs.sparkSession, min_margin)(docs["text"].cast("string"))
    return docs.where(predicate)
