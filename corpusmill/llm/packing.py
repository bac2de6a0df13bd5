"""Operator 4: best-fit packing into sequences of several permitted lengths.

Documents are spread over groups by a hash of the id; the number of groups follows
the number of documents, so a group stays at about ``GROUP_ROWS`` and is packed by
one task.  A document longer than the longest sequence fills whole sequences, and
its rest is packed.  In descending order of size, an item goes to the open bin
where it leaves the least room; if none has room, the bin opened is of the length
with the least cost per token that a greedy filling from the items still to come
would give it.  At the end each bin is cut down to the shortest permitted length
that holds its contents.

Lengths are in tokens of ``tokens``: op4 and the pipeline give the byte-level BPE
count of ``token_counts``.  Without it a text's tokens are runs of letters or digits
and single symbols, for sizes that needn't hold under a vocabulary.

Cases: null and empty texts have no token and are in no bin; null ids are
spread by their number of tokens; rows that repeat an id are packed each; ties go by id (null first), then to
the bin opened first; other columns are ignored; an empty table gives no bin.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_tokens, small_batches

LENGTHS = (512, 1024, 2048, 4096, 8192)
SEQUENCE_COST = 16  #: of a sequence, in tokens, besides its length
GROUP_ROWS = 10_000
SCHEMA = "doc_id long, piece int, first_token long, tokens long, bin_id long, bin_length int, bin_offset int"


def cost(length: int) -> float:
    return length + SEQUENCE_COST


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset in it, length of each bin) for sizes in descending order, none above the longest."""
    lengths = tuple(sorted(lengths))
    down = [-int(s) for s in sizes]
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    full, length, bins, offsets = [], [], [], []
    for k, s in enumerate(map(int, sizes)):
        at = bisect_left(open_bins, (s, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            best = None
            for c in lengths[bisect_left(lengths, s) :]:
                room, j = c - s, k + 1
                while room and (j := bisect_left(down, -room, j)) < len(down):
                    room += down[j]
                    j += 1
                if best is None or cost(c) / (c - room) < best[0] - 1e-12:
                    best = (cost(c) / (c - room), c)
            b, room = len(full), best[1]
            full.append(0)
            length.append(room)
        bins.append(b)
        offsets.append(full[b])
        full[b] += s
        if room - s:
            insort(open_bins, (room - s, b))
    return bins, offsets, [lengths[bisect_left(lengths, f)] for f in full]


def _pack_group(lengths: tuple[int, ...]):
    most = max(lengths)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("n").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        out, items = [], []
        base = table.column("g")[0].as_py() << 32
        for i, n in rows:
            for piece in range(n // most):
                out.append((i, piece, piece * most, most, base + len(out), most, 0))
            if n % most:
                items.append((n % most, i, n // most))
        whole = len(out)
        items.sort(key=lambda x: -x[0])
        bins, offsets, length = pack(np.array([x[0] for x in items], np.int64), lengths)
        out += [(i, piece, piece * most, n, base + whole + b, length[b], o) for (n, i, piece), b, o in zip(items, bins, offsets)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokens: Column | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each piece of a document: its tokens [first_token, first_token + tokens) and its place in a bin.

    Only (doc_id, count) is shuffled, once.  A group but for its last few bins is as
    well filled as one packing of everything, so the loss is a few bins in thousands.
    """
    small_batches(docs)
    groups = max(1, math.ceil(docs.count() / group_rows))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (n_tokens() if tokens is None else tokens).alias("n")).where("n > 0")
    counted = counted.withColumn("g", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(groups)).cast("long"))
    return counted.groupBy("g").applyInArrow(_pack_group(tuple(lengths)), SCHEMA)
