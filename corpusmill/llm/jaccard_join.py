"""Operator 5: n-gram Jaccard join with several global orders.

A text is the set of its word ``N``-grams.  Two texts are near duplicates if the
Jaccard similarity of their sets is at least ``THRESHOLD``; groups are connected
components, and one document of each is kept.

A pair of similarity t shares a token among the first |x| - ceil(t |x|) + 1 of
each set, under any global order of tokens.  All orders here begin with the tokens
of one text only, which can't be shared; a text with more of them than its prefix
is long has no partner, and all others keep only shared tokens.  Then come, order
A: rarest first; B: by a hash; C: most frequent first.  Postings of A's prefixes
give candidates; those that share no token of B's and of C's prefixes are dropped,
and the rest verified on the whole sets.

Tokens are 64-bit hashes, whatever the number of partitions; how they are shuffled,
ordered and posted is said in ``operators.overlap``.  Order A also bounds a pair: from
its first common token on, neither text has more than its tokens left to share.

Groups of n near copies have n^2 pairs; for groups only those that join two
components matter.  Within a posting, the texts are tried in rounds against its
most typical ones (rank 0, then 1-3, 4-15, ...), skipping pairs that are already
in one component; a posting is done when all of its texts are in one component or
all ranks have been tried, so every candidate pair is either verified or implied.
Ranks are found by a limit in each group before the shuffle, the other figures of a
posting by aggregates, and a join on a long one is split, so it is never one task's.

Cases: null texts, and those without a word, have no set and are in no group; a
text of 1 to N-1 words has one token, all of it; copies have one set, and are all
in one group, also rows that repeat an id; a null doc_id is carried, the smallest
id (null first) is kept, of rows that repeat it with the same text one; an empty
table gives an empty result; other columns are ignored, and kept when filtering.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import overlap
from ..operators.overlap import common
from .common import Workspace, gram_hashes, lower, mix, slices, small_batches, span_hashes, text_bytes, words
from .components import components, relabel

N = 4
THRESHOLD = 0.5
#: Removed ids, and roots of components, are sent to every task up to this number, beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def need(size: np.ndarray | int, threshold: float) -> np.ndarray:
    """The least overlap of a set with a partner of its own or larger size."""
    return np.maximum(1, np.ceil(np.asarray(size) * threshold - 1e-9)).astype(np.int64)


def token_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text, its distinct tokens in ascending order."""
    data, offs = text_bytes(lower(texts))
    a, b, of = words(data, offs)
    g, of = gram_hashes(span_hashes(data, a, b), of, len(texts), n)
    out = []
    for x in np.split(g, np.searchsorted(of, np.arange(1, len(texts)))):
        x = np.sort(x)
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def _sets_of(n: int) -> overlap.Sets:
    def of(batch):
        for part in slices(batch, "text"):
            yield part.column("uid").to_pylist(), lambda places, texts=part.column("text"): token_sets(texts.take(pa.array(places, pa.int64())), n)

    return of


def prepare(ws: Workspace, docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(uid, size, tokens) of each distinct text that can have a partner, with its shared tokens in order A; and postings of A's prefixes.

    ``docs`` has uid and text; both results are written to the workspace.
    """
    prefix = lambda k, size: k - need(size, threshold) + 1
    return overlap.prepare(ws, small_batches(docs), _sets_of(n), lambda k, size: k >= need(size, threshold), prefix, prefix)


def _verify(threshold: float):
    """Intersects the prefix filters of orders B and C, then the sets."""

    def prefixes(tokens, size):
        k = len(tokens) - int(need(size, threshold)) + 1
        return tokens[np.argpartition(mix(tokens), k - 1)[:k]] if k < len(tokens) else tokens, tokens[len(tokens) - k :]

    def run(batches):
        kept: dict[int, tuple] = {}
        for batch in batches:
            rows = batch.to_pydict()
            out: list[list] = [[], [], []]

            def side(c, r):
                u = rows[c][r]
                if u not in kept:
                    if len(kept) > 256:
                        kept.clear()
                    t = np.frombuffer(rows[f"tokens_{c}"][r], np.uint64)
                    kept[u] = (np.sort(t), *(np.sort(p) for p in prefixes(t, rows[f"size_{c}"][r])))
                return kept[u]

            for r in range(batch.num_rows):
                m, n = rows["size_a"][r], rows["size_b"][r]
                x, y = side("a", r), side("b", r)
                if not (common(x[1], y[1]) and common(x[2], y[2])):
                    continue
                both = common(x[0], y[0])
                if both >= threshold * (m + n - both) - 1e-9:
                    for c, v in zip(out, (rows["a"][r], rows["b"][r], both / (m + n - both))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "jaccard"])

    return run


def verify(ws: Workspace, sets: DataFrame, pairs: DataFrame, threshold: float, name: str = "pairs") -> DataFrame:
    """(a, b, jaccard) of the candidate pairs (a, b) that are similar enough."""
    # a row is two sets: few rows to a batch
    return overlap.sets_of_pairs(ws, sets, pairs, name, "a", "b").select("a", "b", *(f"{k}_{c}" for c in "ab" for k in ("size", "tokens"))).mapInArrow(_verify(threshold), "a long, b long, jaccard double")


def _can_match(threshold: float) -> str:
    """Of the texts a and b with a common token: sizes m and n that fit, and enough left from the token on."""
    return f"least(m, n) >= {threshold} * greatest(m, n) - 1e-9 and least(ra, rb) >= {threshold / (1 + threshold)} * (m + n) - 1e-6"


def _sides(p: DataFrame, q: DataFrame, *more: str) -> DataFrame:
    a = p.select("token", F.col("uid").alias("a"), F.col("size").alias("m"), F.col("rest").alias("ra"), *(F.col(c).alias(f"a_{c}") for c in more))
    return a.join(q.select("token", F.col("uid").alias("b"), F.col("size").alias("n"), F.col("rest").alias("rb"), *(F.col(c).alias(f"b_{c}") for c in more)), "token")


def similar_pairs(ws: Workspace, docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of distinct texts (a < b, by uid) with their similarity: the join itself, quadratic within groups."""
    sets, p = prepare(ws, docs, n, threshold)
    return verify(ws, sets, _sides(p, p).where(f"a < b and {_can_match(threshold)}").select("a", "b").distinct(), threshold)


def _open(active: DataFrame, tried: int) -> DataFrame:
    """Postings with texts of several components and ranks that haven't been tried: figures of a posting are aggregates."""
    left = active.groupBy("token").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where(f"c > {tried} + 1 and x <> y").select("token")
    return active.join(left, "token", "left_semi")


def groups(ws: Workspace, docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): the component of each distinct text (uid) that is linked to a smaller one."""
    sets, active = prepare(ws, docs, n, threshold)
    active, found, lo, hi, step = active.drop("probe").withColumn("comp", F.col("uid")), None, 0, 1, 0
    while not active.isEmpty():
        rank = F.row_number().over(Window.partitionBy("token").orderBy("alone", "uid"))
        p = active.withColumn("rank", rank).where(f"rank <= {hi}").where(f"rank > {lo}")
        pairs = _sides(p, active, "comp").where(f"a_comp <> b_comp and {_can_match(threshold)}")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = ws.save(verify(ws, sets, pairs, threshold, f"pairs-{step}").select("a", "b"), f"edges-{step}")
        if found is not None:
            ab = relabel(edges.select(F.col("a").alias("root"), F.col("b").alias("node")), found).select(F.col("root").alias("a"), F.col("node").alias("root"))
            edges = relabel(ab.select("root", F.col("a").alias("node")), found).select(F.col("node").alias("a"), F.col("root").alias("b"))
        new = components(ws, edges, f"cc-{step}")
        found = ws.save(new if found is None else relabel(found, new).unionByName(new), f"found-{step}")
        up = found.select(F.col("node").alias("uid"), F.col("root").alias("up"))
        if up.count() <= BROADCAST_ROWS:
            up = F.broadcast(up)
        active = active.drop("comp").join(up, "uid", "left").withColumn("comp", F.coalesce("up", "uid")).drop("up")
        active = ws.save(_open(active, hi), f"active-{step}")
        for name in (f"pairs-{step}", f"edges-{step}", f"cc-{step}", *([f"found-{step - 1}", f"active-{step - 1}"] if step else ["postings"])):
            ws.drop(name)
        lo, hi, step = hi, 4 * hi, step + 1
    for name in ("sets", "sets-of-slices"):
        ws.drop(name)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "node long, root long")
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, text): a text's identity is a 64-bit hash of its bytes; texts without a word have none."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("uid"), text.alias("text")).where(r"text rlike '[A-Za-z0-9\\x{80}-\\x{10FFFF}]'")


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, kept): every document of a group of two or more; group_id is the one that stays."""
    ws = Workspace(docs.sparkSession)
    keyed = _keyed(docs)
    found = groups(ws, keyed.select("uid", "text"), n, threshold)
    named = ws.save(keyed.select("doc_id", "uid").join(found.withColumnRenamed("node", "uid"), "uid", "left").select("doc_id", F.coalesce("root", "uid").alias("root")), "named")
    whole = named.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("doc_id")).alias("first")).where("n > 1")
    return named.join(whole, "root").select("doc_id", F.col("first.doc_id").alias("group_id"), F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are in no group, and of each group the one with the smallest (doc_id, uid); all columns."""
    ws = Workspace(docs.sparkSession)
    keyed = _keyed(docs)
    found = groups(ws, keyed.select("uid", "text"), n, threshold)
    rows = keyed.groupBy("doc_id", "uid").count().join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    rows = ws.save(rows, "rows")
    whole = rows.groupBy("root").agg(F.count("*").alias("n"), F.max("count").alias("most"), F.min(F.struct("doc_id", "uid")).alias("first")).where("n > 1 or most > 1")
    rows = rows.join(whole, "root").withColumn("stays", F.struct("doc_id", "uid").eqNullSafe(F.col("first")))
    out = ws.save(rows.where("not stays or count > 1").select(F.col("doc_id").alias("_id"), F.col("uid").alias("_uid"), "stays"), "out")
    sizes = out.groupBy("stays").count().collect()
    small = sum(r["count"] for r in sizes) <= BROADCAST_ROWS
    side = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    match = lambda x: docs["doc_id"].cast("long").eqNullSafe(x["_id"]) & (F.xxhash64(docs["text"].cast("string")) == x["_uid"])
    kept = docs.join(side(out), match(out), "left_anti") if sizes else docs
    if any(r["stays"] for r in sizes):  # rows that repeat an id and its text: one of them
        again = out.where("stays")
        twice = docs.join(side(again), match(again), "left_semi")
        number = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in twice.columns))))
        mark = "_number" + "_" * max(map(len, docs.columns))
        kept = kept.unionByName(twice.withColumn(mark, F.row_number().over(number)).where(F.col(mark) == 1).drop(mark))
    return kept
