"""``deduplicator``: fuzzy, n-gram and combined, within a dataset and against external ones.

Fuzzy: over distinct strings, row r of string s goes if some similar t (ratio of at
least the threshold) has r > min(first(s), first(t)); with ``remove_exact`` also if
r > first(s).  Texts meet in pairs of blocks whose lengths can reach the threshold;
in one, many texts are held against one by bit-parallel LCS (``similarity.Matcher``).

N-gram: rows in order; a row that is kept removes later ones whose containment
100 |A n B| / min(|A|, |B|) reaches the threshold.  Copies are collapsed first; pairs
of distinct texts come from a prefix filter over packed sets (``overlap``).  The greedy
choice is a fixpoint over the pairs: a family of n near copies that differ has n^2.

Null texts are never duplicates, and are kept.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.batches import mix, small_batches
from ..functions.tokens import TokenizerSpec
from ..functions.values import column
from ..storage import Workspace
from . import overlap
from .base import ROW_ID, Processor, with_row_id

LOG = logging.getLogger(__name__)
METHODS = ("fuzzy", "ngram", "combined")
#: An external side with up to this many rows is sent to the tasks; beyond it, it is shuffled.
BROADCAST_ROWS = 10_000
#: The same for the distinct grams of an external side.
BROADCAST_GRAMS = 1_000_000
#: The same for the characters of an external side's strings.
BROADCAST_CHARS = 4 << 20
#: Characters of a block of texts that is compared with others in one task.
BLOCK_CHARS = 1 << 19
#: A class of length is so wide, in the logarithm.
LENGTH_CLASS = 0.05


def _blocks(tables: tuple[DataFrame, DataFrame], threshold: float, same: bool) -> tuple[DataFrame, int]:
    """(p, q, right, id, s) of all pairs of blocks of the two tables that lengths don't rule out, and the number of pairs.

    A block is some BLOCK_CHARS characters of texts (id, s) of one class of length, chosen by
    hash.  Per class, its blocks and those that they meet are ranges of numbers: only these
    are known to the driver, some hundred classes at most.
    """
    k = F.when(F.length("s") == 0, -1).otherwise(F.floor(F.log(F.length("s").cast("double")) / LENGTH_CLASS + 1e-9).cast("int"))
    tables = tuple(t.where("s is not null").select("id", "s", k.alias("k")) for t in tables)
    sizes = [{r["k"]: r["chars"] for r in t.groupBy("k").agg(F.sum(F.length("s").cast("long") + 1).alias("chars")).collect()} for t in (tables[:1] if same else tables)]
    sizes += sizes[:1] * same
    splits = [{x: -(-c // BLOCK_CHARS) for x, c in sorted(s.items())} for s in sizes]
    begins = [dict(zip(s, np.cumsum([0, *s.values()])[:-1].tolist())) for s in splits]
    # of a class's least and the next one's: lengths m <= n meet if 200 m / (m + n) reaches the threshold
    least = -np.inf if threshold <= 0 else np.log(threshold / (200 - threshold)) - 1e-6
    meet = lambda x, y: threshold <= 0 or (x == y if min(x, y) < 0 else (min(x, y) + 1 - max(x, y)) * LENGTH_CLASS >= least)
    rows, total = [[], []], 0
    for side in (0, 1):
        mine, other = splits[side], splits[1 - side]
        for x, c in mine.items():
            partners = [y for y in other if meet(x, y)]
            if partners:
                lo, hi = begins[1 - side][partners[0]], begins[1 - side][partners[-1]] + other[partners[-1]] - 1
                rows[side].append((x, c, begins[side][x], lo, hi))
                total += c * (hi - lo + 1) * (side == 0)
    sides = []
    for side, t in enumerate(tables):
        ranges = F.broadcast(t.sparkSession.createDataFrame(rows[side], "k int, c long, at long, lo long, hi long"))
        t = t.join(ranges, "k").withColumn("own", F.col("at") + F.pmod(F.xxhash64("s"), F.col("c")))
        if same:  # p <= q
            t = t.withColumn("hi", F.least("hi", "own")) if side else t.withColumn("lo", F.greatest("lo", "own"))
        t = t.withColumn("other", F.explode(F.sequence("lo", "hi")))
        p, q = ("other", "own") if side else ("own", "other")
        sides.append(t.select(F.col(p).alias("p"), F.col(q).alias("q"), F.lit(bool(side)).alias("right"), "id", "s"))
    return sides[0].union(sides[1]), total // 2 + 1 if same else total


def _compared(left: DataFrame, right: DataFrame, threshold: float, same: bool, result, schema: str) -> DataFrame:
    """``result(pairs)`` of each pair of blocks, where ``pairs`` is ((id, text), (id, text), ratio) of the similar ones."""
    blocks, total = _blocks((left, right), threshold, same)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(table: pa.Table) -> pa.Table:
        is_right = table.column("right")
        a, b = (list(zip(*(t.column(c).to_pylist() for c in ("id", "s")))) for t in (table.filter(pc.invert(is_right)), table.filter(is_right)))
        one = same and table.column("p")[0] == table.column("q")[0]
        if not a or not b:
            return result([])
        matcher, texts = similarity.Matcher([s for _, s in a], threshold), np.array([s for _, s in a], object)
        return result([(a[k], y, score) for y in b for k, score in matcher.matches(y[1], texts < y[1] if one else None)])

    # a pair of blocks is much work on few bytes: the number of partitions is not left to their size
    return blocks.repartition(max(parts, min(total, 16 * parts)), "p", "q").groupBy("p", "q").applyInArrow(compare, schema)


def similar_strings(left: DataFrame, right: DataFrame, threshold: float, same: bool) -> DataFrame:
    """(a, b, score) of the strings ``s`` of two tables with a ratio of at least the threshold; ``same``: a < b within one."""
    if threshold > 100:
        return left.select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit(0.0).alias("score")).where("false")
    if threshold >= 100:  # ratio 100 is equality
        pairs = left.select(F.col("s").alias("a")).join(right.select(F.col("s").alias("b")), F.col("a") == F.col("b"))
        return pairs.where("a < b" if same else "true").withColumn("score", F.lit(100.0))

    def listed(pairs) -> pa.Table:
        rows = [(*(sorted((x[1], y[1])) if same else (x[1], y[1])), score) for x, y, score in pairs]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a", "b", "score"])

    return _compared(*(t.select("s").distinct().select(F.lit(0).cast("long").alias("id"), "s") for t in (left, right)), threshold, same, listed, "a string, b string, score double")


def _least_partners(first: DataFrame, threshold: float) -> DataFrame:
    """(id, other): of each of the distinct texts with a similar one, the least id of these; pairs of blocks give theirs, not all pairs."""

    def least(pairs) -> pa.Table:
        found: dict[int, int] = {}
        for (i, _), (j, _), _ in pairs:
            for x, y in ((i, j), (j, i)):
                found[x] = min(y, found.get(x, y))
        return pa.table([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["id", "other"])

    return _compared(first, first, threshold, True, least, "id long, other long").groupBy("id").agg(F.min("other").alias("other"))


def fuzzy_removed(rows: DataFrame, threshold: float, remove_exact: bool = True, max_matches: int | None = None) -> DataFrame:
    """The ids that go, of rows (ROW_ID, s)."""
    first = rows.where("s is not null").groupBy("s").agg(F.min(ROW_ID).alias("first"))
    if max_matches:
        pairs = similar_strings(first, first, threshold, same=True)
        both = pairs.select("a", "b", "score").union(pairs.select("b", "a", "score")).toDF("s", "t", "score")
        best = Window.partitionBy("s").orderBy(F.desc("score"), "t")
        both = both.withColumn("k", F.row_number().over(best)).where(F.col("k") <= max_matches)
        other = first.select(F.col("s").alias("t"), F.col("first").alias("other"))
        least = both.join(other, "t").groupBy("s").agg(F.min("other").alias("other"))
        limit = first.join(least, "s", "left" if remove_exact else "inner").select("s", F.least("first", "other").alias("limit"))
        return rows.join(limit, "s").where(F.col(ROW_ID) > F.col("limit")).select(ROW_ID)
    first, copies = first_of_copies(rows)
    least = Workspace(rows.sparkSession).save(_least_partners(first.select(F.col(ROW_ID).alias("id"), "s"), threshold), "least") if threshold < 100 else None
    gone = copies.select(ROW_ID) if remove_exact else None
    if least is not None:
        near = least.where("id > other").select(F.col("id").alias(ROW_ID))
        if not remove_exact:  # a copy goes if it comes after a partner of its text, or its text has one and isn't new
            near = near.union(copies.join(least.select(F.col("id").alias("first")), "first").select(ROW_ID))
        gone = near if gone is None else gone.union(near)
    return rows.select(ROW_ID).where("false") if gone is None else gone


def grams_of(texts: DataFrame, tokenizer: TokenizerSpec, n: int) -> DataFrame:
    """``texts`` (.., s) with ``grams``: each text's distinct n-grams, hashed."""
    return small_batches(texts).where("s is not null").withColumn("grams", tokenizer.gram_hashes(F.col("s"), n))


def gram_sets(rows: DataFrame, tokenizer: TokenizerSpec, n: int) -> DataFrame:
    """(ROW_ID, grams, size); rows without any gram have no partner."""
    return grams_of(rows, tokenizer, n).select(ROW_ID, "grams", F.size("grams").alias("size")).where("size > 0")


def _listed_sets(batch: pa.RecordBatch):
    """Of (ROW_ID, grams): the ids, and the sets of spread-out tokens."""
    grams = batch.column("grams")

    def made(places: list[int]) -> list[np.ndarray]:
        return [np.sort(mix(grams[k].values.to_numpy().view(np.uint64))) for k in places]

    yield batch.column(ROW_ID).to_pylist(), made


def containment_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(i, j, shared, size_i, size_j), i < j, of sets whose containment reaches the threshold.

    Of the smaller of two sets, one of the first |A| - need + 1 tokens must be shared,
    need = ceil(t |A|), and from their first common token on both must have need left.
    Only pairs that pass are verified, on the sets themselves, a pair of blocks at a time.
    """
    ws = Workspace(sets.sparkSession)
    share = threshold / 100.0
    need = lambda size: np.maximum(1, np.ceil(size * share - 1e-9)).astype(np.int64)
    found, postings = overlap.prepare(ws, sets.select(ROW_ID, "grams"), _listed_sets, lambda k, size: k > 0, lambda k, size: k, lambda k, size: np.maximum(0, k - need(size) + 1))
    p = postings.where("probe").select("token", F.col("uid").alias("p"), F.col("size").alias("m"), F.col("rest").alias("rp"))
    q = postings.select("token", F.col("uid").alias("q"), F.col("size").alias("n"), F.col("rest").alias("rq"))
    # sets of one size meet from both sides, at the same token
    pairs = p.join(q, "token").where(f"(m < n or m = n and p < q) and least(rp, rq) >= greatest(1, ceil(m * {share} - 1e-9))").select("p", "q").distinct()
    pairs = ws.save(pairs, "candidates")

    def verify(links: pa.Table, sent: pa.Table) -> pa.Table:
        uids, size = sent.column("uid").to_numpy(), sent.column("size").to_numpy()
        at = np.argsort(uids)
        p, q = (at[np.searchsorted(uids, links.column(c).to_numpy(), sorter=at)] for c in "pq")
        both = overlap.common_of([np.frombuffer(x, np.uint64) for x in sent.column("tokens").to_pylist()], p, q)
        keep = 100.0 * both / size[p] >= threshold
        p, q, both = p[keep], q[keep], both[keep]
        return pa.table([pa.array(x, t) for x, t in ((uids[p], pa.int64()), (uids[q], pa.int64()), (both, pa.int64()), (size[p], pa.int32()), (size[q], pa.int32()))], names=["p", "q", "shared", "size_p", "size_q"])

    links, sent = overlap.blocks_of_pairs(ws, found, pairs)
    counted = links.groupBy("bp", "bq").cogroup(sent.groupBy("to_p", "to_q")).applyInArrow(verify, "p long, q long, shared long, size_p int, size_q int")
    ordered = lambda a, b: F.when(F.col("p") < F.col("q"), F.col(a)).otherwise(F.col(b))
    return counted.select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "shared", ordered("size_p", "size_q").alias("size_i"), ordered("size_q", "size_p").alias("size_j"))


def first_of_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((ROW_ID, s) of the first row of each text, (ROW_ID, first) of the others): copies are told by 128 bits of hashes."""
    keyed = rows.where("s is not null").select(ROW_ID, "s", F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("k"))
    first = keyed.groupBy("h", "k").agg(F.min(ROW_ID).alias("first"), F.count("*").alias("c"))
    copies = keyed.drop("s").join(first.where("c > 1"), ["h", "k"]).where(F.col(ROW_ID) > F.col("first")).select(ROW_ID, "first")
    return rows.where("s is not null").join(copies.select(ROW_ID), ROW_ID, "left_anti"), copies


def copies_and_sets(ws: Workspace, rows: DataFrame, tokenizer: TokenizerSpec, n: int) -> tuple[DataFrame, DataFrame]:
    """``first_of_copies``' (ROW_ID, first), and the gram sets of first texts; both are read several times, so they are written."""
    copies = ws.save(first_of_copies(rows)[1], "copies")
    return copies, ws.save(gram_sets(rows.join(copies.select(ROW_ID), ROW_ID, "left_anti"), tokenizer, n), "sets")


def greedy_removed(ws: Workspace, pairs: DataFrame) -> DataFrame:
    """Ids that the ordered scan removes, of pairs (i < j): in each step, undecided ids without an undecided smaller partner stay, and their partners go."""
    open_pairs, gone, step = ws.save(pairs.select("i", "j"), "pairs-0"), None, 0
    while not open_pairs.isEmpty():
        blocked = open_pairs.select(F.col("j").alias("i")).distinct()
        stay = open_pairs.select("i").distinct().join(blocked, "i", "left_anti")
        out = ws.save(open_pairs.join(stay, "i").select(F.col("j").alias("x")).distinct(), f"gone-{step}")
        gone = out if gone is None else gone.union(out)
        step += 1
        left = open_pairs.join(stay, "i", "left_anti").join(out.withColumnRenamed("x", "i"), "i", "left_anti").join(out.withColumnRenamed("x", "j"), "j", "left_anti")
        open_pairs = ws.save(left.select("i", "j"), f"pairs-{step}")
    if gone is None:
        gone = open_pairs.select(F.col("i").alias("x"))
    return gone.select(F.col("x").alias(ROW_ID))


def ngram_removed(rows: DataFrame, tokenizer: TokenizerSpec, n: int, threshold: float) -> DataFrame:
    """Ids that go.  Copies of a text with a gram always do, and remove nothing that the first doesn't, so only first ones are compared."""
    ws = Workspace(rows.sparkSession)
    copies, sets = copies_and_sets(ws, rows, tokenizer, n)
    pairs = greedy_removed(ws, containment_pairs(sets, threshold))
    if threshold > 100:
        return pairs
    return pairs.union(copies.join(sets.select(F.col(ROW_ID).alias("first")), "first", "left_semi").select(ROW_ID))


def external_fuzzy_removed(rows: DataFrame, external: DataFrame, threshold: float) -> DataFrame:
    """Rows with a ratio of at least the threshold to an external string."""
    theirs = external.where("s is not null").select("s").distinct()
    size = theirs.agg(F.count("*").alias("n"), F.sum(F.length("s").cast("long")).alias("chars"), F.min(F.length("s")).alias("least"), F.max(F.length("s")).alias("most")).first()
    if size["n"] and size["n"] <= BROADCAST_ROWS and size["chars"] <= BROADCAST_CHARS:
        return _near_a_few(rows, [r["s"] for r in theirs.collect()], threshold, size["least"], size["most"])
    strings = rows.where("s is not null").select("s").distinct()
    if threshold >= 100:
        hit = similar_strings(strings, theirs, threshold, same=False).select(F.col("a").alias("s"))
    else:
        each = lambda pairs: pa.table({"s": pa.array(sorted({a for (_, a), _, _ in pairs}), pa.string())})
        hit = _compared(*(t.select(F.lit(0).cast("long").alias("id"), "s") for t in (strings, theirs)), threshold, False, each, "s string").distinct()
    return rows.join(hit, "s", "left_semi").select(ROW_ID)


def _near_a_few(rows: DataFrame, strings: list[str], threshold: float, least: int, most: int) -> DataFrame:
    """The same by a scan without a shuffle: the strings are sent, and texts too short or too long for any don't leave the JVM."""
    sent = rows.sparkSession.sparkContext.broadcast(strings)
    made: list[similarity.Matcher] = []

    @F.arrow_udf("boolean")
    def near(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(similarity.Matcher(sent.value, threshold))
        return pa.array([made[0].hit(t.as_py()) for t in texts], pa.bool_())

    n = F.length("s")
    rows = rows.where("s is not null")
    if threshold > 0:
        f = (200 - threshold) / threshold
        rows = rows.where((n >= least / f - 1e-6) & (n <= most * f + 1e-6)) if f > 0 else rows.where((n >= least) & (n <= most) & F.lit(threshold <= 100))
    return rows.where(near("s")).select(ROW_ID)


def external_ngram_removed(rows: DataFrame, external: DataFrame, tokenizer: TokenizerSpec, n: int) -> DataFrame:
    """Rows that share a gram with an external text, whatever the threshold.

    Few grams are sent to the rows, in a scan without a shuffle; beyond BROADCAST_GRAMS
    both sides are shuffled.
    """
    theirs = grams_of(external, tokenizer, n).select(F.explode("grams").alias("g")).distinct()
    ours = grams_of(rows, tokenizer, n)
    some = theirs.limit(BROADCAST_GRAMS + 1).toArrow().column("g").to_numpy()
    if len(some) > BROADCAST_GRAMS:
        return ours.select(ROW_ID, F.explode("grams").alias("g")).join(theirs, "g", "left_semi").select(ROW_ID).distinct()
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(some))

    @F.arrow_udf("boolean")
    def hit(grams: pa.Array) -> pa.Array:
        found = np.concatenate([[0], np.cumsum(overlap.find(sent.value, grams.flatten().to_numpy())[1])])
        ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(grams), 0).to_numpy()]))
        return pa.array(found[ends[1:]] > found[ends[:-1]])

    return ours.where(hit("grams")).select(ROW_ID)


class Deduplicator(Processor):
    type = "deduplicator"

    def __init__(self, config=None, context=None):
        super().__init__(config, context)
        c = self.config
        self.method = c.get("method", "fuzzy")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        self.column = c.get("column", "text")
        self.threshold = float(c.get("similarity_threshold", 90.0))
        self.n = int(c.get("ngram_size", 8))

    def _without(self, df: DataFrame, removed: DataFrame, part: str) -> DataFrame:
        removed = removed.distinct()
        if self.config.get("report"):
            removed = self.ws.save(removed, f"{part}-{len(self.removed)}")
            self.removed.append((part, removed.count()))
        return df.join(removed, ROW_ID, "left_anti")

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(ROW_ID, column(self.column).cast("string").alias("s"))

    def transform(self, df: DataFrame) -> DataFrame:
        """With ``report``, what each part removed is counted from written tables, and kept in ``context.reports``."""
        if self.column not in df.columns:
            raise KeyError(self.column)
        had = ROW_ID in df.columns
        df = with_row_id(df, self.config.get("order_by") or self.context.order_by)
        self.removed: list[tuple[str, int]] = []
        if self.config.get("report"):
            self.ws, total = Workspace(df.sparkSession), df.count()
        tokenizer, exact = self.context.tokenizer, self.config.get("remove_exact", True)
        methods = {"combined": ("fuzzy", "ngram")}.get(self.method, (self.method,))
        for m in methods if self.config.get("internal", True) else ():
            if m == "ngram" and tokenizer is None:
                if self.method == "combined":
                    continue  # fuzzy has run already
                m = "fuzzy"
            removed = fuzzy_removed(self._rows(df), self.threshold, exact, self.config.get("max_matches")) if m == "fuzzy" else ngram_removed(self._rows(df), tokenizer, self.n, self.threshold)
            df = self._without(df, removed, "internal")
        found = [x for e in self.config.get("external_datasets") or [] for x in self._external(df, e, methods)]
        if found:
            df = self._without(df, reduce(DataFrame.union, found), "external")
        if self.config.get("report"):
            sums = {p: sum(n for q, n in self.removed if p == q) for p in ("internal", "external")}
            self.context.reports[self.name] = {"rows": total, **sums, "kept": total - sum(sums.values())}
        return df if had else df.drop(ROW_ID)

    def _external(self, df: DataFrame, spec: dict | DataFrame, methods: tuple[str, ...]) -> list[DataFrame]:
        from ..sources.load import load_dataset

        try:
            if isinstance(spec, DataFrame):
                theirs, name = spec, self.column
            else:
                theirs = load_dataset(df.sparkSession, spec)
                name = spec.get("column", "text")
            theirs = theirs.select(column(name).cast("string").alias("s"))
        except Exception as e:  # as documented: an external set that can't be read is left out
            LOG.warning("external dataset %s is left out: %s", spec, e)
            return []
        out = []
        if "fuzzy" in methods:
            out.append(external_fuzzy_removed(self._rows(df), theirs, self.threshold))
        if "ngram" in methods and self.context.tokenizer is not None:
            out.append(external_ngram_removed(self._rows(df), theirs, self.context.tokenizer, self.n))
        return out
