"""Which sets share elements: sets of 64-bit tokens, put into one order, and posted under their tokens.

Tokens are shuffled in packed blocks, one for each range of tokens and input slice:
without the bytes that the range's number says, and with a set's place in its slice,
which is two bytes, so a token costs about ten bytes whatever the number of ranges.  A
range finds the tokens of several sets and how many have them, and sends them back to
the slices; each set is then in the order of its tokens' frequencies, rarest first,
without those that it has alone.  A slice is named by what it holds.  A uid is one set:
of the slices that hold it one is used, and counts of copies only affect the order.

Tokens that are frequent in some slice are found by a pass before: they are told to all
tasks, with a count that stands for their order, and are spread by slice or set, so that
no task gets all sets that have one of them.

Postings name the sets of a token, with what each has left from that token on: two
sets share no more than the smaller of these from their first common token on.  Of
tokens with the same sets the first in order is enough, so the others are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import mix, slices
from ..storage import Workspace

#: Tokens of a slice, and its sets at most.
SLICE = 1 << 20
PLACES = 1 << 16
CHUNK = 1 << 18
#: Tokens of a range at most, as a mean: there are as many ranges as the input needs, however few partitions are set.
RANGE = 1 << 21
#: Tokens and sets of a block of like sets; pairs are verified a pair of blocks at a time.
BLOCK_TOKENS = 1 << 18
BLOCK_SETS = 512
#: Bytes of sets that are posted at a time.
POSTED = 1 << 23
#: A token of so many sets of a slice, and of one in FREQUENT_SHARE of them, is spread by set.
FREQUENT_LEAST = 32
FREQUENT_SHARE = 64
#: So many of these tokens are sent to every task; others take the usual way, with the same result.
FREQUENT_MOST = 50_000
FREQUENT_ORDER = 1 << 30
#: Ids that are sent to every task, to choose rows by; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
PACKED = "part int, slice long, place binary, gram binary"
SHARED = "slice long, place binary, gram binary, df binary"
POSTING = (("token", np.uint64), ("uid", np.int64), ("size", np.int32), ("rest", np.int32), ("alone", np.float32), ("probe", np.int8))
Sets = Callable[[pa.RecordBatch], Iterator[tuple[list[int], Callable[[list[int]], list[np.ndarray]]]]]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    s = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return s, np.diff(np.append(s, len(x)))


def find(among: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of values in an ascending array."""
    if not len(among):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return at, among[at] == x


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two ascending arrays share."""
    if len(x) > len(y):
        x, y = y, x
    return int(find(y, x)[1].sum())


def common_of(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many values two different sets share, for each that p and q name: of many pairs by products of matrices, else one by one."""
    rows, cols = np.unique(p), np.unique(q)
    used = np.unique(np.concatenate([rows, cols]))
    value, of = np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in used)]), np.repeat(used, [len(sets[k]) for k in used])
    _, value, n = np.unique(value, return_inverse=True, return_counts=True)
    value, of, wide = (np.cumsum(n > 1) - 1)[value][n[value] > 1], of[n[value] > 1], int((n > 1).sum())
    if len(rows) * len(cols) * wide > 100_000 * len(p):
        kept = {k: np.sort(sets[k]) for k in used.tolist()}
        return np.array([common(kept[x], kept[y]) for x, y in zip(p.tolist(), q.tolist())], np.int64)
    total, order = np.zeros((len(rows), len(cols)), np.float32), np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    for k in range(0, wide, 4096):
        a, b = np.searchsorted(value, (k, k + 4096))
        sides = []
        for among in (rows, cols):
            at, there = find(among, of[a:b])
            m = np.zeros((len(among), 4096), np.float32)
            m[at[there], value[a:b][there] - k] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total[np.searchsorted(rows, p), np.searchsorted(cols, q)].astype(np.int64)


def range_bits(parts: int) -> int:
    """Ranges of tokens are told by so many upper bits: one or two ranges a part."""
    return parts.bit_length()


def cut(g: np.ndarray, bits: int) -> bytes:
    """Tokens of one range without whole bytes of the upper bits."""
    return g.view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8].tobytes()


def whole(data: np.ndarray, number: int, bits: int) -> np.ndarray:
    """The tokens of ``cut``'s bytes."""
    if bits < 8:
        return data.view(np.uint64)
    x = data.reshape(-1, 8 - bits // 8)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view(np.uint64).ravel() | np.uint64((number << (64 - bits)) & (0xFFFFFFFFFFFFFFFF << (8 * x.shape[1])) & 0xFFFFFFFFFFFFFFFF)


def values(table: pa.Table, name: str, dtype) -> np.ndarray:
    """A binary column's values as one array, read where they lie."""
    parts = [np.zeros(0, dtype)]
    for chunk in table.column(name).chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype))
    return np.concatenate(parts) if len(parts) > 2 else parts[-1]


def flushed(sets_of: Sets, flush: Callable) -> Callable:
    """A function of batches that calls ``flush(uids, sets)`` on some SLICE tokens at a time, each uid once a task."""

    def run(batches):
        uids, sets, held, seen = [], [], 0, set()
        for batch in batches:
            for ids, made in sets_of(batch):
                new = [k for k, u in enumerate(ids) if u not in seen and not seen.add(u)]
                for k, s in zip(new, made(new)):
                    if len(s):
                        uids.append(ids[k])
                        sets.append(s)
                        held += len(s)
                    if held >= SLICE or len(uids) == PLACES:
                        yield flush(np.array(uids, np.int64), sets)
                        uids, sets, held = [], [], 0
        if sets:
            yield flush(np.array(uids, np.int64), sets)

    return run


def frequent_tokens(rows: DataFrame, sets_of: Sets) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, order) of those that are frequent in a slice: ascending tokens, and their sets in such slices; and the number of all."""
    least, share = FREQUENT_LEAST, FREQUENT_SHARE

    def flush(uids, sets):
        g = np.sort(np.concatenate(sets))
        s, k = runs(g)
        many = k >= max(least, len(sets) / share)
        # no token stands for all
        return pa.RecordBatch.from_arrays([pa.array([None, *g[s[many]].view(np.int64).tolist()], pa.int64()), pa.array([len(g), *k[many].tolist()], pa.int64())], names=["token", "sets"])

    counted = rows.mapInArrow(flushed(sets_of, flush), "token long, sets long").groupBy("token").agg(F.sum("sets").alias("sets"))
    got = counted.orderBy(F.col("token").isNotNull(), F.desc("sets"), "token").limit(FREQUENT_MOST + 1).toArrow()
    total, got = sum(got.column("sets").to_pylist()[:1]), got.slice(1)
    token, n = got.column("token").to_numpy().astype(np.int64).view(np.uint64), got.column("sets").to_numpy()
    at = np.argsort(token)
    return token[at], (FREQUENT_ORDER + np.minimum(n[at], FREQUENT_ORDER - 1)).astype(np.int32), total


def _parts(token: np.ndarray, spread: np.ndarray, parts: int, frequent) -> np.ndarray:
    """The range of each token; of a frequent one, after the ranges, a share by the hash ``spread``."""
    bits = range_bits(parts)
    part = (token >> np.uint64(64 - bits)).astype(np.int32)
    _, often = find(frequent.value[0], token)
    part[often] = (1 << bits) + (spread[often] % np.uint64(parts)).astype(np.int32)
    return part


def _emit(parts: int, sets_of: Sets, frequent):
    bits = range_bits(parts)

    def flush(uids, sets):
        sizes = np.array([len(s) for s in sets], np.int32)
        g, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        with np.errstate(over="ignore"):
            name = mix((mix(uids.view(np.uint64)) * np.arange(1, len(uids) + 1, dtype=np.uint64)).sum(keepdims=True))
        part = _parts(g, np.broadcast_to(name, len(g)), parts, frequent)
        at = np.argsort(part, kind="stable")
        g, of, part = g[at], of[at], part[at]
        # the slice itself: its uids, and the sizes of their sets
        cols = [[-1 - int(name[0] % np.uint64(parts))], [sizes.tobytes()], [uids.tobytes()]]
        for a, k in zip(*runs(part)):
            number = int(part[a])
            for c, v in zip(cols, (number, of[a : a + k].tobytes(), cut(g[a : a + k], bits if number < 1 << bits else 0))):
                c.append(v)
        names = pa.array(np.full(len(cols[0]), name.view(np.int64)[0]))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), names, *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "slice", "place", "gram"])

    return flushed(sets_of, flush)


def _shared(parts: int, frequent):
    """Of one range of tokens: those of several sets, with the number of sets, packed by slice; slices themselves pass."""
    bits = range_bits(parts)

    def run(table: pa.Table) -> pa.Table:
        number = table.column("part")[0].as_py()
        if number < 0:
            return table.select(["slice", "place", "gram"]).append_column("df", pa.nulls(len(table), pa.binary()))
        often = number >= 1 << bits
        names, code = np.unique(table.column("slice").to_numpy(), return_inverse=True)
        ends = np.cumsum(pc.binary_length(table.column("place")).to_numpy() // 2)
        place, g = values(table, "place", np.uint16), whole(values(table, "gram", np.uint8), number, 0 if often else bits)
        del table
        if often:
            at = np.arange(len(g))
        else:
            x = np.sort(g)
            many = np.unique(x[1:][x[1:] == x[:-1]])
            del x
            # most tokens have one set: only the others are told whose they are
            at = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(find(many, g[k : k + CHUNK])[1]) + k for k in range(0, len(g) if len(many) else 0, CHUNK))])
        g, own = g[at], (code[np.searchsorted(ends, at, side="right")].astype(np.int64) << 16) | place[at]
        df = np.zeros(0, np.int32)
        if len(g):
            at = np.lexsort((own, g))
            g, own = g[at], own[at]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])])  # equal slices are one
            g, own = g[new], own[new]
            if often:
                df = frequent.value[1][find(frequent.value[0], g)[0]]
            else:
                _, k = runs(g)
                df = np.repeat(k, k)
                g, own, df = g[df > 1], own[df > 1], df[df > 1]
        at = np.argsort(own, kind="stable")
        g, own, df = g[at], own[at], df[at].astype(np.int32)
        cols: list[list] = [[] for _ in range(4)]
        for a, k in zip(*runs(own >> 16)):
            for c, v in zip(cols, (int(names[own[a] >> 16]), (own[a : a + k] & 0xFFFF).astype(np.uint16).tobytes(), g[a : a + k].tobytes(), df[a : a + k].tobytes())):
                c.append(v)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["slice", "place", "gram", "df"])

    return run


def _assemble(enough: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Of one slice: its sets with enough shared tokens, which are in order."""

    def run(table: pa.Table) -> pa.Table:
        own = pc.is_null(table.column("df"))
        whole_slice, table = table.filter(own), table.filter(pc.invert(own))
        if not len(whole_slice):
            raise RuntimeError("a slice changed when it was read again: the rows of a task have to keep their order")
        uids, sizes = (np.frombuffer(whole_slice.column(c)[0].as_py(), t) for c, t in (("gram", np.int64), ("place", np.int32)))
        place, g, df = (values(table, c, t) for c, t in (("place", np.uint16), ("gram", np.uint64), ("df", np.int32)))
        del table
        s, k = runs(place[(at := np.argsort(place, kind="stable"))])
        at = at[np.repeat(enough(k, sizes[place[at][s]]), k)]
        g, df, place = g[at], df[at], place[at]
        at = np.lexsort((g, df, place))
        g, place = g[at], place[at]
        s, k = runs(place)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([pa.array(uids[place[s]]), pa.array(sizes[place[s]]), pa.array([g[a : a + c].tobytes() for a, c in zip(s, k)], pa.binary())], names=["uid", "size", "tokens"])

    return run


def _posted(parts: int, posted: Callable, probing: Callable, frequent):
    """Of some sets: their first tokens, packed by range, with what is left from each on; frequent ones by set."""

    def run(batches):
        for batch in (x for b in batches for x in slices(b, "tokens", POSTED)):
            uid, size = batch.column("uid").to_numpy(), batch.column("size").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
            k = np.array([len(x) for x in sets])
            most, probes = posted(k, size), probing(k, size)
            token = np.concatenate([x[:m] for x, m in zip(sets, most)])
            of = np.repeat(np.arange(len(sets)), most)
            place = np.concatenate([np.arange(m) for m in most])
            part = _parts(token, mix(uid[of].view(np.uint64)), parts, frequent)
            at = np.argsort(part, kind="stable")
            part, of, place = part[at], of[at], place[at]
            cols = (token[at], uid[of], size[of], k[of] - place, (1 - k / size)[of], place < probes[of])
            rows = [(int(part[a]), *(v[a : a + c].astype(t).tobytes() for v, (_, t) in zip(cols, POSTING))) for a, c in zip(*runs(part))]
            packed = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int32()), *(pa.array(c, pa.binary()) for c in packed[1:])], names=["part", *(c for c, _ in POSTING)])

    return run


def _lists(parts: int):
    """Of one range of tokens: those with several sets, and of those with the same sets the first in order."""
    bits = range_bits(parts)

    def run(table: pa.Table) -> pa.Table:
        cols = [values(table, c, t) for c, t in POSTING]
        if table.column("part")[0].as_py() < 1 << bits and len(cols[0]):
            at = np.lexsort((cols[1], cols[0]))
            cols = [c[at] for c in cols]
            token, uid, rest = cols[0], cols[1], cols[3]
            s, k = runs(token)
            with np.errstate(over="ignore"):
                x, y = (np.add.reduceat(mix(uid.view(np.uint64) ^ np.uint64(m)), s) for m in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            order = np.lexsort((-rest[s], y, x, k))
            first = np.ones(len(s), bool)
            first[1:] = (k[order][1:] != k[order][:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
            keep = np.zeros(len(s), bool)
            keep[order] = first
            cols = [c[np.repeat(keep & (k > 1), k)] for c in cols]
        cols[0], cols[5] = cols[0].view(np.int64), cols[5].astype(bool)
        return pa.Table.from_arrays([pa.array(c) for c in cols], names=[c for c, _ in POSTING])

    return run


def prepare(ws: Workspace, rows: DataFrame, sets_of: Sets, enough: Callable, posted: Callable, probing: Callable) -> tuple[DataFrame, DataFrame]:
    """(uid, size, tokens) of the sets of ``rows`` with enough shared tokens, and (token, uid, size, rest, alone, probe) of their postings.

    ``sets_of(batch)`` gives, for parts of a batch, the uids and a function from places
    to sets, of distinct tokens in ascending order.  Of a set with k shared tokens of
    ``size``: ``enough(k, size)`` whether it counts, ``posted`` how many of its first
    tokens are posted, ``probing`` how many of them look for others.  Both results are
    written to the workspace.
    """
    spark = rows.sparkSession
    *often, total = frequent_tokens(rows, sets_of)
    frequent = spark.sparkContext.broadcast(tuple(often))  # FREQUENT_MOST at most
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-total // RANGE))
    ranged = lambda df: df.repartition(parts, "part") if parts > least else df
    packed = ranged(rows.mapInArrow(_emit(parts, sets_of, frequent), PACKED))
    shared = packed.groupBy("part").applyInArrow(_shared(parts, frequent), SHARED)
    sets = ws.save(shared.groupBy("slice").applyInArrow(_assemble(enough), "uid long, size int, tokens binary"), "sets-of-slices")
    again = sets.groupBy("uid").count().where("count > 1").select("uid")
    if again.isEmpty():
        one = sets
    else:
        one = ws.save(chosen(sets, again, "uid").dropDuplicates(["uid"]).union(chosen(sets, again, "uid", "left_anti")), "sets")
        ws.drop("sets-of-slices")
    first = one.mapInArrow(_posted(parts, posted, probing, frequent), "part int, " + ", ".join(f"{c} binary" for c, _ in POSTING))
    lists = ranged(first).groupBy("part").applyInArrow(_lists(parts), "token long, uid long, size int, rest int, alone float, probe boolean")
    return one, ws.save(lists, "postings")


def chosen(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The rows with one of the ids, or without: few ids are sent to the rows, which stay where they are."""
    few = len(ids.limit(BROADCAST_ROWS + 1).groupBy().count().where(f"count <= {BROADCAST_ROWS}").take(1)) > 0
    return rows.join(F.broadcast(ids) if few else ids, column, how)


def sets_of_pairs(ws: Workspace, sets: DataFrame, pairs: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """``pairs`` with the size and tokens of both; what is shuffled are the sets that some pair has."""
    pairs = ws.save(pairs, name)
    wanted = chosen(sets, pairs.select(F.col(a).alias("uid")).union(pairs.select(b)).distinct(), "uid")
    for c in (a, b):
        pairs = pairs.join(wanted.select(F.col("uid").alias(c), F.col("size").alias(f"size_{c}"), F.col("tokens").alias(f"tokens_{c}")), c)
    return pairs


def blocks_of_pairs(ws: Workspace, sets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bp, bq, p, q) and (to_p, to_q, uid, size, tokens): pairs (p, q) by the blocks of their sets, and the sets that these have.

    Sets with the same least partner are alike and lie together, so in a large family a
    set is sent once for each block that it meets, not for each pair.
    """
    both = pairs.select(F.col("p").alias("uid"), F.col("q").alias("other")).union(pairs.select("q", "p"))
    label = ws.save(both.groupBy("uid").agg(F.min("other").alias("other")).select("uid", F.least("uid", "other").alias("label")).join(sets.select("uid", "size"), "uid"), "labels")
    split = label.groupBy("label").agg(F.ceil(F.greatest(F.sum("size") / BLOCK_TOKENS, F.count("*") / BLOCK_SETS)).alias("k"))
    block = ws.save(label.join(split, "label").select("uid", F.xxhash64("label", F.pmod(F.xxhash64("uid"), "k")).alias("block")), "blocks")
    named = lambda u, b: block.select(F.col("uid").alias(u), F.col("block").alias(b))
    links = ws.save(pairs.join(named("p", "bp"), "p").join(named("q", "bq"), "q").select("bp", "bq", "p", "q"), "links")
    used = links.select(F.col("bp").alias("to_p"), F.col("bq").alias("to_q"), F.col("p").alias("uid")).distinct().union(links.select("bp", "bq", "q").distinct()).distinct()
    return links, used.join(sets, "uid")
