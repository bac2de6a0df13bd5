"""``random_sampler``, limits and splits: deterministic by md5(seed|id), whatever the partitions."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import free_name
from .base import ROW_ID, Processor, with_row_id

LOG = logging.getLogger(__name__)


def draw(seed: int, id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id.cast("string")))


#: Hex digits of a draw by which rows are counted, to find the border of the ``size`` smallest.
PREFIX = 4


def border(df: DataFrame, size: int, seed: int, id: str) -> tuple[Column, Column | None, int]:
    """(each row's (draw, id), the ``size``-th smallest of them or None if there are fewer, how many rows equal to it are needed).

    Counts by the draw's first digits tell in which of 16^PREFIX buckets it is; only
    that bucket is ordered.  So no task gets a share of the table.
    """
    row = F.struct(draw(seed, F.col(f"`{id}`")).alias("d"), F.col(f"`{id}`").alias("i"))
    rows = df.select(row.alias("r"))
    head = F.substring("r.d", 1, PREFIX)
    before, bucket = 0, None
    for r in sorted(rows.groupBy(head.alias("h")).count().collect(), key=lambda r: r["h"] or ""):
        if before + r["count"] >= size:
            bucket = r["h"]
            break
        before += r["count"]
    else:
        return row, None, 0
    first = rows.where(head.eqNullSafe(bucket)).orderBy("r").limit(size - before)
    last, n = first.groupBy("r").agg(F.count("*").alias("n")).orderBy(F.desc("r")).first()
    return row, F.struct(F.lit(last["d"]).alias("d"), F.lit(last["i"]).cast(df.schema[id].dataType).alias("i")), n


def sample_down(df: DataFrame, size: int, seed: int, id: str = ROW_ID) -> DataFrame:
    """Exactly ``size`` rows, those with the smallest (draw, id); of rows with the last one's id, as many as fit."""
    row, last, n = border(df, size, seed, id)
    if last is None:
        return df
    return df.where(row < last).union(df.where(F.col(f"`{id}`").eqNullSafe(last["i"])).limit(n))


def dense_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds 0, 1, ... in the given order: a range sort and offsets of partitions, not a single-task window."""
    from ..storage import Workspace

    ws = Workspace(df.sparkSession)
    part, at, start = (free_name(df, x) for x in ("part", "at", "start"))
    ordered = ws.save(df.sort(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "ranked")
    sizes = ordered.groupBy(part).count().orderBy(part).collect()  # a row for each partition
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r[0], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, f"`{part}` int, `{start}` long")
    # ids of a partition count up from the partition's number in the upper bits
    within = F.col(at) - F.shiftleft(F.col(part).cast("long"), 33)
    return ordered.join(F.broadcast(starts), part).withColumn(name, F.col(start) + within).drop(part, at, start)


def sample_up(df: DataFrame, size: int, seed: int, id: str = ROW_ID) -> DataFrame:
    """``size`` draws with replacement: draw k takes the row whose rank by id is the first 15 hex digits of md5(seed|k), modulo the count.

    Where no id repeats, ids alone are ranked and drawn, and rows joined to how often
    theirs was; else whole rows are ranked.
    """
    n = df.count()
    if not n:
        return df
    rank, times = free_name(df, "rank"), free_name(df, "times")
    ids = df.select(F.col(f"`{id}`").alias("i"))
    one_each = ids.groupBy("i").count().where("count > 1").isEmpty()
    ranked = dense_rank(ids, "rank", F.col("i")) if one_each else dense_rank(df, rank, F.col(f"`{id}`"))
    drawn = F.conv(F.substring(draw(seed, F.col("id")), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(size).select((drawn % n).alias("rank")).groupBy("rank").agg(F.count("*").alias(times))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))
    if not one_each:
        return ranked.join(draws.withColumnRenamed("rank", rank), rank).withColumn(times, again).drop(rank, times).select(*df.columns)
    drawn_ids = draws.join(ranked, "rank").select(F.col("i").alias(rank), times)
    out = df.join(drawn_ids, F.col(f"`{id}`").eqNullSafe(F.col(rank))).withColumn(rank, again)
    return out.drop(rank, times)


class RandomSampler(Processor):
    """``sample_size`` rows without replacement; more than there are only with ``allow_upsampling``, with replacement."""

    type = "random_sampler"

    def __init__(self, config=None, context=None):
        super().__init__(config, context)
        self.size, self.seed = self.config.get("sample_size"), int(self.config.get("seed", 42))
        if not isinstance(self.size, int) or isinstance(self.size, bool) or self.size <= 0:
            raise ValueError("sample_size has to be an integer above 0")

    def transform(self, df: DataFrame) -> DataFrame:
        n = df.count()
        if n == self.size:
            return df
        if n < self.size and not self.config.get("allow_upsampling", False):
            LOG.warning("sample_size %d exceeds the %d rows: unchanged", self.size, n)
            return df
        had = ROW_ID in df.columns
        df = with_row_id(df, self.config.get("order_by") or self.context.order_by)
        out = sample_down(df, self.size, self.seed) if n > self.size else sample_up(df, self.size, self.seed)
        return out if had else out.drop(ROW_ID)


def sample_dataset(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """min(n, rows) draws with replacement; an empty table is refused."""
    rows = df.count()
    if not rows:
        raise ValueError("the dataset is empty")
    had = ROW_ID in df.columns
    out = sample_up(with_row_id(df), min(n, rows), seed)
    return out if had else out.drop(ROW_ID)


def take_first(df: DataFrame, limit: int, order_by: str | None = None) -> DataFrame:
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        raise ValueError("limit must be a positive integer")
    return df.orderBy(order_by).limit(limit) if order_by else df.limit(limit)


def train_test_split(df: DataFrame, size: float, seed: int = 42, id: str = ROW_ID) -> tuple[DataFrame, DataFrame]:
    """(train, test): below 1 a fraction, rounded up, else a count."""
    n = df.count()
    test = -int(-(n * size) // 1) if size < 1 else int(size)
    if not 0 < test < n:
        raise ValueError(f"a test set of {test} rows of {n}")
    row, last, _ = border(df, test, seed, id)
    inside = row <= last  # rows that share the last one's id come along
    return df.where(~inside), df.where(inside)


def step_count(rows: int, micro_batch_size: int = 1, accumulation: int = 1, epochs: int = 1) -> int:
    return rows // (micro_batch_size * accumulation) * epochs
