"""Operator 10: sharding by vector bin packing.

Documents of one (source, language) belong together.  A group that has more than
a quarter of a shard's fair share of bytes, tokens or rows is split by a hash of
the id; smaller ones are gathered into buckets by a hash of their key.  So there are
at most some 16 units a shard, whatever the data, and these are placed on the
driver: in descending order of their largest share, each where the dot product of
its (bytes, tokens, rows) with the shard's residual capacity is highest, among the
shards that have room in all three, else among all.

Cases: a null text has no bytes or tokens but counts as a row; null keys are a
group of their own, and a key column that is missing is null in every row; null ids of one group stay together, as do rows that repeat an
id; ties go to the unit with the smaller number and to the first shard; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, n_tokens, small_batches

SHARDS = 64
KEYS = ("source", "lang")
SLACK = 0.02  #: capacity above the fair share
UNITS_A_SHARD = 4
MEASURES = ("bytes", "tokens", "docs")


def place(units: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """The shard of each unit; units are [bytes, tokens, rows]."""
    total = units.sum(axis=0, dtype=float)
    need = units / np.where(total > 0, total, 1) * shards  # in fair shares
    left = np.full((shards, units.shape[1]), 1.0 + slack)
    out = np.zeros(len(units), np.int64)
    for k in np.lexsort((np.arange(len(units)), -need.max(axis=1))) if len(units) else ():
        value = left @ need[k]
        fits = (left >= need[k] - 1e-12).all(axis=1)
        out[k] = np.argmax(np.where(fits, value, -np.inf) if fits.any() else value)
        left[out[k]] -= need[k]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(doc_id, shard) of every row.  Texts are read once, to be measured; what is shuffled is sums, what is sent is bounded."""
    small_batches(docs)
    spark = docs.sparkSession
    ws, fine = Workspace(spark), UNITS_A_SHARD * shards
    key = F.to_json(F.struct(*((F.col(k) if k in docs.columns else F.lit(None)).cast("string").alias(f"k{n}") for n, k in enumerate(keys))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(key).alias("key"), F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(fine)).alias("salt"), F.col("text").cast("string").alias("text"))
    measured = rows.groupBy("key", "salt").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"), F.sum(n_tokens()).alias("tokens"), F.count("*").alias("docs"))
    fine_sums = ws.save(measured, "sums")
    sums = [F.sum(m).alias(m) for m in MEASURES]
    total = fine_sums.agg(*sums).first()
    limits = {m: max(1.0, (total[m] or 0) / fine) for m in MEASURES}
    # a key is large if it has more than 1/fine of something: at most 3 * fine keys are
    large = fine_sums.groupBy("key").agg(*sums).select("key", F.ceil(F.greatest(*(F.col(m) / limits[m] for m in MEASURES))).alias("parts")).where("parts > 1").withColumn("parts", F.least("parts", F.lit(fine)))
    large = spark.createDataFrame(sorted((r["key"], r["parts"]) for r in large.collect()), "key long, parts long")

    def with_unit(df: DataFrame) -> DataFrame:
        hashed = F.pmod(F.xxhash64("key", F.lit("unit")), F.lit(fine))
        split = F.xxhash64("key", F.pmod("salt", "parts"))
        return df.join(F.broadcast(large), "key", "left").withColumn("unit", F.when(F.col("parts").isNull(), hashed).otherwise(split))

    units = with_unit(fine_sums).groupBy("unit").agg(*sums).orderBy("unit").collect()
    shard_of = place(np.array([[r[m] for m in MEASURES] for r in units], float).reshape(-1, len(MEASURES)), shards)
    plan = spark.createDataFrame([(r["unit"], int(s)) for r, s in zip(units, shard_of)], "unit long, shard int")
    ws.drop()
    return with_unit(rows.drop("text")).join(F.broadcast(plan), "unit").select("doc_id", "shard")
