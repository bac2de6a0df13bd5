"""Samples and splits by draws, with ids that repeat and on tables of any size."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import sampling


def drawn(seed, k):
    return hashlib.md5(f"{seed}|{k}".encode()).hexdigest()


@pytest.mark.parametrize("ids", [list(range(3000)), [k // 3 for k in range(900)], [7] * 50, [0]])
@pytest.mark.parametrize("share", [0.01, 0.5, 1.0])
def test_sample_down(spark, ids, share):
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, n int").repartition(5)
    size = max(1, int(len(ids) * share))
    got = sampling.sample_down(df, size, 3, "id").collect()
    want = sorted((drawn(3, i), i) for i in ids)[:size]
    assert sorted((drawn(3, r["id"]), r["id"]) for r in got) == want and len({r["n"] for r in got}) == size


@pytest.mark.parametrize("ids", [list(range(40)), [k // 2 for k in range(20)]])
def test_sample_up(spark, ids):
    df = spark.createDataFrame([(i, k, "x") for k, i in enumerate(ids)], "id long, rank int, part string").repartition(3)
    got = sampling.sample_up(df, 500, 5, "id")
    assert got.columns == df.columns
    order = sorted(ids)
    want: dict[int, int] = {}
    for k in range(500):
        i = order[int(drawn(5, k)[:15], 16) % len(ids)]
        want[i] = want.get(i, 0) + 1
    assert {r["id"]: r["c"] for r in got.groupBy("id").agg(F.count("*").alias("c")).collect()} == want


def test_dense_rank_keeps_columns(spark):
    df = spark.range(100).withColumn("part", F.col("id") % 3).withColumn("at", F.lit(1)).withColumn("start", F.lit(2)).repartition(7)
    got = sampling.dense_rank(df, "k", F.desc("id")).collect()
    assert all(r["k"] == 99 - r["id"] and r["part"] == r["id"] % 3 and (r["at"], r["start"]) == (1, 2) for r in got)


def test_split_is_whole(spark):
    df = spark.createDataFrame([(k,) for k in range(500)], "id long").repartition(4)
    train, test = sampling.train_test_split(df, 0.1, 9, "id")
    assert sorted(r["id"] for r in test.collect()) == sorted(i for _, i in sorted((drawn(9, k), k) for k in range(500))[:50])
    assert train.count() == 450 and "TakeOrdered" not in test._jdf.queryExecution().toString()
