"""Pairs verified by blocks, and ranges by the size of the input, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, overlap
from corpusmill.operators.base import ROW_ID
from corpusmill.storage import Workspace


def families(rng: random.Random) -> list[list[int]]:
    """Sets around a few bases, their subsets, and single ones."""
    out = []
    for f in range(6):
        base = [1000 * f + k for k in range(rng.randint(5, 60))]
        for _ in range(25):
            out.append(sorted({x for x in base if rng.random() < 0.9} | {rng.randrange(10**9) for _ in range(rng.randint(0, 6))}))
    return [x for x in out + [[7], [1001], list(range(3000))] if x]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("threshold", [50.0, 80.0])
def test_pairs_of_families(spark, monkeypatch, small, threshold):
    if small:
        for name, n in (("RANGE", 200), ("BLOCK_TOKENS", 300), ("BLOCK_SETS", 7), ("POSTED", 500)):
            monkeypatch.setattr(overlap, name, n)
    sets = families(random.Random(5))
    df = spark.createDataFrame(list(enumerate(sets)), f"{ROW_ID} long, grams array<bigint>").repartition(3)
    want = set()
    for (i, a), (j, b) in combinations(enumerate(map(set, sets)), 2):
        if 100.0 * len(a & b) / min(len(a), len(b)) >= threshold:
            want.add((i, j, len(a & b), len(a), len(b)))
    assert {tuple(r) for r in dedup.containment_pairs(df, threshold).collect()} == want


def test_common_of():
    rng = np.random.default_rng(1)
    for most in (30, 20_000):
        sets = [rng.permutation(np.unique(rng.integers(0, most, rng.integers(1, 200)).astype(np.uint64))) for _ in range(40)]
        for n in (1, 1500):
            p = rng.integers(0, 40, n)
            q = (p + rng.integers(1, 40, n)) % 40
            assert overlap.common_of(sets, p, q).tolist() == [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(p, q)]


def test_a_set_is_sent_once_for_each_block(spark):
    """A family of 60 has 1770 pairs; its sets were sent 3540 times."""
    sets = spark.range(60).select(F.col("id").alias("uid"), F.lit(3).alias("size"), F.lit(b"").alias("tokens"))
    pairs = spark.createDataFrame(list(combinations(range(60), 2)), "p long, q long")
    links, sent = overlap.blocks_of_pairs(Workspace(spark), sets, pairs)
    assert links.count() == 1770 and sent.count() <= 120
