"""The packer against a plain fold, over ranges of any size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusmill import Context, TokenizerSpec, apply_all
from corpusmill.operators.packing import Range, follow


def fold(rows, least, most, separator):
    """Lists of rows of each pack that is kept, of (order, tokens) in order."""
    packs, now, total = [], [], 0
    for i, n in rows:
        if now and total + separator + n > most:
            packs.append((now, total))
            now, total = [], 0
        total = total + separator + n if now else n
        now = [*now, i]
    kept = [p for p in packs if p[1] >= least]
    if now and total < least and kept and kept[-1][1] + separator + total <= most:
        kept[-1] = (kept[-1][0] + now, 0)
    elif now:
        kept.append((now, total))
    return [k for k, _ in kept]


def starts(rows, most, separator):
    """Where each row's pack begins, by key."""
    out, key, first, total = [], None, None, 0
    for k, (g, n) in enumerate(rows):
        if g != key or total + separator + n > most:
            key, first, total = g, k, n
        else:
            total += separator + n
        out.append(first)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_ranges_are_followed(seed):
    rnd = random.Random(seed)
    rows = sorted((rnd.choice("aab") if seed % 3 else "a", rnd.choice([rnd.randint(1, 9), rnd.randint(1, 60)])) for _ in range(rnd.randint(1, 80)))
    if seed % 2:
        rows = [(g, n) for g, n in sorted(rows, key=lambda r: (r[0], rnd.random()))]
    most, separator = rnd.choice([10, 25, 100]), rnd.choice([0, 1, 3])
    cuts = sorted({0, len(rows), *(rnd.randrange(len(rows)) for _ in range(rnd.choice([0, 1, 5, 30])))})
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        parts.append(pa.table({"at": pa.array(range(a, b), pa.int64()), "g": [g for g, _ in rows[a:b]], "n": pa.array([n for _, n in rows[a:b]], pa.int64())}))
    ranges = [Range(t, most, separator) for t in parts]
    entered = follow([r.summary() for r in ranges], most)
    got = np.concatenate([r.packs(*e) for r, e in zip(ranges, entered)]).tolist()
    assert got == starts(rows, most, separator)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("parts", [2, 16])
def test_packs(spark, keys, parts):
    rnd = random.Random(parts)
    rows = [(k, rnd.choice(["x", "y", None]), " ".join(["w"] * rnd.choice([1, 3, 10, 25])) if k % 11 else rnd.choice(["", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        spec = {"type": "sample_packer", "min_tokens": 20, "max_tokens": 30, "separator": " | ", "pack_by": keys}
        got = sorted(r["text"] for r in apply_all(df, [spec], Context(tokenizer=TokenizerSpec(), order_by="id")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for key in {r[1] for r in rows} if keys else {"all"}:
        own = [(i, len(t.split())) for i, k, t in rows if t and (not keys or k == key)]
        want += [" | ".join(rows[i][2] for i in pack) for pack in fold(own, 20, 30, 0)]
    assert got == sorted(want)
