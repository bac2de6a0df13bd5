"""Operators registered over documents, held against brute force on a few texts."""

import hashlib
import random
import re

import __spark_entry__ as entry
from corpusmill.functions import similarity
from corpusmill.functions.tokens import PATTERN

WORDS = "the of and to in is that it was for on are with as at be this have from or".split()


def written(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return entry.queries(), str(path)


def test_random_sample_up(spark, tmp_path):
    rows = [(3 * k, "x" * k, "s") for k in range(40)]
    queries, d = written(spark, tmp_path, rows)
    want = {}
    for k in range(80):
        i, t, _ = rows[int(hashlib.md5(f"42|{k}".encode()).hexdigest()[:15], 16) % 40]
        want[i] = (want.get(i, (0, 0))[0] + 1, want.get(i, (0, 0))[1] + len(t))
    assert {r["doc_id"]: (r["draws"], r["chars"]) for r in queries["random_sample_up"](spark, d).collect()} == want


def grams(text):
    t = re.findall(PATTERN, text)
    return {tuple(t[k : k + 8]) for k in range(len(t) - 7)}


def test_dedup_combined(spark, tmp_path):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(30, 60))) for _ in range(8)]
    texts = [*base, base[0], *("".join(c for c in t if rnd.random() > 0.05) for t in base[:4]), *(t + " " + " ".join(rnd.choice(WORDS) for _ in range(80)) for t in base[4:]), "", "", None, None]
    rnd.shuffle(texts)
    queries, d = written(spark, tmp_path, [(k, t, "s") for k, t in enumerate(texts)])
    known = {k: t for k, t in enumerate(texts) if t is not None}
    first = {}
    for k, t in known.items():
        first.setdefault(t, k)
    fuzzy = {k for k, t in known.items() if any(k > min(first[t], first[u]) for u in first if u == t or similarity.ratio(t, u) >= 80)}
    kept = {k: grams(t) for k, t in known.items() if k not in fuzzy}
    gone = set()
    for k in sorted(kept):
        if k not in gone:
            gone |= {j for j in kept if j > k and kept[k] and kept[j] and 100 * len(kept[k] & kept[j]) >= 80 * min(len(kept[k]), len(kept[j]))}
    assert len(fuzzy) >= 5 and len(gone) >= 4
    got = {r["doc_id"] for r in queries["dedup_combined"](spark, d).collect()}
    assert got == set(range(len(texts))) - fuzzy - gone
