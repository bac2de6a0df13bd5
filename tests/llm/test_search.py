"""Near duplicates, decontamination and licences, against brute force."""

import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import components as cc
from corpusmill.llm import decontamination, embedding_dedup, jaccard_join, licenses
from corpusmill.llm.common import WORD_BYTE, Workspace, squeeze, text_bytes
from corpusmill.operators import overlap
from tests.llm.conftest import sentence

WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def grams(text, n=jaccard_join.N):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def family_texts(seed):
    """A family of many near copies, copies, small families, shared passages, and clean texts."""
    rnd = random.Random(seed)
    edit = lambda t, p: " ".join(("zz" + str(rnd.randint(0, 99)) if rnd.random() < p else w) for w in t.split())
    big, passage = sentence(rnd, n=90), sentence(rnd, n=55)
    out = [edit(big, 0.06) for _ in range(40)] + [big]
    for _ in range(12):
        t = sentence(rnd, n=rnd.choice([3, 8, 30, 120]))
        out += [t, *(edit(t, rnd.choice([0.0, 0.03, 0.1, 0.2])) for _ in range(rnd.choice([0, 1, 3])))]
    out += [sentence(rnd, n=150) + " " + passage + " " + sentence(rnd, "fr", 100) for _ in range(15)]
    out += [big[: len(big) // 2], passage, passage.upper() + "!"]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_groups_and_pairs(spark, seed):
    texts = family_texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [grams(t) for t in texts]
    edges = [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) - 1e-9]
    root = roots(range(len(texts)), edges)
    want = {(k, root[k]) for k in root if sum(r == root[k] for r in root.values()) > 1}
    got = jaccard_join.near_duplicates(df).collect()
    assert {(r["doc_id"], r["group_id"]) for r in got} == want and all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in got)
    kept = {r["doc_id"] for r in jaccard_join.keep_one_of_each(df).collect()}
    groups: dict[int, set] = {}
    for k, r in root.items():
        groups.setdefault(r, set()).add(k)
    assert len(kept) == len(groups) and all(len(kept & g) == 1 for g in groups.values())
    keyed = jaccard_join._keyed(df)
    uid = {r["uid"]: r["doc_id"] for r in keyed.select("uid", "doc_id").collect()}
    pairs = jaccard_join.similar_pairs(Workspace(spark), keyed.select("uid", "text")).collect()
    found = {tuple(sorted((uid[r["a"]], uid[r["b"]]))) for r in pairs}
    distinct = set(uid.values())
    assert found == {(i, j) for i, j in edges if i in distinct and j in distinct}
    for r in pairs:
        x, y = sets[uid[r["a"]]], sets[uid[r["b"]]]
        assert r["jaccard"] == pytest.approx(len(x & y) / len(x | y))


@pytest.mark.parametrize("parts", [2, 8, 200])
def test_jaccard_groups_whatever_the_partitions(spark, monkeypatch, parts):
    """Also with tokens that are spread by text, as they are frequent in a slice."""
    monkeypatch.setattr(overlap, "FREQUENT_LEAST", 5)
    monkeypatch.setattr(overlap, "SLICE", 500)
    texts = family_texts(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(overlap.frequent_tokens(jaccard_join._keyed(df).select("uid", "text"), jaccard_join._sets_of(jaccard_join.N))[0])
    sets = [grams(t) for t in texts]
    root = roots(range(len(texts)), [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) - 1e-9])
    want = {(k, root[k]) for k in root if sum(r == root[k] for r in root.values()) > 1}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert {(r["doc_id"], r["group_id"]) for r in jaccard_join.near_duplicates(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_jaccard_of_nasty(nasty):
    got = {(r["doc_id"], r["group_id"]) for r in jaccard_join.near_duplicates(nasty).collect()}
    assert {(1, None), (3, None), (None, None), (7, 7), (8, 7), (9, 9), (10, 9), (2, 2)} == got
    kept = jaccard_join.keep_one_of_each(nasty)
    assert kept.columns == nasty.columns
    rows = [(r["doc_id"], r["text"] is None) for r in kept.collect()]
    # of the copies of the first text the null id stays; doc 2 stays once, and its other text
    assert sorted(rows, key=repr) == sorted([(None, False), (2, False), (2, False), (None, True), (4, True), (5, False), (6, False), (7, False), (9, False), (11, False)], key=repr)
    none = nasty.where("false")
    assert jaccard_join.near_duplicates(none).count() == 0 and jaccard_join.keep_one_of_each(none).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    for n, m in ((1, 0), (50, 30), (60, 59), (40, 200)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + ([(k, k + 1) for k in range(n - 1)] if m == 59 else [])
        got = cc.components(Workspace(spark), spark.createDataFrame(edges, "a long, b long"), "t").collect()
        want = {(k, r) for k, r in roots(range(n), edges).items() if k != r}
        assert {(r["node"], r["root"]) for r in got} == want


# embeddings:
def test_embedding_recall(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(1500, 64))
    copies = base[rnd.integers(0, 200, 700)] + rnd.normal(size=(700, 64)) * rnd.choice([0.02, 0.1, 0.2], (700, 1))
    x = np.concatenate([base, copies])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    want = roots(range(len(x)), near.tolist())
    got = {r["vec_id"]: r["group_id"] for r in embedding_dedup.near_duplicates(df, cell=100).collect()}
    assert len(got) == len(x) and len(near) > 300
    assert np.mean([got[i] == got[j] for i, j in near]) >= 0.98
    assert all(want[got[k]] == want[k] for k in got)  # nothing is joined that isn't similar


def test_embeddings_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (2, [2.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [None, 1.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cell int, a string")
    got = {(r["vec_id"], r["group_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), *((k, k, True) for k in range(3, 10))}
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id = 3")).count() == 1


def test_embeddings_of_any_length(spark):
    rows = [(1, [1e25, 1e25]), (2, [1e25, 1.0001e25]), (3, [1e-25, 2e-25]), (4, [1.0, 2.0]), (5, [3e38, -3e38]), (6, [1e-44, -1e-44])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["group_id"] for r in embedding_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}


def test_many_copies_of_a_vector(spark):
    """20,000 equal vectors are one to the clustering, and thousands of nearly equal ones are joined by blocks."""
    rnd = np.random.default_rng(9)
    base, other = rnd.normal(size=64), rnd.normal(size=64)
    same = [(k, base.tolist()) for k in range(20_000)]
    near = [(20_000 + k, (other + rnd.normal(size=64) * 0.01).tolist()) for k in range(3000)]
    df = spark.createDataFrame(same + near, "vec_id long, embedding array<float>").repartition(8)
    began = time.monotonic()
    got = {(r["group_id"], r["count"]) for r in embedding_dedup.near_duplicates(df).groupBy("group_id").count().collect()}
    assert got == {(0, 20_000), (20_000, 3000)} and time.monotonic() - began < 60


def near_threshold(n, dims, seed):
    """Vectors, and for each another one at a cosine slightly above or below 0.95; as single precision, with the groups by brute force."""
    rnd = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rnd.normal(size=(n, dims)))
    v = rnd.normal(size=(n, dims))
    v = unit(v - (v * x).sum(axis=1, keepdims=True) * x)
    c = rnd.choice([0.9499, 0.9501, 0.951, 0.954], (n, 1))
    x = (np.concatenate([x, c * x + np.sqrt(1 - c * c) * v]) * rnd.uniform(0.1, 10, (2 * n, 1))).astype(np.float32)
    exact = unit(x.astype(np.float64))
    near = np.argwhere(np.triu(exact @ exact.T >= 0.95, 1)).tolist()
    return x, near, roots(range(2 * n), near)


@pytest.mark.parametrize("dims, strip", [(8, None), (8, 1 << 12), (64, 1 << 16), (200, 1 << 18)])
def test_embedding_pairs_near_the_threshold(spark, monkeypatch, dims, strip):
    """None is missed, wherever borders of cells lie; also with many strips, and many passes over them."""
    x, near, want = near_threshold(1500, dims, dims)
    if strip:
        monkeypatch.setattr(embedding_dedup, "STRIP", strip, raising=False)
        monkeypatch.setattr(embedding_dedup, "CHUNK", 4 * strip, raising=False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: r["group_id"] for r in embedding_dedup.near_duplicates(df, cell=50).collect()}
    assert len(near) >= 1000 and sum(got[i] != got[j] for i, j in near) == 0
    assert got == want


def test_embedding_cosines_next_to_the_threshold(spark):
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0, 0, 0, 0, 0]), (2, [*at(0.95 - 5e-7), 0, 0, 0, 0]), (3, [0, 0, 7.0, 0, 0, 0]), (4, [0, 0, *at(0.95 + 5e-7), 0, 0])]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["group_id"] for r in embedding_dedup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_embeddings_of_several_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [1.0, 0.0, 0.0]), (5, [9.0, 0.0, 0.5]), (6, [0.0, 1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [5.0]), (9, [2.0]), (10, [-1.0]), (11, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["group_id"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 4, 8: 8, 9: 8, 10: 10, 11: 11}


def test_join_of_labels():
    rnd = np.random.default_rng(2)
    for n, m in ((1, 0), (30, 20), (200, 150), (200, 900)):
        a, b = rnd.integers(0, n, m), rnd.integers(0, n, m)
        label = np.arange(n)
        for part in np.array_split(np.arange(m), 3):
            embedding_dedup.join(label, a[part], b[part])
        want = roots(range(n), zip(a.tolist(), b.tolist()))
        assert label.tolist() == [want[k] for k in range(n)]


# Wu-Manber:
@pytest.mark.parametrize("seed", range(5))
def test_wu_manber(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 3)))
    bench = [(k, " ".join(word() for _ in range(rnd.randint(0, 9)))) for k in range(12)]
    texts = [", ".join(word() for _ in range(rnd.randint(0, 400))).upper() for _ in range(20)] + [None, "", bench[3][1], "x " + bench[4][1] + "!!"]
    p = decontamination.Patterns.build([*bench, (None, bench[5][1]), (99, None)], window=4, min_words=2)
    got = {(d, p.texts[k]) for d, k in decontamination._hits(pa.array(texts), p)}
    flat = lambda t: " " + " ".join(WORD.findall((t or "").lower())) + " "
    want = {(d, x) for d, t in enumerate(texts) for x in p.texts if x.decode() in flat(t)}
    assert got == want
    data, offs = squeeze(*text_bytes(pa.array([t and t.lower() for t in texts])), WORD_BYTE)
    raw = data.tobytes().decode()
    assert raw == "".join(flat(t) if WORD.search(t or "") else " " for t in texts) and len(offs) == len(texts) + 1


def test_decontamination_of_nasty(spark, nasty):
    rows = nasty.select("doc_id", "text").collect()
    bench = spark.createDataFrame([(1, rows[0]["text"]), (2, rows[0]["text"]), (None, rows[11]["text"][-300:]), (4, None), (5, ""), (6, "one two")], "item_id long, text string").withColumn("windows", F.lit(1))
    p = decontamination.build(bench)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contaminated(nasty, p).collect()}
    assert got == {(1, 1), (1, 2), (3, 1), (3, 2), (None, 1), (None, 2), (9, None), (10, None)}
    kept = decontamination.drop_contaminated(nasty, p)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 5
    several = decontamination.build(bench, table_bytes=100)
    assert len(several) > 2 and {(r["doc_id"], r["item_id"]) for r in decontamination.find_contaminated(nasty, several).collect()} == got
    assert decontamination.drop_contaminated(nasty, several).count() == kept.count()
    nothing = decontamination.build(bench.where("false"))
    assert decontamination.drop_contaminated(nasty, nothing).count() == nasty.count() and decontamination.find_contaminated(nasty, nothing).count() == 0
    assert decontamination.find_contaminated(nasty.where("false"), p).count() == 0


# licences:
def test_licenses_brute():
    rnd = random.Random(6)
    index = licenses.Index.build(licenses.TEMPLATES)
    texts = []
    for _ in range(120):
        t = licenses.word_list(rnd.choice(list(licenses.TEMPLATES.values())))
        t = [w if rnd.random() > rnd.choice([0, 0, 0.03, 0.1]) else b"other" for w in t]
        texts.append((sentence(rnd, n=rnd.randint(0, 300)) + " " + b" ".join(t).decode() + " " + sentence(rnd, n=rnd.randint(0, 100))).strip())
    got = {(d, name): share for d, name, share, _ in index.scan(pa.array([*texts, None, "", "word"]))}
    want = {}
    for d, t in enumerate(texts):
        s = list(zip(w := licenses.word_list(t), w[1:]))
        for c in index.classes:
            for lo in range(0, max(1, len(s) - c.window + c.stride), c.stride):
                part = set(s[lo : lo + c.window])
                for name in c.names:
                    share = len(index.shingles[name] & part) / len(index.shingles[name])
                    if share >= licenses.CONTAINMENT:
                        want[d, name] = max(share, want.get((d, name), 0))
    assert set(got) <= set(want) and len(want) > 80
    assert sum(got.get(k) == pytest.approx(v) for k, v in want.items()) >= 0.99 * len(want)


def test_bands_guarantee():
    for c in licenses.Index.build(licenses.TEMPLATES).classes:
        for name in c.names:
            t = len(licenses.shingles(licenses.word_list(licenses.TEMPLATES[name])))
            similarity = licenses.CONTAINMENT * t / (c.window + (1 - licenses.CONTAINMENT) * t)
            assert 1 - (1 - similarity) ** c.bands >= licenses.RECALL
    with pytest.raises(ValueError):
        licenses.Index.build({"x": "word"})


def test_licenses_of_nasty(spark, nasty):
    assert licenses.scan(nasty).count() == 0
    t = "Some text.\n" + licenses.TEMPLATES["mit-text"] + "\n" + licenses.TEMPLATES["gpl-3.0-notice"]
    df = nasty.unionByName(spark.createDataFrame([(50, t), (50, t), (None, t)], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((repr(r["doc_id"]), r["license"], r["containment"]) for r in licenses.scan(df).collect())
    assert got == sorted((k, n, 1.0) for k in ("50", "50", "None") for n in ("mit-text", "gpl-3.0-notice"))
    assert licenses.scan(df.where("false")).count() == 0
