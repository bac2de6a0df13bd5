"""Packing, sharding, and the pipeline as a whole."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import decontamination, jaccard_join, language_id, packing, quality, queries, sharding
from corpusmill.llm.common import TOKEN_PATTERN, table, token_counts

DATA = "/root/testdata/sf0.001"


def slow_pack(sizes, lengths):
    """The packing rule with plain scans."""
    bins = []
    for k, s in enumerate(sizes):
        fits = [(b[1] - b[0], n) for n, b in enumerate(bins) if b[1] - b[0] >= s]
        if fits:
            n = min(fits)[1]
        else:
            best = None
            for c in [x for x in sorted(lengths) if x >= s]:
                room = c - s
                for t in sizes[k + 1 :]:
                    if t <= room:
                        room -= t
                price = packing.cost(c) / (c - room)
                if best is None or price < best[0] - 1e-12:
                    best = (price, c)
            n = len(bins)
            bins.append([0, best[1], []])
        bins[n][2].append(k)
        bins[n][0] += s
    return [(b[0], b[2]) for b in bins]


@pytest.mark.parametrize("seed", range(8))
def test_pack(seed):
    rnd = random.Random(seed)
    lengths = (16, 32, 64, 128)
    sizes = sorted((rnd.choice([rnd.randint(1, 128), rnd.randint(1, 20), 16]) for _ in range(rnd.randint(0, 150))), reverse=True)
    bins, offsets, final = packing.pack(np.array(sizes, int), lengths)
    want = slow_pack(sizes, lengths)
    assert [[k for k, b in enumerate(bins) if b == n] for n in range(len(final))] == [w[1] for w in want]
    for n, (total, items) in enumerate(want):
        assert final[n] == min(x for x in lengths if x >= total)
        assert [offsets[k] for k in items] == [sum(sizes[j] for j in items[:i]) for i in range(len(items))]


def test_packing_is_whole(spark):
    docs = table(spark, DATA, "documents")
    want = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))).alias("n")).collect()}
    got = packing.pack_documents(docs, lengths=(64, 256, 1024), group_rows=50).collect()
    per, bins = {}, {}
    for r in got:
        per.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
        bins.setdefault((r["bin_id"], r["bin_length"]), []).append((r["bin_offset"], r["tokens"]))
    assert {k: sum(n for _, n in v) for k, v in per.items()} == {k: n for k, n in want.items() if n}
    for v in [*per.values(), *bins.values()]:
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n
    assert len({b for b, _ in bins}) == len(bins)
    used, room = sum(n for v in bins.values() for _, n in v), sum(length for _, length in bins)
    assert used > 0.9 * room


def test_token_counts():
    texts = ["a b-c  d1\té\u00a0x", "", None, "9é", "_", " ", "a", "b\n\x0bc", "\U0001f600!!"]
    assert token_counts(pa.array(texts)).tolist() == [len(re.findall("(?a)" + TOKEN_PATTERN, t)) if t else 0 for t in texts]


def test_packing_of_nasty(nasty):
    got = packing.pack_documents(nasty).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, None, 6, 7, 8, 9, 10, 11}
    assert sum(r["doc_id"] == 2 and r["piece"] == 0 for r in got) == 3
    assert sum(r["tokens"] for r in got if r["doc_id"] == 9) == sum(1 for _ in re.finditer(TOKEN_PATTERN, nasty.where("doc_id = 9").first()["text"]))
    assert packing.pack_documents(nasty.where("false")).count() == 0


def test_place():
    rnd = np.random.default_rng(3)
    units = rnd.integers(1, 100, (400, 3)).astype(float)
    out = sharding.place(units, 8)
    totals = np.stack([units[out == s].sum(axis=0) for s in range(8)])
    assert (totals.max(axis=0) / totals.mean(axis=0)).max() < 1.05
    left = np.full((8, 3), 1.02)
    need = units / units.sum(axis=0) * 8
    for k in sorted(range(400), key=lambda k: (-need[k].max(), k)):  # by the definition
        value = [sum(a * b for a, b in zip(left[s], need[k])) for s in range(8)]
        ok = [s for s in range(8) if all(left[s] >= need[k] - 1e-12)] or list(range(8))
        assert value[out[k]] == pytest.approx(max(value[s] for s in ok)) and out[k] in ok
        left[out[k]] -= need[k]
    assert len(sharding.place(np.zeros((0, 3)), 4)) == 0 and sharding.place(np.zeros((3, 3)), 4).tolist() == [0, 0, 0]


def test_sharding(spark, nasty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sharding.shard(docs, shards=4)
    assert got.count() == docs.count() == got.select("doc_id").distinct().count()
    load = got.join(docs, "doc_id").groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).toPandas()
    assert len(load) == 4 and load["n"].max() < 1.3 * load["n"].mean() and load["b"].max() < 1.3 * load["b"].mean()
    odd = sharding.shard(nasty, shards=3)
    assert odd.count() == nasty.count() and odd.columns == ["doc_id", "shard"]
    assert odd.where("doc_id is null").count() == 2
    assert sharding.shard(nasty.where("false")).count() == 0


# the pipeline:
def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    docs = table(spark, DATA, "documents")
    stage = dict(corpus_pipeline.STAGES)
    after = {"documents": docs}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, DATA)
        assert out.columns == docs.columns
        after[name] = docs = spark.createDataFrame(out.toPandas(), out.schema)
    names, ids = list(after), {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in after.items()}
    assert all(ids[b] <= ids[a] for a, b in zip(names, names[1:]))
    # each stage's decision, by the operator's own scores on that stage's input
    d = after["documents"]
    assert ids["language_id"] == {r["doc_id"] for r in language_id.identify(d, language_id.dictionaries(d)).where("accepted").collect()}
    d = after["language_id"]
    assert ids["quality_classifier"] == {r["doc_id"] for r in quality.score(d, quality.train(d, table(spark, DATA, "labels"))).where("accepted").collect()}
    d = after["quality_classifier"]
    gone = {r["doc_id"] for r in jaccard_join.near_duplicates(d).where("not kept").collect()}
    assert ids["ngram_jaccard_join"] == ids["quality_classifier"] - gone and gone
    d = after["ngram_jaccard_join"]
    leaks = {r["doc_id"] for r in decontamination.find_contaminated(d, decontamination.build(table(spark, DATA, "benchmark"))).collect()}
    assert ids["benchmark_decontamination"] == ids["ngram_jaccard_join"] - leaks
    packed = stage["best_fit_packing"](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} <= ids["benchmark_decontamination"]
    whole = {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == {tuple(r) for r in packed}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nasty(spark, nasty, tmp_path, name):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, nasty, str(tmp_path))
    out.write.parquet(f"{tmp_path}/out")
    assert name == "best_fit_packing" or out.columns == nasty.columns
    assert stage(spark, nasty.where("false"), str(tmp_path)).count() == 0


def test_registry():
    assert len(queries.queries()) == 10 and set(queries.oracle_sql()) <= set(queries.queries())
