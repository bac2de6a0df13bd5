"""The pipeline's rows, stage by stage, and the sharding of a table, in plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import zstandard as z
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import decontamination, language_id, packing, quality, sharding, token_counts
from corpusmill.llm.common import TOKEN_PATTERN
from tests.llm.conftest import sentence
from tests.llm.test_layout import slow_pack
from tests.llm.test_models import slow_quality
from tests.llm.test_search import WORD, grams, roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(21)
    good = [(sentence(rnd, lang, rnd.randint(30, 200)), lang, "web") for lang in ("en", "fr", "de") for _ in range(30)]
    junk = [("|| $$ 12 ## " * rnd.randint(5, 40) + sentence(rnd, "en", 4), "en", "junk") for _ in range(25)]
    foreign = [(" ".join("".join(rnd.choice("bcdfgkz") for _ in range(7)) for _ in range(80)), "en", "web") for _ in range(6)]
    passage = sentence(rnd, "en", 14)
    leaks = [(f"{sentence(rnd, 'en', 60)} {passage.upper()}! {sentence(rnd, 'en', 30)}", "en", "web") for _ in range(5)]
    copies = [(" ".join(w if rnd.random() > 0.03 else "zz" for w in t.split()), lang, s) for t, lang, s in good[:12]] + good[5:9]
    rows = [*good, *junk, *foreign, *leaks, *copies, ("", "en", "web"), (None, "en", "web")]
    rnd.shuffle(rows)
    rows = [(k, t, lang, s, None if t is None else len(t)) for k, (t, lang, s) in enumerate(rows)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(s != "junk"), 0) for k, t, _, s, _ in rows if t and k % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, sentence(rnd, "fr", 20)), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage


def languages(model, text):
    """(best, margin) by compressing every block with every dictionary."""
    flat = (" " + " ".join(re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())) + " ").encode()
    if not flat.strip():
        return None, 0.0
    sizes = []
    for lang in sorted(model):
        p = z.ZstdCompressionParameters.from_level(language_id.LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0)
        d = z.ZstdCompressionDict(model[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        c = z.ZstdCompressor(dict_data=d, compression_params=p)
        sizes.append((sum(len(c.compress(flat[i : i + language_id.BLOCK])) for i in range(0, len(flat), language_id.BLOCK)), lang))
    sizes.sort()
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[0][0]


def test_pipeline_brute(spark, corpus):
    folder, rows, passage = corpus
    stages, ids = dict(corpus_pipeline.STAGES), lambda df: {r["doc_id"] for r in df.collect()}
    frame = lambda some: spark.createDataFrame(some, SCHEMA)

    model = language_id.dictionaries(frame(rows))
    known = [r for r in rows if languages(model, r[1])[1] >= language_id.MIN_MARGIN]
    assert ids(stages["language_id"](spark, frame(rows), folder)) == {r[0] for r in known} and 0 < len(known) < len(rows)

    fm = quality.train(frame(known), spark.read.parquet(f"{folder}/labels.parquet"))
    good = []
    for r in known:
        f = list(slow_quality(*r[1:4]).items())
        idx, val = np.array([i for i, _ in f]), np.array([v for _, v in f])
        products = (fm.factor[idx] @ fm.factor[idx].T) * np.outer(val, val)
        s = fm.bias + fm.weight[idx] @ val + (products.sum() - np.trace(products)) / 2
        if 1 / (1 + np.exp(-s)) >= quality.MIN_SCORE:
            good.append(r)
    assert ids(stages["quality_classifier"](spark, frame(known), folder)) == {r[0] for r in good} and 0 < len(good) < len(known)

    sets = [grams(r[1]) for r in good]
    edges = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])]
    root = roots(range(len(good)), edges)
    first = {k: min(good[j][0] for j in root if root[j] == root[k]) for k in root}
    one = [r for k, r in enumerate(good) if first[k] == r[0]]
    assert ids(stages["ngram_jaccard_join"](spark, frame(good), folder)) == {r[0] for r in one} and len(one) < len(good)

    flat = lambda t: " " + " ".join(WORD.findall((t or "").lower())) + " "
    windows = set()
    for t in [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"]]:
        w = WORD.findall(t.lower())
        windows |= {" " + " ".join(w[k : k + decontamination.WINDOW]) + " " for k in range(len(w) - decontamination.WINDOW + 1)}
    clean = [r for r in one if not any(w in flat(r[1]) for w in windows)]
    assert ids(stages["benchmark_decontamination"](spark, frame(one), folder)) == {r[0] for r in clean} and len(clean) < len(one)

    count = token_counts.counter(token_counts.VOCABULARY)
    sizes = sorted(((n, r[0]) for r in clean if (n := count([r[1]])[0])), key=lambda x: (-x[0], x[1]))
    most = max(packing.LENGTHS)
    assert all(n < most for n, _ in sizes)
    want = {(sizes[k][1], 0, n, min(x for x in packing.LENGTHS if x >= total), b) for b, (total, items) in enumerate(slow_pack([n for n, _ in sizes], packing.LENGTHS)) for k, n in ((k, sizes[k][0]) for k in items)}
    got = stages["best_fit_packing"](spark, frame(clean), folder).collect()
    assert {(r["doc_id"], r["first_token"], r["tokens"], r["bin_length"], r["bin_id"]) for r in got} == want
    # and the stages one after the other
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, got))


def test_sharding_brute(spark):
    """Groups, splits and buckets by plain sums; only the hashes are Spark's."""
    rnd = random.Random(2)
    rows = [(k, sentence(rnd, n=rnd.randint(0, 60)), rnd.choice(["en", None]), "hot" if k % 3 else f"s{rnd.randint(0, 40)}") for k in range(600)]
    rows += [(5, None, "en", "hot"), (None, "a b", "fr", None), (None, "c", "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shards, fine = 5, sharding.UNITS_A_SHARD * 5
    key = F.xxhash64(F.to_json(F.struct(F.col("source").alias("k0"), F.col("lang").alias("k1"))))
    hashed = docs.select("doc_id", "text", key.alias("key"), F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(fine)).alias("salt"), F.pmod(F.xxhash64(key, F.lit("unit")), F.lit(fine)).alias("bucket")).collect()
    sizes = [np.array([len((r["text"] or "").encode()), len(re.findall("(?a)" + TOKEN_PATTERN, r["text"] or "")), 1.0]) for r in hashed]
    total = sum(sizes)
    limits = np.maximum(1, total / fine)
    of_key = defaultdict(lambda: np.zeros(3))
    for r, s in zip(hashed, sizes):
        of_key[r["key"]] += s
    parts = {k: min(fine, int(np.ceil((v / limits).max()))) for k, v in of_key.items() if np.ceil((v / limits).max()) > 1}
    assert parts and len(parts) < len(of_key)
    pairs = sorted({(r["key"], r["salt"] % parts[r["key"]]) for r in hashed if r["key"] in parts})
    split = {p: r["u"] for p, r in zip(pairs, spark.createDataFrame([(k, s, n) for n, (k, s) in enumerate(pairs)], "k long, s long, n int").orderBy("n").select(F.xxhash64("k", "s").alias("u")).collect())}
    units = [split[r["key"], r["salt"] % parts[r["key"]]] if r["key"] in parts else r["bucket"] for r in hashed]
    load = defaultdict(lambda: np.zeros(3))
    for u, s in zip(units, sizes):
        load[u] += s
    names = sorted(load)
    place = dict(zip(names, sharding.place(np.array([load[u] for u in names]), shards)))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["shard"]) for r in sharding.shard(docs, shards=shards).collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0, int(place[u])) for r, u in zip(hashed, units))
    by = defaultdict(lambda: np.zeros(3))
    for u, s in zip(units, sizes):
        by[place[u]] += s
    loads = np.array(list(by.values()))
    assert (loads.max(axis=0) < 1.3 * loads.mean(axis=0)).all()  # bytes, tokens and rows
    assert sharding.shard(docs.drop("source", "lang"), shards=shards).count() == len(rows)
