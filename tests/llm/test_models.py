"""Token counts, the three classifiers and language identification."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language_id, quality, token_counts, toxicity
from tests.llm.conftest import sentence

DATA = "/root/testdata/sf0.01"
COUNT = token_counts.counter(token_counts.VOCABULARY)


def labelled(column, data=DATA):
    t = duckdb.sql(f"select d.doc_id, d.text, d.lang, d.source, l.{column} as label from '{data}/documents.parquet' d join '{data}/labels.parquet' l using (doc_id) order by hash(d.doc_id)")
    names = ["doc_id", "text", "lang", "source", "label"]
    rows = t.fetchall()
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names), np.array([r[4] for r in rows])


@pytest.mark.parametrize("seed", range(40))
def test_tree_equals_encoding_again(seed):
    rnd = random.Random(seed)
    text = sentence(rnd, n=rnd.choice([0, 3, 200, 900])).replace(" ", rnd.choice([" ", "  ", "\n", " \t", ""]))
    tree = token_counts.TokenTree(text, COUNT)
    assert tree.tokens == COUNT([text])[0]
    for leaf in range(tree.n):
        chars, tokens = tree.before(leaf)
        assert tokens == COUNT([text[:chars]])[0] and (chars == len(text) == 0 or tree.find(chars) == leaf)
    for _ in range(3):
        spans = [(a := rnd.randint(0, len(tree.text)), a + rnd.choice([0, 1, 5, 400]), rnd.choice(["", " ", "a b", "\n", "'s"])) for _ in range(rnd.choice([0, 1, 3, 12]))]
        want, at = [], 0
        for a, b, new in sorted(spans, key=lambda e: e[:2]):
            b = min(b, len(tree.text))
            if a >= at:
                want += [tree.text[at:a], new]
                at = b
        want = "".join([*want, tree.text[at:]])
        tree.apply(spans)
        assert tree.text == want and tree.tokens == COUNT([want])[0] and tree.sums[1, 0] == len(want)


def test_an_edit_touches_little():
    text = sentence(random.Random(1), n=20_000)
    tree = token_counts.TokenTree(text, COUNT)
    tree.apply([(50_000, 50_010, "other")])
    assert 0 < tree.reencoded < 4 * token_counts.LEAF_CHARS


def test_counts_of_nasty(nasty):
    got = token_counts.count_with_edits(nasty).collect()
    assert len(got) == nasty.count()
    for r, t in zip(got, [x["text"] for x in nasty.select("text").collect()]):
        if t is None:
            assert r["tokens"] is None and r["tokens_after"] is None
        else:
            e, out, at = token_counts.find_edits(t), [], 0
            for a, b, new in sorted(e, key=lambda x: x[:2]):
                if a >= at:
                    out += [t[at:a], new]
                    at = b
            assert (r["tokens"], r["tokens_after"]) == (COUNT([t])[0], COUNT(["".join([*out, t[at:]])])[0])
    assert token_counts.count_with_edits(nasty.where("false")).count() == 0


def test_toxicity_held_out():
    batch, y = labelled("toxic", "/root/testdata/sf0.1")
    g = toxicity.grams(batch.column("text"))
    half = len(y) // 2
    p = toxicity.fit([(g[k], int(y[k])) for k in range(half)]).score(g[half:])
    toxic = y[half:] == 1
    # some 225 toxic rows, in four languages with words of their own, are few to learn from
    assert (p[~toxic] >= 0.5).mean() < 0.01 and (p[toxic][:, None] > p[~toxic][None]).mean() > 0.85


def test_toxicity_learns_words():
    """With enough rows, words that are seen in toxic texts only are caught, and clean texts left alone."""
    rnd = random.Random(8)
    bad = ["worthless", "moron", "trash"]

    def text(toxic):
        w = sentence(rnd, rnd.choice(["en", "fr", "de"]), rnd.randint(20, 400)).split()
        for _ in range(rnd.randint(1, 5) * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        return " ".join(w)

    y = [k % 4 == 0 for k in range(1200)]
    g = toxicity.grams(pa.array([text(k) for k in y]))
    p = toxicity.fit([(g[k], int(y[k])) for k in range(800)]).score(g[800:])
    assert ((p >= toxicity.MIN_SCORE) == y[800:]).mean() > 0.98


def test_toxicity_grams_brute():
    texts = ["The Cat, the cat", "", None, "é!é", "ab"]
    for t, g in zip(texts, toxicity.grams(pa.array(texts))):
        flat = (" " + " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()) + " ").encode() if (t or "").strip() else b" "
        assert len(g) == sum(len({flat[k : k + n] for k in range(len(flat) - n + 1)}) for n in toxicity.ORDERS)


def test_toxicity_of_nasty(spark, nasty, labels):
    model = toxicity.train(nasty, labels)
    got = toxicity.score(nasty, model).collect()
    assert len(got) == nasty.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (4, 5)} == {0.0}
    assert toxicity.find_toxic(nasty, toxicity.train(nasty, labels.where("false"))).count() == 0
    assert toxicity.find_toxic(nasty.where("false"), model).count() == 0


def slow_features(text):
    """A text's features in plain Python: the hash of each distinct byte n-gram of its letters."""
    flat = (" " + " ".join(re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())) + " ").encode()
    flat = flat if flat.strip() else b" "
    out = set()
    for n in toxicity.ORDERS:
        for k in range(len(flat) - n + 1):
            h = n
            for c in flat[k : k + n]:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            out.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return out


def test_toxicity_brute(spark, monkeypatch):
    """Ratios from plain counts, and scores as plain sums, of a model that one pass over all rows leaves."""
    rnd = random.Random(12)
    rows = [(k, sentence(rnd, n=30) + (" you moron" if k % 3 == 0 else "") + rnd.choice(["", " été", " A9b"]), k % 3 == 0) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(90, None), (91, ""), (92, "!!")], "doc_id long, text string")
    known = spark.createDataFrame([(k, int(t)) for k, _, t in rows], "doc_id long, toxic int")
    features = {k: slow_features(t) for k, t, _ in rows}
    size = 1 << toxicity.BITS
    count = {c: {} for c in (True, False)}
    for k, _, t in rows:
        for g in features[k]:
            count[t][g] = count[t].get(g, 0) + 1
    total = {c: size + sum(count[c].values()) for c in count}
    ratio = lambda g: math.log((1 + count[True].get(g, 0)) / total[True]) - math.log((1 + count[False].get(g, 0)) / total[False])
    model = toxicity.train(docs, known)
    # weights are log-count ratio times fitted weight: an unseen feature has none, and none points away from its ratio but a little
    seen = sorted({g for f in features.values() for g in f})
    unseen = np.setdiff1d(np.arange(size), seen)
    assert not model.weight[unseen].any()
    ratios = np.array([ratio(g) for g in seen])
    fitted = model.weight[seen] / np.where(ratios == 0, 1, ratios)
    assert np.abs(fitted).max() < 5 and (model.weight[seen][np.abs(ratios) > 2] * np.sign(ratios[np.abs(ratios) > 2]) > 0).mean() > 0.95
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for k, _, t in rows:
        s = model.bias + sum(float(model.weight[g]) for g in features[k])
        assert got[k] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-6) and (got[k] >= toxicity.MIN_SCORE) == t
    assert got[90] == got[91] == got[92] == 0.0
    found = {r["doc_id"] for r in toxicity.find_toxic(docs, model).collect()}
    assert found == {k for k, _, t in rows if t}


def test_quality_held_out():
    batch, y = labelled("quality")
    idx, val, row = quality.features(batch)
    rows = [(idx[row == k], val[row == k], int(y[k])) for k in range(len(y))]
    half = len(y) // 2
    m = quality.fit(rows[:half])
    p = np.array([m.score(i, v, np.zeros(len(i), int), 1)[0] for i, v, _ in rows[half:]])
    assert ((p >= quality.MIN_SCORE) == y[half:]).mean() > 0.93
    assert (p[y[half:] == 1] >= quality.MIN_SCORE).mean() > 0.95


def slow_quality(text, lang, source):
    """{feature: value} in plain Python; a word's number is looked up from the operator's hash of the word alone."""
    t = text or ""
    low, raw = t.lower().encode(), t.encode()
    found = re.findall(rb"[a-z0-9\x80-\xff]+", low)
    number = lambda w: int(quality.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] >> np.uint64(64 - quality.BITS))
    ids = {number(w) for w in found}
    size, n = max(len(raw), 1), max(len(found), 1)
    symbol = [not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or 48 <= c <= 57 or c in b" \n\t\r") for c in raw]
    lines = raw.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    ended = [x + b"\n" * (k < raw.count(b"\n")) for k, x in enumerate(lines)]
    stats = [
        sum(65 <= c <= 90 for c in raw) / size * 2, sum(48 <= c <= 57 for c in raw) / size * 4, sum(symbol) / size * 4, sum(c in b" \n\t\r" for c in raw) / size * 2,
        math.log1p(len(found)) / 8, sum(map(len, found)) / n / 10, len(ids) / n, 1 - len(set(ended)) / max(len(ended), 1), math.log1p(size / max(len(ended), 1)) / 8,
        raw.count(b"|") / n, sum(a and b for a, b in zip(symbol, symbol[1:])) / n, float(not found),
    ]
    out = {k: 1 / math.sqrt(len(ids)) for k in ids}
    meta = [f"lang={lang}"] * (lang is not None) + [f"source={source}"] * (source is not None) + [f"size={int(math.log2(size))}"]
    for m in meta:
        k = (1 << quality.BITS) + zlib.crc32(m.encode()) % quality.META
        out[k] = out.get(k, 0) + 0.3
    return out | {(1 << quality.BITS) + quality.META + k: v for k, v in enumerate(stats)}


def test_quality_brute(spark):
    """The query's scores from features and all pairs of them, in plain Python."""
    rnd = random.Random(6)
    texts = [sentence(rnd, n=12), "A|b || c9\nA|b || c9\nend", "x\n\nx\n", "", None, "é 12 ÉÉ!!", "word"]
    rows = [(k, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", None])) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    g = np.random.default_rng(1)
    model = quality.Model(0.2, g.normal(0, 0.3, quality.N_FEATURES), g.normal(0, 0.3, (quality.N_FEATURES, quality.FACTORS)))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    kept = {r["doc_id"] for r in quality.keep_good(docs, model).collect()}
    for k, *row in rows:
        f = list(slow_quality(*row).items())
        s = model.bias + sum(model.weight[i] * v for i, v in f)
        s += sum(model.factor[i] @ model.factor[j] * u * v for a, (i, u) in enumerate(f) for j, v in f[:a])
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-6), row
        assert got[k]["accepted"] == (got[k]["score"] >= quality.MIN_SCORE) == (k in kept)


def test_factorisation_identity():
    rnd = np.random.default_rng(2)
    m = quality.Model(0.1, rnd.normal(size=20), rnd.normal(size=(20, 3)))
    idx, val = np.arange(20), rnd.normal(size=20)
    pairs = sum(m.factor[i] @ m.factor[j] * val[i] * val[j] for i in range(20) for j in range(i))
    want = 1 / (1 + np.exp(-np.clip(0.1 + m.weight @ val + pairs, -30, 30)))
    assert m.score(idx, val, np.zeros(20, int), 1)[0] == pytest.approx(want)


def test_quality_of_nasty(nasty, labels):
    model = quality.train(nasty, labels)
    got = quality.score(nasty, model).collect()
    assert len(got) == nasty.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(nasty, model)
    assert kept.columns == nasty.columns and kept.count() == sum(r["accepted"] for r in got)
    assert quality.keep_good(nasty, quality.train(nasty, labels.where("false"))).count() == nasty.count()
    assert quality.keep_good(nasty.where("false"), model).count() == 0
    assert quality.score(nasty.select("doc_id", "text"), model).count() == nasty.count()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.dictionaries(docs.where("doc_id % 2 = 0"))
    got = language_id.identify(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id").where("length(text) > 40")
    n, right, accepted = got.count(), got.where("language = lang").count(), got.where("accepted").count()
    assert right > 0.95 * n and accepted > 0.95 * n


def test_language_brute(spark):
    """Names and margins by a plain loop: letters by a regular expression, one stream a block, the same prepared dictionary."""
    import zstandard as z

    rnd = random.Random(5)
    model = {k: sentence(rnd, k, 3000).encode() for k in ("de", "en", "fr")}
    texts = [sentence(rnd, k, n) for k in model for n in (1, 5, 300, 5000)] + ["A1b--C é!", "x" * 9000, "Der the LE 99 la", "?", ""]
    texts += [f"{sentence(rnd, 'de', 40)}, {sentence(rnd, 'fr', 40)}" for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    for k, t in enumerate(texts):
        flat = (" " + " ".join(re.findall(r"[a-z\x80-\U0010ffff]+", t.lower())) + " ").encode()
        if not flat.strip():
            assert got[k]["language"] is None and got[k]["margin"] == 0 and not got[k]["accepted"]
            continue
        sizes = {}
        for lang, data in model.items():
            p = z.ZstdCompressionParameters.from_level(language_id.LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0)
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            sizes[lang] = sum(len(z.ZstdCompressor(dict_data=d, compression_params=p).compress(flat[i : i + language_id.BLOCK])) for i in range(0, len(flat), language_id.BLOCK))
        best, second = sorted(sizes.values())[:2]
        assert got[k]["language"] == min(sizes, key=lambda x: (sizes[x], x))
        assert got[k]["margin"] == pytest.approx((second - best) / best, abs=1e-9)
        assert got[k]["accepted"] == ((second - best) / best >= language_id.MIN_MARGIN)


def test_language_of_nasty(nasty):
    model = language_id.dictionaries(nasty)
    got = language_id.identify(nasty, model).collect()
    assert len(got) == nasty.count()
    assert all(r["language"] is None and not r["accepted"] and r["margin"] == 0 for r in got if r["doc_id"] in (4, 5, 6))
    kept = language_id.keep_identified(nasty, model)
    assert kept.columns == nasty.columns and kept.count() == sum(r["accepted"] for r in got)
    assert language_id.keep_identified(nasty.where("false")).count() == 0
    none = [(r["doc_id"], r["accepted"]) for r in language_id.identify(nasty, {}).collect()]
    assert all(ok == (k not in (4, 5, 6)) for k, ok in none if k is not None)
    without = nasty.drop("lang")
    assert language_id.dictionaries(without) == {} and {r["doc_id"] for r in language_id.keep_identified(without).collect()} == {1, 2, 3, None, 7, 8, 9, 10, 11}


def test_one_language_is_held_against_none(spark):
    rnd = random.Random(4)
    rows = [(k, sentence(rnd, n=rnd.randint(40, 400)), "en") for k in range(60)] + [(100 + k, sentence(rnd, "fr", n=300), None) for k in range(10)] + [(200, None, "en"), (201, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language_id.keep_identified(df).collect()) == list(range(60))
    got = language_id.identify(df, language_id.dictionaries(df)).collect()
    assert {r["language"] for r in got if r["accepted"]} == {"en"}
    assert language_id.keep_identified(df.where("lang is null").withColumn("lang", F.lit(None).cast("string"))).count() == 10


def test_language_ties(nasty):
    model = language_id.dictionaries(nasty)
    tied = {"aa": model["en"], "bb": model["en"]}
    assert {r["language"] for r in language_id.identify(nasty, tied).collect()} <= {"aa", None}
