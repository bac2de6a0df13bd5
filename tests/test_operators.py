"""Processors on small tables, against values worked out by hand or by plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import Context, TokenizerSpec, apply_all, create_processor, load_config
from corpusmill.functions import images as im
from corpusmill.functions import media, prompts, regex, similarity
from corpusmill.functions.values import truthy
from corpusmill.operators import dedup, sampling
from corpusmill.operators.base import ROW_ID
from corpusmill.operators.images import fitted_size, resample
from corpusmill.operators.mapping import convert_to_messages
from corpusmill.operators.toxicity import safety_tag
from corpusmill.plans.config import set_path
from corpusmill.operators.errors import error_policy, route_errors
from corpusmill.plans.prepare import prepare
from corpusmill.plans.strategies import load_strategy
from corpusmill.sources.load import load_dataset, parse_split
from corpusmill.sources.save import dataset_card, export, prepared_path, save_prepared, size_category, validate_export

TOK = TokenizerSpec(lower=True)


def ids(df, name="id"):
    return sorted(r[name] for r in df.select(name).collect())


def run(df, spec, **context):
    return apply_all(df, [spec], Context(tokenizer=TOK, order_by="id", **context))


@pytest.fixture(scope="module")
def near(spark):
    texts = ["This is a test sentence.", "This is a test sentence.", "This is a test sentence!", "A completely different sentence.", "Another unique sentence here.", "This is a test sentence?", "Completely different content."]
    return spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string").cache()


@pytest.mark.parametrize("threshold, gone", [(95, {2, 3, 6}), (90, {2, 3, 6}), (85, {2, 3, 6}), (70, {2, 3, 6, 7})])
def test_fuzzy(near, threshold, gone):
    out = run(near, {"type": "deduplicator", "similarity_threshold": threshold})
    assert set(range(1, 8)) - set(ids(out)) == gone and out.columns == ["id", "text"]


def test_ngram_and_combined(near):
    assert ids(run(near, {"type": "deduplicator", "method": "ngram", "ngram_size": 3, "similarity_threshold": 80})) == [1, 3, 4, 5, 6, 7]
    assert ids(run(near, {"type": "deduplicator", "method": "combined", "ngram_size": 4, "similarity_threshold": 85})) == [1, 4, 5, 7]
    spec = {"type": "deduplicator", "method": "ngram", "similarity_threshold": 90}
    assert ids(apply_all(near, [spec], Context(order_by="id"))) == [1, 4, 5, 7]  # no tokenizer: fuzzy


def test_dedup_edges(spark, near):
    with pytest.raises(ValueError):
        create_processor({"type": "deduplicator", "method": "invalid_method"})
    with pytest.raises(KeyError):
        run(near, {"type": "deduplicator", "column": "none"})
    assert run(near.where("false"), {"type": "deduplicator"}).count() == 0
    only = spark.createDataFrame([("First content", 1), ("First content", 2), ("Second content", 3), (None, 4), (None, 5)], "text string, id int")
    assert ids(run(only, {"type": "deduplicator", "similarity_threshold": 95})) == [1, 3, 4, 5]
    assert ids(run(only, {"type": "deduplicator", "similarity_threshold": 95, "remove_exact": False})) == [1, 2, 3, 4, 5]
    assert ids(run(only, {"type": "deduplicator", "external_datasets": [{"path": "/nowhere/at/all"}]})) == [1, 3, 4, 5]


def test_order_column(spark):
    df = spark.createDataFrame([("b", "same"), ("a", "same"), ("c", "other text")], "key string, text string")
    for order, kept in (("key", ["a", "c"]), (None, ["b", "c"])):
        out = apply_all(df.coalesce(1), [{"type": "deduplicator"}], Context(order_by=order))
        assert sorted(r["key"] for r in out.collect()) == kept


def _texts(seed, n=40):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 30))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice("abcdx")
        out.append(None if rnd.random() < 0.05 else "".join(t))
    return out


def _indel(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return 200 * d[-1][-1] / (len(a) + len(b)) if a or b else 100.0


@pytest.mark.parametrize("seed, threshold", [(1, 80), (2, 60), (3, 92)])
def test_fuzzy_against_pairs(spark, seed, threshold):
    texts = _texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    strings, gone = {t for t in texts if t is not None}, set()
    first = {t: texts.index(t) for t in strings}
    for k, t in enumerate(texts):
        if t is not None:
            least = min([first[t], *(first[s] for s in strings if s != t and _indel(s, t) >= threshold)])
            if k > least:
                gone.add(k)
    assert set(range(len(texts))) - set(ids(run(df, {"type": "deduplicator", "similarity_threshold": threshold}))) == gone


@pytest.mark.parametrize("seed, threshold", [(4, 50), (5, 80)])
def test_ngram_against_scan(spark, seed, threshold):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 20))] for _ in range(8)]
    texts = [" ".join(w if rnd.random() > 0.1 else "z" for w in rnd.choice(base)) for _ in range(50)]
    grams = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    gone = set()
    for i in range(len(texts)):
        if i not in gone and grams[i]:
            gone |= {j for j in range(i + 1, len(texts)) if grams[j] and 100 * len(grams[i] & grams[j]) / min(len(grams[i]), len(grams[j])) >= threshold}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert set(range(len(texts))) - set(ids(run(df, {"type": "deduplicator", "method": "ngram", "ngram_size": 3, "similarity_threshold": threshold}))) == gone


def test_external(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "something else altogether"), (3, "the cat sat on the rug"), (4, None)], "id long, text string")
    theirs = spark.createDataFrame([("the cat sat on the mat!",), (None,)], "text string")
    spec = {"type": "deduplicator", "similarity_threshold": 95, "external_datasets": [theirs]}
    assert ids(run(df, spec)) == [2, 3, 4]
    assert ids(run(df, spec | {"method": "ngram", "ngram_size": 4})) == [2, 4]
    assert ids(run(df, spec | {"method": "combined", "ngram_size": 4})) == [2, 4]


def test_ratio():
    rnd = random.Random(0)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in "ab")
        assert similarity.ratio(a, b) == pytest.approx(_indel(a, b))
        assert similarity.ratio(a, b, 70) in (0, pytest.approx(_indel(a, b)))


def test_short_lcs(spark):
    rows = [("kitten", "sitting"), ("", "abc"), ("abc", "abc"), ("a", "b"), ("abcdefgh" * 7, "hgfedcba" * 7)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.short_lcs(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == [similarity.lcs_length(r["a"], r["b"]) for r in got]


# filters:
def test_length_and_token_filters(spark):
    df = spark.createDataFrame([(1, "short", None), (2, "a much longer text here", "x"), (3, None, None), (4, "", "y")], "id int, text string, other string")
    assert ids(run(df, {"type": "filter", "min_length": 10})) == [2, 3, 4]
    assert ids(run(df, {"type": "filter", "max_length": 10})) == [1, 3, 4]
    assert ids(run(df, {"type": "filter", "required_fields": ["other"]})) == [2, 4]
    assert ids(run(df, {"type": "filter", "required_fields": ["absent"]})) == []
    assert ids(run(df, {"type": "filter", "required_fields": ["absent"], "compat_skip": True})) == [1, 2, 3, 4]
    assert ids(run(df, {"type": "hf_filter", "min_tokens": 2})) == [2]
    assert ids(run(df, {"type": "hf_filter", "max_tokens": 2})) == [1]  # no text: dropped
    assert ids(apply_all(df, [{"type": "hf_filter", "min_tokens": 2}])) == [1, 2, 3, 4]  # no tokenizer: no limit


def test_conditions(spark):
    df = spark.createDataFrame([(1, "en", "ab"), (2, "fr", "ab"), (3, None, "ab")], "id int, lang string, text string")
    rule = {"type": "filter", "min_length": 5}
    when = lambda **c: ids(run(df, rule | {"condition": c}))
    assert when(type="field_equals", values={"lang": "en"}) == [2, 3]
    assert when(type="field_not_equals", values={"lang": "en"}) == [1]
    assert when(type="field_exists", fields=["lang"]) == []
    assert when(type="field_not_exists", fields=["lang"]) == [1, 2, 3]
    assert when(type="custom") == []
    out = run(df, {"type": "regex_transform", "transformations": [{"field": "text", "pattern": "a", "replacement": "X"}], "condition": {"type": "field_equals", "values": {"lang": "fr"}}})
    assert [r["text"] for r in out.orderBy("id").collect()] == ["ab", "Xb", "ab"]
    out = run(df, {"type": "column_mapping", "column_mapping": {"text": "body"}, "condition": {"type": "field_equals", "values": {"lang": "fr"}}})
    assert {(r["id"], r["body"], r["text"]) for r in out.collect()} == {(1, None, "ab"), (2, "ab", None), (3, None, "ab")}


def test_regex_filter(spark):
    df = spark.createDataFrame([(1, "spam here"), (2, "good Text"), (3, None), (4, "bad\nspam")], "id int, text string")
    f = lambda *p, **k: ids(run(df, {"type": "regex_filter", "filter_patterns": [{"field": "text"} | x for x in p], **k}))
    assert f({"pattern": "spam"}) == [2, 3]
    assert f({"pattern": "^spam"}) == [2, 3]
    assert f({"pattern": "^spam"}, default_flags=[]) == [2, 3, 4]
    assert f({"pattern": "TEXT", "action": "keep", "flags": ["I"]}) == [2, 3]  # null votes no
    assert f({"pattern": "spam"}, {"pattern": "bad"}, logic_mode="all") == [1, 2, 3]
    assert f({"pattern": "spam"}, invert_logic=True) == [1, 4]
    assert ids(run(df, {"type": "regex_filter", "filter_patterns": [{"field": "none", "pattern": "x"}]})) == [1, 2, 3, 4]
    for bad in ({}, {"filter_patterns": [{"field": "text", "pattern": "("}]}, {"filter_patterns": [{"field": "text", "pattern": "x", "action": "no"}]}, {"filter_patterns": [{"field": "t", "pattern": "x"}], "logic_mode": "no"}):
        with pytest.raises(ValueError):
            create_processor({"type": "regex_filter", **bad})


PATTERNS = [r"\d+", r"\bcat\b", r"(?P<a>c)(?P=a)?at", r"^x.y$", r"[^\W\d_]+", r"a\Z", r"\s+", r"(?i)É", r"(a)|(b)"]
TEXTS = ["cat 12٣", "concat", "x\ry", "ccat a", "élan É", "tab nbsp", "", "a\n", "x\ny", "b$1"]


def test_regex_translation(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p in PATTERNS:
        for flags in (0, re.M, re.S | re.I, re.A):
            got = [r[0] for r in df.select(regex.search(F.col("t"), p, flags)).collect()]
            assert got == [bool(re.search(p, t, flags)) for t in TEXTS], (p, flags)
    for p, new in [(r"(\w)(\w)", r"\2\1"), (r"(?P<x>a)", r"<\g<x>>"), (r"a|b", "$"), (r"(a)|(b)", r"[\1\2]"), (r"\d", "\\\\")]:
        got = [r[0] for r in df.select(regex.substitute(F.col("t"), p, new)).collect()]
        assert got == [re.sub(p, new, t) for t in TEXTS], (p, new)
    got = [r[0] for r in df.select(regex.substitute(F.col("t"), "a", "b", count=1)).collect()]
    assert got == [re.sub("a", "b", t, count=1) for t in TEXTS]


def test_truthiness(spark):
    df = spark.createDataFrame([(0, "", [], False, None), (2, "x", [1], True, (1,))], "i int, s string, a array<int>, b boolean, t struct<x: int>")
    got = df.select(*(truthy(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)).collect()
    assert [list(r) for r in got] == [[False] * 5, [True] * 5]


# mappings:
def test_column_mapping(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = run(df, {"type": "column_mapping", "column_mapping": {"b": "x", "a": "c"}})
    assert out.columns == ["x", "c"] and out.first() == (2, 3)  # the unmapped c takes the name


def test_advanced_mapping(spark):
    row = ([("user", "q1"), ("assistant", "a1"), ("user", "q2")], ("42", "train"), ["i1", "i2"], None)
    df = spark.createDataFrame([row, ([], ("7", "test"), [], "z")], "prompt array<struct<role: string, content: string>>, extra struct<answer: string, split: string>, images array<string>, z string")
    rules = [
        {"source": "prompt", "filter": {"role": "user"}, "extract": "content", "targets": ["problem", "original"]},
        {"source": "extra", "extract_first_of": ["none", "answer"], "target": "solution"},
        {"source": "images[0]", "target": "image"},
        {"source": "prompt[-1].content", "target": "last", "remove_after": ["prompt"]},
        {"source": "prompt", "extract": "role", "target": "roles", "take_first": False},
        {"source": "images[9]", "target": "z"},
    ]
    out = run(df, {"type": "advanced_mapping", "mappings": rules, "simple_mappings": {"extra": "meta"}})
    got = out.collect()
    assert len(got) == 1 and "prompt" not in out.columns and "extra" in out.columns
    r = got[0]
    assert (r["problem"], r["original"], r["solution"], r["image"], r["last"], r["roles"], r["meta"]["split"]) == ("q1", "q1", "42", "i1", "q2", ["user", "assistant", "user"], "train")
    assert run(df, {"type": "advanced_mapping", "mappings": [], "keep_unmapped": False}).count() == 0  # required fields are missing
    assert run(df, {"type": "advanced_mapping", "simple_mappings": {"z": "w"}, "keep_unmapped": False, "required_fields": []}).columns == ["w"]


def test_qa(spark):
    df = spark.createDataFrame([(1, "q", "a", None), (2, "", "a", "q2"), (3, None, "a", None)], "id int, problem string, solution string, question string")
    out = run(df, {"type": "qa_to_messages"}).orderBy("metadata.id").collect()
    assert [(r["messages"][0]["content"], r["messages"][1]["role"], r["metadata"]["id"]) for r in out] == [("q", "assistant", 1), ("q2", "assistant", 2)]
    assert convert_to_messages(df).count() == 1 and convert_to_messages(df.select("id")).columns == ["id"]


# prompts, strategies, media:
def test_prompts(spark):
    df = spark.createDataFrame([("do", "in", "out"), ("do", "", None), (None, None, "o")], "i string, n string, o string")
    show = lambda s: [r[0] for r in df.select(prompts.build_prompt(s, *map(F.col, "ino"))).collect()]
    assert show("completion") == ["do in out", "do", "None o"]
    assert show("chatml")[0].endswith("user\ndo\nin<|im_end|>\n<|im_start|>assistant\nout<|im_end|>") and show("chatml")[1].endswith("assistant\n")
    assert show("vicuna")[1].endswith("USER: do\nASSISTANT: ") and show("alpaca")[0].endswith("### Input:\nin\n\n### Response:\nout")


def test_strategies(spark):
    df = spark.createDataFrame([("say hi", "", "hi there"), ("", "", "")], "instruction string, input string, output string")
    r = load_strategy("alpaca", TOK, {"sequence_len": 100})(df).first()
    n = sum(x == -100 for x in r["labels"])
    assert r["input_ids"][-1] == TOK.eos_id and len(r["labels"]) == len(r["attention_mask"]) == len(r["input_ids"]) == n + 3
    assert load_strategy("alpaca", TOK, {"sequence_len": 5})(df).first()["labels"] == [-100] * 5
    assert -100 not in load_strategy("alpaca", TOK, {"sequence_len": 100, "train_on_inputs": True})(df).first()["labels"]
    text = spark.createDataFrame([("",), ("a b",)], "text string")
    empty, two = load_strategy("completion", TOK, {"sequence_len": 2})(text).collect()
    assert empty["input_ids"] == [] and empty["labels"] is None and len(two["input_ids"]) == 2
    chat = spark.createDataFrame([([("user", "a"), ("assistant", "b")],)], "messages array<struct<role: string, content: string>>")
    assert len(load_strategy("chat_template", TOK, {"sequence_len": 4})(chat).first()["input_ids"]) == 5  # EOS past the end
    assert load_strategy("nothing", TOK, {}) is None
    vl = load_strategy("vl", TOK, {"sequence_len": 3})(spark.createDataFrame([("q", "a"), (None, "a"), ("<image>", "a")], "problem string, solution string"))
    good, bad, off = vl.collect()
    assert good["metadata"]["truncated"] and len(good["input_ids"]) == 3 and bad["metadata"]["error"] and bad["input_ids"] == [] and off["metadata"]["error"]


def test_conversation_and_media(spark):
    chat = spark.createDataFrame([([("user", "<image>hi"), ("system", "be"), ("tool", "x"), ("assistant", None)],)], "m array<struct<role: string, content: string>>")
    m = F.col("m")
    assert chat.select(prompts.conversation_text(m)).first()[0] == "System: be\n\nHuman: <image>hi\n\nAssistant:"
    llava = media.get_mm_plugin("llava", image_seqlen=3, image_token="<i>")
    assert chat.select(llava.process_messages(m)).first()[0][0]["content"] == "<i><i><i>hi"
    assert chat.select(media.placeholder_count(m, "<image>")).first()[0] == 1
    with pytest.raises(ValueError):
        media.register_mm_plugin("llava", media.LlavaPlugin)
    with pytest.raises(ValueError):
        media.get_mm_plugin("none")
    with pytest.raises(ValueError):
        media.get_mm_plugin("base", image_token=None).check_media(images=True)


# images:
def _image(pixels, path="p"):
    return (bytearray(im.encode(pixels)), path, pixels.shape[1], pixels.shape[0], "RGB")


def test_image_codec_and_resample():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (im.decode(im.encode(x)) == x).all()
    assert (resample(x, 5, 7) == x).all() and resample(x, 3, 2, "lanczos").shape == (2, 3, 3)
    assert (resample(np.full((8, 8, 1), 77, np.uint8), 3, 5, "bicubic") == 77).all()
    assert fitted_size(200, 100, (50, 50)) == (50, 25) and fitted_size(10, 10, (50, 50)) == (10, 10)


def test_image_transform(spark):
    x = np.zeros((40, 80, 3), np.uint8)
    x[..., 0] = 200
    bad = (bytearray(b"nothing"), "b", 1, 1, "RGB")
    df = spark.createDataFrame([(1, _image(x)), (2, None), (3, bad)], f"id int, image {im.IMAGE_TYPE}")
    out = run(df, {"type": "image_transform", "max_size": [20, 20]}).orderBy("id").collect()
    assert (out[0]["image"]["width"], out[0]["image"]["height"]) == (20, 10) and out[1]["image"] is None and out[2]["image"]["path"] == "b"
    steps = [{"type": "center_crop", "size": 8}, {"type": "grayscale"}, {"type": "color_jitter", "brightness": 1}]
    out = run(df, {"type": "image_transform", "transforms": steps, "skip_on_error": False}).orderBy("id").collect()
    assert [r["id"] for r in out] == [1, 2]
    assert im.decode(bytes(out[0]["image"]["bytes"]))[0, 0, 0] == 90  # 0.299 * 200, half as bright again
    t = run(df, {"type": "image_transform", "output_format": "tensor", "transforms": [{"type": "resize", "size": [2, 2], "mode": "exact"}, {"type": "normalize", "mean": [0.5] * 3, "std": [0.5] * 3}]}).where("id = 1").first()["image"]
    assert (t["channels"], t["height"], t["width"]) == (3, 2, 2) and t["values"][0] == pytest.approx(200 / 255 * 2 - 1, abs=1e-5)
    assert ids(run(df, {"type": "filter", "filter_corrupted_images": True})) == [1, 2]
    assert ids(run(df, {"type": "hf_filter", "max_image_size": [50, 50]})) == [2, 3]
    many = spark.createDataFrame([(1, [_image(x), _image(x[:10])]), (2, []), (3, None)], f"id int, images array<{im.IMAGE_TYPE}>")
    got = run(many, {"type": "image_transform", "image_fields": ["images"], "max_size": [20, 20]}).where("id = 1").first()["images"]
    assert [(i["width"], i["height"]) for i in got] == [(20, 10), (20, 2)]
    assert ids(run(many, {"type": "image_count_filter", "min_images": 1})) == [1]
    assert ids(run(many, {"type": "multimodal_filter", "require_images": True})) == [1]
    pruned = run(many, {"type": "multimodal_filter", "filter_corrupted_images": True, "min_image_size": [1, 20]}).where("id = 1").first()["images"]
    assert len(pruned) == 1


def test_safety_tag(spark):
    e = [[float(k == j) for k in range(4)] for j in range(4)]
    df = spark.createDataFrame([(1, [1.0, 0.5, 0.0, 0.0]), (2, [0.0, 0.0, 1.0, 0.5]), (3, [1.0, 0.0, 0.5, 0.0]), (4, None)], "id int, embedding array<double>")
    tag = safety_tag(F.col("embedding"), e[:2], e[2:], [])
    assert [r[0] for r in df.orderBy("id").select(tag).collect()] == ["UNLIKELY", "NSFW", "UNSURE", None]
    young = safety_tag(F.col("embedding"), e[:2], e[2:3], e[3:], 0.3)
    assert df.orderBy("id").select(young).collect()[1][0] == "UNDERAGE_RISK"
    spec = {"type": "image_toxicity_filter", "neutral_vectors": e[:2], "nsfw_vectors": e[2:]}
    assert ids(run(df, spec)) == [1, 4] and ids(run(df, spec | {"filter_unsure": False})) == [1, 3, 4]


def test_text_toxicity(spark):
    df = spark.createDataFrame([(1, "nice"), (2, "a toxic idea"), (3, ""), (4, None), (5, "HATE it")], "id int, text string")
    scorer = lambda t: {"toxicity": F.when(F.lower(t).rlike("toxic|hate"), 0.9).otherwise(0.1), "insult": F.lit(0.1)}
    f = lambda **k: ids(run(df, {"type": "text_toxicity_filter", **k}, scorers={"text": scorer}))
    assert f() == [1, 3, 4] and f(toxicity_threshold=0.9) == [1, 2, 3, 4, 5]
    assert f(filter_mode="all") == [1, 2, 3, 4, 5] and f(filter_mode="all", check_types=["toxicity"]) == [1, 3, 4]
    assert ids(run(df, {"type": "text_toxicity_filter", "toxicity_threshold": 0.4})) == [1, 2, 3, 4]  # the default lexicon


# sampling, packing:
def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "id")
    a, b = (ids(run(df.repartition(n), {"type": "random_sampler", "sample_size": 10})) for n in (1, 7))
    assert a == b and len(set(a)) == 10
    assert run(df, {"type": "random_sampler", "sample_size": 100}).count() == 100
    assert run(df, {"type": "random_sampler", "sample_size": 500}).count() == 100
    up = run(df, {"type": "random_sampler", "sample_size": 500, "allow_upsampling": True})
    assert up.count() == 500 and up.columns == ["id"]
    for bad in (0, -1, None, 1.5, True):
        with pytest.raises(ValueError):
            create_processor({"type": "random_sampler", "sample_size": bad})
    train, test = sampling.train_test_split(df.withColumn(ROW_ID, F.col("id")), 0.155)
    assert test.count() == 16 and train.count() == 84 and train.intersect(test).count() == 0
    assert sampling.train_test_split(df, 7, id="id")[1].count() == 7
    assert sampling.sample_dataset(df, 30).count() == 30 and sampling.step_count(100, 3, 2, 2) == 32
    with pytest.raises(ValueError):
        sampling.sample_dataset(df.where("false"), 3)
    with pytest.raises(ValueError):
        sampling.take_first(df, 0)


def _fold(rows, least, most, sep):
    packs, now, n = [], [], 0
    for t in rows:
        if not t:
            continue
        k = len(t.split())
        cost = k + (sep if now else 0)
        if now and n + cost > most:
            if n >= least:
                packs.append((now, n))
            now, n = [t], k
        else:
            now, n = [*now, t], n + cost
    if now:
        if n >= least or not packs or packs[-1][1] + sep + n > most:
            packs.append((now, n))
        else:
            packs[-1] = (packs[-1][0] + now, 0)
    return sorted("||".join(p) for p, _ in packs)


@pytest.mark.parametrize("seed", range(6))
def test_packer(spark, seed):
    rnd = random.Random(seed)
    rows = [rnd.choice([None, "", " ".join(["w"] * rnd.randint(1, 12)), " ".join(["v"] * rnd.randint(1, 30))]) for _ in range(rnd.randint(0, 30))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id long, text string")
    out = run(df, {"type": "sample_packer", "min_tokens": 12, "max_tokens": 20, "separator": "||"})
    assert sorted(r["text"] for r in out.collect()) == _fold(rows, 12, 20, 1)


# configuration, sources, sinks:
def test_config(tmp_path):
    cfg = load_config({"datasets": [{"path": "a"}], "x": 1}, ["datasets.0.path=b", "y.z=[1, 2]", "datasets.1.path=c"])
    assert cfg == {"datasets": [{"path": "b"}, {"path": "c"}], "x": 1, "y": {"z": [1, 2]}}
    (tmp_path / "c.yaml").write_text("a: {b: 1}\n")
    assert load_config(str(tmp_path / "c.yaml"), {"a.b": "2"}) == {"a": {"b": 2}}
    d = {}
    set_path(d, "a.b.c", 1)
    assert d == {"a": {"b": {"c": 1}}} and parse_split("train[10:5%]") == ("train", "10", "5%")
    with pytest.raises(ValueError):
        parse_split("a b")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("example1", 1), ("example2", 2)], "text string, n int").coalesce(1)
    for s in ("s1", "s2"):
        df.write.parquet(f"{tmp_path}/sets/{s}/train")
    df.write.json(f"{tmp_path}/lines.jsonl")
    df.write.csv(f"{tmp_path}/table.csv", header=True, sep=";")
    (tmp_path / "list.json").write_text('[{"text": "a"}, {"text": "b"}]')
    (tmp_path / "plain.txt").write_text("one\ntwo\n")
    n = lambda **spec: load_dataset(spark, spec).count()
    assert n(path=f"{tmp_path}/sets", subset="s1") == 2 and n(path=f"{tmp_path}/sets", subset=["s1", "s2"]) == 4
    assert n(path=f"{tmp_path}/sets", subset="_ALL") == 4 and n(path=f"{tmp_path}/sets", subset=["s1", "nope"]) == 2
    assert n(path=f"{tmp_path}/sets/s1", subset="nope") == 2
    assert n(path=f"{tmp_path}/sets", subset="s1", split="train[:1]") == 1 and n(path=f"{tmp_path}/sets", subset="s1", split="train[50%:]") == 1
    assert n(path=f"{tmp_path}/lines.jsonl") == 2 and n(path=f"{tmp_path}/list.json") == 2 and n(path=f"{tmp_path}/plain.txt") == 2
    got = load_dataset(spark, {"path": "csv", "data_files": [f"{tmp_path}/table.csv"], "delimiter": ";"})
    assert got.columns == ["text", "n"] and got.count() == 2
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics/a.png").write_bytes(im.encode(np.zeros((2, 2, 3), np.uint8)))
    assert n(path=f"{tmp_path}/pics") == 1


def test_prepare_and_save(spark, tmp_path):
    spark.createDataFrame([(k, f"text number {k} here") for k in range(20)], "id int, text string").write.parquet(f"{tmp_path}/in")
    cfg = {
        "datasets": [{"path": f"{tmp_path}/in", "limit": 10, "order_by": "id", "type": "completion", "processors": [{"type": "filter", "name": "f", "min_length": 3}, {"reference": "f"}, "f"]}, {"path": f"{tmp_path}/in", "type": "completion"}],
        "val_set_size": 0.1, "sequence_len": 64, "tokenizer_config": "native", "dataset_prepared_path": f"{tmp_path}/out", "count_steps": True, "micro_batch_size": 2, "num_epochs": 3,
    }
    done = prepare(spark, cfg)
    assert done.train.count() == 27 and done.test.count() == 3 and done.steps == 39
    paths = save_prepared(cfg, done.train, done.test)
    assert paths == [f"{tmp_path}/out/train_native_64", f"{tmp_path}/out/eval_native_64"] and spark.read.parquet(paths[0]).count() == 27
    assert prepared_path({"tokenizer_config": "a/b", "sequence_len": 64}, "eval") == "data/prepared/eval_a_b_64"
    assert prepared_path({}, "train") == "data/prepared/train_none_2048"
    cfg["hf_upload"] = {"enabled": True, "organization": "org", "dataset_name": "set-1", "license": "mit"}
    path = export(done.train, f"{tmp_path}/export", cfg)
    assert (tmp_path / "export/org/set-1/README.md").read_text().startswith("---\nlicense: mit") and spark.read.parquet(f"{path}/data").count() == 27
    with pytest.raises(ValueError):
        validate_export({"export": {"dataset_name": "x", "organization": "a b", "enabled": True}})
    assert validate_export({}) is None and size_category(5_000) == "1K<n<10K" and "rows: 3" in dataset_card("n", {}, {"rows": 3})


def test_errors(spark):
    df = spark.createDataFrame([(1, None), (2, "ValueError: no"), (3, "KeyError: k")], "id int, error string")
    good, summary = route_errors(df, "error", "log_and_continue")
    assert ids(good) == [1] and {r["error_type"] for r in summary.collect()} == {"ValueError", "KeyError"}
    with pytest.raises(Exception, match="no|k"):
        route_errors(df, "error", "raise")[0].collect()
    with pytest.raises(RuntimeError):
        route_errors(df, "error", "raise_after_k", 1)
    assert ids(route_errors(df, "error", "raise_after_k", 2)[0]) == [1]
    assert error_policy({"error_handling": "no such"}) == ("raise", 10)


def test_registry_and_stats(spark):
    from corpusmill.operators.pipeline import RowFunction, list_processors

    assert len(list_processors()) >= 17
    for bad in ({"type": "none"}, {"reference": "none"}, {"type": "pipeline"}):
        with pytest.raises(ValueError):
            create_processor(bad)
    df = spark.createDataFrame([(1, "ab"), (2, "abcdef")], "id int, text string")
    context = Context()
    out = apply_all(df, [{"type": "filter", "name": "len", "min_length": 4, "collect_stats": True}], context)
    assert out.count() == 1
    out.collect()
    assert context.metrics["len"].get == {"total": 2, "kept": 1, "filtered": 1}
    shout = RowFunction(lambda r: None if r["id"] == 1 else r | {"text": r["text"].upper()})
    assert [tuple(r) for r in shout(df).collect()] == [(2, "ABCDEF")]
    fails = lambda mode, k=10: RowFunction(lambda r: r if r["id"] == 2 else {"id": 1 // 0}, context=Context(error_mode=mode, max_errors=k))(df)
    assert ids(fails("log_and_continue")) == [2] and ids(fails("raise_after_k")) == [2]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        fails("raise").collect()
    with pytest.raises(RuntimeError):
        fails("raise_after_k", 0)


def test_vl_images(spark):
    big = np.zeros((40, 80, 3), np.uint8)
    chat = f"problem string, solution string, image {im.IMAGE_TYPE}"
    df = spark.createDataFrame([("<image>q", "a", _image(big)), ("q", "a", None), ("q", "a", (None, "x", 0, 0, None))], chat)
    cfg = {"sequence_len": 50, "vl_config": {"image_processing": {"max_size": [20, 20]}}}
    got = load_strategy("vl", TOK, cfg)(df).collect()
    assert len(got) == 2 and (got[0]["images"][0]["width"], got[0]["images"][0]["height"]) == (20, 10)
    assert got[0]["metadata"]["num_images"] == 1 and got[1]["metadata"]["num_images"] == 0


def test_cli(spark, tmp_path, capsys):
    from corpusmill import cli

    df = spark.createDataFrame([(k, f"text {k}") for k in range(5)], "id int, text string")
    df.write.parquet(f"{tmp_path}/in")
    (tmp_path / "c.yaml").write_text(f"datasets:\n- path: {tmp_path}/in\n  filter_only: true\n  type: completion\ndataset_prepared_path: {tmp_path}/out\n")
    assert cli.main([str(tmp_path / "c.yaml"), "sequence_len=16", "--limit", "3", "--debug-num-examples", "1"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/train_none_16").count() == 3 and "train_none_16" in capsys.readouterr().out


def test_batches():
    import pyarrow as pa

    from corpusmill.functions import batches

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab1 .é\t\u00a0😀") for _ in range(rnd.randint(0, 30))) for _ in range(200)] + [None, ""]
    toks = [re.findall(r"(?a)[A-Za-z0-9]+|[^A-Za-z0-9\s]", t or "") for t in texts]
    assert batches.token_counts(pa.array(texts)).tolist() == list(map(len, toks))
    data, offs = batches.text_bytes(pa.array(texts))
    got: list[list[str]] = [[] for _ in texts]
    for a, b, k in zip(*batches.token_spans(data, offs)):
        got[k].append(data[a:b].tobytes().decode())
    assert got == toks
    sets = batches.gram_sets(pa.array(texts), 3)
    assert [len(s) for s in sets] == [len({tuple(t[k : k + 3]) for k in range(len(t) - 2)}) for t in toks]


def test_stream(spark, tmp_path):
    from corpusmill.streaming import stream

    df = spark.createDataFrame([("keep this one",), ("no",), ("keep this one",)], "text string").withColumn("ts", F.current_timestamp())
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = stream.read_stream(spark, "parquet", f"{tmp_path}/in", df.schema)
    out = stream.drop_repeats(stream.apply_stream(live, [{"type": "filter", "min_length": 5}]))
    stream.write_stream(out, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    with pytest.raises(ValueError):
        stream.apply_stream(live, [{"type": "pipeline", "processors": [{"type": "deduplicator"}]}])


def test_containment_pairs_are_complete(spark):
    rnd = random.Random(9)
    sets = [sorted(rnd.sample(range(60), rnd.randint(1, 25))) for _ in range(40)]
    df = spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(sets)], f"{ROW_ID} long, grams array<long>, size int")
    got = {(r["i"], r["j"]) for r in dedup.containment_pairs(df, 55).collect()}
    assert got == {(i, j) for j in range(40) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) / min(len(sets[i]), len(sets[j])) >= 55}
