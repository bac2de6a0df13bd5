"""Tokenizers, processors, uploads, error modes and empty results, by small files that the tests write."""

import json
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import Context, TokenizerSpec, apply_all
from corpusmill.functions import images as im
from corpusmill.functions.device import pick_device
from corpusmill.functions.tokens import load_tokenizer, native_id
from corpusmill.operators import overlap
from corpusmill.operators.pipeline import RowFunction
from corpusmill.plans.prepare import prepare
from corpusmill.plans.processor import load_processor
from corpusmill.plans.strategies import load_strategy
from corpusmill.sources.save import debug_rows, find_token, upload

WORDS = ["<unk>", "<s>", "</s>", "<|im_end|>", "the", "cat", "sat"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tmp_path_factory.mktemp("model")
    t = Tokenizer(models.WordLevel({w: k for k, w in enumerate(WORDS)}, unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(str(path / "tokenizer.json"))
    (path / "tokenizer_config.json").write_text(json.dumps({"eos_token": {"content": "</s>"}, "bos_token": "<s>", "padding_side": "left"}))
    (path / "preprocessor_config.json").write_text(json.dumps({"size": {"shortest_edge": 28}, "crop_size": {"width": 28, "height": 14}, "image_mean": [0.5] * 3, "image_std": [0.5] * 3}))
    (path / "processor_config.json").write_text(json.dumps({"patch_size": 7, "num_additional_image_tokens": 1, "vision_feature_select_strategy": "default"}))
    return str(path)


def test_tokenizer_of_a_folder(spark, folder):
    spec = load_tokenizer({"base_model": folder})
    assert (spec.eos_id, spec.bos_id, spec.pad_id, spec.padding, spec.padding_side) == (2, 1, None, 2, "left")
    other = load_tokenizer({"base_model": "no/where", "tokenizer_config": folder, "special_tokens": {"eos_token": "<|im_end|>", "pad_token": "</s>"}, "tokenizer_pad_side": "right"})
    assert (other.eos_id, other.pad_id, other.padding_side) == (3, None, "right")
    df = spark.createDataFrame([(1, "the cat sat down"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r for r in df.select("id", spec.ids(F.col("text"), 3).alias("ids"), spec.count(F.col("text")).alias("n"), spec.tokens(F.col("text")).alias("t")).collect()}
    assert (got[1]["ids"], got[1]["n"], got[1]["t"]) == ([4, 5, 6], 4, ["the", "cat", "sat", "<unk>"])
    assert (got[2]["ids"], got[2]["n"]) == (None, None) and (got[3]["ids"], got[3]["n"]) == ([], 0)
    run = load_strategy("completion", spec, {"sequence_len": 8})(df).collect()
    assert [r["input_ids"] for r in run] == [[4, 5, 6, 0, 2], [], []]
    assert debug_rows(load_strategy("completion", spec, {"sequence_len": 8})(df), 1, tokenizer=spec) == [{"input_ids": [4, 5, 6, 0, 2], "text": "the cat sat <unk> </s>"}]
    added = load_tokenizer({"tokenizer_config": folder, "tokens": ["<x>"], "special_tokens": {"eos_token": "<x>"}})
    assert added.eos_id == len(WORDS)
    grams = df.select(spec.gram_hashes(F.col("text"), 2).alias("g")).collect()
    assert [None if r["g"] is None else len(r["g"]) for r in grams] == [3, None, 0]


def test_tokenizers_that_cannot_be_loaded(folder, tmp_path):
    with pytest.raises(ValueError, match="can't be loaded"):
        load_tokenizer({"base_model": "some/model", "special_tokens": {"eos_token": "<|im_end|>"}})
    with pytest.raises(ValueError, match="isn't in the vocabulary"):
        load_tokenizer({"tokenizer_config": folder, "special_tokens": {"eos_token": "<none>"}})
    assert load_tokenizer({"tokenizer_config": "native", "special_tokens": {"eos_token": "<|im_end|>", "bos_token": 7}}).eos_id == native_id("<|im_end|>", 1_000_000)
    assert load_tokenizer({}) == TokenizerSpec()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_public_vocabularies(spark, name):
    public = pytest.importorskip("public_tokenizers")
    texts = ["The cat's 12 mats.", "", "été  and\nmore", None]
    spec = TokenizerSpec(path=public.path(name))
    known = spec.loaded()
    got = [r["ids"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spec.ids(F.col("t")).alias("ids")).collect()]
    assert got == [None if t is None else list(known.ids([t])[0]) for t in texts]
    assert known.decode(got[0]) == texts[0]


def test_processor(spark, folder):
    p = load_processor({"processor_type": "AutoProcessor", "base_model": folder})
    assert (p.image_size, p.patch_size, p.additional_tokens, p.feature_strategy) == ((28, 14), 7, 1, "default")
    assert load_processor({}) is None and load_processor({"processor_type": "x", "base_model": "no/where"}) is None
    chat = spark.createDataFrame([([("user", "<image>hi")], [(im.encode(np.zeros((3, 4, 3), np.uint8)), "p", None, None, None)])], f"messages array<struct<role: string, content: string>>, images array<{im.IMAGE_TYPE}>")
    cfg = {"processor_type": "AutoProcessor", "base_model": folder, "sequence_len": 100}
    got = load_strategy("vl", TokenizerSpec(), cfg, {"mm_plugin": "llava"})(chat).first()
    assert list(got["input_ids"]).count(native_id("image", 1_000_000)) == 4 * 2 + 1 - 1 and (got["images"][0]["width"], got["images"][0]["height"]) == (4, 3)


def test_headers_and_checks(spark):
    rnd = np.random.default_rng(1)
    png = im.encode(rnd.integers(0, 256, (5, 7, 3), np.uint8))
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + b"\0" * 9 + b"\xff\xd9"
    files = {"png": (png, (7, 5, "RGB")), "pgm": (b"P5\n2 3\n255\nabcdef", (2, 3, "L")), "gif": (b"GIF89a\x05\x00\x06\x00", (5, 6, "P")), "jpeg": (jpeg, (32, 16, "RGB")), "bmp": (b"BM" + b"\0" * 16 + (9).to_bytes(4, "little") + (8).to_bytes(4, "little"), (9, 8, "RGB")), "no": (b"text", None)}
    for name, (data, want) in files.items():
        assert im.header(data) == want, name
    rows = [(1, (png, "p", None, None, None)), (2, (png[:-3], "p", None, None, None)), (3, (None, "p", 4, 5, "L")), (4, None), (5, (b"text", "p", None, None, None))]
    df = spark.createDataFrame(rows, f"id int, image {im.IMAGE_TYPE}")
    got = {r["id"]: r["c"] and tuple(r["c"]) for r in df.select("id", im.checked(F.col("image")).alias("c")).collect()}
    assert got == {1: (7, 5, "RGB", True), 2: (7, 5, "RGB", False), 3: (4, 5, "L", True), 4: None, 5: (None, None, None, False)}
    small = {"min_image_size": [100, 100], "filter_corrupted_images": True}
    for kind in ("hf_filter", "multimodal_filter"):
        assert [r["id"] for r in apply_all(df, [{"type": kind, **small}]).collect()] == [4]


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import struct
    import zlib

    rnd = np.random.default_rng(kind)
    x = rnd.integers(0, 256, (6, 5, 3), np.uint8)
    flat, lines = x.reshape(6, -1).astype(int), []
    for y in range(6):
        above = flat[y - 1] if y else np.zeros(15, int)
        left, corner = (np.concatenate([np.zeros(3, int), r[:-3]]) for r in (flat[y], above))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines.append(bytes([kind]) + ((flat[y] - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (im.decode(data) == x).all() and im.verify(data) and not im.verify(data[:-20])


def test_empty_results_are_errors(spark, tmp_path):
    spark.createDataFrame([(1, "short")], "id int, text string").write.parquet(f"{tmp_path}/in")
    cfg = {"datasets": [{"path": f"{tmp_path}/in", "processors": [{"type": "filter", "min_length": 100}]}]}
    with pytest.raises(ValueError, match="leaves no row"):
        prepare(spark, cfg)
    assert prepare(spark, cfg | {"strict_empty": False}).train.count() == 0
    none = spark.createDataFrame([], "id int, text string")
    assert apply_all(none, [{"type": "filter", "min_length": 100}], Context(strict_empty=True)).count() == 0


def test_a_function_runs_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def counted(row):
        with open(calls, "a") as f:
            f.write("x")
        return {"error": 1 // row["error"]}

    df = spark.createDataFrame([(0,), (1,), (1,)], "error int")
    step = RowFunction(counted, context=Context(error_mode="raise_after_k", max_errors=1))
    assert step(df).count() == 2 and {r["error_type"]: r["count"] for r in step.errors.collect()} == {"ZeroDivisionError": 1}
    assert calls.read_text() == "xxx"


def test_upload_and_token(monkeypatch, tmp_path):
    monkeypatch.setenv("HF_HOME", str(tmp_path))
    monkeypatch.delenv("HF_TOKEN", raising=False)
    with pytest.raises(ValueError, match="needs a token"):
        find_token()
    (tmp_path / "token").write_text("saved\n")
    assert find_token() == "saved" and find_token("given") == "given"
    monkeypatch.setenv("HF_TOKEN", "env")
    assert find_token() == "env"
    sent = []
    api = lambda token: types.SimpleNamespace(create_repo=lambda n, **k: sent.append((token, n, k["private"])), upload_folder=lambda **k: sent.append(k["folder_path"]))
    cfg = {"hf_upload": {"enabled": True, "organization": "o", "dataset_name": "d", "private": True}}
    monkeypatch.setitem(sys.modules, "huggingface_hub", None)
    with pytest.raises(RuntimeError, match="isn't installed"):
        upload("/x", cfg)
    monkeypatch.setitem(sys.modules, "huggingface_hub", types.SimpleNamespace(HfApi=api))
    assert upload("file:/x", cfg, "t") == "o/d" and sent == [("t", "o/d", True), "/x"]
    with pytest.raises(ValueError):
        upload("/x", {})


def test_strategies_by_module(spark):
    df = spark.range(5)
    assert load_strategy("corpusmill.plans.strategies:filter_only", TokenizerSpec(), {})(df).count() == 5
    assert load_strategy("no_such.module", TokenizerSpec(), {}) is None and load_strategy("none", TokenizerSpec(), {}) is None
    assert load_strategy("corpusmill.plans.strategies:no_such", TokenizerSpec(), {}) is None


def test_device():
    assert pick_device("cuda:1") == "cuda:1" and pick_device() in ("cpu", "cuda", "xpu", "mps")


def test_tokens_keep_64_bits():
    for parts in (1, 2, 51, 256, 1000, 70_000):
        g = np.sort(np.random.default_rng(parts).integers(0, 1 << 64, 2000, np.uint64))
        bits = overlap.range_bits(parts)
        number = (g >> np.uint64(64 - bits)).astype(int)
        for k in np.unique(number):
            x = g[number == k]
            data = overlap.cut(x, bits)
            assert len(data) == len(x) * (8 - bits // 8) and (overlap.whole(np.frombuffer(data, np.uint8), int(k), bits) == x).all()


@pytest.mark.parametrize("parts", [2, 8, 100])
def test_containment_whatever_the_partitions(spark, monkeypatch, parts):
    """Families that share most tokens, with tokens that are frequent in every slice."""
    from corpusmill.operators import dedup

    monkeypatch.setattr(overlap, "FREQUENT_LEAST", 4)
    monkeypatch.setattr(overlap, "SLICE", 300)
    rnd = np.random.default_rng(parts)
    base = [rnd.integers(0, 1 << 40, 60) for _ in range(4)]
    sets = [sorted({*rnd.choice(base[k % 4], rnd.integers(5, 50)).tolist(), *rnd.integers(0, 1 << 40, rnd.integers(0, 20)).tolist()}) for k in range(60)] + [[5], [5], [6]]
    df = spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(sets)], "_row_id long, grams array<long>, size int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r["i"], r["j"]): (r["shared"], r["size_i"], r["size_j"]) for r in dedup.containment_pairs(df, 40).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    both = lambda i, j: len(set(sets[i]) & set(sets[j]))
    want = {(i, j): (both(i, j), len(sets[i]), len(sets[j])) for j in range(len(sets)) for i in range(j) if 100 * both(i, j) / min(len(sets[i]), len(sets[j])) >= 40}
    assert got == want and len(want) > 50
