"""Prompt strategies: input_ids, attention_mask and labels as expressions around a tokenizer."""

from __future__ import annotations

import importlib
import importlib.util
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import checked_all
from ..functions.media import get_mm_plugin, placeholders_match
from ..functions.prompts import build_prompt, chat_text, conversation_text, template_of
from ..functions.tokens import TokenizerSpec
from ..functions.values import column, computed_once, field, free_name
from ..operators.filters import size_within
from ..operators.images import ImageTransform
from ..operators.mapping import MESSAGES, first_truthy, messages_of
from .processor import load_processor

LOG = logging.getLogger(__name__)
IGNORE = -100
NO_IDS = "array<int>"
Strategy = Callable[[DataFrame], DataFrame]
_strategies: dict[str, Callable[[TokenizerSpec, dict, dict], Strategy]] = {}


def register_strategy(name: str, load: Callable[[TokenizerSpec, dict, dict], Strategy]) -> None:
    _strategies[name] = load


def load_strategy(name: str, tokenizer: TokenizerSpec, cfg: dict, dataset: dict | None = None) -> Strategy | None:
    """A registered strategy, or ``package.module:function`` (by default ``load``); None, with a warning, if there is none."""
    load = _strategies.get(name)
    if load is None and "." in name:
        module, _, function = name.partition(":")
        if importlib.util.find_spec(module.split(".")[0]) is not None:
            load = getattr(importlib.import_module(module), function or "load", None)
    if load is None:
        LOG.warning("no prompt strategy is named %s", name)
        return None
    return load(tokenizer, cfg, dataset or {})


def tokenize(text: Column, spec: TokenizerSpec, most: int, add_eos: bool = True, strip_bos: bool = False, eos_past_end: bool = False) -> Column:
    """Ids cut to ``most``, with EOS if it isn't there and has room; an empty text has none."""
    ids = F.coalesce(spec.ids(text, most), F.array().cast(NO_IDS))
    if add_eos:
        room = F.lit(True) if eos_past_end else F.size(ids) < most
        ids = F.when((F.size(ids) > 0) & ~F.coalesce(F.try_element_at(ids, F.lit(-1)) == spec.eos_id, F.lit(False)) & room, F.concat(ids, F.array(F.lit(spec.eos_id)))).otherwise(ids)
    if strip_bos and spec.bos_id is not None:
        ids = F.when(F.try_element_at(ids, F.lit(1)) == spec.bos_id, F.slice(ids, 2, most)).otherwise(ids)
    return ids


def masked(ids: Column, n: Column) -> Column:
    """Labels: the first n ids are ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORE), F.least(n, F.size(ids))), F.slice(ids, n + 1, F.greatest(F.size(ids), F.lit(1))))


def _with_ids(df: DataFrame, text: Column, spec: TokenizerSpec, most: int, prompt: Column | None = None, **how) -> DataFrame:
    df = computed_once(df, "input_ids", tokenize(text, spec, most, **how))
    ids = F.col("input_ids")
    labels = ids if prompt is None else masked(ids, F.least(F.coalesce(spec.count(prompt), F.lit(0)), F.lit(most)))
    # an empty text has no labels at all
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(ids))).withColumn("labels", F.when(F.size(ids) > 0, labels))


OUT = ("input_ids", "attention_mask", "labels")


def _opt(df: DataFrame, name: str) -> Column | None:
    return column(name).cast("string") if field(df, name) is not None else None


def instruction(style: str):
    def load(spec: TokenizerSpec, cfg: dict, dataset: dict) -> Strategy:
        most, whole = int(cfg.get("sequence_len", 2048)), bool(cfg.get("train_on_inputs", False))

        def run(df: DataFrame) -> DataFrame:
            if field(df, "instruction") is None:
                raise KeyError("instruction")
            ask, given, say = (_opt(df, c) for c in ("instruction", "input", "output"))
            prompt = None if whole else build_prompt(style, ask, given)
            keep = [c for c in dataset.get("keep_columns") or [] if c in df.columns]
            return _with_ids(df, build_prompt(style, ask, given, say), spec, most, prompt).select(*keep, *OUT)

        return run

    return load


def completion(spec: TokenizerSpec, cfg: dict, dataset: dict) -> Strategy:
    def run(df: DataFrame) -> DataFrame:
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        name = next((c for c in ("text", "content", *strings) if c in df.columns), None)
        if name is None:
            raise ValueError("no text column")
        keep = [c for c in dataset.get("keep_columns") or [] if c in df.columns]
        return _with_ids(df, column(name).cast("string"), spec, int(cfg.get("sequence_len", 2048))).select(*keep, *OUT)

    return run


def chat_template(spec: TokenizerSpec, cfg: dict, dataset: dict) -> Strategy:
    """Messages rendered by a template (``chat_template``: a name, or parts); every token is trained on; EOS is added also past the limit."""
    parts = template_of(dataset.get("chat_template") or cfg.get("chat_template") or "chatml")

    def run(df: DataFrame) -> DataFrame:
        name = next((c for c in ("messages", "conversations") if c in df.columns), None)
        if name is None:
            raise ValueError("no messages or conversations column")
        keep = [c for c in dataset.get("keep_columns") or [] if c in df.columns]
        return _with_ids(df, chat_text(column(name), parts), spec, int(cfg.get("sequence_len", 2048)), eos_past_end=True).select(*keep, *OUT)

    return run


def vision_language(spec: TokenizerSpec, cfg: dict, dataset: dict) -> Strategy:
    """Messages or question and answer with media.

    A row whose images all fail the gate (unreadable, of no size, or too small) is left
    out; one that has no question or answer, or as many placeholders as it hasn't media,
    is an empty row with an error.  Images are brought within ``max_size``, or within a
    budget of pixels, by the step after the gate.
    """
    most = int(cfg.get("sequence_len", 2048))
    gate = dict((cfg.get("vl_config") or {}).get("image_processing") or {})
    if dataset.get("filter_corrupted_images"):
        gate["verify_images"] = True
    if dataset.get("max_image_size"):
        gate["max_size"] = dataset["max_image_size"]
    name = dataset.get("mm_plugin", "base")
    processor = load_processor(cfg)
    options = {"image_seqlen": int(dataset["image_seqlen"])} if dataset.get("image_seqlen") else {}
    options |= processor.plugin_options() if processor else {}
    options |= {k: dataset[k] for k in ("patch_size", "additional_tokens", "feature_strategy", "image_size") if dataset.get(k) is not None}
    plugin = get_mm_plugin(name, image_token=dataset.get("image_token", "<image>"), video_token=dataset.get("video_token", "<video>"), audio_token=dataset.get("audio_token", "<audio>"), **options)

    def run(df: DataFrame) -> DataFrame:
        given = df
        if "messages" in df.columns:
            messages = column("messages")
        else:
            q, a = (first_truthy(df, f) for f in (["problem", "question", "original_question"], ["solution", "answer", "original_answer"]))
            missing = F.lit(None).cast(MESSAGES)
            messages = missing if q is None or a is None else F.when(q.isNotNull() & a.isNotNull(), messages_of(q, a)).otherwise(missing)
        many = lambda c: F.coalesce(column(c), F.array().cast(field(given, c))) if isinstance(field(given, c), T.ArrayType) else F.array().cast("array<string>")
        one = field(df, "image")
        images = F.when(column("image").isNotNull(), F.array(column("image"))).otherwise(many("images") if isinstance(field(df, "images"), T.ArrayType) else F.array().cast(T.ArrayType(one))) if one is not None else many("images")
        plugin.check_media(images=any(field(df, c) is not None for c in ("image", "images")), videos=field(df, "videos") is not None, audios=field(df, "audios") is not None)
        m, raw, good, videos, audios, checks, error, ids = (free_name(df, f"vl_{n}") for n in ("messages", "raw", "images", "videos", "audios", "checks", "error", "ids"))
        df = df.select("*", messages.alias(m), images.alias(raw), many("videos").alias(videos), many("audios").alias(audios))
        kind = df.schema[raw].dataType.elementType
        if isinstance(kind, T.StructType):
            verifies = gate.get("verify_images", True)

            def passes(x: Column) -> Column:
                sized = x["readable"] & (x["width"] > 0) & (x["height"] > 0) if verifies else F.lit(True)
                return F.coalesce(sized & size_within(x, gate.get("min_size"), None), F.lit(False))

            df = computed_once(df, checks, checked_all(F.col(raw), whole=verifies))
            sized = lambda x, c: F.struct(x["bytes"].alias("bytes"), x["path"].alias("path"), *(c[k].alias(k) for k in ("width", "height", "mode")))
            kept = F.filter(F.zip_with(raw, checks, lambda x, c: F.struct(sized(x, c).alias("x"), (x.isNotNull() & passes(c)).alias("ok"))), lambda p: p["ok"])
            df = df.withColumn(good, F.transform(kept, lambda p: p["x"]))
            budget = {"max_pixels": gate.get("image_max_pixels"), "min_pixels": gate.get("image_min_pixels")}
            if any(budget.values()):
                df = ImageTransform({"image_fields": [good], "transforms": [{"type": "regular", **budget}]})(df)
            if gate.get("max_size"):
                df = ImageTransform({"image_fields": [good], "max_size": list(gate["max_size"])})(df)
        else:
            df = df.withColumn(good, F.filter(raw, lambda x: x.isNotNull()))
        if gate.get("verify_images", True):
            df = df.where(~((F.size(raw) > 0) & (F.size(good) == 0)))
        fault = F.when(F.col(m).isNull(), "missing question or answer").when(~placeholders_match(F.col(m), F.col(good), F.col(videos), F.col(audios)), "placeholders and media differ in number")
        sized_images = F.col(good) if isinstance(kind, T.StructType) else None
        text = F.when(fault.isNull(), conversation_text(plugin.process_messages(F.col(m), sized_images)))
        df = computed_once(df.withColumn(error, fault), ids, F.coalesce(spec.ids(text), F.array().cast(NO_IDS)))
        cut, none = F.slice(ids, 1, most), F.col(error).isNotNull()
        media = [F.when(none, F.slice(c, 1, 0)).otherwise(F.col(c)) for c in (good, videos, audios)]
        meta = F.struct(F.size(ids).alias("original_length"), (F.size(ids) > most).alias("truncated"), *(F.size(c).alias(n) for c, n in zip((good, videos, audios), ("num_images", "num_videos", "num_audios"))), F.lit(name).alias("mm_plugin"), F.col(error).alias("error"))
        keep = [c for c in dataset.get("keep_columns") or [] if c in given.columns]
        return df.select(*keep, cut.alias("input_ids"), F.array_repeat(F.lit(1), F.size(cut)).alias("attention_mask"), cut.alias("labels"), *(x.alias(n) for x, n in zip(media, ("images", "videos", "audios"))), meta.alias("metadata"))

    return run


def filter_only(spec: TokenizerSpec, cfg: dict, dataset: dict) -> Strategy:
    return lambda df: df


for _name in ("alpaca", "chatml", "vicuna"):
    register_strategy(_name, instruction(_name))
register_strategy("completion", completion)
register_strategy("chat_template", chat_template)
for _name in ("vision_language", "vl"):
    register_strategy(_name, vision_language)
register_strategy("filter_only", filter_only)
