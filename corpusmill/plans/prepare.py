"""``prepare``: load, process, tokenize, concatenate, split; one lazy plan until something is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.tokens import TokenizerSpec, load_tokenizer
from ..operators.base import ROW_ID, Context, with_row_id
from ..operators.errors import error_policy
from ..operators.pipeline import apply_all
from ..operators.sampling import step_count, take_first, train_test_split
from ..sources.load import concat_datasets, load_dataset
from ..sources.save import save_prepared
from .strategies import load_strategy

@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame | None
    steps: int | None
    context: Context


def prepare_one(spark: SparkSession, cfg: dict, spec: dict, context: Context, limit: int | None = None) -> DataFrame:
    df = load_dataset(spark, spec)
    most = spec.get("limit", limit)
    if most is not None:
        df = take_first(df, most, spec.get("order_by") or context.order_by)
    df = apply_all(df, spec.get("processors") or [], context)
    if spec.get("type") and not spec.get("filter_only", cfg.get("filter_only", False)):
        strategy = load_strategy(spec["type"], context.tokenizer or TokenizerSpec(), cfg, spec)
        if strategy is not None:
            df = strategy(df)
    return df


def prepare(spark: SparkSession, cfg: dict, limit: int | None = None, scorers: dict | None = None) -> Prepared:
    """The datasets of a configuration, concatenated in order and split by ``val_set_size``."""
    if not cfg.get("datasets"):
        raise ValueError("the configuration has no datasets")
    tokenizer = load_tokenizer(cfg) if cfg.get("tokenizer_file") or cfg.get("tokenizer_config") or cfg.get("base_model") else None
    mode, most = error_policy(cfg)
    context = Context(tokenizer=tokenizer, order_by=cfg.get("order_by"), scorers=scorers or {}, error_mode=mode, max_errors=most, strict_empty=bool(cfg.get("strict_empty", True)))
    limit = limit if limit is not None else cfg.get("limit")
    train = concat_datasets([prepare_one(spark, cfg, spec, context, limit) for spec in cfg["datasets"]])
    test = None
    if cfg.get("val_set_size"):
        train, test = train_test_split(with_row_id(train, by if (by := cfg.get("order_by")) in train.columns else None), cfg["val_set_size"], int(cfg.get("seed", 42)))
        train, test = train.drop(ROW_ID), test.drop(ROW_ID)
    steps = None
    if cfg.get("count_steps"):
        steps = step_count(train.count(), int(cfg.get("micro_batch_size", 1)), int(cfg.get("gradient_accumulation_steps", 1)), int(cfg.get("num_epochs", 1)))
    return Prepared(train, test, steps, context)


def run(spark: SparkSession, cfg: dict, limit: int | None = None) -> list[str]:
    """Prepares and saves; the paths that were written."""
    done = prepare(spark, cfg, limit)
    return save_prepared(cfg, done.train, done.test)


def load_datasets(cfg: dict, spark: SparkSession | None = None, limit: int | None = None) -> Prepared:
    return prepare(spark or SparkSession.builder.getOrCreate(), cfg, limit)
