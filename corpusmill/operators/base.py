"""What a processor is: a configured DataFrame -> DataFrame step, bound to a schema when it is applied."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import TokenizerSpec
from ..functions.values import condition

LOG = logging.getLogger(__name__)
ROW_ID = "_row_id"


@dataclass
class Context:
    """What a run gives its processors: the tokenizer, the order column, named instances, scorers, metrics."""

    tokenizer: TokenizerSpec | None = None
    order_by: str | None = None
    instances: dict[str, Processor] = field(default_factory=dict)
    scorers: dict[str, object] = field(default_factory=dict)
    metrics: dict[str, Observation] = field(default_factory=dict)
    reports: dict[str, dict] = field(default_factory=dict)
    error_mode: str = "raise"
    max_errors: int = 10
    strict_empty: bool = False

    def observe(self, name: str, df: DataFrame, *aggregates: Column) -> DataFrame:
        """Counts that come with the run's own job, never by one more."""
        key, n = name, 1
        while key in self.metrics:
            n += 1
            key = f"{name}-{n}"
        self.metrics[key] = Observation(key)
        return df.observe(self.metrics[key], *aggregates)

    def stats(self) -> dict[str, dict]:
        """The counts of each step, once an action has run, with the rates that follow from them."""
        out = {}
        for key, observed in self.metrics.items():
            n = dict(observed.get)
            if n.get("total") is not None and "filtered" in n:
                rate = n["filtered"] / n["total"] if n["total"] else 0.0
                n |= {"filter_rate": rate, "keep_rate": 1.0 - rate}
            out[key] = n
        return out


class Processor:
    """``transform`` does the work on the rows that meet the condition; the others are kept as they are."""

    type = ""

    def __init__(self, config: dict | None = None, context: Context | None = None):
        self.config = dict(config or {})
        self.context = context or Context()
        self.name = self.config.get("name") or self.type

    def required_columns(self) -> list[str]:
        return []

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def skips(self, df: DataFrame) -> bool:
        """A step whose required columns are missing leaves the rows unchanged."""
        missing = [c for c in self.required_columns() if c not in df.columns]
        if missing:
            LOG.warning("%s is skipped: no column %s", self.name, missing)
        return bool(missing)

    def __call__(self, df: DataFrame) -> DataFrame:
        cond = condition(df, self.config.get("condition"))
        if cond is False or self.skips(df):
            return df
        if cond is True:
            return self.transform(df)
        return self.transform(df.where(cond)).unionByName(df.where(~cond), allowMissingColumns=True)


class Filter(Processor):
    """A row predicate: a condition widens it, so that it stays one filter that Catalyst can push."""

    def keep(self, df: DataFrame) -> Column | None:
        """True for rows that stay, never null; None keeps all."""
        raise NotImplementedError

    def counts(self, df: DataFrame, keep: Column) -> list[Column]:
        return [F.count("*").alias("total"), F.count(F.when(keep, 1)).alias("kept"), F.count(F.when(~keep, 1)).alias("filtered")]

    def __call__(self, df: DataFrame) -> DataFrame:
        cond = condition(df, self.config.get("condition"))
        if cond is False or self.skips(df):
            return df
        keep = self.keep(df)
        if keep is None:
            return df
        keep = keep if cond is True else ~cond | keep
        if self.config.get("collect_stats", False) and not df.isStreaming:
            df = self.context.observe(self.name, df, *self.counts(df, keep))
        return df.where(keep)

    transform = __call__


class Passthrough(Processor):
    type = "passthrough"

    def __call__(self, df: DataFrame) -> DataFrame:
        return df


def with_row_id(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Adds ROW_ID, by which "first" is meant: an integer order column itself, else the order of any other column, or
    the order read; these two are fixed by a checkpoint, as they would change if a lost partition were read again."""
    if ROW_ID in df.columns:
        return df
    if order_by and isinstance(df.schema[order_by].dataType, T.IntegralType):
        return df.withColumn(ROW_ID, F.col(f"`{order_by}`").cast("long"))
    from ..storage import shared_dir

    shared_dir(df.sparkSession)
    ordered = df.sort(F.col(f"`{order_by}`")) if order_by else df
    return ordered.withColumn(ROW_ID, F.monotonically_increasing_id()).checkpoint()
