"""What becomes of rows that fail."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
ERROR_MODES = ("raise", "log_and_continue", "raise_after_k")


def error_policy(cfg: dict) -> tuple[str, int]:
    """An unknown mode means raise."""
    given = cfg.get("error_handling") or {}
    given = {"mode": given} if isinstance(given, str) else given
    mode = given.get("mode", cfg.get("error_handling_mode", "raise"))
    if mode not in ERROR_MODES:
        LOG.warning("unknown error mode %s: raise", mode)
        mode = "raise"
    return mode, int(given.get("max_errors", cfg.get("max_errors", 10)))


def route_errors(df: DataFrame, error: str, mode: str = "raise", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(good rows, count of rows by error) of a table whose column ``error`` says what failed.

    ``raise`` fails the job at the first bad row; ``raise_after_k`` counts first, and
    fails if there are more than k; otherwise bad rows are left out.
    """
    bad = df.where(F.col(error).isNotNull())
    summary = bad.groupBy(F.split_part(error, F.lit(":"), F.lit(1)).alias("error_type")).count()
    if mode == "raise":
        checked = F.when(F.col(error).isNotNull(), F.raise_error(F.col(error)).cast("boolean")).otherwise(F.lit(True))
        return df.where(checked).drop(error), summary
    if mode == "raise_after_k" and bad.limit(most + 1).count() > most:
        raise RuntimeError(f"more than {most} rows failed")
    return df.where(F.col(error).isNull()).drop(error), summary
