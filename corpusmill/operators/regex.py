"""``regex_filter`` and ``regex_transform``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regex import parse_flags, search, substitute
from ..functions.values import column, condition, field
from .base import Filter, Processor

DEFAULT_FLAGS = ["MULTILINE"]
ACTIONS = ("remove", "keep", "keep_only")


class RegexFilter(Filter):
    """Each pattern votes to take a row out: ``remove`` if it occurs, ``keep`` and ``keep_only`` if it doesn't.

    A null field votes no, whatever the action.  Votes are combined by ``any`` or
    ``all`` and may be inverted.  If a pattern's column is missing the step is skipped.
    """

    type = "regex_filter"

    def __init__(self, config=None, context=None):
        super().__init__(config, context)
        patterns = self.config.get("filter_patterns") or []
        self.mode = str(self.config.get("logic_mode", "any")).lower()
        if not patterns:
            raise ValueError("regex_filter needs filter_patterns")
        if self.mode not in ("any", "all"):
            raise ValueError("logic_mode must be any or all")
        flags = parse_flags(self.config.get("default_flags", DEFAULT_FLAGS))
        self.patterns: list[tuple[str, str, str, int, str]] = []
        for n, p in enumerate(patterns):
            action = str(p.get("action", "remove")).lower()
            if not p.get("field") or not p.get("pattern") or action not in ACTIONS:
                raise ValueError(f"filter pattern {n} needs a field, a pattern and an action of {ACTIONS}")
            both = flags | parse_flags(p.get("flags", []))
            try:
                re.compile(p["pattern"], both)
            except re.error as e:
                raise ValueError(f"filter pattern {n} is no regular expression: {e}") from e
            self.patterns.append((p["field"], p["pattern"], action, both, p.get("description", f"pattern {n}")))

    def required_columns(self) -> list[str]:
        return sorted({p[0] for p in self.patterns})

    def votes(self, df: DataFrame) -> list[Column]:
        out = []
        for f, pattern, action, flags, _ in self.patterns:
            if not isinstance(field(df, f), T.StringType):
                out.append(F.lit(False))
                continue
            found = search(column(f), pattern, flags)
            out.append(F.coalesce(found if action == "remove" else ~found, F.lit(False)))
        return out

    def keep(self, df: DataFrame) -> Column | None:
        out = reduce((lambda a, b: a | b) if self.mode == "any" else (lambda a, b: a & b), self.votes(df))
        return out if self.config.get("invert_logic", False) else ~out

    def counts(self, df: DataFrame, keep: Column) -> list[Column]:
        per = [F.count(F.when(v, 1)).alias(f"{p[4]}: filtered") for p, v in zip(self.patterns, self.votes(df))]
        return [*super().counts(df, keep), *per]


class RegexTransform(Processor):
    """A chain of substitutions; null and non-string fields are left alone."""

    type = "regex_transform"

    def __init__(self, config=None, context=None):
        super().__init__(config, context)
        flags = parse_flags(self.config.get("default_flags", DEFAULT_FLAGS))
        self.rules: list[tuple[str, str, str, int, int]] = []
        for n, t in enumerate(self.config.get("transformations") or []):
            if not t.get("field") or not t.get("pattern"):
                raise ValueError(f"transformation {n} needs a field and a pattern")
            both = flags | parse_flags(t.get("flags", []))
            try:
                re.compile(t["pattern"], both)
            except re.error as e:
                raise ValueError(f"transformation {n} is no regular expression: {e}") from e
            self.rules.append((t["field"], t["pattern"], t.get("replacement", ""), both, int(t.get("count", 0))))
        if not self.rules:
            raise ValueError("regex_transform needs transformations")

    def required_columns(self) -> list[str]:
        return sorted({r[0] for r in self.rules})

    def __call__(self, df: DataFrame) -> DataFrame:
        cond = condition(df, self.config.get("condition"))
        if cond is False or self.skips(df):
            return df
        new: dict[str, Column] = {}
        for f, pattern, replacement, flags, count in self.rules:
            if isinstance(field(df, f), T.StringType):
                new[f] = substitute(new.get(f, column(f)), pattern, replacement, flags, count)
        if cond is not True:
            new = {f: F.when(cond, c).otherwise(column(f)) for f, c in new.items()}
        return df.withColumns(new)

    transform = __call__
