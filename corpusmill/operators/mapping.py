"""``column_mapping``, ``advanced_mapping`` and ``qa_to_messages``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import IMAGE_TYPE
from ..functions.values import as_text, column, field, navigate, truthy
from .base import Processor


class ColumnMapping(Processor):
    """Renamed columns first, in the mapping's order, then the others; another column with a new name takes its place."""

    type = "column_mapping"

    def transform(self, df: DataFrame) -> DataFrame:
        names = {old: new for old, new in (self.config.get("column_mapping") or {}).items() if old in df.columns}
        out: dict[str, Column] = {new: column(old).alias(new) for old, new in names.items()}
        out |= {c: column(c) for c in df.columns if c not in names}
        return df.select(*out.values())


def _top(path: str) -> str:
    """The column that a path begins with."""
    return re.split(r"[.\[]", path, maxsplit=1)[0]


def _listed(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


class AdvancedMapping(Processor):
    """Rules that read nested values of the original row and write them to new columns, in one projection.

    A rule whose value is null leaves its target as it was.  Rows that lack one of
    ``required_fields`` in the result are dropped.
    """

    type = "advanced_mapping"

    def required_columns(self) -> list[str]:
        rules = [m["source"] for m in self.config.get("mappings") or [] if m.get("source")]
        return sorted({_top(s) for s in rules} | set(self.config.get("simple_mappings") or {}))

    def value(self, df: DataFrame, rule: dict) -> tuple[Column, T.DataType] | None:
        got = navigate(None, df.schema, rule.get("source", ""))
        if got is None:
            return None
        col, kind = got
        items = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
        if items and "filter" in rule:
            tests = [(f, v) for f, v in rule["filter"].items()]
            if all(f in kind.elementType.names for f, _ in tests):
                col = F.filter(col, lambda x: reduce(lambda a, b: a & b, (x.getField(f).eqNullSafe(F.lit(v)) for f, v in tests), F.lit(True)))
            elif any(v is not None for _, v in tests):
                col = F.filter(col, lambda x: F.lit(False))
        if "extract" in rule:
            if items:
                sub = navigate(F.lit(0), kind.elementType, rule["extract"])
                if sub is None:
                    return None
                element, path = kind.elementType, rule["extract"]
                # an item that is null isn't a record, and is dropped
                col, kind = F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: navigate(x, element, path)[0]), T.ArrayType(sub[1])
            elif isinstance(kind, T.StructType):
                sub = navigate(col, kind, rule["extract"])
                if sub is None:
                    return None
                col, kind = sub
        if "extract_first_of" in rule:
            base, inner = (F.try_element_at(col, F.lit(1)), kind.elementType) if items and isinstance(kind, T.ArrayType) else (col, kind)
            if isinstance(inner, T.StructType):
                subs = [s for p in rule["extract_first_of"] if (s := navigate(base, inner, p)) is not None]
                if subs:
                    same = all(s[1] == subs[0][1] for s in subs)
                    col = F.coalesce(*(s[0] if same else s[0].cast("string") for s in subs))
                    kind = subs[0][1] if same else T.StringType()
        if isinstance(kind, T.ArrayType) and rule.get("take_first", True):
            col, kind = F.try_element_at(col, F.lit(1)), kind.elementType
        return col, kind

    def transform(self, df: DataFrame) -> DataFrame:
        c = self.config
        out: dict[str, tuple[Column, T.DataType]] = {f.name: (column(f.name), f.dataType) for f in df.schema.fields} if c.get("keep_unmapped", True) else {}
        written: set[str] = set()
        used: set[str] = set()
        for old, new in (c.get("simple_mappings") or {}).items():
            if old in df.columns:
                out[new] = (column(old), field(df, old))
                used.add(old)
        for rule in c.get("mappings") or []:
            if not rule.get("source"):
                continue
            for f in _listed(rule.get("remove_before")):
                out.pop(f, None)
            got = self.value(df, rule)
            used.add(_top(rule["source"]))
            if got is not None:
                col, kind = got
                for t in [rule["target"]] if rule.get("target") else _listed(rule.get("targets")):
                    if t in out:
                        old, was = out[t]
                        out[t] = (F.coalesce(col, old), kind) if was == kind else (F.coalesce(col.cast("string"), old.cast("string")), T.StringType())
                    else:
                        out[t] = (col, kind)
                        written.add(t)
            for f in _listed(rule.get("remove_after")):
                out.pop(f, None)
        if c.get("remove_source_fields"):
            for f in used - written - {t for m in c.get("mappings") or [] for t in [m.get("target"), *_listed(m.get("targets"))]}:
                out.pop(f, None)
        need = c.get("required_fields", ["image", "problem", "solution"])
        if any(f not in out for f in need):
            return df.select(*(v.alias(k) for k, (v, _) in out.items())).where("false")
        df = df.select(*(v.alias(k) for k, (v, _) in out.items()))
        tests = [column(f).isNotNull() for f in need if f in written]
        return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


MESSAGES = "array<struct<role: string, content: string>>"


def first_truthy(df: DataFrame, fields: list[str]) -> Column | None:
    there = [F.when(truthy(column(f), field(df, f)), as_text(column(f), field(df, f))) for f in fields if field(df, f) is not None]
    return F.coalesce(*there) if there else None


def messages_of(question: Column, answer: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", question), turn("assistant", answer))


class QaToMessages(Processor):
    """A question and an answer as two messages, with images, and the other columns as ``metadata``."""

    type = "qa_to_messages"

    def transform(self, df: DataFrame) -> DataFrame:
        c = self.config
        ask = [c.get("question_field", "problem"), *(c.get("question_alternatives", ["question", "original_question"]))]
        say = [c.get("answer_field", "solution"), *(c.get("answer_alternatives", ["answer", "original_answer"]))]
        image = c.get("image_field", "image")
        question, answer = first_truthy(df, ask), first_truthy(df, say)
        if question is None or answer is None:
            return df.where("false").select(F.lit(None).cast(MESSAGES).alias("messages"))
        one, many = field(df, image), field(df, "images")
        if one is not None:
            images = F.when(truthy(column(image), one), F.array(column(image))).otherwise(F.array().cast(T.ArrayType(one)))
        elif isinstance(many, T.ArrayType):
            images = F.coalesce(column("images"), F.array().cast(many))
        else:
            images = F.array().cast(f"array<{IMAGE_TYPE}>")
        none = F.array().cast("array<string>")
        rest = [x for x in df.columns if x not in {*ask, *say, image, "images"}]
        out = [messages_of(question, answer).alias("messages"), images.alias("images"), none.alias("videos"), none.alias("audios")]
        if rest:
            out.append(F.struct(*(column(x) for x in rest)).alias("metadata"))
        return df.where(question.isNotNull() & answer.isNotNull()).select(*out)


PAIRS = (("problem", "solution"), ("original_question", "original_answer"), ("question", "answer"), ("instruction", "output"))


def convert_to_messages(df: DataFrame) -> DataFrame:
    """By schema: messages as they are, a known pair of question and answer converted, others unchanged."""
    if "messages" in df.columns:
        return df
    for q, a in PAIRS:
        if q in df.columns and a in df.columns:
            return QaToMessages({"question_field": q, "question_alternatives": [], "answer_field": a, "answer_alternatives": []})(df)
    return df
