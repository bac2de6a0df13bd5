"""Truthiness, text of a row, nested paths, conditions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def field(df: DataFrame, name: str) -> T.DataType | None:
    """The type of a top-level column, or None if there is none."""
    return next((f.dataType for f in df.schema.fields if f.name == name), None)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def truthy(col: Column, kind: T.DataType) -> Column:
    """What ``if value`` says in Python; never null."""
    if isinstance(kind, T.StringType):
        test = col != ""
    elif isinstance(kind, T.BooleanType):
        test = col
    elif isinstance(kind, NUMBERS):
        test = col != 0
    elif isinstance(kind, T.BinaryType):
        test = F.octet_length(col) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(col) > 0
    else:
        test = col.isNotNull()
    return F.coalesce(test, F.lit(False))


def as_text(col: Column, kind: T.DataType) -> Column:
    """``str(value)``: Spark's cast, with Python's spelling of booleans."""
    return F.initcap(col.cast("string")) if isinstance(kind, T.BooleanType) else col.cast("string")


def joined_text(df: DataFrame, fields: list[str]) -> Column | None:
    """The truthy fields, space-joined; null if there is none; None if no such column exists."""
    there = [f for f in fields if field(df, f) is not None]
    if not there:
        return None
    parts = [F.when(truthy(column(f), field(df, f)), as_text(column(f), field(df, f))) for f in there]
    return F.when(reduce(lambda a, b: a | b, (p.isNotNull() for p in parts)), F.concat_ws(" ", *parts))


def computed_once(df: DataFrame, name: str, col: Column) -> DataFrame:
    """Adds a column behind a generator, which the optimizer doesn't merge into later projections.

    A costly array that a lambda refers to would else be made again for each element.
    """
    return df.select("*", F.explode(F.array(col)).alias(name))


_PART = re.compile(r"^([^\[\]]*)(?:\[(-?\d+)\])?$")


def navigate(start: Column | None, kind: T.DataType, path: str) -> tuple[Column, T.DataType] | None:
    """``a.b[0].c`` from a value of a known type; None where the schema says that the path can't exist."""
    col = start
    for part in path.split(".") if path else ():
        found = _PART.match(part)
        if not found:
            return None
        name, index = found.groups()
        if name:
            if isinstance(kind, T.StructType) and name in kind.names:
                col = column(name) if col is None else col.getField(name)
                kind = kind[name].dataType
            elif isinstance(kind, T.MapType) and col is not None:
                col, kind = F.try_element_at(col, F.lit(name)), kind.valueType
            else:
                return None
        if index is not None:
            if not isinstance(kind, T.ArrayType) or col is None:
                return None
            i = int(index)
            col, kind = F.try_element_at(col, F.lit(i + 1 if i >= 0 else i)), kind.elementType
    return None if col is None else (col, kind)


def condition(df: DataFrame, spec: dict | None) -> Column | bool:
    """A processor's condition: column tests are settled now, value tests are null-safe predicates."""
    if not spec:
        return True
    kind, fields = spec.get("type"), spec.get("fields", spec.get("field", []))
    fields = [fields] if isinstance(fields, str) else fields
    wanted = spec.get("values", spec.get("value", {}))
    if not isinstance(wanted, dict):
        wanted = {f: wanted for f in fields}
    if kind == "field_exists":
        return all(f in df.columns for f in fields)
    if kind == "field_not_exists":
        return not any(f in df.columns for f in fields)
    if kind == "field_equals":
        if not all(f in df.columns for f in wanted):
            return False
        tests = [column(f).eqNullSafe(F.lit(v)) for f, v in wanted.items()]
    elif kind == "field_not_equals":
        tests = [~column(f).eqNullSafe(F.lit(v)) for f, v in wanted.items() if f in df.columns]
    elif kind == "custom":
        if not spec.get("sql"):
            return True
        tests = [F.coalesce(F.expr(spec["sql"]), F.lit(False))]
    else:
        raise ValueError(f"unknown condition type: {kind}")
    return reduce(lambda a, b: a & b, tests) if tests else True
