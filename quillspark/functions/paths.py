"""Resolving dotted paths against static types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.values import Value, missing

#: Columns that stages carry beside the document's own.
HIDDEN = "__"


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


def fields_of(df: DataFrame) -> dict[str, Value]:
    """The document's fields as values; times without a zone are UTC."""
    out = {}
    for f in df.schema.fields:
        if not f.name.startswith(HIDDEN):
            col, t = F.col(f"`{f.name}`"), f.dataType
            if isinstance(t, (T.TimestampNTZType, T.DateType)):
                col, t = col.cast("timestamp"), T.TimestampType()
            out[f.name] = Value(col, t)
    return out


def child(value: Value, name: str) -> Value:
    """One field of an object, no fan-out."""
    if isinstance(value.type, T.StructType):
        return Value(value.col.getField(name), value.type[name].dataType) if name in value.type.fieldNames() else missing()
    if isinstance(value.type, T.MapType):
        return Value(F.try_element_at(value.col, F.lit(name)), value.type.valueType)
    return missing()


def walk(value: Value, parts: list[str]) -> Value:
    """The value at a path; arrays of objects give the array of their elements' values, flattened by one level."""
    for k, name in enumerate(parts):
        if isinstance(value.type, T.ArrayType):
            inner: list[Value] = []

            element, rest = value.type.elementType, parts[k:]

            def each(e: Column) -> Column:
                inner.append(walk(Value(e, element), rest))  # noqa: B023  called at once
                return inner[-1].col

            col = F.transform(value.col, each)
            got = inner[-1]
            if got.missing:
                return missing()
            if isinstance(got.type, T.ArrayType):
                return Value(F.flatten(col), got.type)
            return Value(col, T.ArrayType(got.type))
        value = child(value, name)
        if value.missing:
            return value
    return value


def plain(value: Value, parts: list[str]) -> Value:
    """The value at a path without fan-out: missing behind an array."""
    for name in parts:
        value = child(value, name)
    return value


def top(fields: dict[str, Value], path: str, fan_out: bool = True) -> Value:
    head, *rest = path.split(".")
    if head not in fields:
        return missing()
    return (walk if fan_out else plain)(fields[head], rest)
