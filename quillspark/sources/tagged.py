"""JSON text that keeps types: numbers, times and bytes are wrapped in an object that names their type.

``{"a": 5}`` of a long is ``{"a": {"$numberLong": "5"}}``; text, booleans and nulls stand as they are. Both ways are built
from a schema as one expression, so nothing runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names as in the extended JSON of document databases, and the text that stands for a value.
_TAGS: list[tuple[type | tuple, str]] = [
    ((T.ByteType, T.ShortType, T.IntegerType), "$numberInt"), (T.LongType, "$numberLong"), ((T.FloatType, T.DoubleType), "$numberDouble"), (T.DecimalType, "$numberDecimal"),
    ((T.TimestampType, T.TimestampNTZType, T.DateType), "$date"), (T.BinaryType, "$binary"),
]


def _tag(t: T.DataType) -> str | None:
    return next((name for kinds, name in _TAGS if isinstance(t, kinds)), None)


def _text(col: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BinaryType):
        return F.base64(col)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col.cast("timestamp")).cast("string")
    return col.cast("string")


def _wrapped(col: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_wrapped(col.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(col, lambda x: _wrapped(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(col, lambda k, x: _wrapped(x, t.valueType))
    name = _tag(t)
    return F.when(col.isNotNull(), F.struct(_text(col, t).alias(name))) if name else col


def _shape(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _shape(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_shape(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(T.StringType(), _shape(t.valueType))
    name = _tag(t)
    return T.StructType([T.StructField(name, T.StringType())]) if name else t


def _unwrapped(col: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_unwrapped(col.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(col, lambda x: _unwrapped(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(col, lambda k, x: _unwrapped(x, t.valueType))
    name = _tag(t)
    if not name:
        return col
    text = col.getField(name)
    if name == "$binary":
        return F.unbase64(text)
    if name == "$date":
        return F.timestamp_micros(text.cast("long")).cast(t)
    return text.cast(t)


def tagged(df: DataFrame) -> DataFrame:
    """Each row as type-tagged JSON, in the column ``doc``."""
    return df.select(F.to_json(F.struct(*[_wrapped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])).alias("doc"))


def untagged(df: DataFrame, schema: T.StructType, column: str = "doc") -> DataFrame:
    """Rows of ``schema`` from type-tagged JSON; what is missing is null."""
    parsed = df.select(F.from_json(column, _shape(schema)).alias("d"))
    return parsed.select(*[_unwrapped(F.col("d").getField(f.name), f.dataType).alias(f.name) for f in schema.fields])
