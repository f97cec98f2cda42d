"""Typed values: a Column with its static type, and the order, equality and truth of the document model.

Types are known when a query is compiled, so comparisons across type classes fold to constants and only comparisons
within a class reach the plan. A field that the schema doesn't have is *missing*, which behaves as null but for the
sites that tell them apart (``$exists``, ``$addFields``, computed fields).
"""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import BAD_VALUE, QueryError

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Type classes in ascending order.
NULL, NUMBER, STRING, OBJECT, ARRAY, BINARY, BOOL, DATE = range(8)
ALIASES = {
    "double": 1, "string": 2, "object": 3, "array": 4, "binData": 5, "objectId": 7, "bool": 8, "date": 9, "null": 10, "regex": 11,
    "int": 16, "timestamp": 17, "long": 18, "decimal": 19, "minKey": -1, "maxKey": 127,
}


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    missing: bool = False

    @property
    def kind(self) -> int:
        return kind_of(self.type)


def kind_of(t: T.DataType) -> int:
    for types, kind in ((NUMBERS, NUMBER), ((T.StringType, T.CharType, T.VarcharType), STRING), ((T.StructType, T.MapType), OBJECT), (T.ArrayType, ARRAY), (T.BinaryType, BINARY), (T.BooleanType, BOOL), ((T.TimestampType, T.TimestampNTZType, T.DateType), DATE)):
        if isinstance(t, types):
            return kind
    return NULL


def missing() -> Value:
    return Value(F.lit(None), T.NullType(), True)


def null() -> Value:
    return Value(F.lit(None), T.NullType())


def whole(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def literal(value) -> Value:
    """A Python value as a typed constant."""
    if isinstance(value, Value):
        return value
    if value is None:
        return null()
    if isinstance(value, bool):
        return Value(F.lit(value), T.BooleanType())
    if isinstance(value, int):
        t = T.IntegerType() if -(1 << 31) <= value < 1 << 31 else T.LongType()
        return Value(F.lit(value).cast(t), t)
    if isinstance(value, float):
        return Value(F.lit(value), T.DoubleType())
    if isinstance(value, str):
        return Value(F.lit(value), T.StringType())
    if isinstance(value, (bytes, bytearray)):
        return Value(F.lit(bytes(value)), T.BinaryType())
    if isinstance(value, decimal.Decimal):
        t = T.DecimalType(38, max(0, -int(value.as_tuple().exponent)))
        return Value(F.lit(value).cast(t), t)
    if isinstance(value, datetime.datetime):
        utc = value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)
        micros = (utc - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1)
        return Value(F.timestamp_micros(F.lit(micros)), T.TimestampType())
    if isinstance(value, datetime.date):
        return literal(datetime.datetime(value.year, value.month, value.day))
    if isinstance(value, (list, tuple)):
        return array([literal(v) for v in value])
    if isinstance(value, dict):
        return struct({k: literal(v) for k, v in value.items()})
    raise QueryError(BAD_VALUE, f"no such value: {value!r}")


def common_type(types: list[T.DataType]) -> T.DataType | None:
    """The type that holds all of them, or None."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if not known:
        return T.NullType()
    if all(t == known[0] for t in known):
        return known[0]
    if all(isinstance(t, NUMBERS) for t in known):
        if all(whole(t) for t in known):
            return T.LongType()
        decimals = [t for t in known if isinstance(t, T.DecimalType)]
        if decimals and not any(isinstance(t, (T.FloatType, T.DoubleType)) for t in known):
            return T.DecimalType(38, max(t.scale for t in decimals))
        return T.DoubleType()
    if all(isinstance(t, T.ArrayType) for t in known):
        inner = common_type([t.elementType for t in known])
        return None if inner is None else T.ArrayType(inner)
    if all(isinstance(t, T.StructType) for t in known) and all(t.fieldNames() == known[0].fieldNames() for t in known):
        fields = [(n, common_type([t[n].dataType for t in known])) for n in known[0].fieldNames()]
        return None if any(t is None for _, t in fields) else T.StructType([T.StructField(n, t) for n, t in fields])
    if all(kind_of(t) == DATE for t in known):
        return T.TimestampType()
    return None


def cast(value: Value, t: T.DataType) -> Value:
    return value if value.type == t else Value(value.col.cast(t), t, value.missing)


def array(values: list[Value]) -> Value:
    t = common_type([v.type for v in values])
    if t is None:
        raise QueryError(BAD_VALUE, "the elements of an array must have one type on the typed path")
    col = F.array(*[cast(v, t).col for v in values]) if values else F.array()
    return Value(col.cast(T.ArrayType(t)), T.ArrayType(t))


def struct(fields: dict[str, Value]) -> Value:
    t = T.StructType([T.StructField(k, v.type) for k, v in fields.items()])
    return Value(F.struct(*[v.col.alias(k) for k, v in fields.items()]) if fields else F.struct(), t)


def truth(value: Value) -> Column:
    """Never null: null is false, numbers are true unless 0, anything else that isn't null is true."""
    if value.kind == NULL:
        return F.lit(False)
    if value.kind == BOOL:
        return F.coalesce(value.col, F.lit(False))
    if value.kind == NUMBER:
        return F.coalesce(value.col != 0, F.lit(False))
    return value.col.isNotNull()


def _aligned(a: Value, b: Value) -> tuple[Column, Column] | None:
    t = common_type([a.type, b.type])
    return None if t is None else (cast(a, t).col, cast(b, t).col)


def equal(a: Value, b: Value) -> Column:
    """Null equals null and missing; numbers by value; across type classes only nulls are equal."""
    pair = _aligned(a, b) if a.kind == b.kind else None
    if pair:
        return pair[0].eqNullSafe(pair[1])
    return a.col.isNull() & b.col.isNull()


def less(a: Value, b: Value) -> Column:
    """a < b in the total order, null lowest; never null."""
    if a.kind == b.kind and (pair := _aligned(a, b)):
        return F.coalesce(pair[0] < pair[1], a.col.isNull() & b.col.isNotNull())
    ranked = F.lit(a.kind < b.kind)
    return F.when(a.col.isNull(), b.col.isNotNull()).when(b.col.isNull(), F.lit(False)).otherwise(ranked)


def compare(a: Value, b: Value) -> Column:
    return F.when(equal(a, b), F.lit(0)).when(less(a, b), F.lit(-1)).otherwise(F.lit(1))


def sort_key(value: Value, ascending: bool) -> Column:
    """What rows are sorted by: arrays stand for their least element (ascending) or greatest; [] comes before null."""
    if value.kind != ARRAY:
        return value.col
    x = value.col
    empty = F.size(x) == 0
    if ascending:
        lowest = F.when(empty, 0).when(x.isNull() | F.exists(x, lambda e: e.isNull()), 1).otherwise(2)
        return F.struct(lowest.alias("c"), F.array_min(x).alias("v"))
    highest = F.when(empty, 0).when(x.isNull() | F.array_max(x).isNull(), 1).otherwise(2)
    return F.struct(highest.alias("c"), F.array_max(x).alias("v"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def has_type(t: T.DataType, wanted) -> bool:
    """Whether a static type is the one of a code or alias."""
    if wanted == "number":
        return kind_of(t) == NUMBER
    code = ALIASES.get(wanted, wanted)
    if code not in ALIASES.values():
        raise QueryError(BAD_VALUE, f"Unknown type name alias: {wanted}")
    return {
        1: isinstance(t, (T.DoubleType, T.FloatType)), 2: kind_of(t) == STRING, 3: kind_of(t) == OBJECT, 4: kind_of(t) == ARRAY, 5: kind_of(t) == BINARY,
        8: kind_of(t) == BOOL, 9: kind_of(t) == DATE, 16: isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)), 18: isinstance(t, T.LongType), 19: isinstance(t, T.DecimalType),
    }.get(code, False)
