"""Accumulators of ``$group`` and ``$bucket`` as aggregates; all combine partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import QueryError
from quillspark.functions import values as V
from quillspark.functions.expressions import Scope, compile_expression
from quillspark.functions.values import Value

#: Order columns, each with whether it ascends.
Order = list[tuple[str, bool]]


def _numbers(v: Value) -> Value:
    return v if v.kind == V.NUMBER else Value(F.lit(None).cast("bigint"), T.LongType())


def _sum(v: Value, order: Order) -> Column:
    n = _numbers(v)
    t = "bigint" if V.whole(n.type) else n.type.simpleString() if not isinstance(n.type, T.DecimalType) else f"decimal(38,{n.type.scale})"
    return F.coalesce(F.sum(n.col), F.lit(0)).cast(t)


def _avg(v: Value, order: Order) -> Column:
    return F.avg(_numbers(v).col).cast("double")


def _uniform(order: Order) -> bool:
    return len({asc for _, asc in order}) <= 1


def _listed(v: Value, order: Order, skip_null: bool) -> Column:
    """All values in order; nulls are left out before they are gathered."""
    pair = F.struct(*[F.col(c) for c, _ in order], v.col.alias("__v"))
    gathered = F.collect_list(F.when(v.col.isNotNull(), pair) if skip_null else pair)
    if not order:
        return F.transform(gathered, lambda p: p["__v"])
    if _uniform(order):
        done = F.sort_array(gathered, asc=order[0][1])
    else:

        def before(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for c, asc in reversed(order):
                x, y = (a[c], b[c]) if asc else (b[c], a[c])
                out = F.when(x.eqNullSafe(y), out).when(F.coalesce(x < y, x.isNull()), -1).otherwise(1)
            return out

        done = F.array_sort(gathered, before)
    return F.transform(done, lambda p: p["__v"])


def _edge(last: bool):
    def make(v: Value, order: Order) -> Column:
        if not order:
            return (F.last if last else F.first)(v.col)
        if not _uniform(order):
            return F.element_at(_listed(v, order, False), -1 if last else 1)
        key = F.struct(*[F.col(c) for c, _ in order])
        return (F.max_by if order[0][1] == last else F.min_by)(v.col, key)

    return make


ACCUMULATORS = {
    "$sum": _sum,
    "$avg": _avg,
    "$min": lambda v, order: F.min(v.col),
    "$max": lambda v, order: F.max(v.col),
    "$first": _edge(False),
    "$last": _edge(True),
    "$push": lambda v, order: _listed(v, order, True),
    "$addToSet": lambda v, order: F.sort_array(F.collect_set(v.col)),
}


def aggregates(spec: dict, scope: Scope, order: Order) -> list[Column]:
    """The named aggregates of a group's fields."""
    out = []
    for name, acc in spec.items():
        if not isinstance(acc, dict) or len(acc) != 1:
            raise QueryError(40238, f"The field '{name}' must specify one accumulator")
        (op, argument), = acc.items()
        if op not in ACCUMULATORS:
            raise QueryError(15952, f"unknown group operator '{op}'")
        if op == "$sum" and isinstance(argument, int) and not isinstance(argument, bool):
            out.append((F.count(F.lit(1)) * argument).alias(name))  # counting
            continue
        value = compile_expression(argument, scope)
        if value.kind == V.NULL and op in ("$push", "$addToSet"):
            value = Value(F.lit(None).cast("string"), T.StringType())
        out.append(ACCUMULATORS[op](value, order).alias(name))
    return out
