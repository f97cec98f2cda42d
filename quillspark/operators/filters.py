"""Filter documents (find, ``$match``, ``$elemMatch``, array filters) compiled to one boolean Column, never null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import BAD_VALUE, NOT_IMPLEMENTED, QueryError
from quillspark.functions import values as V
from quillspark.functions.expressions import Scope, compile_expression, stringify
from quillspark.functions.paths import child
from quillspark.functions.values import Value

Test = Callable[[Value], Column]
Sure = Callable[[Column], Column]


def never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def as_it_is(c: Column) -> Column:
    """Where rows are kept if a condition is true, null is as good as false, and a bare comparison reaches the scan."""
    return c


def row_filter(spec: dict, scope: Scope) -> Column:
    """A filter for ``DataFrame.filter``: as ``compile_filter``, but null may stand for false."""
    return compile_filter(spec, scope, as_it_is)


def compile_filter(spec: dict, scope: Scope, sure: Sure = never_null) -> Column:
    if not isinstance(spec, dict):
        raise QueryError(BAD_VALUE, "the filter must be an object")
    return V.all_of([_top(k, v, scope, sure) for k, v in spec.items()])


def _top(key: str, spec, scope: Scope, sure: Sure) -> Column:
    if key in ("$and", "$or", "$nor"):
        if not isinstance(spec, list) or not spec:
            raise QueryError(BAD_VALUE, f"{key} must be a nonempty array")
        if any(not isinstance(s, dict) for s in spec):
            raise QueryError(14817, f"{key} entries need to be full objects")
        parts = [compile_filter(s, scope, never_null if key == "$nor" else sure) for s in spec]
        return V.all_of(parts) if key == "$and" else V.any_of(parts) if key == "$or" else ~V.any_of(parts)
    if key == "$expr":
        return V.truth(compile_expression(spec, scope))
    if key == "$comment":
        return F.lit(True)
    if key.startswith("$"):
        raise QueryError(BAD_VALUE, f"unknown top level operator: {key}")
    head, *rest = key.split(".")
    return field_condition(scope.fields.get(head, V.missing()), rest, spec, scope, sure)


def is_operators(spec) -> bool:
    return isinstance(spec, dict) and any(k.startswith("$") for k in spec) and "$ref" not in spec


def field_condition(value: Value, rest: list[str], spec, scope: Scope, sure: Sure = never_null) -> Column:
    """One path's condition: an operator document, a pattern, or a value to equal."""
    if isinstance(spec, re.Pattern):
        spec = {"$regex": spec.pattern, "$options": "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if spec.flags & f)}
    if not is_operators(spec):
        return along(value, rest, lambda v: equals(v, spec, sure))
    if bad := [k for k in spec if not k.startswith("$")]:
        raise QueryError(BAD_VALUE, f"unknown operator: {bad[0]}")
    if "$regex" in spec:
        return along(value, rest, lambda v: any_element(v, pattern(spec["$regex"], spec.get("$options", ""))))
    # negations hold if no element matches; the others must hold together for one and the same element
    apart = [_negated(k, v, value, rest, scope) for k, v in spec.items() if k in ("$ne", "$nin", "$not")]
    wholes = {k: v for k, v in spec.items() if k in ("$size", "$all", "$elemMatch", "$exists", "$type", "$in", "$eq", "$options")}
    singles = {k: v for k, v in spec.items() if k not in ("$ne", "$nin", "$not") and k not in wholes}
    conditions = apart + [_whole(k, v, value, rest, scope, sure) for k, v in wholes.items()]
    if singles:
        tests = [single(k, v, sure) for k, v in singles.items()]
        conditions.append(along(value, rest, lambda v: any_element(v, lambda e: V.all_of([t(e) for t in tests]))))
    return V.all_of(conditions)


def _through_array(value: Value, rest: list[str]) -> bool:
    """Whether the path goes on inside an array's documents."""
    for name in rest:
        if value.kind == V.ARRAY:
            return not name.isdigit()
        value = child(value, name)
    return False


def along(value: Value, rest: list[str], test: Test) -> Column:
    """The test at a path: through arrays of objects any element may satisfy it; a number is also an index."""
    if not rest:
        return test(value)
    name = rest[0]
    if value.kind == V.ARRAY:
        if name == "":
            return test(value)
        if name.isdigit():
            return along(Value(F.get(value.col, int(name)), value.type.elementType), rest[1:], test)
        e = value.type.elementType
        if not isinstance(e, (T.StructType, T.MapType, T.ArrayType)) or isinstance(e, T.StructType) and name not in e.fieldNames():
            return test(V.missing())
        return F.coalesce(F.exists(value.col, lambda x: along(Value(x, e), rest, test)), F.lit(False))
    return along(child(value, name), rest[1:], test)


def any_element(value: Value, test: Test) -> Column:
    """The test on a value, or on any element of an array."""
    if value.kind != V.ARRAY:
        return test(value)
    return F.coalesce(F.exists(value.col, lambda e: test(Value(e, value.type.elementType))), F.lit(False))


def equals(value: Value, wanted, sure: Sure = never_null) -> Column:
    if isinstance(wanted, dict) and "$ref" in wanted and isinstance(value.type, T.StructType):
        return V.all_of([V.equal(child(value, k), V.literal(v)) for k, v in wanted.items()])
    literal = V.literal(wanted)
    if value.kind == V.ARRAY:
        whole = V.equal(value, literal) if literal.kind in (V.ARRAY, V.NULL) else F.lit(False)
        member = F.coalesce(F.exists(value.col, lambda e: V.equal(Value(e, value.type.elementType), literal)), F.lit(False))
        return whole | member
    if literal.kind == V.NULL:
        return value.col.isNull()
    if value.kind == literal.kind and value.kind in (V.NUMBER, V.STRING, V.BOOL, V.DATE):
        return sure(_direct(value, literal, "="))
    return V.equal(value, literal)


def _direct(value: Value, literal: Value, op: str) -> Column:
    """A comparison with the literal cast to the column's type where that loses nothing, so that it can be pushed to the scan."""
    a, b = value.col, literal.col
    if value.kind == V.NUMBER and value.type != literal.type and isinstance(value.type, (T.LongType, T.DoubleType)) and isinstance(literal.type, (T.IntegerType, T.LongType)):
        b = b.cast(value.type)
    return {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def pattern(source, options: str = "") -> Test:
    """Found anywhere in the value's text."""
    if isinstance(source, re.Pattern):
        source = source.pattern
    if bad := set(options) - set("imsxu"):
        raise QueryError(BAD_VALUE, f"invalid flag in regex options: {bad.pop()}")
    flags = "".join(sorted(set(options) | {"u"}))

    def test(v: Value) -> Column:
        if v.kind in (V.NULL, V.OBJECT, V.ARRAY, V.BINARY):
            return F.lit(False)
        return F.coalesce(stringify(v).rlike(f"(?{flags}){source}"), F.lit(False))

    return test


def single(name: str, argument, sure: Sure = never_null) -> Test:
    """Operators that look at one value."""
    if name in ("$gt", "$gte", "$lt", "$lte"):
        literal = V.literal(argument)
        op = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}[name]

        def ordered(v: Value) -> Column:
            if v.kind != literal.kind or v.kind == V.NULL:
                return F.lit(name in ("$gte", "$lte") and literal.kind == V.NULL) & v.col.isNull()
            return sure(_direct(v, literal, op))

        return ordered
    if name == "$mod":
        if not isinstance(argument, list) or len(argument) != 2:
            raise QueryError(BAD_VALUE, "malformed mod, needs to be an array of two numbers")
        d, r = (int(x) for x in argument)
        if d == 0:
            raise QueryError(BAD_VALUE, "divisor cannot be 0")
        return lambda v: F.coalesce(_whole_number(v) % d == r, F.lit(False)) if v.kind == V.NUMBER else F.lit(False)
    if name in ("$nearSphere", "$geoWithin"):
        raise QueryError(NOT_IMPLEMENTED, f"{name} is not yet implemented")
    raise QueryError(BAD_VALUE, f"unknown operator: {name}")


def _whole_number(v: Value) -> Column:
    return v.col if V.whole(v.type) else v.col.try_cast("bigint")


def _member(wanted: list, value: Value, sure: Sure = never_null) -> Column:
    plain = [w for w in wanted if not isinstance(w, re.Pattern)]
    tests = [any_element(value, pattern(w.pattern, "i" if w.flags & re.I else "")) for w in wanted if isinstance(w, re.Pattern)]
    literals = [V.literal(w) for w in plain]
    simple = [w for w, l in zip(plain, literals, strict=True) if l.kind == value.kind and value.kind in (V.NUMBER, V.STRING)]
    if simple and value.kind != V.ARRAY and not isinstance(value.type, T.DecimalType):
        same = [w for w in simple if not (V.whole(value.type) and isinstance(w, float))]
        tests.append(sure(value.col.isin([F.lit(w).cast(value.type) for w in same])) if same else F.lit(False))
        plain = [w for w in plain if w not in same]
    return V.any_of(tests + [equals(value, w, sure) for w in plain])


def _negated(name: str, argument, value: Value, rest: list[str], scope: Scope) -> Column:
    if name == "$ne":
        return ~along(value, rest, lambda v: equals(v, argument))
    if name == "$nin":
        return ~along(value, rest, lambda v: _member(_list(argument, name), v))
    if not (is_operators(argument) or isinstance(argument, re.Pattern)):
        raise QueryError(BAD_VALUE, "$not needs a regex or a document")
    return ~field_condition(value, rest, argument, scope)


def _list(argument, name: str) -> list:
    if not isinstance(argument, (list, tuple)):
        raise QueryError(BAD_VALUE, f"{name} needs an array")
    return list(argument)


def _whole(name: str, argument, value: Value, rest: list[str], scope: Scope, sure: Sure = never_null) -> Column:
    """Operators that look at an array as a whole, or at whether and what there is."""
    if name == "$eq":
        return along(value, rest, lambda v: equals(v, argument, sure))
    if name == "$in":
        return along(value, rest, lambda v: _member(_list(argument, name), v, sure))
    if name == "$exists":
        found = along(value, rest, lambda v: F.lit(False) if v.missing else v.col.isNotNull())
        return found if argument else ~found
    if name == "$type":
        wanted = argument if isinstance(argument, list) else [argument]
        if not wanted:
            raise QueryError(9, "must match at least one type")

        def typed(v: Value) -> Column:
            null = v.col.isNull() if not v.missing and {"null", 10} & set(wanted) else F.lit(False)
            own = v.col.isNotNull() if any(V.has_type(v.type, w) for w in wanted) else F.lit(False)
            element = F.coalesce(F.exists(v.col, lambda e: e.isNotNull()), F.lit(False)) if v.kind == V.ARRAY and any(V.has_type(v.type.elementType, w) for w in wanted) else F.lit(False)
            return null | own | element

        return along(value, rest, typed)
    if name == "$size":
        if isinstance(argument, bool) or not isinstance(argument, (int, float)):
            raise QueryError(BAD_VALUE, "$size needs a number")
        return along(value, rest, lambda v: F.coalesce(F.size(v.col) == argument, F.lit(False)) if v.kind == V.ARRAY else F.lit(False))
    if name == "$all":
        wanted = _list(argument, name)

        def every(v: Value) -> Column:
            if not wanted or v.kind != V.ARRAY:
                return F.lit(False)
            return V.all_of([elem_match(v, w["$elemMatch"], scope) if isinstance(w, dict) and "$elemMatch" in w else equals(v, w) for w in wanted])

        if wanted and _through_array(value, rest):  # each value in any of the array's documents
            return V.all_of([_whole("$elemMatch", w["$elemMatch"], value, rest, scope, sure) if isinstance(w, dict) and "$elemMatch" in w else along(value, rest, lambda v, w=w: equals(v, w)) for w in wanted])
        return along(value, rest, every)
    if name == "$elemMatch":
        return along(value, rest, lambda v: elem_match(v, argument, scope))
    return F.lit(True)  # $options beside $regex


def element_test(t: T.DataType, argument: dict, scope: Scope) -> Callable[[Column], Column]:
    """A filter on one element of an array."""
    if not isinstance(argument, dict):
        raise QueryError(BAD_VALUE, "$elemMatch needs an Object")
    logical = {"$and", "$or", "$nor", "$expr"}
    if is_operators(argument) and not set(argument) & logical:
        return lambda e: field_condition(Value(e, t), [], argument, scope)
    return lambda e: compile_filter(argument, Scope({n: child(Value(e, t), n) for n in t.fieldNames()} if isinstance(t, T.StructType) else {}, scope.variables))


def elem_match(value: Value, argument, scope: Scope) -> Column:
    test = element_test(value.type.elementType if value.kind == V.ARRAY else T.NullType(), argument, scope)
    if value.kind != V.ARRAY:
        return F.lit(False)
    return F.coalesce(F.exists(value.col, test), F.lit(False))
