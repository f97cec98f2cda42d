"""Aggregation expressions compiled to Columns.

``compile_expression(spec, scope)`` gives a ``Value``. Whatever depends only on the specification and the schema is
checked here, with its error code; what depends on a row becomes part of the plan (``raise_error`` where a row must
fail).
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import QueryError
from quillspark.functions import values as V
from quillspark.functions.paths import child, walk
from quillspark.functions.values import Value

LONG, DOUBLE, STRING, BOOL, TIME = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()


@dataclass
class Scope:
    """What names stand for: the document's fields, and ``$$`` variables."""

    fields: dict[str, Value]
    variables: dict[str, Value] = field(default_factory=dict)

    def root(self) -> Value:
        return V.struct(self.fields)

    def bind(self, **names: Value) -> Scope:
        return Scope(self.fields, self.variables | names)


OPERATORS: dict[str, Callable] = {}


def operator(name: str, least: int | None = None, most: int | None = None, raw: bool = False):
    """Registers ``f(args, scope)``; arguments are compiled first unless ``raw``."""

    def register(f):
        def call(spec, scope: Scope) -> Value:
            if raw:
                return f(spec, scope)
            listed = spec if isinstance(spec, list) else [spec]
            if least is not None and not least <= len(listed) <= (least if most is None else most):
                raise QueryError(16020, f"Expression {name} takes exactly {least} arguments. {len(listed)} were passed in.")
            return f([compile_expression(a, scope) for a in listed], scope)

        OPERATORS[name] = call
        return f

    return register


def compile_expression(spec, scope: Scope) -> Value:
    if isinstance(spec, str) and spec.startswith("$$"):
        name, *rest = spec[2:].split(".")
        if name in scope.variables:
            return walk(scope.variables[name], rest)
        if name in ("ROOT", "CURRENT"):
            return walk(scope.fields[rest[0]], rest[1:]) if rest and rest[0] in scope.fields else scope.root() if not rest else V.missing()
        if name == "NOW":
            return Value(F.current_timestamp(), TIME)
        if name in ("KEEP", "PRUNE", "DESCEND"):
            return Value(F.lit(spec), STRING)
        if name == "REMOVE":
            return V.missing()
        raise QueryError(17276, f"Use of undefined variable: {name}")
    if isinstance(spec, str) and spec.startswith("$"):
        head, *rest = spec[1:].split(".")
        return walk(scope.fields[head], rest) if head in scope.fields else V.missing()
    if isinstance(spec, dict):
        names = [k for k in spec if k.startswith("$")]
        if names:
            if len(spec) > 1:
                raise QueryError(15983, f"An object representing an expression must have exactly one field: {spec}")
            if names[0] not in OPERATORS:
                raise QueryError(168, f"Unrecognized expression '{names[0]}'")
            return OPERATORS[names[0]](spec[names[0]], scope)
        made = {k: compile_expression(v, scope) for k, v in spec.items()}
        return V.struct({k: v for k, v in made.items() if not v.missing})
    if isinstance(spec, list):
        return V.array([compile_expression(v, scope) for v in spec])
    return V.literal(spec)


def _number(v: Value, name: str, code: int = 28765) -> Column:
    if v.kind not in (V.NUMBER, V.NULL):
        raise QueryError(code, f"{name} only supports numeric types, not {v.type.simpleString()}")
    return v.col


def _fail(code: int, message: str) -> Column:
    return F.raise_error(F.lit(f"[{code}] {message}"))


# --- arithmetic -------------------------------------------------------------------------------------------------------


def _unary(name: str, make: Callable[[Column, T.DataType], Column], result: Callable[[T.DataType], T.DataType]):
    @operator(name, 1)
    def f(args, scope):
        (x,) = args
        col, t = _number(x, name), result(x.type)
        return Value(make(col, x.type).cast(t), t)


def _same(t: T.DataType) -> T.DataType:
    return LONG if V.whole(t) else t if isinstance(t, T.DecimalType) else DOUBLE


_double = lambda t: DOUBLE
_long = lambda t: LONG


def _log(f: Callable[[Column], Column]) -> Callable[[Column, T.DataType], Column]:
    # the logarithm of 0 is -Infinity and of less NaN, where Spark has null
    return lambda x, t: F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(x.cast("double"))


_unary("$abs", lambda x, t: F.abs(x.cast("bigint") if V.whole(t) else x), _same)
_unary("$ceil", lambda x, t: F.ceil(x), _double)
_unary("$floor", lambda x, t: F.floor(x), _long)
_unary("$trunc", lambda x, t: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), _long)
_unary("$exp", lambda x, t: F.exp(x), _double)
_unary("$sqrt", lambda x, t: F.sqrt(x.cast("double")), _double)
_unary("$ln", _log(F.ln), _double)
_unary("$log", _log(F.ln), _double)
_unary("$log10", _log(F.log10), _double)


def _wide(a: Value, t: T.DataType) -> Column:
    return V.cast(a, t).col


@operator("$add")
def _add(args, scope):
    dates = [a for a in args if a.kind == V.DATE]
    if len(dates) > 1:
        raise QueryError(16612, "only one date allowed in an $add expression")
    for a in args:
        if a.kind not in (V.NUMBER, V.DATE, V.NULL):
            raise QueryError(16554, f"$add only supports numeric or date types, not {a.type.simpleString()}")
    numbers = [a for a in args if a.kind != V.DATE]
    t = V.common_type([a.type for a in numbers] + [T.IntegerType()])
    t = LONG if V.whole(t) else t
    total = F.lit(0).cast(t)
    for a in numbers:
        total = total + _wide(a, t)
    if dates:
        return Value(F.timestamp_millis((F.unix_millis(dates[0].col) + total).cast("bigint")), TIME)
    return Value(total.cast(t), t)


@operator("$subtract", 2)
def _subtract(args, scope):
    a, b = args
    if V.NULL in (a.kind, b.kind):
        return V.null()
    if a.kind == V.DATE:
        if b.kind == V.DATE:
            return Value(F.unix_millis(a.col) - F.unix_millis(b.col), LONG)
        return Value(F.timestamp_millis((F.unix_millis(a.col) - _number(b, "$subtract", 16556)).cast("bigint")), TIME)
    x, y = _number(a, "$subtract", 16556), _number(b, "$subtract", 16556)
    t = V.common_type([a.type, b.type])
    t = LONG if V.whole(t) else t
    return Value((x.cast(t) - y.cast(t)).cast(t), t)


@operator("$multiply", 2)
def _multiply(args, scope):
    x, y = (_number(a, "$multiply", 16555) for a in args)
    t = V.common_type([a.type for a in args])
    t = LONG if V.whole(t) else t
    return Value((x.cast(t) * y.cast(t)).cast(t), t)


@operator("$divide", 2)
def _divide(args, scope):
    x, y = (_number(a, "$divide", 16609).cast("double") for a in args)
    return Value(F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, _fail(16608, "can't $divide by zero").cast("double")).otherwise(x / y), DOUBLE)


@operator("$mod", 2)
def _mod(args, scope):
    x, y = (_number(a, "$mod", 16611).cast("double") for a in args)
    return Value(F.when(y == 0, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(x % y), DOUBLE)


@operator("$pow", 2)
def _pow(args, scope):
    x, y = _number(args[0], "$pow", 28762), _number(args[1], "$pow", 28763)
    return Value(F.pow(x.cast("double"), y.cast("double")), DOUBLE)


@operator("$rand", raw=True)
def _rand(spec, scope):
    if spec not in ({}, []):
        raise QueryError(16020, "$rand takes no arguments")
    return Value(F.rand(), DOUBLE)


@operator("$range", 2, 3)
def _range(args, scope):
    start, end = (_number(a, "$range", 34443).cast("int") for a in args[:2])
    step = _number(args[2], "$range", 34447).cast("int") if len(args) > 2 else F.lit(1)
    empty = F.array().cast("array<int>")
    last = end - F.signum(step).cast("int")
    up = (step > 0) & (start < end) | (step < 0) & (start > end)
    safe = F.when(step == 0, 1).otherwise(step)
    col = F.when(step == 0, _fail(34449, "$range requires a non-zero step value").cast("array<int>")).when(up, F.sequence(start, F.when(up, last).otherwise(start), F.when(up, safe).otherwise(F.lit(1)))).otherwise(empty)
    return Value(col, T.ArrayType(T.IntegerType()))


def _listed(args: list[Value]) -> Value | None:
    """The arguments as one array: a single array argument stands for its elements."""
    if len(args) == 1 and args[0].kind == V.ARRAY:
        return args[0]
    numbers = [a for a in args if a.kind == V.NUMBER]
    return V.array(numbers) if numbers else None


@operator("$sum")
def _sum(args, scope):
    x = _listed(args)
    if x is None or V.kind_of(x.type.elementType) != V.NUMBER:
        return V.literal(0)
    t = LONG if V.whole(x.type.elementType) else x.type.elementType
    t = T.DecimalType(38, t.scale) if isinstance(t, T.DecimalType) else t
    return Value(F.coalesce(F.aggregate(F.filter(x.col, lambda e: e.isNotNull()), F.lit(0).cast(t), lambda s, e: (s + e).cast(t)), F.lit(0).cast(t)), t)


@operator("$avg")
def _avg(args, scope):
    x = _listed(args)
    if x is None or V.kind_of(x.type.elementType) != V.NUMBER:
        return V.null()
    kept = F.filter(x.col, lambda e: e.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda s, e: s + e.cast("double"))
    return Value(F.when(F.size(kept) > 0, total / F.size(kept)), DOUBLE)


def _extreme(name: str, of: Callable[[Column], Column]):
    @operator(name)
    def f(args, scope):
        x = args[0] if len(args) == 1 and args[0].kind == V.ARRAY else V.array([a for a in args if a.kind != V.NULL])
        return Value(of(x.col), x.type.elementType)


_extreme("$max", F.array_max)
_extreme("$min", F.array_min)

# --- logic ------------------------------------------------------------------------------------------------------------


@operator("$and")
def _and(args, scope):
    return Value(V.all_of([V.truth(a) for a in args]), BOOL)


@operator("$or")
def _or(args, scope):
    return Value(V.any_of([V.truth(a) for a in args]), BOOL)


@operator("$not", 1)
def _not(args, scope):
    return Value(~V.truth(args[0]), BOOL)


def _comparison(name: str, make: Callable[[Value, Value], Column], t: T.DataType = BOOL):
    @operator(name, 2)
    def f(args, scope):
        return Value(make(*args), t)


_comparison("$cmp", V.compare, T.IntegerType())
_comparison("$eq", V.equal)
_comparison("$ne", lambda a, b: ~V.equal(a, b))
_comparison("$gt", lambda a, b: V.less(b, a))
_comparison("$gte", lambda a, b: ~V.less(a, b))
_comparison("$lt", V.less)
_comparison("$lte", lambda a, b: ~V.less(b, a))


def _branches(values: list[Value], name: str) -> tuple[list[Column], T.DataType]:
    t = V.common_type([v.type for v in values])
    if t is None:
        if any(v.kind in (V.ARRAY, V.OBJECT) for v in values):
            raise QueryError(14, f"the results of {name} must have one type on the typed path")
        t = STRING
    return [V.cast(v, t).col for v in values], t


@operator("$cond", raw=True)
def _cond(spec, scope):
    if isinstance(spec, dict):
        for k in ("if", "then", "else"):
            if k not in spec:
                raise QueryError(17080, f"Missing '{k}' parameter to $cond")
        if extra := set(spec) - {"if", "then", "else"}:
            raise QueryError(17083, f"Unrecognized parameter to $cond: {extra.pop()}")
        spec = [spec["if"], spec["then"], spec["else"]]
    if len(spec) != 3:
        raise QueryError(16020, f"Expression $cond takes exactly 3 arguments. {len(spec)} were passed in.")
    test, yes, no = (compile_expression(s, scope) for s in spec)
    (a, b), t = _branches([yes, no], "$cond")
    return Value(F.when(V.truth(test), a).otherwise(b), t)


@operator("$ifNull", 2)
def _if_null(args, scope):
    cols, t = _branches(args, "$ifNull")
    return Value(F.coalesce(*cols), t)


@operator("$switch", raw=True)
def _switch(spec, scope):
    if not isinstance(spec, dict) or not spec.get("branches"):
        raise QueryError(40068, "$switch requires at least one branch.")
    for b in spec["branches"]:
        if set(b) != {"case", "then"}:
            raise QueryError(40067 if "case" not in b else 40062, "$switch requires each branch have a 'case' and a 'then' expression")
    cases = [compile_expression(b["case"], scope) for b in spec["branches"]]
    results = [compile_expression(b["then"], scope) for b in spec["branches"]]
    given = "default" in spec
    cols, t = _branches([*results, *([compile_expression(spec["default"], scope)] if given else [])], "$switch")
    out = F.when(V.truth(cases[0]), cols[0])
    for c, r in zip(cases[1:], cols[1:], strict=False):
        out = out.when(V.truth(c), r)
    return Value(out.otherwise(cols[-1] if given else _fail(40066, "$switch could not find a matching branch for an input, and no default was specified.").cast(t)), t)


@operator("$literal", raw=True)
def _literal(spec, scope):
    return V.literal(spec)


# --- strings ----------------------------------------------------------------------------------------------------------


def _text(v: Value, name: str, code: int = 16702) -> Column:
    if v.kind not in (V.STRING, V.NULL):
        raise QueryError(code, f"{name} requires a string argument, found: {v.type.simpleString()}")
    return v.col.cast("string")


def stringify(v: Value) -> Column:
    if v.kind == V.DATE:
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if v.kind in (V.STRING, V.NUMBER, V.BOOL, V.NULL):
        return v.col.cast("string")
    raise QueryError(16007, f"can't convert from {v.type.simpleString()} to String")


@operator("$concat")
def _concat(args, scope):
    return Value(F.concat(*[_text(a, "$concat") for a in args]) if args else F.lit(""), STRING)


def _index(name: str, size: Callable[[Column], Column], cut: Callable[[Column, Column, Column], Column]):
    @operator(name, 2, 4)
    def f(args, scope):
        text, part = _text(args[0], name, 40091), _text(args[1], name, 40092)
        start = _number(args[2], name, 40096).cast("int") if len(args) > 2 else F.lit(0)
        end = F.least(_number(args[3], name, 40096).cast("int"), size(text)) if len(args) > 3 else size(text)
        inside = cut(text, start, F.greatest(end - start, F.lit(0)))
        at = _locate(part, inside)
        before = F.substring(inside, 1, at - 1)
        found = F.when(at > 0, start + size(before)).otherwise(-1)
        return Value(F.when(text.isNull(), F.lit(None)).when(start > end, -1).otherwise(found).cast("int"), T.IntegerType())


def _locate(part: Column, text: Column) -> Column:
    return F.call_function("locate", part, text)


def _cut_bytes(text: Column, start: Column, length: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, length), "UTF-8")


def _cut_points(text: Column, start: Column, length: Column) -> Column:
    return F.substring(text, start + 1, length)


_index("$indexOfBytes", F.octet_length, _cut_bytes)
_index("$indexOfCP", F.char_length, _cut_points)


@operator("$split", 2)
def _split(args, scope):
    text, by = _text(args[0], "$split", 40085), _text(args[1], "$split", 40086)
    return Value(F.split(text, F.concat(F.lit("\\Q"), by, F.lit("\\E")), -1), T.ArrayType(STRING))


@operator("$strLenBytes", 1)
def _len_bytes(args, scope):
    return Value(F.octet_length(_text(args[0], "$strLenBytes", 34473)), T.IntegerType())


@operator("$strLenCP", 1)
def _len_points(args, scope):
    return Value(F.char_length(_text(args[0], "$strLenCP", 34471)), T.IntegerType())


def _substr(name: str, cut: Callable, size: Callable):
    @operator(name, 3)
    def f(args, scope):
        text = F.coalesce(stringify(args[0]), F.lit(""))
        start, length = (_number(a, name, 16034).cast("int") for a in args[1:])
        rest = F.greatest(size(text) - start, F.lit(0))
        wanted = F.when(length < 0, rest).otherwise(F.least(length, rest))
        return Value(F.when(start >= size(text), F.lit("")).otherwise(cut(text, start, wanted)), STRING)


_substr("$substr", _cut_bytes, F.octet_length)
_substr("$substrBytes", _cut_bytes, F.octet_length)
_substr("$substrCP", _cut_points, F.char_length)


@operator("$toLower", 1)
def _lower(args, scope):
    return Value(F.lower(stringify(args[0])), STRING)


@operator("$toUpper", 1)
def _upper(args, scope):
    return Value(F.upper(stringify(args[0])), STRING)


# --- dates ------------------------------------------------------------------------------------------------------------


def _date(spec, scope: Scope, name: str) -> Column:
    """The date of ``{date, timezone}`` or of an expression, as a local time; the zone is UTC unless given."""
    zone = None
    if isinstance(spec, dict) and "date" in spec:
        zone, spec = spec.get("timezone"), spec["date"]
    if isinstance(spec, list) and len(spec) == 1:
        spec = spec[0]
    v = compile_expression(spec, scope)
    if v.kind not in (V.DATE, V.NULL):
        raise QueryError(16006, f"can't convert from {v.type.simpleString()} to Date")
    col = v.col.cast("timestamp")
    return col if zone is None else F.from_utc_timestamp(col, compile_expression(zone, scope).col)


def _date_part(name: str, make: Callable[[Column], Column]):
    @operator(name, raw=True)
    def f(spec, scope):
        return Value(make(_date(spec, scope, name)).cast("int"), T.IntegerType())


_date_part("$year", F.year)
_date_part("$month", F.month)
_date_part("$dayOfMonth", F.dayofmonth)
_date_part("$dayOfWeek", lambda d: F.weekday(d) + 1)
_date_part("$dayOfYear", F.dayofyear)
_date_part("$hour", F.hour)
_date_part("$minute", F.minute)
_date_part("$second", F.second)

_pad = lambda n: lambda d: F.lpad(d.cast("string"), n, "0")
#: Letters of a date format.
_FORMATS: dict[str, Callable[[Column, Column], Column]] = {
    "Y": lambda d, z: F.date_format(d, "yyyy"),
    "G": lambda d, z: F.date_format(d, "yyyy"),
    "m": lambda d, z: F.date_format(d, "MM"),
    "d": lambda d, z: F.date_format(d, "dd"),
    "H": lambda d, z: F.date_format(d, "HH"),
    "M": lambda d, z: F.date_format(d, "mm"),
    "S": lambda d, z: F.date_format(d, "ss"),
    "L": lambda d, z: F.date_format(d, "SSS"),
    "j": lambda d, z: _pad(3)(F.dayofyear(d)),
    "u": lambda d, z: (F.weekday(d) + 1).cast("string"),
    "V": lambda d, z: _pad(2)(F.weekofyear(d)),
    "z": lambda d, z: z,
    "%": lambda d, z: F.lit("%"),
}


def _known_zone(name: str) -> bool:
    """A region's name, UTC, GMT or Z, or an offset."""
    if re.fullmatch(r"(UTC|GMT|UT|Z|(UTC|GMT|UT)?[+-]\d{1,2}(:?\d{2}(:?\d{2})?)?)", name):
        return True
    names = zoneinfo.available_timezones()
    return not names or name in names  # without a table of zones here, Spark's own decides


@operator("$dateToString", raw=True)
def _date_to_string(spec, scope):
    if not isinstance(spec, dict):
        raise QueryError(18629, "$dateToString only supports an object as its argument")
    if "date" not in spec:
        raise QueryError(18628, "Missing 'date' parameter to $dateToString")
    for key in spec:
        if key not in ("date", "format", "timezone", "onNull"):
            raise QueryError(18534, f"Unrecognized parameter to $dateToString: {key}")
    text = spec["format"] if spec.get("format") is not None else "%Y-%m-%dT%H:%M:%S.%LZ"
    if not isinstance(text, str):
        raise QueryError(18533, f"$dateToString requires that 'format' be a string, found: {V.literal(text).type.simpleString()} with value {text}")
    if len(re.search(r"%*$", text)[0]) % 2:
        raise QueryError(18535, "Unmatched '%' at end of $dateToString format string")
    zone_name = spec.get("timezone")
    if isinstance(zone_name, str) and not zone_name.startswith("$") and not _known_zone(zone_name):
        raise QueryError(40485, f"$dateToString unrecognized time zone identifier: {zone_name}")
    v = compile_expression(spec["date"], scope)
    if v.kind not in (V.DATE, V.NULL):
        raise QueryError(16006, f"can't convert from {v.type.simpleString()} to Date")
    utc = v.col.cast("timestamp")
    zone = compile_expression(spec["timezone"], scope).col if spec.get("timezone") is not None else F.lit("UTC")
    local = F.from_utc_timestamp(utc, zone)
    minutes = F.floor((F.unix_seconds(local) - F.unix_seconds(utc)) / 60)
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), _pad(2)(F.floor(F.abs(minutes) / 60)), _pad(2)(F.abs(minutes) % 60))
    parts = []
    for plain, letter in re.findall(r"([^%]+)|%(.)", text):
        if plain:
            parts.append(F.lit(plain))
        elif letter in _FORMATS:
            parts.append(_FORMATS[letter](local, offset))
        else:
            raise QueryError(18536, f"Invalid format character '%{letter}' in format string")
    out = F.concat(*parts) if parts else F.lit("")
    if "onNull" in spec:
        return Value(F.when(utc.isNull(), stringify(compile_expression(spec["onNull"], scope))).otherwise(out), STRING)
    return Value(F.when(utc.isNotNull(), out), STRING)


# --- arrays -----------------------------------------------------------------------------------------------------------


def _array(v: Value, name: str, code: int) -> Value:
    if v.kind == V.NULL:
        return Value(F.lit(None).cast("array<void>"), T.ArrayType(T.NullType()))
    if v.kind != V.ARRAY:
        raise QueryError(code, f"{name}'s argument must be an array, but is {v.type.simpleString()}")
    return v


@operator("$arrayElemAt", 2)
def _elem_at(args, scope):
    x = _array(args[0], "$arrayElemAt", 28689)
    i = _number(args[1], "$arrayElemAt", 28690).cast("int")
    return Value(F.get(x.col, F.when(i < 0, F.size(x.col) + i).otherwise(i)), x.type.elementType)


@operator("$concatArrays")
def _concat_arrays(args, scope):
    xs = [_array(a, "$concatArrays", 28664) for a in args]
    t = V.common_type([x.type for x in xs]) if xs else T.ArrayType(T.NullType())
    if t is None:
        raise QueryError(28664, "$concatArrays needs arrays of one type on the typed path")
    return Value(F.concat(*[V.cast(x, t).col for x in xs]) if xs else F.array(), t)


def _each(spec: dict, scope: Scope, name: str, allowed: set[str]) -> tuple[Value, str]:
    if not isinstance(spec, dict):
        raise QueryError(28646, f"{name} only supports an object as its argument")
    if extra := set(spec) - allowed:
        raise QueryError(28647, f"Unrecognized parameter to {name}: {extra.pop()}")
    if "input" not in spec:
        raise QueryError(28648, f"Missing 'input' parameter to {name}")
    return _array(compile_expression(spec["input"], scope), name, 28651), spec.get("as", "this")


@operator("$filter", raw=True)
def _filter(spec, scope):
    x, name = _each(spec, scope, "$filter", {"input", "as", "cond"})
    return Value(F.filter(x.col, lambda e: V.truth(compile_expression(spec["cond"], scope.bind(**{name: Value(e, x.type.elementType)})))), x.type)


@operator("$map", raw=True)
def _map(spec, scope):
    x, name = _each(spec, scope, "$map", {"input", "as", "in"})
    made: list[Value] = []

    def each(e):
        made.append(compile_expression(spec["in"], scope.bind(**{name: Value(e, x.type.elementType)})))
        return made[-1].col

    col = F.transform(x.col, each)
    return Value(col, T.ArrayType(made[-1].type))


@operator("$reduce", raw=True)
def _reduce(spec, scope):
    x, _ = _each(spec, scope, "$reduce", {"input", "initialValue", "in"})
    start = compile_expression(spec["initialValue"], scope)
    t = LONG if V.whole(start.type) else start.type
    # the type of the result may be wider than that of the start: found by compiling the step once
    for _ in range(2):
        probe = compile_expression(spec["in"], scope.bind(value=Value(F.lit(None), t), this=Value(F.lit(None), x.type.elementType)))
        t = V.common_type([t, probe.type]) or t
    step = lambda acc, e: compile_expression(spec["in"], scope.bind(value=Value(acc, t), this=Value(e, x.type.elementType))).col.cast(t)
    return Value(F.aggregate(x.col, start.col.cast(t), step), t)


@operator("$in", 2)
def _in(args, scope):
    x, xs = args
    if xs.kind != V.ARRAY:
        raise QueryError(40081, "$in requires an array as a second argument")
    return Value(F.coalesce(F.exists(xs.col, lambda e: V.equal(x, Value(e, xs.type.elementType))), F.lit(False)), BOOL)


@operator("$indexOfArray", 2, 4)
def _index_of_array(args, scope):
    xs = _array(args[0], "$indexOfArray", 40090)
    start = _number(args[2], "$indexOfArray", 40096).cast("int") if len(args) > 2 else F.lit(0)
    end = F.least(_number(args[3], "$indexOfArray", 40096).cast("int"), F.size(xs.col)) if len(args) > 3 else F.size(xs.col)
    hits = F.filter(F.transform(xs.col, lambda e, i: F.when(V.equal(Value(e, xs.type.elementType), args[1]) & (i >= start) & (i < end), i)), lambda i: i.isNotNull())
    return Value(F.when(xs.col.isNotNull(), F.coalesce(F.get(hits, 0), F.lit(-1))), T.IntegerType())


@operator("$isArray", 1)
def _is_array(args, scope):
    return Value(args[0].col.isNotNull() if args[0].kind == V.ARRAY else F.lit(False), BOOL)


@operator("$reverseArray", 1)
def _reverse(args, scope):
    x = _array(args[0], "$reverseArray", 34435)
    return Value(F.reverse(x.col), x.type)


@operator("$size", 1)
def _size(args, scope):
    if args[0].kind != V.ARRAY:
        raise QueryError(17124, f"The argument to $size must be an array, but was of type: {args[0].type.simpleString()}")
    x = args[0].col
    return Value(F.when(x.isNull(), _fail(17124, "The argument to $size must be an array, but was of type: null").cast("int")).otherwise(F.size(x)), T.IntegerType())


@operator("$slice", 2, 3)
def _slice(args, scope):
    x = _array(args[0], "$slice", 28724)
    size = F.size(x.col)
    if len(args) == 2:
        n = _number(args[1], "$slice", 28725).cast("int")
        start = F.when(n < 0, F.greatest(size + n, F.lit(0))).otherwise(0)
        length = F.least(F.abs(n), size)
    else:
        at, n = (_number(a, "$slice", 28725).cast("int") for a in args[1:])
        start = F.when(at < 0, F.greatest(size + at, F.lit(0))).otherwise(F.least(at, size))
        length = F.when(n < 0, _fail(28729, "Third argument to $slice must be positive").cast("int")).otherwise(F.least(n, size - start))
    return Value(F.slice(x.col, start + 1, length), x.type)


# --- sets -------------------------------------------------------------------------------------------------------------


def _quantified(name: str, code: int, make: Callable):
    @operator(name, 1)
    def f(args, scope):
        x = args[0]
        if x.kind != V.ARRAY:
            raise QueryError(code, f"{name}'s argument must be an array, but is {x.type.simpleString()}")
        return Value(make(x.col, lambda e: V.truth(Value(e, x.type.elementType))), BOOL)


_quantified("$allElementsTrue", 17040, lambda x, f: F.forall(x, f))
_quantified("$anyElementTrue", 17041, lambda x, f: F.coalesce(F.exists(x, f), F.lit(False)))


def _sets(args: list[Value], name: str, code: int) -> tuple[list[Column], T.DataType]:
    xs = [_array(a, name, code) for a in args]
    t = V.common_type([x.type for x in xs])
    if t is None:
        raise QueryError(code, f"{name} needs arrays of one type on the typed path")
    return [V.cast(x, t).col for x in xs], t


@operator("$setDifference", 2)
def _set_difference(args, scope):
    (a, b), t = _sets(args, "$setDifference", 17048)
    return Value(F.array_except(a, b), t)


@operator("$setEquals", 2, 99)
def _set_equals(args, scope):
    cols, _ = _sets(args, "$setEquals", 17044)
    return Value(V.all_of([(F.size(F.array_except(cols[0], c)) == 0) & (F.size(F.array_except(c, cols[0])) == 0) for c in cols[1:]]), BOOL)


@operator("$setIntersection")
def _set_intersection(args, scope):
    if not args:
        return V.array([])
    cols, t = _sets(args, "$setIntersection", 17047)
    out = F.array_distinct(cols[0])
    for c in cols[1:]:
        out = F.array_intersect(out, c)
    return Value(out, t)


@operator("$setIsSubset", 2)
def _set_is_subset(args, scope):
    (a, b), _ = _sets(args, "$setIsSubset", 17046)
    return Value(F.size(F.array_except(a, b)) == 0, BOOL)


@operator("$setUnion")
def _set_union(args, scope):
    if not args:
        return V.array([])
    cols, t = _sets(args, "$setUnion", 17043)
    return Value(F.array_sort(F.array_distinct(F.concat(*cols))), t)


# --- objects ----------------------------------------------------------------------------------------------------------


@operator("$arrayToObject", 1)
def _array_to_object(args, scope):
    x = _array(args[0], "$arrayToObject", 40386)
    e = x.type.elementType
    if isinstance(e, T.StructType) and e.fieldNames() == ["k", "v"]:
        return Value(_last_wins(x.col, lambda p: p["k"], lambda p: p["v"]), T.MapType(STRING, e["v"].dataType))
    if isinstance(e, T.ArrayType):
        return Value(_last_wins(x.col, lambda p: F.get(p, 0), lambda p: F.get(p, 1)), T.MapType(STRING, e.elementType))
    raise QueryError(40398, "$arrayToObject requires pairs or objects with 'k' and 'v'")


def _last_wins(pairs: Column, key: Callable, value: Callable) -> Column:
    """A map whose repeated keys hold their last value, at their first place, whatever the session's policy is."""
    keys = F.array_distinct(F.transform(pairs, lambda p: key(p).cast("string")))
    last = F.transform(keys, lambda k: value(F.element_at(F.filter(pairs, lambda p: key(p).cast("string") == k), -1)))
    return F.map_from_arrays(keys, last)


@operator("$mergeObjects")
def _merge_objects(args, scope):
    fields: dict[str, Value] = {}
    for a in args:
        if a.kind == V.NULL:
            continue
        if not isinstance(a.type, T.StructType):
            raise QueryError(40400, f"$mergeObjects requires object inputs, but input is of type {a.type.simpleString()}")
        for name in a.type.fieldNames():
            new = child(a, name)
            if name in fields and (t := V.common_type([fields[name].type, new.type])) is not None:
                new = Value(F.when(a.col.isNull(), V.cast(fields[name], t).col).otherwise(V.cast(new, t).col), t)
            fields[name] = new
    return V.struct(fields)


@operator("$objectToArray", 1)
def _object_to_array(args, scope):
    x = args[0]
    if x.kind == V.NULL:
        return V.null()
    if isinstance(x.type, T.MapType):
        return Value(F.transform(F.map_entries(x.col), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), T.ArrayType(T.StructType().add("k", STRING).add("v", x.type.valueType)))
    if not isinstance(x.type, T.StructType):
        raise QueryError(40390, f"$objectToArray requires a document input, found: {x.type.simpleString()}")
    held = [child(x, n) for n in x.type.fieldNames()]
    t = V.common_type([h.type for h in held])
    held = [Value(stringify(h), STRING) for h in held] if t is None else [V.cast(h, t) for h in held]
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), h.col.alias("v")) for n, h in zip(x.type.fieldNames(), held, strict=True)])
    return Value(F.when(x.col.isNotNull(), pairs), T.ArrayType(T.StructType().add("k", STRING).add("v", t or STRING)))


# --- conversion -------------------------------------------------------------------------------------------------------

_ISO = r"^\d{4}-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?$"


def _try(x: Value, to: str) -> tuple[Column, T.DataType]:
    """The conversion, null where it fails (an input of null is the caller's matter)."""
    c, k = x.col, x.kind
    if to == "string":
        return stringify(x), STRING
    if to == "bool":
        return (V.truth(x) if k in (V.NUMBER, V.BOOL) else F.lit(True)), BOOL
    if to == "double":
        return (F.unix_millis(c).cast("double") if k == V.DATE else c.cast("double") if k in (V.NUMBER, V.BOOL) else c.try_cast("double") if k == V.STRING else F.lit(None).cast("double")), DOUBLE
    if to in ("int", "long"):
        t, low, high = (T.IntegerType(), -(1 << 31), (1 << 31) - 1) if to == "int" else (LONG, -(1 << 63), (1 << 63) - 1)
        if k == V.STRING:
            return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast(t)), t
        if k == V.NUMBER:
            return (c.cast(t) if V.whole(x.type) and to == "long" else F.when(c >= high, F.lit(high)).when(c <= low, F.lit(low)).otherwise(c.try_cast(t)).cast(t)), t
        if k == V.DATE and to == "long":
            return F.unix_millis(c), t
        return (c.cast(t) if k == V.BOOL else F.lit(None).cast(t)), t
    if to == "date":
        if k == V.DATE:
            return c, TIME
        if k == V.NUMBER and not isinstance(x.type, T.IntegerType):
            return F.timestamp_millis(c.cast("bigint")), TIME
        return (F.when(c.rlike(_ISO), c.try_cast("timestamp")) if k == V.STRING else F.lit(None).cast("timestamp")), TIME
    if to == "objectId":
        return (F.when(c.rlike("^[a-f0-9]{24}$"), c) if k == V.STRING else F.lit(None).cast("string")), STRING
    raise QueryError(2, f"Unknown type name: {to}")


_CODES = {1: "double", 2: "string", 7: "objectId", 8: "bool", 9: "date", 16: "int", 18: "long"}


def _conversion(name: str, to: str):
    @operator(name, 1)
    def f(args, scope):
        (x,) = args
        col, t = _try(x, to)
        failed = _fail(241, f"Failed to convert value to {to} in {name}").cast(t)
        return Value(F.when(x.col.isNull(), F.lit(None).cast(t)).otherwise(F.coalesce(col, failed)), t)


for _name, _to in (("$toBool", "bool"), ("$toDate", "date"), ("$toDouble", "double"), ("$toInt", "int"), ("$toLong", "long"), ("$toObjectId", "objectId"), ("$toString", "string")):
    _conversion(_name, _to)


@operator("$convert", raw=True)
def _convert(spec, scope):
    if not isinstance(spec, dict) or "input" not in spec or "to" not in spec:
        raise QueryError(9, "Missing 'input' or 'to' parameter to $convert")
    if extra := set(spec) - {"input", "to", "onError", "onNull"}:
        raise QueryError(9, f"$convert found an unknown argument: {extra.pop()}")
    to = _CODES.get(spec["to"], spec["to"])
    if to not in _CODES.values():
        raise QueryError(2, f"Unknown type name: {to}")
    x = compile_expression(spec["input"], scope)
    col, t = _try(x, to)
    others = [compile_expression(spec[k], scope) if k in spec else None for k in ("onError", "onNull")]
    u = V.common_type([t, *[o.type for o in others if o]]) or STRING
    error = V.cast(others[0], u).col if others[0] else _fail(241, f"Failed to convert value to {to} in $convert").cast(u)
    nulls = V.cast(others[1], u).col if others[1] else F.lit(None).cast(u)
    return Value(F.when(x.col.isNull(), nulls).when(col.isNull(), error).otherwise(col.cast(u)), u)


@operator("$isNumber", 1)
def _is_number(args, scope):
    return Value(args[0].col.isNotNull() if args[0].kind == V.NUMBER else F.lit(False), BOOL)
