"""The update language: documents that change fields, compiled to new field values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import BAD_VALUE, CONFLICT, FAILED_TO_PARSE, IMMUTABLE_FIELD, TYPE_MISMATCH, QueryError
from quillspark.functions import values as V
from quillspark.functions.expressions import Scope
from quillspark.functions.paths import child
from quillspark.functions.values import Value
from quillspark.operators.filters import element_test, is_operators
from quillspark.operators.projection import Fields

Change = Callable[[Value], Value]


def either(test: Column, new: Value, old: Value) -> Value:
    """``new`` where the test holds, else ``old``, in the type that holds both."""
    if new.missing and old.missing:
        return old
    t = V.common_type([new.type, old.type]) or merged_struct(new.type, old.type)
    if t is None:
        raise QueryError(TYPE_MISMATCH, f"a field can't hold both {old.type.simpleString()} and {new.type.simpleString()} on the typed path")
    return Value(F.when(test, conformed(new, t).col).otherwise(conformed(old, t).col), t)


def merged_struct(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """Objects with the fields of both."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = []
        for n in [*b.fieldNames(), *[n for n in a.fieldNames() if n not in b.fieldNames()]]:
            held = [s[n].dataType for s in (a, b) if n in s.fieldNames()]
            t = V.common_type(held) or merged_struct(held[0], held[-1])
            if t is None:
                return None
            fields.append(T.StructField(n, t))
        return T.StructType(fields)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = V.common_type([a.elementType, b.elementType]) or merged_struct(a.elementType, b.elementType)
        return None if inner is None else T.ArrayType(inner)
    return None


def conformed(v: Value, t: T.DataType) -> Value:
    """The value in a type with at least its fields."""
    if v.type == t or v.kind == V.NULL:
        return Value(v.col.cast(t), t)
    if isinstance(t, T.StructType) and isinstance(v.type, T.StructType):
        made = V.struct({f.name: conformed(child(v, f.name), f.dataType) for f in t.fields})
        return Value(F.when(v.col.isNotNull(), made.col).cast(t), t)
    if isinstance(t, T.ArrayType) and isinstance(v.type, T.ArrayType):
        return Value(F.transform(v.col, lambda e: conformed(Value(e, v.type.elementType), t.elementType).col).cast(t), t)
    return V.cast(v, t)


class Update:
    def __init__(self, spec: dict, query: dict | None = None, array_filters: list[dict] | None = None):
        if isinstance(spec, list):
            raise QueryError(FAILED_TO_PARSE, "an update with a pipeline is not supported")
        self.spec, self.query = spec, query or {}
        self.replaces = not any(k.startswith("$") for k in spec)
        if not self.replaces and any(not k.startswith("$") for k in spec):
            raise QueryError(FAILED_TO_PARSE, "the update mixes operators and plain fields")
        self.filters = {}
        for f in array_filters or []:
            names = {k.split(".")[0] for k in f}
            if len(names) != 1:
                raise QueryError(FAILED_TO_PARSE, "Expected a single top-level field name in an array filter")
            self.filters[names.pop()] = f
        self._check_conflicts()

    def _check_conflicts(self) -> None:
        seen: list[str] = []
        for op, paths in self.spec.items():
            if op.startswith("$") and isinstance(paths, dict):
                for p in [*paths, *(paths.values() if op == "$rename" else [])]:
                    for other in seen:
                        if p == other or p.startswith(other + ".") or other.startswith(p + "."):
                            raise QueryError(CONFLICT, f"Updating the path '{p}' would create a conflict at '{other}'")
                    seen.append(p)

    def apply(self, fields: Fields, inserting: bool = False) -> Fields:
        """The document's fields after the update."""
        if self.replaces:
            out = {"_id": fields["_id"]} if "_id" in fields else {}
            for k, v in self.spec.items():
                if k != "_id":
                    out[k] = V.literal(v)
            return out
        scope = Scope(fields)
        for op, paths in self.spec.items():
            if op == "$setOnInsert" and not inserting:
                continue
            if op not in OPERATORS:
                raise QueryError(10147, f"Invalid modifier specified: {op}")
            if not isinstance(paths, dict):
                raise QueryError(FAILED_TO_PARSE, f"Modifiers operate on fields but we found type {type(paths).__name__} instead")
            if op == "$rename":
                fields = self._rename(fields, paths)
                continue
            for path, argument in paths.items():
                if path == "_id" or path.startswith("_id."):
                    raise QueryError(IMMUTABLE_FIELD, "Performing an update on the path '_id' would modify the immutable field '_id'")
                change = OPERATORS[op](argument, scope)
                fields = self._edit_fields(fields, path.split("."), change, path.split(".")[0], scope)
        return fields

    def _rename(self, fields: Fields, paths: dict) -> Fields:
        """All values are looked up before any is moved, so renames may take each other's names."""
        found = {}
        for old in paths:
            value = V.missing()
            for k, name in enumerate(old.split(".")):
                value = fields.get(name, V.missing()) if k == 0 else child(value, name)
            if not value.missing:
                found[old] = value
        for old in found:
            fields = self._edit_fields(fields, old.split("."), lambda v: V.missing(), old, Scope(fields))
        for old, value in found.items():
            fields = self._edit_fields(fields, paths[old].split("."), lambda v, value=value: value, paths[old], Scope(fields))
        return fields

    def _edit_fields(self, fields: Fields, parts: list[str], change: Change, path: str, scope: Scope) -> Fields:
        name, *rest = parts
        old = fields.get(name, V.missing())
        new = change(old) if not rest else self._edit(old, rest, change, name, scope)
        out = dict(fields)
        if new.missing:
            out.pop(name, None)
        else:
            out[name] = new
        return out

    def _edit(self, value: Value, parts: list[str], change: Change, path: str, scope: Scope) -> Value:
        name, *rest = parts
        inner = lambda v: change(v) if not rest else self._edit(v, rest, change, f"{path}.{name}", scope)
        if value.kind == V.ARRAY:
            if name == "$[]":
                return self._elements(value, inner, lambda e, i: F.lit(True))
            if name.startswith("$[") and name.endswith("]"):
                key = name[2:-1]
                if key not in self.filters:
                    raise QueryError(BAD_VALUE, f"No array filter found for identifier '{key}' in path '{path}'")
                return self._elements(value, inner, self._filter(key, value.type.elementType, scope))
            if name == "$":
                first = self._first_match(value, path, scope)
                return self._elements(value, inner, lambda e, i: i == first)
            if name.isdigit():
                return self._elements(value, inner, lambda e, i: i == int(name))
            raise QueryError(28, f"Cannot create field '{name}' in element {path}")
        if name.startswith("$"):
            raise QueryError(BAD_VALUE, "The positional operator did not find the match needed from the query.")
        if value.kind not in (V.OBJECT, V.NULL):
            raise QueryError(28, f"Cannot create field '{name}' in element {path}")
        held = {n: child(value, n) for n in value.type.fieldNames()} if isinstance(value.type, T.StructType) else {}
        return V.struct(self._edit_fields(held, parts, change, path, scope))

    def _elements(self, value: Value, change: Change, test: Callable[[Column, Column], Column]) -> Value:
        t = value.type.elementType
        kind: list[T.DataType] = []

        def each(e: Column, i: Column) -> Column:
            old = Value(e, t)
            new = change(old)
            if new.missing:  # an element that goes becomes null
                new = V.null()
            made = either(test(e, i), new, old)
            kind.append(made.type)
            return made.col

        col = F.transform(value.col, each)
        return Value(col, T.ArrayType(kind[-1]))

    def _filter(self, key: str, t: T.DataType, scope: Scope):
        spec = self.filters[key]
        if key in spec:
            test = element_test(t, spec[key] if is_operators(spec[key]) else {"$eq": spec[key]}, scope)
        else:
            test = element_test(t, {k.split(".", 1)[1]: v for k, v in spec.items()}, scope)
        return lambda e, i: test(e)

    def _first_match(self, value: Value, path: str, scope: Scope) -> Column:
        """The index of the first element that the query's condition on this array matches."""
        t = value.type.elementType
        inside = {k[len(path) + 1 :]: v for k, v in self.query.items() if k.startswith(path + ".")}
        if path in self.query:
            q = self.query[path]
            q = q["$elemMatch"] if isinstance(q, dict) and "$elemMatch" in q else q if is_operators(q) else {"$eq": q}
            test = element_test(t, q, scope)
        elif inside:
            test = element_test(t, inside, scope)
        else:
            raise QueryError(BAD_VALUE, "The positional operator did not find the match needed from the query.")
        hits = F.filter(F.transform(value.col, lambda e, i: F.when(test(e), i)), lambda i: i.isNotNull())
        return F.coalesce(F.get(hits, 0), F.lit(-1))


def _arithmetic(name: str, start, make: Callable[[Column, Column], Column]):
    def op(argument, scope):
        n = V.literal(argument)
        if n.kind != V.NUMBER:
            raise QueryError(TYPE_MISMATCH, f"Cannot {name} with non-numeric argument: {argument!r}")

        def change(old: Value) -> Value:
            if old.kind not in (V.NUMBER, V.NULL):
                raise QueryError(TYPE_MISMATCH, f"Cannot apply {name} to a value of non-numeric type {old.type.simpleString()}")
            t = V.common_type([old.type, n.type])
            t = T.LongType() if V.whole(t) and not old.missing and not isinstance(old.type, T.IntegerType) else t
            return Value(make(F.coalesce(old.col.cast(t), F.lit(0).cast(t)), n.col.cast(t)).cast(t), t)

        return change

    return op


def _bound(lower: bool):
    def op(argument, scope):
        new = V.literal(argument)

        def change(old: Value) -> Value:
            if old.missing or old.kind == V.NULL:
                return new
            t = V.common_type([old.type, new.type])
            if t is None:
                raise QueryError(TYPE_MISMATCH, "$min and $max need values of one type on the typed path")
            moves = V.less(new, old) if lower else V.less(old, new)
            return either(old.col.isNull() | moves, new, old)

        return change

    return op


def _set(argument, scope):
    return lambda old: V.literal(argument)


def _unset(argument, scope):
    return lambda old: V.missing()


def _current_date(argument, scope):
    if argument is True or argument == {"$type": "date"} or argument == {"$type": "timestamp"}:
        return lambda old: Value(F.current_timestamp(), T.TimestampType())
    raise QueryError(BAD_VALUE, "$currentDate takes true or a $type of 'date' or 'timestamp'")


def _as_array(old: Value, name: str) -> Value:
    if old.kind == V.NULL:
        return Value(F.array(), T.ArrayType(T.NullType()))
    if old.kind != V.ARRAY:
        raise QueryError(BAD_VALUE, f"The field must be an array but is of type {old.type.simpleString()} for {name}")
    return Value(F.coalesce(old.col, F.array().cast(old.type)), old.type)


def _joined(a: Value, b: Value) -> tuple[Column, Column, T.DataType]:
    t = V.common_type([a.type, b.type]) or merged_struct(a.type, b.type)
    if t is None:
        raise QueryError(TYPE_MISMATCH, "an array needs elements of one type on the typed path")
    return conformed(a, t).col, conformed(b, t).col, t


def _push(argument, scope):
    each = argument["$each"] if isinstance(argument, dict) and "$each" in argument else [argument]
    options = argument if isinstance(argument, dict) and "$each" in argument else {}
    if extra := set(options) - {"$each", "$slice", "$sort", "$position"}:
        raise QueryError(BAD_VALUE, f"Unrecognized clause in $push: {extra.pop()}")

    def change(old: Value) -> Value:
        a, b, t = _joined(_as_array(old, "$push"), V.array([V.literal(v) for v in each]))
        if "$position" in options:
            p = options["$position"]
            at = F.least(F.lit(p), F.size(a)) if p >= 0 else F.greatest(F.size(a) + p, F.lit(0))
            out = F.concat(F.slice(a, F.lit(1), at), b, F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0))))
        else:
            out = F.concat(a, b)
        if "$sort" in options:
            out = _sorted(out, options["$sort"], t.elementType)
        if "$slice" in options:
            n = options["$slice"]
            out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n, F.lit(0)) + 1, F.lit(-n))
        return Value(out, t)

    return change


def _sorted(col: Column, spec, t: T.DataType) -> Column:
    if not isinstance(spec, dict):
        return F.sort_array(col, spec > 0)

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for path, direction in reversed(spec.items()):
            x, y = Value(a, t), Value(b, t)
            for name in path.split("."):
                x, y = child(x, name), child(y, name)
            sign = V.compare(x, y) if direction > 0 else V.compare(y, x)
            out = F.when(sign != 0, sign).otherwise(out)
        return out

    return F.array_sort(col, before)


def _add_to_set(argument, scope):
    each = argument["$each"] if isinstance(argument, dict) and "$each" in argument else [argument]

    def change(old: Value) -> Value:
        a, b, t = _joined(_as_array(old, "$addToSet"), V.array([V.literal(v) for v in each]))
        return Value(F.concat(a, F.array_except(b, a)), t)

    return change


def _pull(argument, scope):
    def change(old: Value) -> Value:
        if old.kind == V.NULL:
            return old
        x = _as_array(old, "$pull")
        t = x.type.elementType
        test = element_test(t, argument if isinstance(argument, dict) else {"$eq": argument}, scope)
        return Value(F.filter(x.col, lambda e: ~test(e)), x.type)

    return change


def _pull_all(argument, scope):
    if not isinstance(argument, list):
        raise QueryError(BAD_VALUE, "$pullAll requires an array argument")

    def change(old: Value) -> Value:
        if old.kind == V.NULL:
            return old
        x = _as_array(old, "$pullAll")
        return Value(F.filter(x.col, lambda e: ~V.any_of([V.equal(Value(e, x.type.elementType), V.literal(v)) for v in argument])), x.type)

    return change


def _pop(argument, scope):
    if argument not in (1, -1):
        raise QueryError(FAILED_TO_PARSE, "$pop expects 1 or -1")

    def change(old: Value) -> Value:
        if old.kind == V.NULL:
            return old
        x = _as_array(old, "$pop")
        rest = F.greatest(F.size(x.col) - 1, F.lit(0))
        return Value(F.slice(x.col, F.lit(1) if argument == 1 else F.lit(2), rest), x.type)

    return change


def _bit(argument, scope):
    raise QueryError(10147, "Invalid modifier specified: $bit")


OPERATORS = {
    "$set": _set, "$setOnInsert": _set, "$unset": _unset, "$inc": _arithmetic("$inc", 0, lambda a, b: a + b), "$mul": _arithmetic("$mul", 0, lambda a, b: a * b),
    "$min": _bound(True), "$max": _bound(False), "$currentDate": _current_date, "$rename": None, "$push": _push, "$addToSet": _add_to_set,
    "$pull": _pull, "$pullAll": _pull_all, "$pop": _pop, "$bit": _bit,
}


def changed_fields(fields: Fields, update: Update, match: Column) -> Fields:
    """All documents' fields, those that match with the update applied."""
    new = update.apply(fields)
    names = [*fields, *[k for k in new if k not in fields]]
    return {k: fields[k] if new.get(k) is fields.get(k) else either(match, new.get(k, V.missing()), fields.get(k, V.missing())) for k in names}


def seed(query: dict) -> dict:
    """The fields that a query's equalities give an upserted document."""
    out: dict = {}
    for k, v in query.items():
        if k == "$and" or (k == "$or" and len(v) == 1):
            for part in v:
                out |= seed(part)
        elif k.startswith("$"):
            continue
        elif is_operators(v):
            if "$eq" in v:
                out[k] = v["$eq"]
            elif k == "_id" and v.get("$in"):
                out[k] = v["$in"][0]
        else:
            out[k] = v
    return out
