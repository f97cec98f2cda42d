"""Inclusion, exclusion and computed fields of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import QueryError
from quillspark.functions import values as V
from quillspark.functions.expressions import Scope, compile_expression
from quillspark.functions.paths import child
from quillspark.functions.values import Value
from quillspark.operators.filters import element_test

Fields = dict[str, Value]


def is_flag(v) -> bool:
    return isinstance(v, bool) or isinstance(v, (int, float))


def tree_of(paths: list[str], code: int = 31249) -> dict:
    """Paths as a tree; a leaf is an empty dict."""
    out: dict = {}
    for path in paths:
        at = out
        parts = path.split(".")
        for k, p in enumerate(parts):
            if p in at and (not at[p] or k == len(parts) - 1):
                raise QueryError(code, f"Path collision at {path}")
            at = at.setdefault(p, {})
    return out


def _rebuild(value: Value, make) -> Value:
    """``make(fields) -> fields`` on an object, or on each object of an array; null stays null."""
    if isinstance(value.type, T.StructType):
        made = make({n: child(value, n) for n in value.type.fieldNames()})
        new = V.struct(made)
        return Value(F.when(value.col.isNotNull(), new.col), new.type)
    if isinstance(value.type, T.ArrayType):
        held: list[Value] = []

        def each(e: Column) -> Column:
            held.append(_rebuild(Value(e, value.type.elementType), make))
            return held[-1].col

        col = F.transform(value.col, each)
        return Value(col, T.ArrayType(held[-1].type))
    return value


def include(fields: Fields, tree: dict) -> Fields:
    """The fields of a tree, in the document's order."""
    out = {}
    for name, value in fields.items():
        if name in tree:
            sub = tree[name]
            if not sub:
                out[name] = value
            elif value.kind in (V.OBJECT, V.ARRAY):
                out[name] = _rebuild(value, lambda f, sub=sub: include(f, sub))
    return out


def exclude(fields: Fields, tree: dict) -> Fields:
    out = {}
    for name, value in fields.items():
        if name not in tree:
            out[name] = value
        elif tree[name]:
            out[name] = _rebuild(value, lambda f, sub=tree[name]: exclude(f, sub))
    return out


def assign(fields: Fields, parts: list[str], value: Value) -> Fields:
    """The fields with one path set; parents are made, and arrays of objects get it in every element. Missing removes."""
    name, *rest = parts
    out = dict(fields)
    if not rest:
        if value.missing:
            out.pop(name, None)
        else:
            out[name] = value
        return out
    old = fields.get(name, V.missing())
    if old.kind == V.OBJECT and isinstance(old.type, T.StructType):
        made = V.struct(assign({n: child(old, n) for n in old.type.fieldNames()}, rest, value))
        out[name] = made
    elif old.kind == V.ARRAY and isinstance(old.type.elementType, T.StructType):
        out[name] = _rebuild(old, lambda f: assign(f, rest, value))
    else:
        out[name] = V.struct(assign({}, rest, value))
    return out


def project(spec: dict, scope: Scope) -> Fields:
    """``$project``."""
    if not isinstance(spec, dict) or not spec:
        raise QueryError(40177, "Invalid $project :: caused by :: specification must have at least one field")
    flat = _flatten(spec)
    flags = {k: bool(v) for k, v in flat.items() if is_flag(v)}
    computed = {k: v for k, v in flat.items() if not is_flag(v)}
    including = any(flags.values()) or bool(computed)
    if including and any(not v and k != "_id" for k, v in flags.items()):
        bad = next(k for k, v in flags.items() if not v and k != "_id")
        raise QueryError(31254, f"Invalid $project :: caused by :: Cannot do exclusion on field {bad} in inclusion projection")
    if not including:
        return exclude(scope.fields, tree_of(list(flags)))
    wanted = [k for k, v in flags.items() if v]
    if "_id" in scope.fields and "_id" not in flat:
        wanted = ["_id", *wanted]
    out = include(scope.fields, tree_of(wanted))
    for path, e in computed.items():
        out = assign(out, path.split("."), compile_expression(e, scope))
    return out


def _flatten(spec: dict, before: str = "") -> dict:
    """Nested plain objects of a projection as dotted paths."""
    out = {}
    for k, v in spec.items():
        if isinstance(v, dict) and v and not any(n.startswith("$") for n in v):
            out |= _flatten(v, f"{before}{k}.")
        else:
            out[before + k] = v
    return out


def add_fields(spec: dict, scope: Scope) -> Fields:
    """``$addFields``: one after the other, each on the document as changed so far."""
    if not isinstance(spec, dict) or not spec:
        raise QueryError(40177, "Invalid $addFields :: caused by :: specification must have at least one field")
    fields = scope.fields
    for path, e in _flatten(spec).items():
        fields = assign(fields, path.split("."), compile_expression(e, Scope(fields, scope.variables)))
    return fields


def find_projection(spec: dict, scope: Scope) -> Fields:
    """A find's projection: flags, ``$slice``, ``$elemMatch``, and ``array.$`` (its first element)."""
    flags = {k: bool(v) for k, v in spec.items() if is_flag(v)}
    special = {k: v for k, v in spec.items() if not is_flag(v)}
    modes = {v for k, v in flags.items() if k != "_id"}
    if len(modes) > 1:
        raise QueryError(31253, "Cannot do exclusion and inclusion in one projection")
    first = [k[:-2] for k, v in flags.items() if k.endswith(".$") and v]
    plain = [k for k in flags if not k.endswith(".$")]
    including = True in modes or any("$elemMatch" in v for v in special.values() if isinstance(v, dict))
    if including or (flags.get("_id") and not modes):
        wanted = [k for k in plain if flags[k]] + first + list(special)
        if flags.get("_id", True) and "_id" in scope.fields and "_id" not in wanted:
            wanted = ["_id", *wanted]
        out = include(scope.fields, tree_of(wanted))
    else:
        out = exclude(scope.fields, tree_of(plain))
    for k in first:
        if k in out and out[k].kind == V.ARRAY:
            out[k] = Value(F.slice(out[k].col, 1, 1), out[k].type)
    for k, v in special.items():
        if k not in out:
            continue
        x = out[k]
        if x.kind != V.ARRAY:
            continue
        if "$slice" in v:
            n = v["$slice"]
            size = F.size(x.col)
            if isinstance(n, list):
                skip, count = n
                if count <= 0:
                    raise QueryError(28724, "$slice limit must be positive")
                at = F.greatest(size + skip, F.lit(0)) if skip < 0 else F.lit(skip)
                out[k] = Value(F.slice(x.col, at + 1, F.lit(count)), x.type)
            else:
                at = F.greatest(size + n, F.lit(0)) if n < 0 else F.lit(0)
                out[k] = Value(F.slice(x.col, at + 1, F.lit(abs(n))), x.type)
        elif "$elemMatch" in v:
            hits = F.filter(x.col, element_test(x.type.elementType, v["$elemMatch"], scope))
            out[k] = Value(F.when(F.size(hits) > 0, F.slice(hits, 1, 1)), x.type)
        else:
            raise QueryError(2, f"Unsupported projection option: {k}: {v}")
    return out
