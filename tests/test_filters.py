"""Filters against a matcher in plain Python, on typed documents with nulls, arrays and arrays of objects."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.errors import QueryError
from quillspark.functions.expressions import Scope
from quillspark.functions.paths import fields_of
from quillspark.operators.filters import compile_filter
from quillspark.sources.catalog import find

SCHEMA = "k int, a int, s string, xs array<int>, o struct<x:int,t:string>, os array<struct<x:int,y:int>>"
FIELDS = {"a": int, "s": str, "xs": list, "o": dict, "os": list}


def documents(n=120):
    rng = random.Random(6)
    maybe = lambda v: None if rng.random() < 0.2 else v
    small = lambda: rng.randrange(5)
    rows = []
    for k in range(n):
        o = maybe({"x": maybe(small()), "t": maybe(rng.choice("abc"))})
        os = maybe([{"x": maybe(small()), "y": small()} for _ in range(rng.randrange(3))])
        rows.append({"k": k, "a": maybe(small()), "s": maybe(rng.choice(["ab", "bc", "Ab", "zz"])), "xs": maybe([maybe(small()) for _ in range(rng.randrange(4))]), "o": o, "os": os})
    return rows


def values_at(doc, path):
    """The values a condition looks at: through arrays of objects, one for each element."""
    head, *rest = path
    value = doc.get(head) if isinstance(doc, dict) else None
    if not rest:
        return [value]
    if isinstance(value, list):
        if rest[0].isdigit():
            inner = value[int(rest[0])] if int(rest[0]) < len(value) else None
            return [inner] if len(rest) == 1 else values_at(inner, rest[1:])
        return [v for e in value for v in values_at(e, rest)]
    return values_at(value or {}, rest)


def same_class(a, b):
    return isinstance(a, int) and isinstance(b, int) or isinstance(a, str) and isinstance(b, str)


def one(value, op, arg):
    each = value if isinstance(value, list) else [value]
    if op == "$eq":
        return value == arg or isinstance(value, list) and arg in value
    if op == "$in":
        return any(one(value, "$eq", x) for x in arg)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return any(same_class(e, arg) and {"$gt": e > arg, "$gte": e >= arg, "$lt": e < arg, "$lte": e <= arg}[op] for e in each if same_class(e, arg))
    if op == "$mod":
        return any(isinstance(e, int) and e % arg[0] == arg[1] for e in each)
    if op == "$size":
        return isinstance(value, list) and len(value) == arg
    if op == "$all":
        return isinstance(value, list) and bool(arg) and all(x in value for x in arg)
    if op == "$exists":
        return (value is not None) == arg
    if op == "$regex":
        return any(e is not None and not isinstance(e, (dict, list)) and re.search(arg, str(e)) is not None for e in each)
    if op == "$elemMatch":
        return isinstance(value, list) and any(e is not None and all(one(e, k, v) for k, v in arg.items()) if not isinstance(e, dict) and all(k[0] == "$" for k in arg) else isinstance(e, dict) and matches(e, arg) for e in value)
    raise AssertionError(op)


def condition(doc, path, spec):
    found = values_at(doc, path.split("."))
    if not (isinstance(spec, dict) and any(k.startswith("$") for k in spec)):
        return any(one(v, "$eq", spec) for v in found)
    negative = {"$ne": "$eq", "$nin": "$in"}
    ranges = {k: v for k, v in spec.items() if k in ("$gt", "$gte", "$lt", "$lte", "$mod")}
    parts = []
    for op, arg in spec.items():
        if op in negative:
            parts.append(not any(one(v, negative[op], arg) for v in found))
        elif op == "$not":
            parts.append(not condition(doc, path, arg))
        elif op == "$exists" and not arg:
            parts.append(not any(one(v, "$exists", True) for v in found))
        elif op not in ranges:
            parts.append(any(one(v, op, arg) for v in found))
    if ranges:
        parts.append(any(all(one(e, op, arg) for op, arg in ranges.items()) for v in found for e in (v if isinstance(v, list) else [v])))
    return all(parts)


def matches(doc, query):
    out = True
    for k, v in query.items():
        if k == "$and":
            out = out and all(matches(doc, q) for q in v)
        elif k == "$or":
            out = out and any(matches(doc, q) for q in v)
        elif k == "$nor":
            out = out and not any(matches(doc, q) for q in v)
        else:
            out = out and condition(doc, k, v)
    return out


QUERIES = [
    {"a": 2}, {"a": None}, {"a": 2.0}, {"a": "2"}, {"a": {"$ne": 2}}, {"a": {"$gt": 1, "$lt": 4}}, {"a": {"$in": [1, None]}}, {"a": {"$nin": [1, 2]}}, {"a": {"$mod": [2, 1]}}, {"a": {"$exists": True}}, {"a": {"$exists": False}},
    {"a": {"$not": {"$gte": 3}}}, {"s": {"$regex": "^a"}}, {"s": {"$gt": "b"}}, {"s": {"$gt": 1}}, {"s": {"$in": ["ab", "zz"]}}, {"xs": 3}, {"xs": [1, 2]}, {"xs": []}, {"xs": None}, {"xs": {"$ne": 3}}, {"xs": {"$gt": 2}},
    {"xs": {"$gt": 1, "$lt": 3}}, {"xs": {"$size": 2}}, {"xs": {"$all": [1, 3]}}, {"xs": {"$all": []}}, {"xs": {"$elemMatch": {"$gte": 1, "$lt": 2}}}, {"xs": {"$in": [4]}}, {"xs": {"$nin": [0, 1]}}, {"xs": {"$not": {"$size": 1}}}, {"xs.0": 2}, {"xs.1": {"$gt": 1}},
    {"o.x": 1}, {"o.x": None}, {"o.x": {"$gte": 2}}, {"o.t": {"$ne": "a"}}, {"o.nothing": None}, {"os.x": 1}, {"os.x": {"$gt": 1}, "os.y": {"$lt": 2}}, {"os": {"$elemMatch": {"x": {"$gt": 1}, "y": {"$lt": 2}}}}, {"os.x": {"$ne": 1}}, {"os.0.y": 3}, {"os": {"$size": 0}},
    {"$or": [{"a": 1}, {"xs": 1}]}, {"$and": [{"a": {"$gt": 0}}, {"$nor": [{"s": "ab"}, {"s": "zz"}]}]}, {"$nor": [{"a": None}, {"xs": 2}]},
]


def test_filters_equal_the_plain_matcher(spark):
    docs = documents()
    df = spark.createDataFrame([tuple(d.values()) for d in docs], SCHEMA)
    scope = Scope(fields_of(df))
    got = df.select("k", *[compile_filter(q, scope).alias(f"q{i}") for i, q in enumerate(QUERIES)]).collect()
    for i, q in enumerate(QUERIES):
        assert {r.k for r in got if r[f"q{i}"]} == {d["k"] for d in docs if matches(d, q)}, q
        assert all(r[f"q{i}"] is not None for r in got), q


@pytest.mark.parametrize(("query", "code"), [({"$what": 1}, 2), ({"a": {"$what": 1}}, 2), ({"$or": []}, 2), ({"$and": [1]}, 14817), ({"a": {"$near": 1}}, 2), ({"a": {"$nearSphere": 1}}, 238), ({"a": {"$mod": [2]}}, 2), ({"a": {"$type": []}}, 9), ({"xs": {"$size": "x"}}, 2), ({"xs": {"$elemMatch": 1}}, 2)])
def test_errors(spark, query, code):
    df = spark.createDataFrame([(1, [1])], "a int, xs array<int>")
    with pytest.raises(QueryError) as e:
        find(df, query)
    assert e.value.code == code


def test_types_patterns_and_expressions(spark):
    df = spark.createDataFrame([(1, "abc", 1.5, [1]), (2, None, None, None)], "k int, s string, d double, xs array<int>")
    ids = lambda q: [r.k for r in find(df, q).collect()]
    assert ids({"s": {"$type": "string"}}) == [1] and ids({"s": {"$type": 10}}) == [2] and ids({"d": {"$type": "number"}}) == [1] and ids({"xs": {"$type": "int"}}) == [1] and ids({"s": {"$type": ["int", "string"]}}) == [1]
    assert ids({"s": re.compile("B", re.I)}) == [1] and ids({"s": {"$in": [re.compile("^a")]}}) == [1] and ids({"d": {"$regex": "^1[.]5"}}) == [1] and ids({"s": {"$not": re.compile("b")}}) == [2]
    assert ids({"$expr": {"$gt": ["$d", "$k"]}}) == [1] and ids({"$comment": "x"}) == [1, 2]


def test_conditions_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = find(df, {"o_custkey": 7, "o_totalprice": {"$gt": 100}}, {"o_orderkey": 1})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]
    assert df.filter(F.lit(True)).count() > 0
