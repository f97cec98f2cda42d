"""Expressions on literals and on a small typed document, and their compile-time errors."""

import datetime
import math

import pytest

from quillspark.errors import QueryError
from quillspark.functions.expressions import OPERATORS
from quillspark.plans.pipeline import run_pipeline

UTC = datetime.timezone.utc
DATE = datetime.datetime(2021, 3, 14, 15, 9, 26, 535000, tzinfo=UTC)


@pytest.fixture(scope="module")
def doc(spark):
    return spark.createDataFrame(
        [(1, 5, -2.5, "Hé llo", [3, 1, None, 2], [(1, "a"), (2, "b")], DATE, True, None, {"x": 4, "y": {"z": 9}})],
        "_id int, i int, d double, s string, a array<int>, objs array<struct<n:int,t:string>>, at timestamp, yes boolean, no string, sub struct<x:int,y:struct<z:int>>",
    )


def evaluate(doc, *specs):
    row = run_pipeline(doc, [{"$project": {"_id": 0, **{f"x{k}": s for k, s in enumerate(specs)}}}]).first()
    return [row[f"x{k}"] for k in range(len(specs))]


CASES = [
    ({"$abs": -7}, 7), ({"$abs": "$d"}, 2.5), ({"$abs": None}, None), ({"$add": [1, 2, 3.5]}, 6.5), ({"$add": ["$i", None]}, None), ({"$ceil": "$d"}, -2.0),
    ({"$floor": "$d"}, -3), ({"$trunc": "$d"}, -2), ({"$divide": [7, 2]}, 3.5), ({"$mod": [-7, 3]}, -1.0), ({"$multiply": [2147483647, 2]}, 4294967294),
    ({"$pow": [2, 10]}, 1024.0), ({"$sqrt": 16}, 4.0), ({"$exp": 0}, 1.0), ({"$ln": 1}, 0.0), ({"$log10": 1000}, 3.0), ({"$log": {"$exp": 2}}, 2.0),
    ({"$ln": 0}, -math.inf), ({"$range": [5, 0, -2]}, [5, 3, 1]), ({"$range": [3, 3]}, []), ({"$subtract": [5, 8]}, -3), ({"$sum": [1, "x", 2.5]}, 3.5), ({"$sum": "$a"}, 6),
    ({"$avg": "$a"}, 2.0), ({"$avg": ["x"]}, None), ({"$max": "$a"}, 3), ({"$min": [4, None, 2]}, 2), ({"$and": []}, True), ({"$and": ["$i", "$no"]}, False),
    ({"$or": []}, False), ({"$or": [0, ""]}, True), ({"$not": [0]}, True), ({"$cmp": ["$i", 9]}, -1), ({"$cmp": [None, 1]}, -1), ({"$cmp": ["a", 1]}, 1),
    ({"$eq": [1, 1.0]}, True), ({"$eq": ["$missing", None]}, True), ({"$ne": ["$i", "5"]}, True), ({"$gt": [True, "zzz"]}, True), ({"$lt": [None, 0]}, True), ({"$gte": [2, 2]}, True), ({"$lte": ["$no", None]}, True),
    ({"$cond": ["$yes", 1, 2]}, 1), ({"$cond": {"if": "$no", "then": 1, "else": 2.5}}, 2.5), ({"$ifNull": ["$no", "d"]}, "d"), ({"$switch": {"branches": [{"case": "$no", "then": 1}, {"case": "$yes", "then": 2}]}}, 2),
    ({"$literal": {"$add": [1, 2]}}, None), ({"$concat": ["a", "$s"]}, "aHé llo"), ({"$concat": ["a", None]}, None), ({"$indexOfBytes": ["$s", "l"]}, 4), ({"$indexOfCP": ["$s", "l"]}, 3),
    ({"$indexOfCP": ["$s", "q"]}, -1), ({"$indexOfCP": ["$s", "l", 4]}, 4), ({"$split": ["a.b..c", "."]}, ["a", "b", "", "c"]), ({"$strLenBytes": "$s"}, 7), ({"$strLenCP": "$s"}, 6),
    ({"$substr": ["$s", 0, 3]}, "Hé"), ({"$substrBytes": ["$s", 4, -1]}, "llo"), ({"$substrCP": ["$s", 1, 100]}, "é llo"), ({"$substrCP": [None, 1, 2]}, ""), ({"$toLower": "$s"}, "hé llo"), ({"$toUpper": "$no"}, None),
    ({"$year": "$at"}, 2021), ({"$month": "$at"}, 3), ({"$dayOfMonth": "$at"}, 14), ({"$dayOfWeek": "$at"}, 7), ({"$dayOfYear": "$at"}, 73), ({"$hour": "$at"}, 15), ({"$minute": "$at"}, 9), ({"$second": "$at"}, 26),
    ({"$hour": {"date": "$at", "timezone": "Europe/Berlin"}}, 16), ({"$dateToString": {"date": "$at"}}, "2021-03-14T15:09:26.535Z"),
    ({"$dateToString": {"date": "$at", "format": "%d/%m/%Y %j %u %V %G %% %z", "timezone": "+02:00"}}, "14/03/2021 073 7 10 2021 % +0200"), ({"$dateToString": {"date": None, "onNull": "none"}}, "none"),
    ({"$arrayElemAt": ["$a", -1]}, 2), ({"$arrayElemAt": ["$a", 9]}, None), ({"$concatArrays": [[1], [2, 3]]}, [1, 2, 3]), ({"$concatArrays": [[1], None]}, None), ({"$filter": {"input": "$a", "as": "e", "cond": {"$gte": ["$$e", 2]}}}, [3, 2]),
    ({"$map": {"input": "$objs", "in": "$$this.n"}}, [1, 2]), ({"$reduce": {"input": "$objs.t", "initialValue": "", "in": {"$concat": ["$$value", "$$this"]}}}, "ab"), ({"$reduce": {"input": [1, 2], "initialValue": 0, "in": {"$add": ["$$value", 0.5]}}}, 1.0),
    ({"$in": [2, "$a"]}, True), ({"$indexOfArray": ["$a", 2]}, 3), ({"$indexOfArray": ["$a", 3, 1]}, -1), ({"$isArray": "$a"}, True), ({"$isArray": "$s"}, False), ({"$reverseArray": [[1, 2]]}, [2, 1]), ({"$size": "$a"}, 4),
    ({"$slice": ["$a", 2]}, [3, 1]), ({"$slice": ["$a", -9]}, [3, 1, None, 2]), ({"$slice": ["$a", -2, 1]}, [None]), ({"$slice": ["$a", 9, 1]}, []), ({"$allElementsTrue": [[1, 2]]}, True), ({"$allElementsTrue": [[1, 0]]}, False), ({"$anyElementTrue": [[0, None]]}, False),
    ({"$setDifference": [[3, 1, 3, 2], [2]]}, [3, 1]), ({"$setEquals": [[1, 2, 2], [2, 1]]}, True), ({"$setIntersection": [[3, 1, 2], [2, 3]]}, [3, 2]), ({"$setIsSubset": [[1], [2, 1]]}, True), ({"$setUnion": [[3, 1], [2, 1]]}, [1, 2, 3]),
    ({"$toBool": 0}, False), ({"$toBool": ""}, True), ({"$toInt": 3.9}, 3), ({"$toInt": "12"}, 12), ({"$toInt": 1e12}, 2147483647), ({"$toLong": True}, 1), ({"$toDouble": "1.5"}, 1.5), ({"$toString": 5}, "5"), ({"$toObjectId": "0" * 24}, "0" * 24),
    ({"$toLong": {"$toDate": "1970-01-02"}}, 86400000), ({"$convert": {"input": "x", "to": "int", "onError": -1}}, -1), ({"$convert": {"input": None, "to": 1, "onNull": 2.5}}, 2.5), ({"$isNumber": "$d"}, True), ({"$isNumber": "$s"}, False),
    ("$objs.n", [1, 2]), ("$sub.y.z", 9), ("$$ROOT.i", 5), ({"$subtract": ["$at", "$at"]}, 0),
]


def test_values(doc):
    good = [(s, v) for s, v in CASES if "$literal" not in str(s)]
    for k in range(0, len(good), 40):
        got = evaluate(doc, *[s if isinstance(s, (dict, str)) else s for s, _ in good[k : k + 40]])
        for (spec, want), value in zip(good[k : k + 40], got, strict=True):
            assert value == want or (want is not None and isinstance(want, float) and value == pytest.approx(want)), (spec, value, want)


def test_objects_and_dates(doc):
    merged, pairs, back, shifted, nan = evaluate(doc, {"$mergeObjects": ["$sub", {"x": 7}, None]}, {"$objectToArray": {"p": 1, "q": 2}}, {"$arrayToObject": [[{"k": "a", "v": 1}, {"k": "a", "v": 2}]]}, {"$add": ["$at", 1000]}, {"$mod": [5, 0]})
    assert merged.asDict(True) == {"x": 7, "y": {"z": 9}} and [tuple(p) for p in pairs] == [("p", 1), ("q", 2)] and back == {"a": 2}
    assert shifted.second == 27 and math.isnan(nan)


def test_all_operators_are_there():
    assert len(OPERATORS) == 85


@pytest.mark.parametrize(
    ("spec", "code"),
    [
        ({"$nope": 1}, 168), ({"$add": 1, "$abs": 2}, 15983), ("$$who", 17276), ({"$abs": "x"}, 28765), ({"$divide": [1]}, 16020), ({"$multiply": [1, 2, 3]}, 16020), ({"$ifNull": [1]}, 16020), ({"$concat": [1]}, 16702),
        ({"$size": "x"}, 17124), ({"$in": [1, 2]}, 40081), ({"$cond": {"if": 1, "then": 2}}, 17080), ({"$cond": {"if": 1, "then": 2, "else": 3, "or": 4}}, 17083), ({"$dateToString": {"date": None, "format": "%U"}}, 18536), ({"$switch": {"branches": []}}, 40068),
        ({"$convert": {"input": 1, "to": "what"}}, 2), ({"$mergeObjects": [1]}, 40400), ({"$allElementsTrue": [1]}, 17040), ({"$objectToArray": 5}, 40390), ({"$add": ["x"]}, 16554), ({"$year": "x"}, 16006),
    ],
)
def test_errors_at_compile_time(doc, spec, code):
    with pytest.raises(QueryError) as e:
        evaluate(doc, spec)
    assert e.value.code == code


@pytest.mark.parametrize("spec", [{"$divide": ["$i", 0]}, {"$toInt": "1.5"}, {"$switch": {"branches": [{"case": False, "then": 1}]}}, {"$range": [0, 5, 0]}])
def test_errors_of_rows(doc, spec):
    with pytest.raises(Exception, match=r"\[(16608|241|40066|34449)\]"):
        evaluate(doc, spec)
