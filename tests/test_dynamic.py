"""Documents of any shape, and BSON."""

import datetime
import decimal
import json

import pytest
from pyspark.sql import types as T

from quillspark.errors import QueryError
from quillspark.functions.dynamic import Dynamic
from quillspark.sources import bson
from quillspark.sources.bson import BsonSource, decode, encode

DOCS = [{"k": 1, "a": 5}, {"k": 2, "a": 5.0}, {"k": 3, "a": "5"}, {"k": 4, "a": None}, {"k": 5}, {"k": 6, "a": [1, 5]}, {"k": 7, "a": {"b": 2}}, {"k": 8, "a": True}, {"k": 9, "a": 7.5}]


@pytest.fixture(scope="module")
def dynamic(spark):
    return Dynamic.from_json(spark.createDataFrame([(json.dumps(d),) for d in DOCS], "j string").coalesce(1), "j")


def ks(d):
    return [json.loads(r.doc)["k"] for r in d.to_json().collect()]


def test_filters_tell_null_from_missing_and_compare_within_types(dynamic):
    for query, want in [
        ({"a": 5}, [1, 2, 6]), ({"a": None}, [4, 5]), ({"a": {"$exists": True}}, [1, 2, 3, 4, 6, 7, 8, 9]), ({"a": {"$exists": False}}, [5]), ({"a": {"$type": "null"}}, [4]), ({"a": {"$gt": 5}}, [9]), ({"a": {"$gte": "4"}}, [3]),
        ({"a": {"$in": [True, "5"]}}, [3, 8]), ({"a": {"$ne": 5}}, [3, 4, 5, 7, 8, 9]), ({"a.b": 2}, [7]), ({"a.0": 1}, [6]), ({"a": {"$type": "number"}}, [1, 2, 6, 9]), ({"a": {"$size": 2}}, [6]), ({"$or": [{"k": 1}, {"a": {"$regex": "^5"}}]}, [1, 2, 3, 6]), ({"a": {"$not": {"$lt": 6}}}, [3, 4, 5, 7, 8, 9]),
    ]:
        assert ks(dynamic.match(query)) == want, query
    with pytest.raises(QueryError):
        dynamic.match({"a": {"$what": 1}})


def test_order_groups_and_distinct(dynamic):
    assert ks(dynamic.sort({"a": 1, "k": 1})) == [4, 5, 1, 2, 9, 3, 7, 6, 8]
    got = {r._id.toJson() if r._id is not None else None: (r.n, r.s) for r in dynamic.group("$a", {"n": {"$sum": 1}, "s": {"$sum": "$k"}}).collect()}
    assert got["5"] == (2, 3.0) and got['"5"'] == (1, 3.0) and sum(n for n, _ in got.values()) == 9
    assert [r.value.toJson() for r in dynamic.distinct("a").collect()] == ["null", "1", "5", "7.5", '"5"', '{"b":2}', "true"]


def test_large_whole_numbers_stay_apart(spark):
    big = 1 << 53
    d = Dynamic.from_json(spark.createDataFrame([(json.dumps({"k": k, "a": a}),) for k, a in enumerate([big, big + 1, float(big), big + 2, -big - 1, 2.5])], "j string").coalesce(1), "j")
    assert ks(d.match({"a": big})) == [0, 2] and ks(d.match({"a": {"$gt": big}})) == [1, 3] and ks(d.sort({"a": 1, "k": 1})) == [4, 5, 0, 2, 1, 3]


def test_tagged_json_keeps_types(spark):
    from quillspark.sources.tagged import tagged, untagged

    kind = "a long, b int, c double, d decimal(10,2), e string, f boolean, g timestamp, h binary, i array<struct<x:long,y:string>>, j map<string,double>, k struct<z:date>"
    when = datetime.datetime(2020, 5, 17, 1, 2, 3, 4005)
    rows = [(1 << 60, 2, 1.5, decimal.Decimal("3.25"), "é", True, when, b"\x00\xff", [(1, "a"), (None, None)], {"m": 0.1}, (when.date(),)), (None,) * 11]
    df = spark.createDataFrame(rows, kind)
    assert untagged(tagged(df), df.schema).collect() == df.collect()
    assert json.loads(tagged(df).first().doc)["a"] == {"$numberLong": str(1 << 60)}


def test_bson_round_trip(spark, tmp_path, monkeypatch):
    when = datetime.datetime(2020, 5, 17, 1, 2, 3, 4000, tzinfo=datetime.timezone.utc)
    d = {"_id": {"$oid": "ab" * 12}, "i": 1, "l": 1 << 40, "d": 1.5, "s": "é", "b": b"\x01", "n": None, "t": True, "w": when, "xs": [1, "two", {"three": 3.0}]}
    want = d | {"b": {"$binary": {"base64": "AQ==", "subType": "00"}}, "w": {"$date": "2020-05-17T01:02:03.004Z"}}
    assert decode(encode(d)) == want
    (tmp_path / "a.bson").write_bytes(encode(d) + encode({"x": 2}))
    spark.dataSource.register(BsonSource)
    rows = [json.loads(r.doc) for r in spark.read.format("bson").load(str(tmp_path)).collect()]
    assert rows == [want, {"x": 2}]
    monkeypatch.setattr(bson, "PART", 100)
    parts = bson._Reader(str(tmp_path / "a.bson"), T.StructType.fromDDL("doc string")).partitions()
    assert [p.value[1:] for p in parts] == [(0, len(encode(d))), (len(encode(d)), len(encode(d)) + len(encode({"x": 2})))]
    kind = "_id string, i int, l long, d double, s string, b binary, n string, t boolean, w timestamp, xs array<string>, gone int"
    one = spark.read.format("bson").schema(kind).load(str(tmp_path)).first()
    assert (one._id, one.i, one.l, one.d, one.s, bytes(one.b), one.n, one.t, one.gone) == ("ab" * 12, 1, 1 << 40, 1.5, "é", b"\x01", None, True, None)
    assert one.w == when.replace(microsecond=4000).astimezone().replace(tzinfo=None) or one.w == when.replace(tzinfo=None)
    assert one.xs == ["1", "two", '{"three": 3.0}']
    with pytest.raises(ValueError):
        decode(encode(d)[:4] + b"\x00" + encode(d)[5:])
