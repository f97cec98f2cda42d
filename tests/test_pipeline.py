"""Stages, accumulators and lookups on small collections."""

import pytest
from pyspark.sql import functions as F

from quillspark.errors import QueryError
from quillspark.plans.pipeline import run_pipeline
from quillspark.sources.catalog import distinct, find


def rows(df):
    return [r.asDict(True) for r in df.collect()]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [(1, "pen", 3, 10.0, ["s", "m"]), (2, "ink", 1, 4.0, []), (3, "pen", 2, 12.5, None), (4, None, 5, 1.0, ["m"]), (5, "ink", 1, 6.0, ["l", "s", "m"])],
        "_id int, item string, qty int, price double, sizes array<string>",
    )


def test_group_sort_and_order_of_first_last_push(sales):
    got = rows(run_pipeline(sales, [{"$sort": {"price": -1}}, {"$group": {"_id": "$item", "n": {"$sum": 1}, "first": {"$first": "$_id"}, "last": {"$last": "$_id"}, "all": {"$push": "$_id"}, "q": {"$avg": "$qty"}, "set": {"$addToSet": "$qty"}, "text": {"$sum": "$item"}}}, {"$sort": {"_id": 1}}]))
    assert got == [
        {"_id": None, "n": 1, "first": 4, "last": 4, "all": [4], "q": 5.0, "set": [5], "text": 0},
        {"_id": "ink", "n": 2, "first": 5, "last": 2, "all": [5, 2], "q": 1.0, "set": [1], "text": 0},
        {"_id": "pen", "n": 2, "first": 3, "last": 1, "all": [3, 1], "q": 2.5, "set": [2, 3], "text": 0},
    ]
    mixed = rows(run_pipeline(sales, [{"$sort": {"item": -1, "price": 1}}, {"$group": {"_id": None, "f": {"$first": "$_id"}, "p": {"$push": "$_id"}}}]))
    assert mixed == [{"_id": None, "f": 1, "p": [1, 3, 2, 5, 4]}]
    assert rows(run_pipeline(sales.limit(0), [{"$group": {"_id": None, "n": {"$sum": 1}}}])) == []
    assert rows(run_pipeline(sales.limit(0), [{"$count": "n"}])) == []


def test_unwind(sales):
    keep = {"path": "$sizes", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}
    got = rows(run_pipeline(sales, [{"$unwind": keep}, {"$project": {"_id": 1, "sizes": 1, "at": 1}}, {"$sort": {"_id": 1, "at": 1}}]))
    assert [(r["_id"], r["sizes"], r["at"]) for r in got] == [(1, "s", 0), (1, "m", 1), (2, None, None), (3, None, None), (4, "m", 0), (5, "l", 0), (5, "s", 1), (5, "m", 2)]
    assert run_pipeline(sales, [{"$unwind": "$sizes"}]).count() == 6 and run_pipeline(sales, [{"$unwind": "$item"}]).count() == 4


def test_bucket_facet_and_sort_by_count(sales):
    got = rows(run_pipeline(sales, [{"$bucket": {"groupBy": "$price", "boundaries": [0, 5, 10], "default": "more", "output": {"n": {"$sum": 1}, "ids": {"$push": "$_id"}}}}]))
    assert [(r["_id"], r["n"], sorted(r["ids"])) for r in got] == [("0", 2, [2, 4]), ("5", 1, [5]), ("more", 2, [1, 3])]
    facet = rows(run_pipeline(sales, [{"$facet": {"by": [{"$sortByCount": "$item"}], "n": [{"$match": {"qty": {"$gt": 100}}}, {"$count": "n"}], "top": [{"$sort": {"price": -1}}, {"$limit": 2}, {"$project": {"_id": 1}}]}}]))
    assert facet[0]["n"] == [] and facet[0]["top"] == [{"_id": 3}, {"_id": 1}] and [x["count"] for x in facet[0]["by"]] == [2, 2, 1]
    with pytest.raises(Exception, match="40066"):
        run_pipeline(sales, [{"$bucket": {"groupBy": "$price", "boundaries": [0, 5]}}]).collect()


def test_projection_and_fields(spark):
    df = spark.createDataFrame([(1, (2, [(3, "x"), (4, "y")]), [(5, 6)])], "_id int, a struct<n:int,l:array<struct<p:int,q:string>>>, o array<struct<u:int,v:int>>")
    one = lambda *p: rows(run_pipeline(df, list(p)))[0]
    assert one({"$project": {"a.l.p": 1}}) == {"_id": 1, "a": {"l": [{"p": 3}, {"p": 4}]}}
    assert one({"$project": {"a.l": 0, "o.u": 0}}) == {"_id": 1, "a": {"n": 2}, "o": [{"v": 6}]}
    assert one({"$project": {"_id": 0, "x": "$a.l.q", "gone": "$nothing"}}) == {"x": ["x", "y"]}
    assert one({"$addFields": {"a.m": {"$add": ["$a.n", 1]}, "o.w": 9, "b.c": 1, "_id": "$nothing"}}) == {"a": {"n": 2, "l": [{"p": 3, "q": "x"}, {"p": 4, "q": "y"}], "m": 3}, "o": [{"u": 5, "v": 6, "w": 9}], "b": {"c": 1}}
    assert one({"$unset": ["a.l", "o"]}) == {"_id": 1, "a": {"n": 2}}
    assert one({"$replaceRoot": {"newRoot": {"$mergeObjects": ["$a", {"n": 8}]}}}, {"$project": {"n": 1}}) == {"n": 8}
    assert rows(find(df, None, {"o": {"$slice": -1}, "a": 1}))[0]["o"] == [{"u": 5, "v": 6}]
    assert rows(find(df, None, {"o": {"$elemMatch": {"u": 7}}, "_id": 1})) == [{"_id": 1, "o": None}]
    assert rows(find(df, None, {"_id": 0, "a.n": 1})) == [{"a": {"n": 2}}]


def test_sort_with_arrays_and_nulls(spark):
    df = spark.createDataFrame([(1, [3, 1]), (2, []), (3, None), (4, [2]), (5, [None, 9])], "_id int, xs array<int>")
    order = lambda d: [r["_id"] for r in rows(find(df, sort={"xs": d, "_id": 1}))]
    assert order(1) == [2, 3, 5, 1, 4]
    assert order(-1) == [5, 1, 4, 3, 2]
    assert [r.value for r in distinct(df, "xs").collect()] == [None, 1, 2, 3, 9]


def test_lookups(spark):
    books = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 99)], "_id int, title string, author int")
    authors = spark.createDataFrame([(10, "X", [1, 5]), (None, "nobody", [2]), (11, "Y", None)], "_id int, name string, wrote array<int>")
    get = {"authors": authors, "books": books}.get
    look = {"$lookup": {"from": "authors", "localField": "author", "foreignField": "_id", "as": "who"}}
    names = {r["_id"]: [w["name"] for w in r["who"]] for r in rows(run_pipeline(books, [look], get))}
    assert names == {1: ["X"], 2: ["nobody"], 3: []}
    by_array = {"$lookup": {"from": "authors", "localField": "_id", "foreignField": "wrote", "as": "who"}}
    assert {r["_id"]: [w["name"] for w in r["who"]] for r in rows(run_pipeline(books, [by_array], get))} == {1: ["X"], 2: ["nobody"], 3: []}
    from_array = {"$lookup": {"from": "books", "localField": "wrote", "foreignField": "_id", "as": "b"}}
    assert {r["name"]: [b["title"] for b in r["b"]] for r in rows(run_pipeline(authors, [from_array], get))} == {"X": ["a"], "nobody": ["b"], "Y": []}
    assert [r["who"] for r in rows(run_pipeline(books, [{"$lookup": {"from": "none", "localField": "a", "foreignField": "b", "as": "who"}}], get))] == [[], [], []]
    inner = rows(run_pipeline(books, [look, {"$unwind": "$who"}, {"$project": {"_id": 1, "n": "$who.name"}}, {"$sort": {"_id": 1}}], get))
    assert inner == [{"_id": 1, "n": "X"}, {"_id": 2, "n": "nobody"}]
    theta = {"$lookup": {"from": "books", "let": {"k": "$_id"}, "pipeline": [{"$match": {"$expr": {"$gt": ["$_id", "$$k"]}}}, {"$addFields": {"d": {"$subtract": ["$_id", "$$k"]}}}, {"$sort": {"_id": -1}}, {"$project": {"_id": 0, "d": 1}}], "as": "later"}}
    assert {r["_id"]: [x["d"] for x in r["later"]] for r in rows(run_pipeline(books, [theta], get))} == {1: [2, 1], 2: [1], 3: []}


def test_lookup_idioms_become_joins(spark):
    books = spark.createDataFrame([(1, 10), (2, 11)], "_id int, author int")
    authors = spark.createDataFrame([(10,)], "_id int")
    look = {"$lookup": {"from": "a", "localField": "author", "foreignField": "_id", "as": "who"}}
    plan = lambda *p: run_pipeline(books, [look, *p], lambda n: authors)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan({"$match": {"who": {"$ne": []}}}, {"$unset": "who"}) and "LeftAnti" in plan({"$match": {"who": []}}, {"$unset": "who"})
    assert "Join Inner" in plan({"$unwind": "$who"}) and "collect_list" not in plan({"$unwind": "$who"})


def test_graph_lookup_follows_cycles_once(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "_id int, to int")
    walk = {"from": "n", "startWith": "$to", "connectFromField": "to", "connectToField": "_id", "as": "seen", "depthField": "d"}
    got = {r["_id"]: [(s["_id"], s["d"]) for s in r["seen"]] for r in rows(run_pipeline(nodes, [{"$graphLookup": walk}], lambda n: nodes))}
    assert got[4] == [] and sorted(got[1]) == [(1, 2), (2, 0), (3, 1)]
    short = {r["_id"]: len(r["seen"]) for r in rows(run_pipeline(nodes, [{"$graphLookup": walk | {"maxDepth": 0}}], lambda n: nodes))}
    assert short == {1: 1, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize(
    ("stage", "code"),
    [
        ({"$nope": 1}, 40324), ({"$set": {"a": 1}}, 40324), ({"$match": {}, "$limit": 1}, 40323), ({"$project": {}}, 40177), ({"$project": {"item": 1, "qty": 0}}, 31254), ({"$group": {"n": {"$sum": 1}}}, 15955), ({"$group": {"_id": 1, "n": {"$what": 1}}}, 15952),
        ({"$group": {"_id": 1, "n": {"$sum": 1, "$avg": 1}}}, 40238), ({"$bucket": {"groupBy": "$qty", "boundaries": [1]}}, 40192), ({"$bucket": {"groupBy": "$qty", "boundaries": [2, 1]}}, 40194), ({"$replaceRoot": {"newRoot": "$qty"}}, 40228), ({"$replaceRoot": {}}, 40231),
        ({"$unwind": "sizes"}, 28818), ({"$sample": {"size": -1}}, 28746), ({"$geoNear": {}}, 238), ({"$redact": "$$DESCEND"}, 238), ({"$lookup": {"from": "x", "as": "y"}}, 9), ({"$addFields": {}}, 40177),
    ],
)
def test_errors(sales, stage, code):
    with pytest.raises(QueryError) as e:
        run_pipeline(sales, [stage])
    assert e.value.code == code


def test_fields_used_of_a_lookup():
    from quillspark.plans.lookup import fields_used

    for following, want in [
        ([{"$project": {"a": 1, "n": {"$size": "$x"}, "s": {"$sum": "$x.q"}}}], {"q"}),
        ([{"$match": {"x.k": 1, "x": {"$elemMatch": {"r": 2, "q.z": 3}}}}, {"$project": {"a": 1}}], {"k", "r", "q"}),
        ([{"$addFields": {"y": "$x.q"}}, {"$group": {"_id": "$y", "n": {"$sum": 1}}}], {"q"}),
        ([{"$match": {"$expr": {"$gt": [{"$size": "$x"}, 1]}}}, {"$sort": {"a": 1}}, {"$limit": 3}, {"$count": "n"}], set()),
        ([{"$project": {"x": 0}}], set()),
        ([{"$project": {"x": 1}}], None),
        ([{"$match": {"x": {"$ne": []}}}, {"$project": {"a": 1}}], None),
        ([{"$project": {"y": "$x"}}], None),
        ([{"$project": {"y": "$$ROOT"}}], None),
        ([{"$unwind": "$x"}], None),
        ([], None),
    ]:
        assert fields_used("x", following) == want, following
    assert fields_used("x.y", [{"$project": {"a": 1}}]) is None


def test_lookup_reads_only_what_is_used(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, t string").write.parquet(f"{tmp_path}/left")
    spark.createDataFrame([(1, 2.0, "long text"), (1, 3.0, "other")], "fk int, v double, text string").write.parquet(f"{tmp_path}/right")
    left, right = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("left", "right"))
    out = run_pipeline(left, [{"$lookup": {"from": "r", "localField": "k", "foreignField": "fk", "as": "x"}}, {"$project": {"k": 1, "n": {"$size": "$x"}, "s": {"$sum": "$x.v"}}}], lambda name: right)
    assert [tuple(r) for r in out.collect()] == [(1, 2, 5.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "fk:int,v:double>" in plan.replace(" ", "") and "text:string" not in plan.split("right")[-1]


ORDERS = [(1, 10, 5.0), (2, 10, 7.0), (3, 20, 1.0)]
LINES = [(1, "a", [1, 2]), (1, "b", []), (2, "a", [3]), (2, "c", None), (9, "z", [4])]


def test_any_stage_in_a_correlated_lookup(spark):
    orders = spark.createDataFrame(ORDERS, "o int, c int, total double")
    lines = spark.createDataFrame(LINES, "ol int, part string, tags array<int>")
    get = lambda name: {"orders": orders, "lines": lines}.get(name)
    of = {"$match": {"$expr": {"$eq": ["$ol", "$$o"]}}}

    def inner(*stages):
        spec = {"$lookup": {"from": "lines", "let": {"o": "$o", "t": "$total"}, "pipeline": [of, *stages], "as": "x"}}
        return {r.o: [y.asDict(True) for y in r.x] for r in run_pipeline(orders, [spec], get).collect()}

    part = {"$project": {"part": 1}}
    assert inner({"$unwind": "$tags"}, {"$project": {"tags": 1}}) == {1: [{"tags": 1}, {"tags": 2}], 2: [{"tags": 3}], 3: []}
    assert sorted(str(x) for x in inner({"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}, {"$project": {"part": 1, "i": 1}})[2]) == ["{'part': 'a', 'i': 0}", "{'part': 'c', 'i': None}"]
    assert inner({"$sort": {"part": -1}}, {"$skip": 1}, part) == {1: [{"part": "a"}], 2: [{"part": "a"}], 3: []}
    assert inner({"$redact": {"$cond": [{"$eq": ["$part", "a"]}, "$$PRUNE", "$$KEEP"]}}, part) == {1: [{"part": "b"}], 2: [{"part": "c"}], 3: []}
    assert {k: len(v) for k, v in inner({"$sample": {"size": 1}}).items()} == {1: 1, 2: 1, 3: 0}
    assert inner({"$sortByCount": "$ol"}) == {1: [{"_id": 1, "count": 2}], 2: [{"_id": 2, "count": 2}], 3: []}
    assert inner({"$bucket": {"groupBy": {"$add": ["$ol", "$$t"]}, "boundaries": [0, 7, 20]}}) == {1: [{"_id": 0, "count": 2}], 2: [{"_id": 7, "count": 2}], 3: []}
    assert inner({"$facet": {"n": [{"$count": "n"}], "p": [{"$match": {"part": "a"}}, part]}}) == {1: [{"n": [{"n": 2}], "p": [{"part": "a"}]}], 2: [{"n": [{"n": 2}], "p": [{"part": "a"}]}], 3: [{"n": [], "p": []}]}
    nested = {"$lookup": {"from": "orders", "let": {"l": "$ol"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o", "$$l"]}, {"$eq": ["$total", "$$t"]}]}}}, {"$project": {"c": 1}}], "as": "y"}}
    assert inner({"$match": {"part": "a"}}, nested, {"$project": {"y": 1}}) == {1: [{"y": [{"c": 10}]}], 2: [{"y": [{"c": 10}]}], 3: []}
    plain = {"$lookup": {"from": "orders", "localField": "ol", "foreignField": "o", "as": "y"}}
    assert inner({"$match": {"part": "a"}}, plain, {"$project": {"y.total": 1}}) == {1: [{"y": [{"total": 5.0}]}], 2: [{"y": [{"total": 7.0}]}], 3: []}
    for bad, code in (({"$out": "a"}, 51047), ({"$what": 1}, 40324), ({"$limit": 0}, 15958)):
        with pytest.raises(QueryError) as e:
            inner(bad)
        assert e.value.code == code


def test_skip_takes_no_task_for_all_rows(spark):
    n = 20_000
    df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 3).alias("same"), F.concat(F.lit("x"), F.col("id")).alias("text"))
    found = run_pipeline(df, [{"$sort": {"k": 1}}, {"$skip": 100}, {"$project": {"k": 1}}])
    assert found.columns == ["k"] and [r.k for r in found.collect()] == list(range(100, n))
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.k for r in run_pipeline(df, [{"$sort": {"k": -1}}, {"$skip": 12_345}]).collect()] == list(range(n - 12_346, -1, -1))
    ties = run_pipeline(df, [{"$sort": {"same": -1}}, {"$skip": 9_000}]).collect()  # most of the ties lie in a few tasks
    assert len({r.text for r in ties}) == len(ties) == n - 9_000 and [r.same for r in ties] == sorted((r.same for r in ties), reverse=True)
    assert {r.text for r in run_pipeline(df, [{"$skip": 7_000}]).collect()} == {f"x{k}" for k in range(7_000, n)}
    assert [r.k for r in run_pipeline(df, [{"$sort": {"k": 1}}, {"$skip": 50}, {"$skip": 19_000}, {"$match": {"k": {"$lt": 19_053}}}]).collect()] == [19_050, 19_051, 19_052]
    assert [r.k for r in run_pipeline(df, [{"$sort": {"k": 1}}, {"$skip": 5}, {"$limit": 3}]).collect()] == [5, 6, 7]
    assert run_pipeline(df, [{"$skip": 5}, {"$sort": {"k": 1}}, {"$skip": 3}, {"$group": {"_id": None, "n": {"$sum": 1}}}]).first().n == n - 8
    assert run_pipeline(df, [{"$sort": {"k": 1}}, {"$skip": n}]).count() == run_pipeline(df.limit(0), [{"$skip": 1}]).count() == 0
    assert run_pipeline(df, [{"$sort": {"k": 1}}, {"$skip": 0}, {"$limit": 1}]).first().k == 0
