"""Collections, updates, commands and change streams."""

import pytest

from quillspark.commands import Session
from quillspark.errors import QueryError
from quillspark.operators.updates import Update
from quillspark.sources import catalog
from quillspark.sources.catalog import Engine
from quillspark.streaming.changes import ChangeCursor, events, invalidated, token, watch


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/engine")


def docs(df):
    """Documents without absent (null) fields, in natural order."""

    def clean(v):
        return {k: clean(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [clean(x) for x in v] if isinstance(v, list) else v

    return [clean(r.asDict(True)) for r in df.collect()]


def test_insert_find_update_delete(engine):
    c = engine["db"]["c"]
    assert c.insert([{"_id": 1, "a": 1, "s": {"x": 1}}, {"_id": 2, "a": 2, "xs": [1, 2, 3]}, {"_id": 3}]) == 3
    assert docs(c.find({"a": {"$gte": 2}})) == [{"_id": 2, "a": 2, "xs": [1, 2, 3]}] and c.count() == 3 and c.count({"a": None}) == 1
    assert c.update({"a": {"$gt": 0}}, {"$inc": {"a": 10}, "$set": {"s.y": "new"}}, multi=True) == {"n": 2, "nModified": 2, "upserted": None}
    assert docs(c.find({"_id": 1})) == [{"_id": 1, "a": 11, "s": {"x": 1, "y": "new"}}]
    assert c.update({"_id": 2}, {"$set": {"a": 12}})["nModified"] == 0
    assert c.update({"_id": 9, "a": {"$gt": 5}}, {"$set": {"b": 1}, "$setOnInsert": {"t": "up"}}, upsert=True)["upserted"] == 9
    assert docs(c.find({"_id": 9})) == [{"_id": 9, "b": 1, "t": "up"}]
    assert c.update({"_id": 3}, {"a": 7})["nModified"] == 1 and docs(c.find({"_id": 3})) == [{"_id": 3, "a": 7}]
    assert c.delete({"a": {"$lt": 12}}, 1) == 1 and c.delete({}) == 3 and c.count() == 0
    with pytest.raises(QueryError) as e:
        c.update({}, {"a": 1}, multi=True)
    assert e.value.code == 10158


CHANGES = [
    ({"$push": {"xs": 9}}, {"xs": [1, 2, 3, 9]}), ({"$push": {"xs": {"$each": [0, 5], "$position": 1}}}, {"xs": [1, 0, 5, 2, 3]}), ({"$push": {"xs": {"$each": [0], "$sort": -1, "$slice": 2}}}, {"xs": [3, 2]}), ({"$push": {"new": 1}}, {"new": [1]}),
    ({"$addToSet": {"xs": {"$each": [3, 4]}}}, {"xs": [1, 2, 3, 4]}), ({"$pull": {"xs": {"$gt": 1}}}, {"xs": [1]}), ({"$pullAll": {"xs": [1, 3]}}, {"xs": [2]}), ({"$pop": {"xs": 1}}, {"xs": [1, 2]}), ({"$pop": {"xs": -1}}, {"xs": [2, 3]}),
    ({"$min": {"a": 3}}, {"a": 3}), ({"$max": {"a": 3}}, {"a": 5}), ({"$mul": {"a": 2}}, {"a": 10}), ({"$inc": {"nothing": 2}}, {"nothing": 2}), ({"$set": {"xs.1": 7}}, {"xs": [1, 7, 3]}), ({"$set": {"xs.$[]": 0}}, {"xs": [0, 0, 0]}), ({"$set": {"o.p": 4}}, {"o": {"n": 1, "p": 4}}),
    ({"$inc": {"ds.$[].k": 1}}, {"ds": [{"k": 2, "t": "a"}, {"k": 3, "t": "b"}]}), ({"$pull": {"ds": {"t": "a"}}}, {"ds": [{"k": 2, "t": "b"}]}), ({"$unset": {"o.n": ""}}, {"o": {}}), ({"$rename": {"a": "z"}}, {"z": 5}),
]


def test_update_operators(spark):
    from quillspark.functions.paths import fields_of

    df = spark.createDataFrame([(1, 5, [1, 2, 3], (1,), [(1, "a"), (2, "b")])], "_id int, a int, xs array<int>, o struct<n:int>, ds array<struct<k:int,t:string>>")
    for change, want in CHANGES:
        fields = Update(change).apply(fields_of(df))
        row = df.select(*[v.col.alias(k) for k, v in fields.items()]).first().asDict(True)
        assert {k: row[k] for k in want} == want, change
    picked = Update({"$set": {"xs.$[big]": 0, "ds.$.t": "hit"}}, {"ds.k": 2}, [{"big": {"$gte": 2}}]).apply(fields_of(df))
    row = df.select(*[v.col.alias(k) for k, v in picked.items()]).first().asDict(True)
    assert row["xs"] == [1, 0, 0] and row["ds"] == [{"k": 1, "t": "a"}, {"k": 2, "t": "hit"}]


@pytest.mark.parametrize(("change", "code"), [({"$bit": {"a": 1}}, 10147), ({"$set": {"a": 1}, "$inc": {"a.b": 1}}, 40), ({"$set": {"_id": 2}}, 66), ({"$inc": {"a": "x"}}, 14), ({"$set": {"a": 1}, "b": 2}, 9), ([{"$set": {"a": 1}}], 9), ({"$push": {"a": 1}}, 2), ({"$set": {"xs.$[q]": 1}}, 2)])
def test_update_errors(spark, change, code):
    from quillspark.functions.paths import fields_of

    df = spark.createDataFrame([(1, 5, [1])], "_id int, a int, xs array<int>")
    with pytest.raises(QueryError) as e:
        Update(change).apply(fields_of(df))
    assert e.value.code == code


def test_unique_keys_and_find_and_modify(engine):
    c = engine["db"]["c"]
    c.insert([{"_id": 1, "k": "a", "n": 1}, {"_id": 2, "k": "b", "n": 2}])
    c.create_index({"k": 1}, unique=True)
    for bad in ([{"_id": 1}], [{"_id": 3, "k": "a"}]):
        with pytest.raises(QueryError) as e:
            c.insert(bad)
        assert e.value.code == 11000
    assert c.count() == 2 and sorted(c.indexes()) == ["_id_", "k_1"]
    assert c.find_and_modify({}, {"$inc": {"n": 5}}, sort={"n": -1}, new=True, fields={"n": 1}) == {"_id": 2, "n": 7}
    assert c.find_and_modify({"k": "a"}, remove=True)["_id"] == 1 and c.count() == 1
    assert c.aggregate([{"$indexStats": {}}, {"$match": {"name": "k_1"}}]).count() == 1 and engine["db"].system_indexes().count() == 2 and engine["db"].namespaces().first()["name"] == "db.c"
    c.drop_index("k_1")
    c.insert([{"_id": 4, "k": "b"}])
    assert c.stats()["count"] == 2 and c.validate()["valid"]


def test_out_and_merge(engine):
    db = engine["db"]
    db["src"].insert([{"_id": 1, "g": "x", "v": 1}, {"_id": 2, "g": "y", "v": 2}, {"_id": 3, "g": "x", "v": 3}])
    group = {"$group": {"_id": "$g", "total": {"$sum": "$v"}}}
    assert db["src"].aggregate([group, {"$out": "sums"}]).count() == 0
    assert {d["_id"]: d["total"] for d in docs(db["sums"].find())} == {"x": 4, "y": 2}
    db["keep"].insert([{"_id": "x", "note": "old", "total": 0}, {"_id": "z", "note": "only"}])
    db["src"].aggregate([group, {"$merge": {"into": "keep"}}])
    assert {d["_id"]: d for d in docs(db["keep"].find())} == {"x": {"_id": "x", "note": "old", "total": 4}, "y": {"_id": "y", "total": 2}, "z": {"_id": "z", "note": "only"}}
    db["src"].aggregate([group, {"$merge": {"into": "keep", "whenMatched": [{"$addFields": {"total": {"$add": ["$total", "$$new.total"]}}}], "whenNotMatched": "discard"}}])
    assert {d["_id"]: d.get("total") for d in docs(db["keep"].find())} == {"x": 8, "y": 4, "z": None}
    with pytest.raises(QueryError) as e:
        db["src"].aggregate([group, {"$merge": {"into": "keep", "on": "note"}}])
    assert e.value.code == 51183
    with pytest.raises(QueryError):
        db["src"].aggregate([{"$out": "a"}, {"$match": {}}])


def test_change_stream(engine):
    c = engine["db"]["c"]
    c.insert([{"_id": 1, "a": 1}, {"_id": 2, "a": 2}])
    c.update({"_id": 1}, {"$set": {"a": 5}})
    c.delete({"_id": 2})
    engine["db"]["other"].insert([{"_id": 7}])
    seen = watch(c).orderBy("clusterTime", "documentKey").collect()
    assert [r.operationType for r in seen] == ["insert", "insert", "update", "delete"] and seen[2].fullDocument.a == 5 and seen[2].documentKey._id == 1
    assert seen[0]._id._data == token(1, '{"_id":1}') and (seen[0].ns.db, seen[0].ns.coll) == ("db", "c")
    after = events(c, [{"$project": {"operationType": 1}}], resume_after=seen[0]._id._data, stream=False).collect()
    assert [r.operationType for r in after] == ["insert", "update", "delete"]  # the other insert of the same write too
    now = events(c, [{"$match": {"operationType": "update"}}], start_at=1, full_document="updateLookup", stream=False).first()
    assert now.fullDocument.asDict() == {"_id": 1, "a": 5}
    assert events(c, stream=False).count() == 0  # from now on
    with pytest.raises(QueryError):
        events(c, [{"$group": {"_id": 1}}])


def test_change_cursors_stay_open_and_end_with_the_collection(engine):
    c = engine["db"]["c"]
    c.insert([{"_id": 1}])
    tail = ChangeCursor(c)
    assert tail.take(5) == []
    c.insert([{"_id": 2, "v": 1}, {"_id": 3, "v": 2}])
    first = tail.take(1)
    assert [d["documentKey"]["_id"] for d in first + tail.take(5)] == [2, 3] and tail.take(5) == []
    engine["db"]["d"].insert([{"_id": 9}])
    c.drop()
    assert [d["operationType"] for d in tail.take(5)] == ["drop"]
    assert ChangeCursor(c, resume_after=tail.after).take(3) == [{"_id": {"_data": tail.after}, "operationType": "invalidate"}]
    assert not invalidated(c, first[0]["_id"]) and ChangeCursor(c, start_after=tail.after).take(1) == []
    other = ChangeCursor(engine["db"]["d"])
    engine["db"].drop()
    assert [d["operationType"] for d in other.take(5)] == ["dropDatabase"]


def test_writes_append_and_compact(engine, monkeypatch):
    c = engine["db"]["c"]
    c.insert([{"_id": k, "v": k} for k in range(5)])
    first = c.meta()["segments"]
    c.update({"v": {"$gte": 3}}, {"$inc": {"v": 10}}, multi=True)
    c.delete({"_id": 0})
    assert c.meta()["segments"][:1] == first and len(c.meta()["segments"]) == 2 and len(c.meta()["gone"]) == 2
    want = [{"_id": 1, "v": 1}, {"_id": 2, "v": 2}, {"_id": 3, "v": 13}, {"_id": 4, "v": 14}]
    assert docs(c.find(sort={"$natural": 1})) == want and docs(c.find(sort={"$natural": -1})) == want[::-1]
    with pytest.raises(QueryError) as e:
        c.insert([{"_id": 4}])
    assert e.value.code == 11000 and c.insert([{"_id": 0, "v": 0}]) == 1
    stale = c.meta()
    c.delete({"_id": 0})
    with pytest.raises(QueryError) as e:
        c._save_meta(stale)
    assert e.value.code == 112
    monkeypatch.setattr(catalog, "COMPACT", 2)
    c.update({"_id": 1}, {"$set": {"w": "x"}})
    assert len(c.meta()["segments"]) == 1 and not c.meta()["gone"] and docs(c.find(sort={"_id": 1})) == [want[0] | {"w": "x"}, *want[1:]]
    assert engine.tick() + 1 == engine.tick() == engine.now()


def test_batches_insert_what_they_can(engine):
    c = engine["db"]["c"]
    c.create_index({"k": -1}, unique=True)
    c.insert([{"_id": 1, "k": 1}])
    batch = [{"_id": 2, "k": 2}, {"_id": 3, "k": 1}, {"_id": 4, "k": 2}, {"_id": 5, "k": 5}, {"_id": 5, "k": 6}]
    n, errors = c.insert_some(batch, ordered=False)
    assert (n, [e["index"] for e in errors], {e["code"] for e in errors}) == (2, [1, 2, 4], {11000}) and c.count() == 3
    n, errors = c.insert_some([{"_id": 7, "k": 7}, {"_id": 1, "k": 8}, {"_id": 9, "k": 9}])
    assert (n, [e["index"] for e in errors]) == (1, [1]) and c.count({"_id": 9}) == 0
    stats = {r["name"]: r for r in c.aggregate([{"$indexStats": {}}]).collect()}
    assert stats["k_-1"].key == {"k": -1} and stats["k_-1"].spec.v == 2 and stats["k_-1"].accesses.ops == 0 and stats["k_-1"].host
    engine.read_only = True
    for write in (lambda: c.drop_index("k_-1"), lambda: c.delete({}), lambda: c.update({}, {"$set": {"a": 1}}), lambda: engine.rename("db.c", "other.c")):
        with pytest.raises(QueryError) as e:
            write()
        assert e.value.code == 20


def test_commands(engine):
    s = Session(engine)
    run = lambda **c: s.run("db", c)
    assert run(ping=1) == {"ok": 1} and run(nonsense=1)["code"] == 59
    assert run(insert="c", documents=[{"_id": k, "v": k % 3} for k in range(7)])["n"] == 7
    assert run(insert="c", documents=[{"_id": 9}, {"_id": 1}, {"_id": 10}], ordered=False)["writeErrors"][0]["index"] == 1 and run(count="c", query={})["n"] == 9
    first = run(find="c", filter={"v": {"$exists": True}}, sort={"_id": 1}, batchSize=3)["cursor"]
    assert [d["_id"] for d in first["firstBatch"]] == [0, 1, 2]
    more = run(getMore=first["id"], batchSize=10)["cursor"]
    assert [d["_id"] for d in more["nextBatch"]] == [3, 4, 5, 6] and more["id"] == 0
    assert run(distinct="c", key="v")["values"] == [None, 0, 1, 2] or run(distinct="c", key="v", query={"v": {"$exists": True}})["values"] == [0, 1, 2]
    assert run(update="c", updates=[{"q": {"_id": 1}, "u": {"$set": {"v": 8}}}])["nModified"] == 1
    assert run(findAndModify="c", query={"_id": 1}, update={"$inc": {"v": 1}}, new=True)["value"]["v"] == 9
    assert run(aggregate="c", pipeline=[{"$match": {"v": 9}}, {"$count": "n"}], cursor={})["cursor"]["firstBatch"] == [{"n": 1}]
    assert run(delete="c", deletes=[{"q": {"_id": 9}, "limit": 1}])["n"] == 1 and run(createIndexes="c", indexes=[{"key": {"v": 1}}])["ok"] == 1
    assert [c["name"] for c in run(listCollections=1)["cursor"]["firstBatch"]] == ["c"] and run(renameCollection="db.c", to="other.c")["ok"] == 1 and run(renameCollection="other.c", to="db.d")["ok"] == 1 and run(drop="c")["code"] == 26
    assert run(collStats="d")["count"] == 8 and run(dbStats=1)["collections"] == 1 and run(listIndexes="d")["cursor"]["firstBatch"][0]["name"] == "_id_"
    assert [d["_id"] for d in run(find="d", filter={"$query": {"v": {"$gte": 1}}, "$orderby": {"_id": -1}}, batchSize=2)["cursor"]["firstBatch"]] == [10, 5] or run(count="d", query={})["n"] == 8
    tail = run(aggregate="d", pipeline=[{"$changeStream": {}}], cursor={})["cursor"]
    assert tail["id"] and tail["firstBatch"] == [] and run(insert="d", documents=[{"_id": 99}])["n"] == 1
    assert [e["documentKey"]["_id"] for e in run(getMore=tail["id"], maxTimeMS=500)["cursor"]["nextBatch"]] == [99] and run(getMore=tail["id"])["cursor"]["nextBatch"] == []
    bad = run(aggregate="d", pipeline=[{"$bucket": {"groupBy": "$_id", "boundaries": [0, 3]}}], cursor={})
    assert bad["code"] == 40066 and bad["errmsg"].startswith("PlanExecutor error during aggregation :: caused by :: ")
    assert run(dropDatabase=1)["ok"] == 1 and run(killCursors="d", cursors=[5])["cursorsNotFound"] == [5]
    engine.read_only = True
    assert run(insert="c", documents=[{"_id": 1}])["code"] == 20 and run(find="c")["ok"] == 1
