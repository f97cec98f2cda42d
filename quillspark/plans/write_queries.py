"""Queries that write: updates, deletes, ``$merge``, ``$out``, and a change stream, over scratch collections.

The update queries change whole tables as DataFrames (what a collection's new version is made of); the others go
through an engine in a temporary folder of the session's shared storage.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.commands import Session
from quillspark.errors import QueryError
from quillspark.functions.expressions import Scope
from quillspark.functions.paths import fields_of
from quillspark.operators.filters import compile_filter
from quillspark.operators.updates import Update, changed_fields
from quillspark.plans.catalogue import QUERIES, Query, finish, tables
from quillspark.plans.pipeline import run_pipeline
from quillspark.sources.bson import BsonSource, encode
from quillspark.sources.catalog import Engine, find
from quillspark.sources.storage import read, shared_folder, write
from quillspark.sources.tagged import tagged, untagged
from quillspark.streaming.changes import ChangeCursor, events, watch


def updated(df: DataFrame, query: dict, change: dict, array_filters: list[dict] | None = None) -> DataFrame:
    fields = fields_of(df)
    new = changed_fields(fields, Update(change, query, array_filters), compile_filter(query, Scope(fields)))
    return df.select(*[v.col.alias(k) for k, v in new.items()])


def _update(name: str, table: str, before: list[dict], query: dict, change: dict, after: list[dict], sql: str, array_filters=None, **post: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = updated(run_pipeline(tables(spark, sf_dir)(table), before), query, change, array_filters)
        return finish(run_pipeline(df, after), post)

    QUERIES[f"update_{name}"] = Query(run, sql)


_KEEP = [{"$project": {"c_custkey": 1, "c_acctbal": 1, "c_mktsegment": 1}}]
_update("set_inc", "customer", [], {"c_mktsegment": "BUILDING"}, {"$set": {"c_mktsegment": "HOUSES"}, "$inc": {"c_acctbal": 10.5}}, _KEEP, "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_update("mul", "customer", [], {"c_custkey": {"$lt": 50}}, {"$mul": {"c_acctbal": 2}}, [{"$project": {"c_custkey": 1, "c_acctbal": 1}}], "SELECT c_custkey, CASE WHEN c_custkey < 50 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
_update("min_max", "part", [], {}, {"$min": {"p_size": 20}, "$max": {"p_retailprice": 1200}}, [{"$project": {"p_partkey": 1, "p_size": 1, "p_retailprice": 1}}], "SELECT p_partkey, least(p_size, 20) AS p_size, greatest(p_retailprice, 1200) AS p_retailprice FROM part", p_size="CAST(p_size AS INT)")
_update("rename_unset", "nation", [], {}, {"$rename": {"n_name": "title"}, "$unset": {"n_regionkey": ""}}, [{"$project": {"n_nationkey": 1, "title": 1, "gone": {"$eq": ["$n_regionkey", None]}}}], "SELECT n_nationkey, n_name AS title, TRUE AS gone FROM nation")
_TAGS = [{"$project": {"p_partkey": 1, "p_size": 1, "tags": {"$range": [0, {"$mod": ["$p_size", 4]}]}}}]
_JOIN = {"tags": "array_join(tags, ',')"}
_update("push", "part", _TAGS, {"p_size": {"$gt": 25}}, {"$push": {"tags": {"$each": [9, 7], "$sort": -1, "$slice": 3}}}, [{"$project": {"p_partkey": 1, "tags": 1}}], "SELECT p_partkey, array_to_string(CASE WHEN p_size > 25 THEN list_reverse_sort(list_concat(range(0, p_size % 4), [9, 7]))[1:3] ELSE range(0, p_size % 4) END, ',') AS tags FROM part", **_JOIN)
_update("add_to_set", "part", _TAGS, {}, {"$addToSet": {"tags": {"$each": [1, 8]}}}, [{"$project": {"p_partkey": 1, "tags": 1}}], "SELECT p_partkey, array_to_string(CASE WHEN p_size % 4 >= 2 THEN list_concat(range(0, p_size % 4), [8]) ELSE list_concat(range(0, p_size % 4), [1, 8]) END, ',') AS tags FROM part", **_JOIN)
_update("pull", "part", _TAGS, {}, {"$pull": {"tags": {"$gte": 1}}}, [{"$project": {"p_partkey": 1, "tags": 1}}], "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE '0' END AS tags FROM part", **_JOIN)
_update("pull_all", "part", _TAGS, {}, {"$pullAll": {"tags": [0, 2]}}, [{"$project": {"p_partkey": 1, "tags": 1}}], "SELECT p_partkey, CASE WHEN p_size % 4 >= 2 THEN '1' ELSE '' END AS tags FROM part", **_JOIN)
_update("pop", "part", _TAGS, {}, {"$pop": {"tags": -1}}, [{"$project": {"p_partkey": 1, "tags": 1}}], "SELECT p_partkey, array_to_string(range(1, p_size % 4), ',') AS tags FROM part", **_JOIN)
_update("array_filters", "part", _TAGS, {}, {"$inc": {"tags.$[big]": 100}}, [{"$project": {"p_partkey": 1, "tags": 1}}], "SELECT p_partkey, array_to_string([CASE WHEN t >= 2 THEN t + 100 ELSE t END FOR t IN range(0, p_size % 4)], ',') AS tags FROM part", [{"big": {"$gte": 2}}], **_JOIN)
_update("positional", "part", _TAGS, {"tags": {"$gt": 0}}, {"$set": {"tags.$": 50}}, [{"$project": {"p_partkey": 1, "tags": 1}}], "SELECT p_partkey, array_to_string([CASE WHEN t = 1 THEN 50 ELSE t END FOR t IN range(0, p_size % 4)], ',') AS tags FROM part", **_JOIN)
_update("positional_all", "part", _TAGS, {}, {"$inc": {"tags.$[]": 5}}, [{"$project": {"p_partkey": 1, "tags": 1}}], "SELECT p_partkey, array_to_string([t + 5 FOR t IN range(0, p_size % 4)], ',') AS tags FROM part", **_JOIN)
_update("rename_swap", "nation", [], {}, {"$rename": {"n_name": "n_title", "n_regionkey": "n_part"}}, [{"$project": {"n_nationkey": 1, "n_title": 1, "n_part": 1}}], "SELECT n_nationkey, n_name AS n_title, n_regionkey AS n_part FROM nation")
_update("current_date", "region", [], {}, {"$currentDate": {"at": True}}, [{"$project": {"r_regionkey": 1, "set": {"$gt": ["$at", None]}}}], "SELECT r_regionkey, TRUE AS set FROM region")


def _engine(spark: SparkSession):
    return Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex[:10]}")["db"]


def _customers(spark: SparkSession, sf_dir: str, name: str = "customers"):
    db = _engine(spark)
    db[name].insert(tables(spark, sf_dir)("customer").withColumnRenamed("c_custkey", "_id"))
    return db


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db["customers"].delete({"c_acctbal": {"$lt": 0}})
    return db["customers"].find(projection={"_id": 1})


def _collection_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)["customers"]
    c.update({"c_nationkey": 3}, {"$set": {"flag": True}}, multi=True)
    c.update({"_id": -5}, {"$set": {"flag": False}, "$setOnInsert": {"c_name": "new"}}, upsert=True)
    return c.aggregate([{"$group": {"_id": "$flag", "n": {"$sum": 1}}}])


def _out(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db["customers"].aggregate([{"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}}}, {"$out": "segments"}])
    return db["segments"].find()


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db["orders"].insert(tables(spark, sf_dir)("orders").withColumnRenamed("o_orderkey", "_id"))
    db["orders"].aggregate([{"$group": {"_id": {"$add": ["$o_custkey", 100]}, "spent": {"$max": "$o_totalprice"}}}, {"$merge": "customers"}])
    return db["customers"].find(projection={"_id": 1, "c_nationkey": 1, "spent": 1})


def _merge_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``whenMatched`` and ``whenNotMatched``, on one collection of nations each."""
    out, db = None, _engine(spark)
    nation = tables(spark, sf_dir)("nation").withColumnRenamed("n_nationkey", "_id")
    db["new"].insert(nation.selectExpr("_id + 20 AS _id", "concat('new ', n_name) AS n_name"))
    modes = [("replace", "insert"), ("keepExisting", "insert"), ("merge", "discard"), ([{"$addFields": {"n_name": {"$concat": ["$n_name", "+", "$$new.n_name"]}}}], "insert"), ("fail", "insert"), ("merge", "fail")]
    for k, (matched, not_matched) in enumerate(modes):
        target = db[f"to{k}"]
        target.insert(nation)
        try:
            db["new"].aggregate([{"$merge": {"into": target.name, "whenMatched": matched, "whenNotMatched": not_matched}}])
        except (PySparkException, Py4JJavaError, QueryError):
            pass  # these two modes refuse the write: the collection stays as it was
        one = target.find(projection={"_id": 1, "n_name": 1, "n_regionkey": 1}).withColumn("mode", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert of a table, one of documents with other fields, and a batch with keys that are taken."""
    c = _customers(spark, sf_dir)["customers"]
    c.insert([{"_id": -1, "c_name": "new", "tags": ["a", "b"]}, {"_id": -2, "c_acctbal": 5.5}])
    n, errors = c.insert_some([{"_id": -3, "c_name": "third"}, {"_id": 1}, {"_id": -3}], ordered=False)
    return c.find(projection={"_id": 1, "c_name": 1, "c_acctbal": 1, "tags": 1}).withColumn("tags", F.array_join("tags", ",")).withColumn("errors", F.lit(len(errors) * 10 + n))


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some writes are refused by a unique key over array elements, and what is there after them."""
    c = _engine(spark)["c"]
    c.create_index({"tags": 1}, unique=True, sparse=True)
    codes = []
    for documents in ([{"_id": 1, "tags": ["a", "b"]}], [{"_id": 2, "tags": ["c", "b"]}], [{"_id": 3}, {"_id": 4}], [{"_id": 5, "tags": ["d"]}, {"_id": 6, "tags": ["d"]}], [{"_id": 1}], [{"_id": 7, "tags": ["e"]}]):
        try:
            c.insert(documents)
            codes.append(0)
        except QueryError as e:
            codes.append(e.code)
    return c.find(projection={"_id": 1}).withColumn("codes", F.lit(",".join(map(str, codes))))


def _replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)["customers"]
    c.update({"_id": 3}, {"c_name": "replaced"})
    return c.find(projection={"_id": 1, "c_name": 1, "c_nationkey": 1})


def _find_and_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)["customers"]
    richest = c.find_and_modify({}, {"$set": {"c_name": "first"}}, sort={"c_acctbal": -1, "_id": 1}, new=True, fields={"c_name": 1})
    poorest = c.find_and_modify({}, remove=True, sort={"c_acctbal": 1, "_id": 1}, fields={"c_name": 1})
    made = c.find_and_modify({"_id": -9}, {"$set": {"c_name": "made"}}, upsert=True, new=True, fields={"c_name": 1})
    return spark.createDataFrame([(n, r["_id"], r["c_name"]) for n, r in (("changed", richest), ("removed", poorest), ("made", made))], "what string, _id long, c_name string").crossJoin(c.aggregate([{"$count": "n"}]))


def _natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _engine(spark)["nations"]
    c.insert([r.asDict() for r in tables(spark, sf_dir)("nation").orderBy("n_nationkey").collect()])
    first, last = c.find(sort={"$natural": 1}, skip=2, limit=3), c.find(sort={"$natural": -1}, limit=4)
    return first.select(F.lit("first").alias("end"), "n_nationkey").union(last.select(F.lit("last"), "n_nationkey"))


QUERIES["write_insert"] = Query(_insert, "SELECT c_custkey AS _id, c_name, c_acctbal, NULL AS tags, 21 AS errors FROM customer UNION ALL SELECT -1, 'new', NULL, 'a,b', 21 UNION ALL SELECT -2, NULL, 5.5, NULL, 21 UNION ALL SELECT -3, 'third', NULL, NULL, 21")
QUERIES["write_unique_keys"] = Query(_unique, "SELECT CAST(unnest([1, 3, 4, 7]) AS INTEGER) AS _id, '0,11000,0,11000,11000,0' AS codes")
QUERIES["write_replacement"] = Query(_replacement, "SELECT c_custkey AS _id, CASE WHEN c_custkey = 3 THEN 'replaced' ELSE c_name END AS c_name, CASE WHEN c_custkey <> 3 THEN c_nationkey END AS c_nationkey FROM customer")
QUERIES["write_find_and_modify"] = Query(
    _find_and_modify,
    "SELECT 'changed' AS what, (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS _id, 'first' AS c_name, (SELECT count(*) FROM customer) AS n UNION ALL "
    "SELECT 'removed', (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1), (SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1), (SELECT count(*) FROM customer) UNION ALL SELECT 'made', -9, 'made', (SELECT count(*) FROM customer)",
)
QUERIES["find_natural"] = Query(_natural, "SELECT * FROM (SELECT 'first' AS end, n_nationkey FROM nation ORDER BY n_nationkey LIMIT 3 OFFSET 2) UNION ALL SELECT * FROM (SELECT 'last', n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 4)")
QUERIES["write_merge_modes"] = Query(
    _merge_modes,
    "WITH new AS (SELECT n_nationkey + 20 AS k, 'new ' || n_name AS name FROM nation), "
    "pair AS (SELECT coalesce(n_nationkey, k) AS _id, n_name, n_regionkey, name, n_nationkey IS NOT NULL AS had, k IS NOT NULL AS got FROM nation FULL JOIN new ON n_nationkey = k) "
    "SELECT _id, CASE WHEN got THEN name ELSE n_name END AS n_name, CASE WHEN NOT got THEN n_regionkey END AS n_regionkey, 0 AS mode FROM pair UNION ALL "
    "SELECT _id, CASE WHEN had THEN n_name ELSE name END, n_regionkey, 1 FROM pair UNION ALL SELECT _id, CASE WHEN got THEN name ELSE n_name END, n_regionkey, 2 FROM pair WHERE had UNION ALL "
    "SELECT _id, CASE WHEN had AND got THEN n_name || '+' || name WHEN had THEN n_name ELSE name END, n_regionkey, 3 FROM pair UNION ALL SELECT n_nationkey, n_name, n_regionkey, 4 FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 5 FROM nation",
)
QUERIES["write_delete"] = Query(_delete, "SELECT c_custkey AS _id FROM customer WHERE NOT c_acctbal < 0")
QUERIES["write_update_upsert"] = Query(_collection_update, "SELECT CASE WHEN c_nationkey = 3 THEN TRUE END AS _id, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT FALSE, 1")
QUERIES["write_out"] = Query(_out, "SELECT c_mktsegment AS _id, count(*) AS n FROM customer GROUP BY 1")
QUERIES["write_merge"] = Query(_merge, "SELECT coalesce(c_custkey, k) AS _id, c_nationkey, spent FROM customer FULL JOIN (SELECT o_custkey + 100 AS k, max(o_totalprice) AS spent FROM orders GROUP BY 1) ON c_custkey = k")


def _logged(spark: SparkSession, sf_dir: str):
    db = _engine(spark)
    c = db["nations"]
    c.insert(tables(spark, sf_dir)("nation").withColumnRenamed("n_nationkey", "_id"))
    c.update({"n_regionkey": 1}, {"$set": {"n_regionkey": 9}}, multi=True)
    c.delete({"n_regionkey": 2})
    return c


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = watch(_logged(spark, sf_dir), [{"$match": {"operationType": {"$ne": "drop"}}}])
    return events.groupBy("operationType").agg(F.count(F.lit(1)).alias("n"))


def _change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' documents, in order of time, resumed in the middle of the first write."""
    c = _logged(spark, sf_dir)
    cursor = ChangeCursor(c, start_at=1)
    token = cursor.take(5)[-1]["_id"]
    rest = events(c, resume_after=token, stream=False)
    return rest.select("operationType", "documentKey._id", "fullDocument.n_name", "fullDocument.n_regionkey", "ns.coll", "clusterTime")


def _change_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tailable cursor says: nothing at first, then what comes, then the collection's end; resumed, ``invalidate``."""
    c = _engine(spark)["c"]
    c.insert([{"_id": 1}])
    cursor = ChangeCursor(c)
    seen = [("before", len(cursor.take(9)), None)]
    c.insert([{"_id": 2}, {"_id": 3}])
    seen += [("after", d["documentKey"]["_id"], d["operationType"]) for d in cursor.take(9)]
    c.drop()
    seen += [("drop", None, d["operationType"]) for d in cursor.take(9)]
    seen += [("resumed", None, d["operationType"]) for d in ChangeCursor(c, resume_after=cursor.after).take(9)]
    return spark.createDataFrame(seen, "step string, n int, operationType string")


def _no_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex[:10]}", log=False)["db"]["c"]
    quiet.insert([{"_id": 1}])
    return events(quiet, start_at=1, stream=False).selectExpr("count(*) AS n")


QUERIES["change_stream"] = Query(_changes, "SELECT 'insert' AS operationType, count(*) AS n FROM nation UNION ALL SELECT 'update', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'delete', count(*) FROM nation WHERE n_regionkey = 2")
QUERIES["change_stream_events"] = Query(
    _change_events,
    """SELECT 'insert' AS operationType, n_nationkey AS _id, n_name, n_regionkey, 'nations' AS coll, CAST(1 AS BIGINT) AS clusterTime FROM (SELECT *, row_number() OVER (ORDER BY '{"_id":' || n_nationkey || '}') AS r FROM nation) WHERE r > 5 UNION ALL
       SELECT 'update', n_nationkey, NULL, 9, 'nations', 2 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'delete', n_nationkey, NULL, NULL, 'nations', 3 FROM nation WHERE n_regionkey = 2""",
)
QUERIES["change_stream_invalidate"] = Query(_change_invalidate, "SELECT * FROM (VALUES ('before', 0, NULL), ('after', 2, 'insert'), ('after', 3, 'insert'), ('drop', NULL, 'drop'), ('resumed', NULL, 'invalidate')) t(step, n, operationType)")
QUERIES["change_stream_no_log"] = Query(_no_log, "SELECT CAST(0 AS BIGINT) AS n")


# --- commands, metadata, errors, codecs ---------------------------------------------------------------------------------


def _said(spark: SparkSession, said: list[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in said], "command string, reply string")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command documents over the nations, read and written; each reply's telling part as text."""
    session = Session(_engine(spark).engine)
    run = lambda **c: session.run("db", c)
    rows = [{"_id": r.n_nationkey, "region": r.n_regionkey, "name": r.n_name} for r in tables(spark, sf_dir)("nation").orderBy("n_nationkey").collect()]
    said: list[tuple[str, object]] = [("insert", run(insert="n", documents=rows)["n"])]
    cursor = run(find="n", filter={"region": {"$lte": 2}}, sort={"_id": 1}, batchSize=4)["cursor"]
    ids = [d["_id"] for d in cursor["firstBatch"]]
    while cursor["id"]:
        cursor = run(getMore=cursor["id"], batchSize=3)["cursor"]
        ids += [d["_id"] for d in cursor["nextBatch"]]
    said.append(("find", ",".join(map(str, ids))))
    said.append(("legacy", ",".join(str(d["_id"]) for d in run(find="n", filter={"$query": {"region": 1}, "$orderby": {"_id": -1}})["cursor"]["firstBatch"])))
    said.append(("count", run(count="n", query={"region": 1})["n"]))
    said.append(("distinct", sorted(run(distinct="n", key="region")["values"])))
    said.append(("aggregate", run(aggregate="n", pipeline=[{"$group": {"_id": None, "most": {"$max": "$_id"}}}], cursor={})["cursor"]["firstBatch"][0]["most"]))
    said.append(("update", run(update="n", updates=[{"q": {"region": 0}, "u": {"$set": {"region": 7}}, "multi": True}])["nModified"]))
    said.append(("findAndModify", run(findAndModify="n", query={"_id": 3}, update={"$set": {"name": "x"}}, new=True)["value"]["name"]))
    said.append(("delete", run(delete="n", deletes=[{"q": {"region": 7}, "limit": 0}])["n"]))
    said.append(("duplicate", run(insert="n", documents=[{"_id": 100}, {"_id": 1}, {"_id": 101}])["writeErrors"][0]["code"]))
    said.append(("getLastError", run(getLastError=1)["code"]))
    run(ISMASTER=1)
    said.append(("reset", run(getlasterror=1)["err"]))
    said.append(("left", run(count="n", query={})["n"]))
    return _said(spark, said)


def _admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands about collections, indexes, cursors and the server."""
    engine = _engine(spark).engine
    session = Session(engine)
    run = lambda **c: session.run("db", c)
    said: list[tuple[str, object]] = [("create", run(create="a")["ok"]), ("create again", run(create="a")["code"])]
    run(insert="a", documents=[{"_id": k, "v": k} for k in range(5)])
    said.append(("createIndexes", run(createIndexes="a", indexes=[{"key": {"v": -1}, "unique": True}])["numIndexesAfter"]))
    said.append(("listIndexes", [(i["name"], i["key"]) for i in run(listIndexes="a")["cursor"]["firstBatch"]]))
    said.append(("indexStats", [(r.name, r.key, r.spec.v, r.accesses.ops) for r in engine["db"]["a"].aggregate([{"$indexStats": {}}, {"$sort": {"name": 1}}]).collect()]))
    said.append(("system.indexes", engine["db"].system_indexes().count()))
    said.append(("dropIndexes", run(dropIndexes="a", index="v_-1")["ok"]))
    said.append(("namespaces", [r.name for r in engine["db"].namespaces().collect()]))
    said.append(("collStats", run(collStats="a")["count"]))
    said.append(("dbStats", run(dbStats=1)["objects"]))
    said.append(("validate", run(validate="a")["valid"]))
    said.append(("renameCollection", run(renameCollection="db.a", to="other.b")["ok"]))
    said.append(("listCollections", [c["name"] for c in session.run("other", {"listCollections": 1})["cursor"]["firstBatch"]]))
    said.append(("listDatabases", sorted(d["name"] for d in run(listDatabases=1)["databases"])))
    cursor = session.run("other", {"find": "b", "batchSize": 2})["cursor"]["id"]
    said.append(("killCursors", run(killCursors="b", cursors=[cursor, 77])["cursorsNotFound"]))
    said.append(("getMore killed", run(getMore=cursor)["code"]))
    said += [(c, run(**{c: 1})["ok"]) for c in ("ping", "isMaster", "buildInfo", "serverStatus", "whatsmyuri", "hostInfo", "connectionStatus", "getCmdLineOpts", "getFreeMonitoringStatus", "endSessions", "resetError")]
    said.append(("getLog", run(getLog="*")["names"]))
    said.append(("unknown", run(nonsense=1)["code"]))
    said.append(("drop", session.run("other", {"drop": "b"})["ok"]))
    said.append(("dropDatabase", session.run("other", {"dropDatabase": 1})["ok"]))
    engine.read_only = True
    said += [(f"read-only {c}", run(**{c: "a", **more})["code"]) for c, more in (("insert", {"documents": [{}]}), ("create", {}), ("drop", {}), ("dropIndexes", {}))]
    return _said(spark, said)


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of what is refused when it is compiled."""
    nation = tables(spark, sf_dir)("nation")
    at = lambda spec: lambda: run_pipeline(nation, [{"$project": {"x": {"$dateToString": spec}}}])
    now, key = {"date": "$$NOW"}, {"n_nationkey": 1}
    tried = [
        ("$nearSphere", lambda: find(nation, {"n_nationkey": {"$nearSphere": 1}})), ("$geoWithin", lambda: find(nation, {"n_nationkey": {"$geoWithin": 1}})), ("unknown operator", lambda: find(nation, {"n_nationkey": {"$what": 1}})), ("unknown top", lambda: find(nation, {"$what": []})),
        ("$geoNear", lambda: run_pipeline(nation, [{"$geoNear": {}}])), ("unknown stage", lambda: run_pipeline(nation, [{"$what": {}}])), ("$out inside", lambda: run_pipeline(nation, [{"$out": "a"}, {"$match": {}}])),
        ("$bit", lambda: updated(nation, {}, {"$bit": key})), ("pipeline update", lambda: updated(nation, {}, [{"$set": key}])), ("conflict", lambda: updated(nation, {}, {"$set": key, "$inc": {"n_nationkey.x": 1}})), ("_id", lambda: updated(nation, {}, {"$set": {"_id": 1}})),
        ("format parameter", at(now | {"what": 1})), ("format type", at(now | {"format": 5})), ("format end", at(now | {"format": "%Y%"})), ("format letter", at(now | {"format": "%q"})), ("zone", at(now | {"timezone": "Nowhere/Else"})), ("format spec", at(5)), ("format date", at({"format": "%Y"})),
    ]
    codes = []
    for name, attempt in tried:
        try:
            attempt()
            codes.append((name, 0))
        except QueryError as e:
            codes.append((name, e.code))
    return spark.createDataFrame(codes, "what string, code int")


def _bson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions written as a BSON file and read back."""
    rows = [r.asDict() for r in tables(spark, sf_dir)("region").collect()]
    path = f"{shared_folder(spark)}/bson-{uuid.uuid4().hex[:10]}/regions.bson"
    _engine(spark).engine.write_bytes(path, b"".join(encode(r) for r in rows))
    spark.dataSource.register(BsonSource)
    return spark.read.format("bson").load(path).select(F.from_json("doc", "r_regionkey int, r_name string").alias("d")).select("d.*")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as type-tagged JSON text and back."""
    orders = tables(spark, sf_dir)("orders")
    return untagged(tagged(orders), orders.schema).select("o_orderkey", "o_totalprice", "o_orderstatus", F.unix_millis("o_orderdate").alias("ms"))


def _jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations through a JDBC sink and source; the database is in the driver's process, which reads and writes it."""
    where = {"url": f"jdbc:derby:memory:q{uuid.uuid4().hex[:10]};create=true", "dbtable": "nations", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    write(tables(spark, sf_dir)("nation"), "", "jdbc", mode="overwrite", **where)
    return find(read(spark, "", "jdbc", **where).toDF("n_nationkey", "n_name", "n_regionkey"), {"n_regionkey": {"$gte": 2}}, {"n_nationkey": 1, "n_name": 1})


QUERIES["commands_data"] = Query(
    _commands,
    """SELECT 'insert' AS command, CAST(count(*) AS VARCHAR) AS reply FROM nation UNION ALL SELECT 'find', string_agg(n_nationkey, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey <= 2 UNION ALL
       SELECT 'legacy', string_agg(n_nationkey, ',' ORDER BY n_nationkey DESC) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey = 1 UNION ALL
       SELECT 'distinct', '[' || string_agg(DISTINCT n_regionkey, ', ' ORDER BY n_regionkey) || ']' FROM nation UNION ALL SELECT 'aggregate', CAST(max(n_nationkey) AS VARCHAR) FROM nation UNION ALL
       SELECT 'update', CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'findAndModify', 'x' UNION ALL SELECT 'delete', CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey = 0 UNION ALL
       SELECT 'duplicate', '11000' UNION ALL SELECT 'getLastError', '11000' UNION ALL SELECT 'reset', 'None' UNION ALL SELECT 'left', CAST(count(*) + 1 AS VARCHAR) FROM nation WHERE n_regionkey <> 0""",
)
QUERIES["commands_admin"] = Query(
    _admin,
    """SELECT * FROM (VALUES ('create', '1'), ('create again', '48'), ('createIndexes', '2'), ('listIndexes', '[(''_id_'', {''_id'': 1}), (''v_-1'', {''v'': -1})]'), ('indexStats', '[(''_id_'', {''_id'': 1}, 2, 0), (''v_-1'', {''v'': -1}, 2, 0)]'),
       ('system.indexes', '2'), ('dropIndexes', '1'), ('namespaces', '[''db.a'']'), ('collStats', '5'), ('dbStats', '5'), ('validate', 'True'), ('renameCollection', '1'), ('listCollections', '[''b'']'), ('listDatabases', '[''db'', ''other'']'),
       ('killCursors', '[77]'), ('getMore killed', '43'), ('ping', '1'), ('isMaster', '1'), ('buildInfo', '1'), ('serverStatus', '1'), ('whatsmyuri', '1'), ('hostInfo', '1'), ('connectionStatus', '1'), ('getCmdLineOpts', '1'), ('getFreeMonitoringStatus', '1'), ('endSessions', '1'), ('resetError', '1'), ('getLog', '[''startupWarnings'']'), ('unknown', '59'), ('drop', '1'), ('dropDatabase', '1'),
       ('read-only insert', '20'), ('read-only create', '20'), ('read-only drop', '20'), ('read-only dropIndexes', '20')) t(command, reply)""",
)
QUERIES["errors_refused"] = Query(
    _refused,
    """SELECT * FROM (VALUES ('$nearSphere', 238), ('$geoWithin', 238), ('unknown operator', 2), ('unknown top', 2), ('$geoNear', 238), ('unknown stage', 40324), ('$out inside', 40601), ('$bit', 10147), ('pipeline update', 9), ('conflict', 40), ('_id', 66),
       ('format parameter', 18534), ('format type', 18533), ('format end', 18535), ('format letter', 18536), ('zone', 40485), ('format spec', 18629), ('format date', 18628)) t(what, code)""",
)
QUERIES["codec_bson"] = Query(_bson, "SELECT r_regionkey, r_name FROM region")
QUERIES["codec_tagged_json"] = Query(_tagged, "SELECT o_orderkey, o_totalprice, o_orderstatus, epoch_ms(o_orderdate) AS ms FROM orders")
QUERIES["source_jdbc"] = Query(_jdbc, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2")
