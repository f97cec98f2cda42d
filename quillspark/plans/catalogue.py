"""Queries over the standard tables, each with the SQL that gives the same rows.

A query is a pipeline over a table; ``post`` flattens nested results and rounds sums for comparison.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.dynamic import Dynamic
from quillspark.plans.pipeline import run_pipeline
from quillspark.sources.catalog import distinct, find
from quillspark.sources.storage import read

Run = Callable[[SparkSession, str], DataFrame]
DAY = datetime.datetime


@dataclass
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: read(spark, f"{sf_dir}/{name}.parquet")


def finish(df: DataFrame, post: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{post[c]} AS `{c}`" if c in post else f"`{c}`" for c in [*df.columns, *[p for p in post if p not in df.columns]]]) if post else df


def pipeline(name: str, table: str, stages: list[dict], sql: str | None, **post: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        get = tables(spark, sf_dir)
        return finish(run_pipeline(get(table), stages, get), post)

    QUERIES[name] = Query(run, sql)


def finding(name: str, table: str, sql: str | None, post: dict[str, str] | None = None, **arguments) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(find(tables(spark, sf_dir)(table), **arguments), post or {})

    QUERIES[name] = Query(run, sql)


def kept(name: str, table: str, columns: str, condition: dict, where: str) -> None:
    names = columns.split()
    finding(f"filter_{name}", table, f"SELECT {', '.join(names)} FROM {table} WHERE {where}", filter=condition, projection={c: 1 for c in names})


@dataclass
class Expressions:
    """One query for each operator: a projection of a key and computed columns."""

    table: str
    key: str
    made: dict = field(default_factory=dict)

    def add(self, operator: str, spec: dict, sql: dict[str, str], first: list[dict] | None = None, where: str = "", **post: str) -> None:
        stages = [*(first or []), {"$project": {"_id": 0, self.key: 1, **spec}}]
        columns = ", ".join([self.key, *[f"{v} AS {k}" for k, v in sql.items()]])
        # $ifNull -> if_null
        snake = re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", operator.lstrip("$")).lower()
        pipeline(f"expr_{snake}", self.table, stages, f"SELECT {columns} FROM {self.table} {where}", **post)


# --- filters ----------------------------------------------------------------------------------------------------------

O, L = "o_orderkey o_totalprice", "l_orderkey l_partkey l_quantity"
kept("eq", "orders", O, {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
kept("eq_operator", "orders", O, {"o_custkey": {"$eq": 7}}, "o_custkey = 7")
kept("ne", "orders", O, {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'")
kept("in", "lineitem", L, {"l_linenumber": {"$in": [1, 3]}}, "l_linenumber IN (1, 3)")
kept("nin", "lineitem", L, {"l_returnflag": {"$nin": ["A", "N"]}}, "l_returnflag NOT IN ('A', 'N')")
kept("range", "orders", O, {"o_totalprice": {"$gte": 100000, "$lt": 200000.5}}, "o_totalprice >= 100000 AND o_totalprice < 200000.5")
kept("gt_date", "orders", O, {"o_orderdate": {"$gt": DAY(1997, 6, 1)}}, "o_orderdate > TIMESTAMP '1997-06-01'")
kept("lte", "lineitem", L, {"l_quantity": {"$lte": 3}}, "l_quantity <= 3")
kept("and", "orders", O, {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 250000}}]}, "o_orderstatus = 'O' AND o_totalprice > 250000")
kept("or", "orders", O, {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lt": 20000}}]}, "o_orderstatus = 'P' OR o_totalprice < 20000")
kept("nor", "orders", O, {"$nor": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lt": 200000}}]}, "NOT (o_orderstatus = 'P' OR o_totalprice < 200000)")
kept("not", "orders", O, {"o_totalprice": {"$not": {"$gt": 50000}}}, "NOT o_totalprice > 50000")
kept("mod", "orders", O, {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3")
kept("regex", "part", "p_partkey p_name p_brand", {"p_brand": {"$regex": "brand#[1-2]", "$options": "i"}}, "regexp_matches(p_brand, '(?i)brand#[1-2]')")
kept("regex_number", "orders", O, {"o_orderkey": {"$regex": "99$"}}, "CAST(o_orderkey AS VARCHAR) LIKE '%99'")
kept("exists", "orders", O, {"o_comment": {"$exists": False}, "o_custkey": {"$exists": True}}, "o_custkey IS NOT NULL")
kept("type", "lineitem", L, {"l_quantity": {"$type": "double"}, "l_linenumber": {"$type": ["int", "string"]}}, "TRUE")
kept("expr", "lineitem", L, {"$expr": {"$lt": ["$l_tax", "$l_discount"]}}, "l_tax < l_discount")
kept("comment", "orders", O, {"o_orderstatus": "F", "$comment": "why"}, "o_orderstatus = 'F'")
kept("cross_type", "orders", O, {"o_orderstatus": {"$gt": 5}}, "FALSE")
finding("filter_size", "embeddings", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64", filter={"embedding": {"$size": 64}}, projection={"vec_id": 1, "label": 1})
finding("filter_array_any", "embeddings", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.35)) > 0", filter={"embedding": {"$gt": 0.35}}, projection={"vec_id": 1})
finding("filter_elem_match", "embeddings", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2 AND x < 0.21)) > 0", filter={"embedding": {"$elemMatch": {"$gt": 0.2, "$lt": 0.21}}}, projection={"vec_id": 1})
_WITH_LINES = [{"$lookup": {"from": "lineitem", "localField": "o_orderkey", "foreignField": "l_orderkey", "as": "lines"}}]
pipeline(
    "filter_all", "orders", [*_WITH_LINES, {"$match": {"lines.l_returnflag": {"$nin": ["X"]}, "lines.l_linenumber": {"$all": [1, 3]}}}, {"$project": {"o_orderkey": 1}}],
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3)",
)
pipeline(
    "filter_elem_match_objects", "orders", [*_WITH_LINES, {"$match": {"lines": {"$elemMatch": {"l_returnflag": "R", "l_quantity": {"$gt": 45}}}}}, {"$project": {"o_orderkey": 1}}],
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)",
)
pipeline(
    "filter_all_members", "orders", [*_WITH_LINES, {"$addFields": {"flags": "$lines.l_returnflag"}}, {"$match": {"flags": {"$all": ["A", "R"]}}}, {"$project": {"o_orderkey": 1}}],
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)

# --- stages -----------------------------------------------------------------------------------------------------------

PRICING = [
    {"$match": {"l_shipdate": {"$lte": DAY(1998, 9, 2)}}},
    {"$group": {
        "_id": {"f": "$l_returnflag", "s": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "sum_base": {"$sum": "$l_extendedprice"},
        "sum_disc": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "avg_qty": {"$avg": "$l_quantity"}, "n": {"$sum": 1},
    }},
    {"$sort": {"_id": 1}},
    {"$project": {"_id": 0, "flag": "$_id.f", "status": "$_id.s", "sum_qty": 1, "sum_base": 1, "sum_disc": 1, "avg_qty": 1, "n": 1}},
]
pipeline(
    "stage_group_multi_key", "lineitem", PRICING,
    """SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    sum_qty="round(sum_qty, 2)", sum_base="round(sum_base, 2)", sum_disc="round(sum_disc, 2)", avg_qty="round(avg_qty, 4)",
)
pipeline("stage_match", "events", [{"$match": {"event_type": "purchase", "value": {"$gt": 50}}}, {"$project": {"event_id": 1}}], "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 50")
pipeline("stage_project", "orders", [{"$project": {"o_orderkey": 1, "half": {"$divide": ["$o_totalprice", 2]}, "fixed": {"$literal": "$x"}}}], "SELECT o_orderkey, o_totalprice / 2 AS half, '$x' AS fixed FROM orders")
pipeline("stage_project_exclude", "nation", [{"$project": {"n_regionkey": 0}}], "SELECT n_nationkey, n_name FROM nation")
pipeline("stage_add_fields", "customer", [{"$addFields": {"double": {"$multiply": ["$c_acctbal", 2]}, "quad": {"$multiply": ["$double", 2]}}}, {"$project": {"c_custkey": 1, "double": 1, "quad": 1}}], "SELECT c_custkey, c_acctbal * 2 AS double, c_acctbal * 2 * 2 AS quad FROM customer")
pipeline("stage_unset", "supplier", [{"$unset": ["s_name", "s_acctbal"]}], "SELECT s_suppkey, s_nationkey FROM supplier")
pipeline("stage_replace_root", "part", [{"$replaceRoot": {"newRoot": {"k": "$p_partkey", "info": {"brand": "$p_brand"}}}}, {"$project": {"k": 1, "brand": "$info.brand"}}], "SELECT p_partkey AS k, p_brand AS brand FROM part")
pipeline("stage_group_sum", "orders", [{"$group": {"_id": "$o_orderstatus", "total": {"$sum": "$o_totalprice"}}}], "SELECT o_orderstatus AS _id, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", total="round(total, 2)")
pipeline("stage_group_null", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "most": {"$max": "$o_totalprice"}}}, {"$project": {"_id": 0}}], "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders")
pipeline("stage_count", "events", [{"$match": {"event_type": "click"}}, {"$count": "n"}], "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
pipeline("stage_count_nothing", "events", [{"$match": {"event_type": "nothing"}}, {"$count": "n"}], "SELECT n FROM (SELECT count(*) AS n FROM events WHERE event_type = 'nothing') WHERE n > 0")
pipeline("stage_sort_by_count", "orders", [{"$sortByCount": "$o_orderpriority"}], "SELECT o_orderpriority AS _id, count(*) AS count FROM orders GROUP BY 1")
pipeline(
    "stage_bucket", "orders", [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0, 50000, 150000, 300000], "default": -1, "output": {"n": {"$sum": 1}, "most": {"$max": "$o_totalprice"}}}}],
    "SELECT CAST(CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 0 WHEN o_totalprice >= 50000 AND o_totalprice < 150000 THEN 50000 WHEN o_totalprice >= 150000 AND o_totalprice < 300000 THEN 150000 ELSE -1 END AS INTEGER) AS _id, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1",
    _id="CAST(_id AS INT)",
)
pipeline(
    "stage_facet", "orders", [{"$facet": {"status": [{"$sortByCount": "$o_orderstatus"}], "all": [{"$count": "n"}], "big": [{"$match": {"o_totalprice": {"$gt": 300000}}}, {"$count": "n"}]}}],
    "SELECT (SELECT string_agg(o_orderstatus || '=' || n, ',' ORDER BY n DESC, o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)) AS status, (SELECT count(*) FROM orders) AS all, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) AS big",
    status="array_join(transform(status, x -> concat(x._id, '=', x.count)), ',')", all="all[0].n", big="big[0].n",
)
pipeline("stage_sort_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 10}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
pipeline("stage_skip", "orders", [{"$sort": {"o_orderkey": 1}}, {"$skip": 100}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
pipeline("stage_sample", "orders", [{"$sample": {"size": 25}}, {"$count": "n"}], "SELECT 25 AS n", n="CAST(n AS INT)")
pipeline("stage_unwind", "documents", [{"$project": {"doc_id": 1, "line": {"$split": ["$text", "\n"]}}}, {"$unwind": "$line"}, {"$group": {"_id": "$doc_id", "n": {"$sum": 1}}}], "SELECT doc_id AS _id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY 1")
pipeline("stage_unwind_index", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, {"$project": {"vec_id": 1, "i": 1, "embedding": 1}}], "SELECT vec_id, i - 1 AS i, embedding[i] AS embedding FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
pipeline(
    "stage_unwind_preserve", "customer",
    [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}],
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)
pipeline("stage_redact", "orders", [{"$redact": {"$cond": {"if": {"$eq": ["$o_orderstatus", "F"]}, "then": "$$KEEP", "else": "$$PRUNE"}}}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
pipeline("stage_lookup", "orders", [*_WITH_LINES, {"$project": {"o_orderkey": 1, "n": {"$size": "$lines"}, "qty": {"$sum": "$lines.l_quantity"}}}], "SELECT o_orderkey, CAST(count(l_orderkey) AS INTEGER) AS n, coalesce(sum(l_quantity), 0) AS qty FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
pipeline(
    "stage_lookup_null_key", "nation",
    [{"$addFields": {"k": {"$cond": [{"$lt": ["$n_nationkey", 3]}, None, "$n_regionkey"]}}}, {"$lookup": {"from": "region", "localField": "k", "foreignField": "r_regionkey", "as": "r"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$r"}}}],
    "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 0 ELSE 1 END AS n FROM nation",
)
pipeline(
    "stage_lookup_array_key", "embeddings",
    [{"$project": {"vec_id": 1, "keys": {"$range": [0, {"$mod": ["$vec_id", 4]}]}}}, {"$lookup": {"from": "region", "localField": "keys", "foreignField": "r_regionkey", "as": "r"}}, {"$project": {"vec_id": 1, "n": {"$size": "$r"}}}],
    "SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS n FROM embeddings",
)
pipeline(
    "stage_lookup_pipeline", "customer",
    [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$k"]}}}, {"$sort": {"o_totalprice": -1}}, {"$limit": 2}, {"$project": {"o_totalprice": 1}}], "as": "top"}}, {"$project": {"c_custkey": 1, "best": {"$sum": "$top.o_totalprice"}, "n": {"$size": "$top"}}}],
    "SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS best, CAST(count(o_totalprice) AS INTEGER) AS n FROM customer LEFT JOIN (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) ON c_custkey = o_custkey AND r <= 2 GROUP BY 1",
    best="round(best, 2)",
)
pipeline(
    "stage_lookup_uncorrelated", "region", [{"$lookup": {"from": "nation", "pipeline": [{"$match": {"n_nationkey": {"$lt": 5}}}, {"$count": "n"}], "as": "x"}}, {"$project": {"r_regionkey": 1, "n": {"$arrayElemAt": ["$x.n", 0]}}}],
    "SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_nationkey < 5) AS n FROM region",
)
pipeline(
    "stage_lookup_missing_field", "region", [{"$lookup": {"from": "region", "localField": "nothing", "foreignField": "nothing_either", "as": "x"}}, {"$project": {"r_regionkey": 1, "n": {"$size": "$x"}}}],
    "SELECT r_regionkey, CAST((SELECT count(*) FROM region) AS INTEGER) AS n FROM region",
)


def _missing_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [{"$lookup": {"from": "nowhere", "localField": "r_regionkey", "foreignField": "k", "as": "x"}}, {"$lookup": {"from": "nowhere", "let": {"k": "$r_regionkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$k", "$$k"]}}}], "as": "y"}}]
    return run_pipeline(tables(spark, sf_dir)("region"), [*both, {"$project": {"r_regionkey": 1, "n": {"$add": [{"$size": "$x"}, {"$size": "$y"}]}}}], lambda name: None)


QUERIES["stage_lookup_missing_collection"] = Query(_missing_collection, "SELECT r_regionkey, 0 AS n FROM region")
_LINES_OF = {"from": "lineitem", "let": {"k": "$o_orderkey"}, "as": "x"}
_OF_ORDER = {"$match": {"$expr": {"$eq": ["$l_orderkey", "$$k"]}}}
pipeline(
    "stage_lookup_pipeline_unwind", "orders",
    [{"$lookup": {**_LINES_OF, "pipeline": [_OF_ORDER, {"$project": {"q": {"$range": [0, "$l_linenumber"]}}}, {"$unwind": "$q"}, {"$match": {"q": {"$gt": 1}}}]}}, {"$project": {"o_orderkey": 1, "n": {"$size": "$x"}, "total": {"$sum": "$x.q"}}}],
    "SELECT o_orderkey, CAST(count(q) AS INTEGER) AS n, CAST(coalesce(sum(q), 0) AS BIGINT) AS total FROM orders LEFT JOIN (SELECT * FROM (SELECT l_orderkey, unnest(range(0, l_linenumber)) AS q FROM lineitem) WHERE q > 1) ON o_orderkey = l_orderkey GROUP BY 1",
    n="CAST(n AS INT)", total="CAST(total AS BIGINT)",
)
pipeline(
    "stage_lookup_pipeline_bucket", "orders",
    [{"$lookup": {**_LINES_OF, "pipeline": [_OF_ORDER, {"$bucket": {"groupBy": "$l_quantity", "boundaries": [0, 10, 30, 100], "output": {"n": {"$sum": 1}}}}]}}, {"$project": {"o_orderkey": 1, "x": 1}}],
    "SELECT o_orderkey, coalesce(string_agg(b || '=' || n, ',' ORDER BY b), '') AS x FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 10 ELSE 30 END AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) ON o_orderkey = l_orderkey GROUP BY 1",
    x="array_join(transform(x, b -> concat(cast(b._id as int), '=', b.n)), ',')",
)
pipeline(
    "stage_lookup_pipeline_nested", "customer",
    [{"$lookup": {"from": "orders", "let": {"c": "$c_custkey", "m": "$c_acctbal"}, "pipeline": [
        {"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}}},
        {"$lookup": {**_LINES_OF, "pipeline": [_OF_ORDER, {"$match": {"$expr": {"$gt": ["$l_extendedprice", "$$m"]}}}, {"$count": "n"}]}},
        {"$project": {"n": {"$sum": "$x.n"}}},
    ], "as": "o"}}, {"$project": {"c_custkey": 1, "orders": {"$size": "$o"}, "lines": {"$sum": "$o.n"}}}],
    "SELECT c_custkey, CAST(count(DISTINCT o_orderkey) AS INTEGER) AS orders, CAST(count(l_orderkey) AS BIGINT) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_extendedprice > c_acctbal GROUP BY 1",
    orders="CAST(orders AS INT)", lines="CAST(lines AS BIGINT)",
)
pipeline(
    "stage_lookup_pipeline_sort_by_count", "customer",
    [{"$lookup": {"from": "orders", "let": {"c": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}}}, {"$sortByCount": "$o_orderstatus"}, {"$limit": 1}], "as": "x"}}, {"$project": {"c_custkey": 1, "most": {"$arrayElemAt": ["$x._id", 0]}}}],
    "SELECT c_custkey, (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey GROUP BY 1 ORDER BY count(*) DESC, o_orderstatus LIMIT 1) AS most FROM customer",
)
pipeline(
    "stage_lookup_pipeline_facet", "nation",
    [{"$lookup": {"from": "customer", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$k"]}}}, {"$facet": {"n": [{"$count": "n"}], "rich": [{"$match": {"c_acctbal": {"$gt": 5000}}}, {"$count": "n"}]}}], "as": "x"}}, {"$unwind": "$x"}, {"$project": {"n_nationkey": 1, "n": {"$sum": "$x.n.n"}, "rich": {"$sum": "$x.rich.n"}}}],
    "SELECT n_nationkey, count(c_custkey) AS n, CAST(coalesce(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END), 0) AS BIGINT) AS rich FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    n="CAST(n AS BIGINT)", rich="CAST(rich AS BIGINT)",
)
_PARENT = {"$addFields": {"parent": {"$cond": [{"$gt": ["$n_nationkey", 0]}, {"$toInt": {"$floor": {"$divide": [{"$subtract": ["$n_nationkey", 1]}, 3]}}}, None]}}}


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = run_pipeline(tables(spark, sf_dir)("nation"), [_PARENT])
    walk = {"$graphLookup": {"from": "tree", "startWith": "$parent", "connectFromField": "parent", "connectToField": "n_nationkey", "as": "up", "depthField": "depth"}}
    out = run_pipeline(tree, [walk, {"$project": {"n_nationkey": 1, "n": {"$size": "$up"}, "furthest": {"$max": "$up.depth"}}}], lambda name: tree)
    return out


QUERIES["stage_graph_lookup"] = Query(
    _graph,
    """WITH RECURSIVE t AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 3 END AS parent FROM nation),
       up AS (SELECT k, parent AS at, 0 AS depth FROM t WHERE parent IS NOT NULL UNION ALL SELECT up.k, t.parent, depth + 1 FROM up JOIN t ON up.at = t.k WHERE t.parent IS NOT NULL)
       SELECT t.k AS n_nationkey, CAST(count(up.k) AS INTEGER) AS n, CAST(max(depth) AS BIGINT) AS furthest FROM t LEFT JOIN up ON t.k = up.k GROUP BY 1""",
)

# --- joins as idioms --------------------------------------------------------------------------------------------------

_TO_CUSTOMER = {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}
_TO_ORDERS = {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}
pipeline("join_inner", "orders", [_TO_CUSTOMER, {"$unwind": "$c"}, {"$group": {"_id": "$c.c_mktsegment", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}}], "SELECT c_mktsegment AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", total="round(total, 2)")
pipeline("join_left", "customer", [_TO_ORDERS, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}], "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
pipeline("join_semi", "customer", [_TO_ORDERS, {"$match": {"o": {"$ne": []}}}, {"$unset": "o"}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
pipeline("join_anti", "part", [{"$lookup": {"from": "lineitem", "localField": "p_partkey", "foreignField": "l_partkey", "as": "l"}}, {"$match": {"l": {"$size": 0}}}, {"$unset": "l"}, {"$project": {"p_partkey": 1}}], "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
pipeline(
    "join_theta", "customer",
    [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey", "a": "$c_acctbal"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$k"]}, {"$gt": ["$o_totalprice", {"$multiply": ["$$a", 20]}]}]}}}, {"$count": "n"}], "as": "big"}}, {"$project": {"c_custkey": 1, "n": {"$sum": "$big.n"}}}],
    "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY 1",
)
pipeline(
    "join_three_way", "lineitem",
    [{"$lookup": {"from": "orders", "localField": "l_orderkey", "foreignField": "o_orderkey", "as": "o"}}, {"$unwind": "$o"}, {"$lookup": {"from": "customer", "localField": "o.o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$c.c_nationkey", "revenue": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}}],
    "SELECT c_nationkey AS _id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    revenue="round(revenue, 2)",
)

# --- accumulators -----------------------------------------------------------------------------------------------------

for _name, _acc, _sql, _post in (
    ("sum", {"$sum": "$value"}, "round(sum(value), 2)", "round(x, 2)"),
    ("avg", {"$avg": "$value"}, "round(avg(value), 6)", "round(x, 6)"),
    ("min", {"$min": "$value"}, "min(value)", "x"),
    ("max", {"$max": "$ts"}, "max(epoch_us(ts) // 1000)", "unix_millis(x)"),
    ("count", {"$sum": 2}, "count(*) * 2", "x"),
    ("add_to_set", {"$addToSet": {"$mod": ["$user_id", 5]}}, "array_to_string(list_sort(list(DISTINCT CAST(user_id % 5 AS INTEGER))), ',')", "array_join(transform(x, v -> cast(v as int)), ',')"),
):
    pipeline(f"acc_{_name}", "events", [{"$group": {"_id": "$event_type", "x": _acc}}], f"SELECT event_type AS _id, {_sql} AS x FROM events GROUP BY 1", x=_post)
_IN_TIME = {"$sort": {"ts": 1, "event_id": -1}}
pipeline("acc_first_last", "events", [_IN_TIME, {"$group": {"_id": "$event_type", "first": {"$first": "$event_id"}, "last": {"$last": "$event_id"}}}], "SELECT event_type AS _id, first(event_id ORDER BY ts, event_id DESC) AS first, last(event_id ORDER BY ts, event_id DESC) AS last FROM events GROUP BY 1")
pipeline("acc_push", "events", [_IN_TIME, {"$group": {"_id": "$user_id", "ids": {"$push": "$event_id"}}}], "SELECT user_id AS _id, array_to_string(list(event_id ORDER BY ts, event_id DESC), ',') AS ids FROM events GROUP BY 1", ids="array_join(ids, ',')")

# --- expressions ------------------------------------------------------------------------------------------------------

ON = Expressions("orders", "o_orderkey")
EV = Expressions("events", "event_id")
CU = Expressions("customer", "c_custkey")
PA = Expressions("part", "p_partkey")
DO = Expressions("documents", "doc_id")
EM = Expressions("embeddings", "vec_id")
_MINUS = {"$subtract": ["$o_totalprice", 150000]}
ON.add("$abs", {"x": {"$abs": _MINUS}}, {"x": "abs(o_totalprice - 150000)"})
ON.add("$add", {"x": {"$add": ["$o_totalprice", "$o_orderkey", 1]}, "d": {"$add": ["$o_orderdate", 86400000]}}, {"x": "o_totalprice + o_orderkey + 1", "d": "epoch_ms(o_orderdate) + 86400000"}, x="round(x, 4)", d="unix_millis(d)")
ON.add("$ceil", {"x": {"$ceil": "$o_totalprice"}}, {"x": "CAST(ceil(o_totalprice) AS DOUBLE)"})
ON.add("$divide", {"x": {"$divide": ["$o_totalprice", 7]}}, {"x": "o_totalprice / 7"})
CU.add("$exp", {"x": {"$exp": {"$divide": ["$c_acctbal", 10000]}}}, {"x": "round(exp(c_acctbal / 10000), 9)"}, x="round(x, 9)")
ON.add("$floor", {"x": {"$floor": _MINUS}}, {"x": "CAST(floor(o_totalprice - 150000) AS BIGINT)"})
ON.add("$ln", {"x": {"$ln": "$o_totalprice"}}, {"x": "round(ln(o_totalprice), 9)"}, x="round(x, 9)")
ON.add("$log", {"x": {"$log": "$o_totalprice"}}, {"x": "round(ln(o_totalprice), 9)"}, x="round(x, 9)")
ON.add("$log10", {"x": {"$log10": "$o_totalprice"}}, {"x": "round(log10(o_totalprice), 9)"}, x="round(x, 9)")
ON.add("$mod", {"x": {"$mod": ["$o_orderkey", 7]}}, {"x": "CAST(o_orderkey % 7 AS DOUBLE)"})
ON.add("$multiply", {"x": {"$multiply": ["$o_orderkey", 3]}}, {"x": "o_orderkey * 3"})
PA.add("$pow", {"x": {"$pow": ["$p_size", 2]}}, {"x": "CAST(p_size * p_size AS DOUBLE)"})
pipeline("expr_rand", "orders", [{"$project": {"r": {"$rand": {}}}}, {"$match": {"r": {"$gte": 0, "$lt": 1}}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders")
PA.add("$range", {"x": {"$range": [0, "$p_size", 5]}}, {"x": "array_to_string(range(0, p_size, 5), ',')"}, x="array_join(x, ',')")
ON.add("$sqrt", {"x": {"$sqrt": "$o_totalprice"}}, {"x": "round(sqrt(o_totalprice), 9)"}, x="round(x, 9)")
ON.add("$subtract", {"x": {"$subtract": ["$o_orderkey", 5]}, "ms": {"$subtract": ["$o_orderdate", DAY(1990, 1, 1)]}}, {"x": "o_orderkey - 5", "ms": "epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1990-01-01')"})
ON.add("$trunc", {"x": {"$trunc": _MINUS}}, {"x": "CAST(trunc(o_totalprice - 150000) AS BIGINT)"})
EM.add("$sum", {"x": {"$sum": "$embedding"}}, {"x": "round(list_sum([CAST(e AS DOUBLE) FOR e IN embedding]), 3)"}, x="round(cast(x as double), 3)")
EM.add("$avg", {"x": {"$avg": "$embedding"}}, {"x": "round(list_avg([CAST(e AS DOUBLE) FOR e IN embedding]), 6)"}, x="round(x, 6)")
EM.add("$max", {"x": {"$max": "$embedding"}}, {"x": "list_max(embedding)"})
EM.add("$min", {"x": {"$min": "$embedding"}}, {"x": "list_min(embedding)"})
ON.add("$and", {"x": {"$and": [{"$gt": ["$o_totalprice", 1000]}, "$o_custkey"]}}, {"x": "o_totalprice > 1000 AND o_custkey <> 0"})
ON.add("$or", {"x": {"$or": [{"$lt": ["$o_totalprice", 90000]}, {"$eq": ["$o_orderstatus", "P"]}]}}, {"x": "o_totalprice < 90000 OR o_orderstatus = 'P'"})
ON.add("$not", {"x": {"$not": [{"$gt": ["$o_totalprice", 90000]}]}}, {"x": "NOT o_totalprice > 90000"})
ON.add("$cmp", {"x": {"$cmp": ["$o_orderkey", "$o_custkey"]}}, {"x": "CAST(CASE WHEN o_orderkey = o_custkey THEN 0 WHEN o_orderkey < o_custkey THEN -1 ELSE 1 END AS INTEGER)"})
for _op, _sign in (("$eq", "="), ("$ne", "<>"), ("$gt", ">"), ("$gte", ">="), ("$lt", "<"), ("$lte", "<=")):
    ON.add(_op, {"x": {_op: ["$o_orderkey", "$o_custkey"]}}, {"x": f"o_orderkey {_sign} o_custkey"})
ON.add("$cond", {"x": {"$cond": {"if": {"$gt": ["$o_totalprice", 200000]}, "then": "high", "else": "low"}}}, {"x": "CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END"})
ON.add("$ifNull", {"x": {"$ifNull": [{"$cond": [{"$eq": ["$o_orderstatus", "P"]}, None, "$o_orderstatus"]}, "none"]}}, {"x": "CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END"})
ON.add("$switch", {"x": {"$switch": {"branches": [{"case": {"$lt": ["$o_totalprice", 50000]}, "then": 1}, {"case": {"$lt": ["$o_totalprice", 200000]}, "then": 2}], "default": 3}}}, {"x": "CASE WHEN o_totalprice < 50000 THEN 1 WHEN o_totalprice < 200000 THEN 2 ELSE 3 END"})
ON.add("$literal", {"x": {"$literal": "$o_custkey"}}, {"x": "'$o_custkey'"})
ON.add("$concat", {"x": {"$concat": ["$o_orderstatus", "-", "$o_orderpriority"]}}, {"x": "o_orderstatus || '-' || o_orderpriority"})
DO.add("$indexOfBytes", {"x": {"$indexOfBytes": ["$text", "en"]}}, {"x": "CAST(CASE WHEN position('en' IN text) = 0 THEN -1 ELSE octet_length(encode(substr(text, 1, position('en' IN text) - 1))) END AS INTEGER)"})
DO.add("$indexOfCP", {"x": {"$indexOfCP": ["$text", "en", 5]}}, {"x": "CAST(CASE WHEN length(text) < 5 OR position('en' IN substr(text, 6)) = 0 THEN -1 ELSE position('en' IN substr(text, 6)) + 4 END AS INTEGER)"})
PA.add("$split", {"x": {"$split": ["$p_type", " "]}}, {"x": "array_to_string(string_split(p_type, ' '), '|')"}, x="array_join(x, '|')")
DO.add("$strLenBytes", {"x": {"$strLenBytes": "$text"}}, {"x": "CAST(octet_length(encode(text)) AS INTEGER)"})
DO.add("$strLenCP", {"x": {"$strLenCP": "$text"}}, {"x": "CAST(length(text) AS INTEGER)"})
PA.add("$substr", {"x": {"$substr": ["$p_name", 2, 4]}}, {"x": "substr(p_name, 3, 4)"})
PA.add("$substrBytes", {"x": {"$substrBytes": ["$p_name", 0, 3]}}, {"x": "substr(p_name, 1, 3)"})
DO.add("$substrCP", {"x": {"$substrCP": ["$text", 3, 10]}}, {"x": "substr(text, 4, 10)"})
PA.add("$toLower", {"x": {"$toLower": "$p_brand"}}, {"x": "lower(p_brand)"})
PA.add("$toUpper", {"x": {"$toUpper": "$p_name"}}, {"x": "upper(p_name)"})
for _op, _sql in (("$year", "year"), ("$month", "month"), ("$dayOfMonth", "day"), ("$dayOfWeek", "isodow"), ("$dayOfYear", "dayofyear"), ("$hour", "hour"), ("$minute", "minute"), ("$second", "second")):
    EV.add(_op, {"x": {_op: "$ts"}}, {"x": f"CAST({_sql}(ts) AS INTEGER)"})
EV.add("$dateToString", {"x": {"$dateToString": {"date": "$ts", "format": "%Y-%m-%d %H:%M:%S.%L %j"}}, "y": {"$dateToString": {"date": "$ts"}}}, {"x": "strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || strftime(ts, ' %j')", "y": "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z'"})
EM.add("$arrayElemAt", {"x": {"$arrayElemAt": ["$embedding", -2]}}, {"x": "embedding[-2]"})
PA.add("$concatArrays", {"x": {"$concatArrays": [{"$split": ["$p_type", " "]}, ["end"]]}}, {"x": "array_to_string(list_concat(string_split(p_type, ' '), ['end']), '|')"}, x="array_join(x, '|')")
EM.add("$filter", {"x": {"$size": {"$filter": {"input": "$embedding", "as": "e", "cond": {"$gt": ["$$e", 0.1]}}}}}, {"x": "CAST(len(list_filter(embedding, lambda e: CAST(e AS DOUBLE) > 0.1)) AS INTEGER)"})
PA.add("$map", {"x": {"$map": {"input": {"$range": [0, 3]}, "as": "k", "in": {"$multiply": ["$$k", "$p_size"]}}}}, {"x": "array_to_string([k * p_size FOR k IN range(0, 3)], ',')"}, x="array_join(x, ',')")
PA.add("$reduce", {"x": {"$reduce": {"input": {"$split": ["$p_type", " "]}, "initialValue": "", "in": {"$concat": ["$$this", "$$value"]}}}}, {"x": "array_to_string(list_reverse(string_split(p_type, ' ')), '')"})
PA.add("$in", {"x": {"$in": ["$p_size", [1, 5, 9]]}}, {"x": "p_size IN (1, 5, 9)"})
PA.add("$indexOfArray", {"x": {"$indexOfArray": [{"$range": [0, 20]}, "$p_size"]}}, {"x": "CAST(CASE WHEN p_size < 20 THEN p_size ELSE -1 END AS INTEGER)"})
EM.add("$isArray", {"x": {"$isArray": "$embedding"}, "y": {"$isArray": "$label"}}, {"x": "TRUE", "y": "FALSE"})
PA.add("$reverseArray", {"x": {"$reverseArray": {"$split": ["$p_type", " "]}}}, {"x": "array_to_string(list_reverse(string_split(p_type, ' ')), '|')"}, x="array_join(x, '|')")
EM.add("$size", {"x": {"$size": "$embedding"}}, {"x": "CAST(len(embedding) AS INTEGER)"})
PA.add("$slice", {"x": {"$slice": [{"$range": [0, "$p_size"]}, -3, 2]}}, {"x": "array_to_string(list_slice(range(0, p_size), greatest(p_size - 2, 1), greatest(p_size - 2, 1) + 1), ',')"}, x="array_join(x, ',')")
_SMALL = {"$range": [0, {"$mod": ["$p_size", 6]}]}
_SMALL_SQL = "range(0, p_size % 6)"
PA.add("$allElementsTrue", {"x": {"$allElementsTrue": [[{"$gt": ["$p_size", 5]}, True]]}}, {"x": "p_size > 5"})
PA.add("$anyElementTrue", {"x": {"$anyElementTrue": [[{"$gt": ["$p_size", 5]}, False]]}}, {"x": "p_size > 5"})
PA.add("$setDifference", {"x": {"$setDifference": [_SMALL, [1, 3]]}}, {"x": f"array_to_string(list_filter({_SMALL_SQL}, lambda v: v NOT IN (1, 3)), ',')"}, x="array_join(x, ',')")
PA.add("$setEquals", {"x": {"$setEquals": [_SMALL, [2, 1, 0, 1]]}}, {"x": "p_size % 6 = 3"})
PA.add("$setIntersection", {"x": {"$setIntersection": [_SMALL, [3, 1, 9]]}}, {"x": f"array_to_string(list_filter({_SMALL_SQL}, lambda v: v IN (1, 3, 9)), ',')"}, x="array_join(x, ',')")
PA.add("$setIsSubset", {"x": {"$setIsSubset": [_SMALL, [0, 1, 2]]}}, {"x": "p_size % 6 <= 3"})
PA.add("$setUnion", {"x": {"$setUnion": [[9, 4], _SMALL]}}, {"x": f"array_to_string(list_sort(list_distinct(list_concat([9, 4], {_SMALL_SQL}))), ',')"}, x="array_join(x, ',')")
PA.add("$arrayToObject", {"x": {"$arrayToObject": [[{"k": "a", "v": "$p_size"}, {"k": "b", "v": 2}, {"k": "a", "v": 7}]]}}, {"x": "'7,2'"}, x="array_join(map_values(x), ',')")
PA.add("$mergeObjects", {"x": {"$mergeObjects": [{"a": "$p_size", "b": 1}, {"b": "$p_partkey"}]}}, {"x": "CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey AS VARCHAR)"}, x="concat(x.a, ',', x.b)")
PA.add("$objectToArray", {"x": {"$objectToArray": {"k1": "$p_size", "k2": 5}}}, {"x": "'k1=' || CAST(p_size AS VARCHAR) || ';k2=5'"}, x="array_join(transform(x, p -> concat(p.k, '=', p.v)), ';')")
ON.add("$convert", {"x": {"$convert": {"input": "$o_orderpriority", "to": "int", "onError": -1}}, "y": {"$convert": {"input": "$o_totalprice", "to": "int"}}}, {"x": "-1", "y": "CAST(trunc(o_totalprice) AS INTEGER)"})
ON.add("$isNumber", {"x": {"$isNumber": "$o_totalprice"}, "y": {"$isNumber": "$o_orderstatus"}}, {"x": "TRUE", "y": "FALSE"})
ON.add("$toBool", {"x": {"$toBool": {"$mod": ["$o_orderkey", 2]}}}, {"x": "o_orderkey % 2 <> 0"})
ON.add("$toDate", {"x": {"$toDate": {"$multiply": ["$o_orderkey", 100000]}}}, {"x": "o_orderkey * 100000"}, x="unix_millis(x)")
ON.add("$toDouble", {"x": {"$toDouble": "$o_orderkey"}}, {"x": "CAST(o_orderkey AS DOUBLE)"})
ON.add("$toInt", {"x": {"$toInt": "$o_totalprice"}}, {"x": "CAST(trunc(o_totalprice) AS INTEGER)"})
ON.add("$toLong", {"x": {"$toLong": "$o_orderdate"}}, {"x": "epoch_ms(o_orderdate)"})
ON.add("$toObjectId", {"x": {"$toObjectId": {"$concat": ["507f1f77bcf86cd7", {"$substrCP": [{"$toString": {"$add": ["$o_orderkey", 10000000]}}, 0, 8]}]}}}, {"x": "'507f1f77bcf86cd7' || substr(CAST(o_orderkey + 10000000 AS VARCHAR), 1, 8)"})
ON.add("$toString", {"x": {"$toString": "$o_orderkey"}}, {"x": "CAST(o_orderkey AS VARCHAR)"})

# --- find -------------------------------------------------------------------------------------------------------------

finding("find_sort_skip_limit", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5", filter={"o_orderstatus": "O"}, projection={"o_orderkey": 1, "o_custkey": 1}, sort={"o_totalprice": -1, "o_orderkey": 1}, skip=5, limit=15)
finding("find_projection_exclude", "region", "SELECT r_regionkey FROM region", projection={"r_name": 0})
finding("find_projection_slice", "embeddings", "SELECT vec_id, array_to_string([CAST(round(e, 4) AS DECIMAL(9, 4)) FOR e IN embedding[4:5]], ',') AS embedding FROM embeddings", {"embedding": "array_join(transform(embedding, e -> cast(round(e, 4) as decimal(9, 4))), ',')"}, projection={"vec_id": 1, "embedding": {"$slice": [3, 2]}})
finding("find_projection_elem_match", "embeddings", "SELECT vec_id, list_filter(embedding, lambda e: CAST(e AS DOUBLE) > 0.2)[1] AS embedding FROM embeddings", {"embedding": "get(embedding, 0)"}, projection={"vec_id": 1, "embedding": {"$elemMatch": {"$gt": 0.2}}})
QUERIES["find_count"] = Query(lambda spark, d: find(tables(spark, d)("lineitem"), {"l_returnflag": "R"}).selectExpr("count(*) AS n"), "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
QUERIES["find_distinct"] = Query(lambda spark, d: distinct(tables(spark, d)("orders"), "o_orderpriority", {"o_totalprice": {"$gt": 1000}}), "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_totalprice > 1000")


def _json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of any shape: ``props`` parsed, with the event's id as a field of its own."""
    events = tables(spark, sf_dir)("events")
    whole = events.select(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.coalesce("props", F.lit("null")), F.lit("}")).alias("j"))
    found = Dynamic.from_json(whole, "j").match({"props.k": {"$gte": 5}})
    return found.df.select(F.try_variant_get("doc", "$.id", "bigint").alias("event_id"), F.try_variant_get("doc", "$.props.k", "bigint").alias("k"))


QUERIES["json_props"] = Query(_json_props, "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 5")
finding("find_projection_positional", "embeddings", "SELECT vec_id, embedding[1] AS embedding FROM embeddings WHERE len(list_filter(embedding, lambda e: CAST(e AS DOUBLE) > 0.2)) > 0", {"embedding": "get(embedding, 0)"}, filter={"embedding": {"$gt": 0.2}}, projection={"vec_id": 1, "embedding.$": 1})
finding("find_key_order", "orders", "SELECT o_orderkey FROM orders", sort={"o_orderkey": 1}, projection={"o_orderkey": 1})
pipeline("expr_variables", "orders", [{"$project": {"k": "$$ROOT.o_orderkey", "c": "$$CURRENT.o_custkey", "now": {"$gt": ["$$NOW", DAY(2020, 1, 1)]}, "same": {"$eq": ["$$NOW", "$$NOW"]}}}], "SELECT o_orderkey AS k, o_custkey AS c, TRUE AS now, TRUE AS same FROM orders")


def _dbref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the form ``{$ref, $id}`` are compared as values, not as operators."""
    refs = tables(spark, sf_dir)("supplier").withColumn("ref", F.struct(F.lit("nation").alias("$ref"), F.col("s_nationkey").alias("$id")))
    return find(refs, {"ref": {"$ref": "nation", "$id": 7}}, {"s_suppkey": 1})


QUERIES["filter_dbref"] = Query(_dbref, "SELECT s_suppkey FROM supplier WHERE s_nationkey = 7")
