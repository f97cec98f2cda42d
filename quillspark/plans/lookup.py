"""``$lookup`` and ``$graphLookup`` as joins."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import FAILED_TO_PARSE, NOT_IMPLEMENTED, QueryError
from quillspark.functions import values as V
from quillspark.functions.expressions import compile_expression
from quillspark.functions.paths import fields_of, plain, top, visible
from quillspark.functions.values import Value
from quillspark.operators.accumulators import aggregates
from quillspark.operators.filters import compile_filter
from quillspark.operators.projection import assign
from quillspark.plans.pipeline import STAGES, Context, bucket_key, compile_stages, group_key, kept_by, row, sort_columns, stage, start, unwind

#: Numbers the rows of one lookup; lookups within lookups have their own hidden columns.
ROW = "__row"
_calls = itertools.count(1)


def _foreign(c: Context, name) -> DataFrame | None:
    if not isinstance(name, str):
        raise QueryError(FAILED_TO_PARSE, "'from' option to $lookup must be a string")
    df = c.collections(name)
    return None if df is None else df.drop("__ord") if "__ord" in df.columns else df


def _checked(spec: dict) -> None:
    for k in ("from", "as"):
        if k not in spec:
            raise QueryError(FAILED_TO_PARSE, f"must specify '{k}' field for a $lookup")
    if "pipeline" not in spec:
        for k in ("localField", "foreignField"):
            if k not in spec:
                raise QueryError(FAILED_TO_PARSE, "$lookup requires either 'pipeline' or both 'localField' and 'foreignField' to be specified")
            if not isinstance(spec[k], str):
                raise QueryError(FAILED_TO_PARSE, f"'{k}' option to $lookup must be a string")


def _none() -> Value:
    return Value(F.array().cast("array<struct<>>"), T.ArrayType(T.StructType()))


def _keys(local: Value, foreign: Value) -> tuple[Column, Column]:
    t = V.common_type([local.type, foreign.type])
    if t is None or isinstance(t, T.NullType):
        return F.when(local.col.isNull(), 0).otherwise(1), F.when(foreign.col.isNull(), 0).otherwise(2)
    return V.cast(local, t).col, V.cast(foreign, t).col


def _set(c: Context, df: DataFrame, path: str, found: Column, t: T.DataType) -> Context:
    done = replace(c, df=df)
    hidden = [x for x in df.columns if x.startswith("__") and x in c.df.columns]
    fields = assign(done.scope().fields, path.split("."), Value(found, T.ArrayType(t)))
    return replace(c, df=df.select(*[v.col.alias(k) for k, v in fields.items()], *[F.col(x) for x in hidden]))


@stage("$lookup")
def _lookup(c: Context, spec) -> Context:
    _checked(spec)
    if "pipeline" not in spec:
        return equality(c, spec)
    other = _foreign(c, spec["from"])
    if other is None:
        return c.with_fields(assign(c.scope().fields, spec["as"].split("."), _none()))
    return _with_pipeline(c, spec, other)


#: Stages after which only what they name is left of a document.
_CLOSING = ("$group", "$count", "$sortByCount", "$bucket", "$replaceRoot")


def fields_used(name, following: list[dict]) -> set[str] | None:
    """The fields of a looked-up array's documents that later stages read; None for all of them."""
    if not isinstance(name, str) or "." in name:
        return None
    used: set[str] = set()

    def reads(spec) -> bool:
        """Gathers what an expression reads; false if it may read whole documents."""
        if isinstance(spec, str):
            if spec in (f"${name}", "$$ROOT", "$$CURRENT") or spec.startswith(("$$ROOT.", "$$CURRENT.")):
                return False
            if spec.startswith(f"${name}."):
                used.add(spec.split(".")[1])
            return True
        if isinstance(spec, dict):
            return all(v == f"${name}" if k == "$size" and isinstance(v, str) and v == f"${name}" else reads(v) for k, v in spec.items())
        return all(map(reads, spec)) if isinstance(spec, list) else True

    def tests(spec) -> bool:
        for k, v in spec.items():
            if k in ("$and", "$or", "$nor"):
                if not all(map(tests, v)):
                    return False
            elif k == "$expr":
                if not reads(v):
                    return False
            elif k.split(".")[0] == name:
                inner = v.get("$elemMatch") if isinstance(v, dict) and set(v) == {"$elemMatch"} else None
                if "." in k:
                    used.add(k.split(".")[1])
                elif isinstance(inner, dict) and not any(x.startswith("$") for x in inner):
                    used.update(x.split(".")[0] for x in inner)
                elif not (isinstance(v, dict) and set(v) == {"$size"}):
                    return False
        return True

    for stage_ in following:
        if not isinstance(stage_, dict) or len(stage_) != 1:
            return None
        (kind, argument), = stage_.items()
        if kind == "$match":
            if not isinstance(argument, dict) or not tests(argument):
                return None
        elif kind == "$project" and isinstance(argument, dict):
            if any(k.split(".")[0] == name and v in (1, True) and "." not in k for k, v in argument.items()):
                return None
            used.update(k.split(".")[1] for k, v in argument.items() if k.startswith(f"{name}."))
            if not reads(list(argument.values())):
                return None
            if any(v not in (0, False) for k, v in argument.items() if k != "_id" and not isinstance(v, (dict, list, str))) or any(isinstance(v, (dict, list, str)) for v in argument.values()):
                return used  # an inclusion: the rest of the document is gone
            if name in argument:
                return used
        elif kind == "$addFields" and isinstance(argument, dict):
            if not reads(list(argument.values())) or any(k.split(".")[0] == name for k in argument):
                return None
        elif kind == "$sort" and isinstance(argument, dict) and not any(k.split(".")[0] == name for k in argument) or kind in ("$limit", "$skip"):
            continue
        elif kind in _CLOSING:
            return used if reads(argument) else None
        else:
            return None
    return None


def equality(c: Context, spec, only: set[str] | None = None) -> Context:
    """A left join with the other collection's documents gathered by key; of these, ``only`` some fields may be needed."""
    _checked(spec)
    other = _foreign(c, spec["from"])
    if other is None:
        return c.with_fields(assign(c.scope().fields, spec["as"].split("."), _none()))
    head, *rest = spec["localField"].split(".")
    fields = c.scope().fields
    local = plain(fields[head], rest) if head in fields else V.missing()
    remote = top(fields_of(other), spec["foreignField"])
    names = [f.name for f in other.schema.fields if not f.name.startswith("__")]
    if only is not None and set(names):
        names = [n for n in names if n in only] or [n for n in names if n == spec["foreignField"].split(".")[0]] or names[:1]
    t = T.StructType([other.schema[n] for n in names])
    found_row = F.struct(*[F.col(f"`{n}`") for n in names])
    per_row = local.kind == V.ARRAY
    if remote.kind == V.ARRAY:
        keyed = other.select(found_row.alias("__r"), F.explode_outer(F.array_distinct(remote.col)).alias("__f"))
        remote = Value(F.col("__f"), remote.type.elementType)
    else:
        keyed = other.select(found_row.alias("__r"), remote.col.alias("__f"))
        remote = Value(F.col("__f"), remote.type)
    left, mark = c.df, f"{ROW}{next(_calls)}"
    if per_row:
        left = left.withColumn(mark, F.monotonically_increasing_id()).withColumn("__k", F.explode_outer(local.col))
        local = Value(F.col("__k"), local.type.elementType)
    lk, rk = _keys(local, remote)
    grouped = keyed.select(rk.alias("__f"), "__r").groupBy("__f").agg(F.collect_list("__r").alias("__found"))
    joined = left.withColumn("__k", lk).join(grouped, F.col("__k").eqNullSafe(F.col("__f")), "left")
    found = F.coalesce("__found", F.array().cast(T.ArrayType(t)))
    if per_row:
        kept = [F.first(F.col(f"`{x}`")).alias(x) for x in c.df.columns]
        joined = joined.groupBy(mark).agg(*kept, F.flatten(F.collect_list(found)).alias("__found"))
        found = F.col("__found")
    return _set(c, joined, spec["as"], found, t)


def joined_with_next(c: Context, spec, following: list[dict]) -> tuple[Context, int] | None:
    """An equality lookup whose array the next stages unwind or test for emptiness, as an inner, left, semi or anti join."""
    if not isinstance(spec, dict) or "pipeline" in spec or not following or "." in str(spec.get("as")):
        return None
    _checked(spec)
    other = _foreign(c, spec["from"])
    if other is None:
        return None
    fields = c.scope().fields
    head, *rest = spec["localField"].split(".")
    local, remote = (plain(fields[head], rest) if head in fields else V.missing()), top(fields_of(other), spec["foreignField"])
    if V.ARRAY in (local.kind, remote.kind):
        return None
    name = spec["as"]
    lk, rk = _keys(local, remote)
    unwind = following[0].get("$unwind")
    if unwind is not None:
        unwind = {"path": unwind} if isinstance(unwind, str) else unwind
        if unwind.get("path") != f"${name}" or unwind.get("includeArrayIndex"):
            return None
        keep = bool(unwind.get("preserveNullAndEmptyArrays"))
        right = other.select(rk.alias("__f"), row(other).alias("__r"))
        df = c.df.withColumn("__k", lk).join(right, F.col("__k").eqNullSafe(F.col("__f")), "left" if keep else "inner")
        done = replace(c, df=df)
        new = assign(done.scope().fields, [name], Value(F.col("__r"), df.schema["__r"].dataType))
        hidden = [F.col(x) for x in c.df.columns if x.startswith("__")]
        return replace(c, df=df.select(*[v.col.alias(k) for k, v in new.items()], *hidden)), 1
    test = following[0].get("$match")
    if test in ({name: {"$ne": []}}, {name: []}, {name: {"$size": 0}}) and len(following) > 1 and following[1].get("$unset") in (name, [name]) and name not in fields:
        how = "left_semi" if test == {name: {"$ne": []}} else "left_anti"
        df = c.df.withColumn("__k", lk).join(other.select(rk.alias("__f")), F.col("__k").eqNullSafe(F.col("__f")), how).drop("__k")
        return replace(c, df=df), 2
    return None


def _names(spec, out: set[str]) -> set[str]:
    if isinstance(spec, str) and spec.startswith("$$"):
        out.add(spec[2:].split(".")[0])
    elif isinstance(spec, dict):
        for k, v in spec.items():
            _names(v, out)
    elif isinstance(spec, list):
        for v in spec:
            _names(v, out)
    return out


def _with_pipeline(c: Context, spec: dict, other: DataFrame) -> Context:
    """Runs the inner pipeline for all outer documents at once.

    The outer documents are left-joined with the inner ones on the pipeline's first ``$match`` stages; equalities among
    these become join keys, and without any the join is a nested loop over both sides. Outer columns and variables go
    along as hidden columns, so stages that work row by row are the pipeline's own; the others work within an outer row.
    """
    pipeline, let = spec["pipeline"], spec.get("let", {})
    scope = c.scope()
    used = {k: compile_expression(v, scope) for k, v in let.items() if k in _names(pipeline, set())}
    outer = {k: v for k, v in c.variables.items() if k in _names(pipeline, set())}
    if not used and not outer:  # the same for every row: computed once, one row
        inner = compile_stages(start(other, c.collections), pipeline)
        ordered = _gathered(inner, F.lit(True))
        one = ordered[0].agg(ordered[1].alias("__found"))
        return _set(c, c.df.crossJoin(one), spec["as"], F.col("__found"), one.schema["__found"].dataType.elementType)
    n = next(_calls)
    mark, hit, out = f"{ROW}{n}", f"__hit{n}", f"__out{n}_"
    lets = {f"__let{n}_{k}": v for k, v in used.items()}
    left = c.df.select(*[F.col(f"`{x}`").alias(f"{out}{x}") for x in c.df.columns], *[v.col.alias(k) for k, v in lets.items()], F.monotonically_increasing_id().alias(mark))
    inherited = {k: _renamed(v, c.df, out) for k, v in outer.items() if k not in used}
    variables = inherited | {k[len(f"__let{n}_") :]: Value(F.col(f"`{k}`"), v.type) for k, v in lets.items()}
    right = other.select(*[F.col(f"`{x}`") for x in visible(other)]).withColumn(hit, F.lit(True))
    stages, on = list(pipeline), F.lit(True)
    bound = scope.__class__(fields_of(right), variables)
    while stages and "$match" in stages[0]:
        on = on & compile_filter(_split_and(stages.pop(0)["$match"]), bound)
    inner = Context(left.join(right, on, "left"), [], c.collections, variables)
    inner = _correlated(inner, stages, mark, hit)
    df, packed = _gathered(inner, F.col(hit), mark)
    kept = [F.first(F.col(f"`{out}{x}`")).alias(x) for x in c.df.columns]
    grouped = df.groupBy(mark).agg(*kept, packed.alias("__found"))
    return _set(c, grouped, spec["as"], F.col("__found"), grouped.schema["__found"].dataType.elementType)


def _renamed(v: Value, df: DataFrame, prefix: str) -> Value:
    """An outer pipeline's variable, whose hidden column has a new name on the inner side."""
    name = next((x for x in df.columns if x.startswith("__let") and str(F.col(f"`{x}`")) == str(v.col)), None)
    if name is None:
        raise QueryError(NOT_IMPLEMENTED, "only variables of 'let' reach a nested pipeline")
    return Value(F.col(f"`{prefix}{name}`"), v.type)


def _gathered(c: Context, there: Column, mark: str | None = None) -> tuple[DataFrame, Column]:
    """The rows that are ``there`` as one array, in their order."""
    if not c.sorted:
        return c.df, F.collect_list(F.when(there, row(c.df)))
    by = [F.col(k).asc() if asc else F.col(k).desc() for k, asc in c.order]
    if mark is None:  # one group: the order's columns go into the array
        if len({asc for _, asc in c.order}) == 1:
            packed = F.sort_array(F.collect_list(F.when(there, F.struct(*[F.col(k) for k, _ in c.order], row(c.df).alias("__r")))), c.order[0][1])
            return c.df, F.transform(packed, lambda x: x["__r"])
        df = c.ordered().withColumn("__rank", F.monotonically_increasing_id())
    else:
        df = c.df.withColumn("__rank", F.row_number().over(Window.partitionBy(mark).orderBy(*by)))
    packed = F.sort_array(F.collect_list(F.when(there, F.struct("__rank", row(df).alias("__r")))))
    return df, F.transform(packed, lambda x: x["__r"])


def _split_and(spec: dict) -> dict:
    """``$expr: {$and: [...]}`` as several conditions, so that equalities can become join keys."""
    e = spec.get("$expr")
    if isinstance(e, dict) and set(e) == {"$and"} and len(spec) == 1:
        return {"$and": [_split_and({"$expr": x}) for x in e["$and"]]}
    return spec


def _correlated(c: Context, stages: list[dict], mark: str, hit: str) -> Context:
    """An inner pipeline's stages on all outer rows at once.

    ``mark`` tells outer rows apart; ``hit`` is null in rows that only keep the place of an outer row without documents.
    """
    there = F.col(hit)

    def grouped(c: Context, key: Column, output: dict) -> Context:
        """Groups within outer rows; rows without a hit are one group, which keeps none."""
        own = [x for x in c.df.columns if x.startswith(("__out", "__let", ROW, "__hit")) and x not in (mark, hit)]
        aggs = aggregates(output, c.scope(), c.order)
        done = c.df.groupBy(mark, hit, key.alias("_id")).agg(*aggs, *[F.first(F.col(f"`{x}`")).alias(x) for x in own])
        return replace(c, df=done, order=[], sorted=False)

    for spec in stages:
        if not isinstance(spec, dict) or len(spec) != 1:
            raise QueryError(40323, "A pipeline stage specification object must contain exactly one field.")
        (name, argument), = spec.items()
        only = lambda keep, c=c: replace(c, df=c.df.withColumn(hit, F.when(there & keep, True)))
        if name in ("$match", "$redact"):
            c = only((compile_filter if name == "$match" else kept_by)(argument, c.scope()))
        elif name in ("$limit", "$skip", "$sample"):
            STAGES[name](c, argument)  # checks the argument
            by = [F.rand()] if name == "$sample" else [F.col(k).asc() if asc else F.col(k).desc() for k, asc in c.order]
            at = F.row_number().over(Window.partitionBy(mark).orderBy(there.desc_nulls_last(), *by))
            c = only(at > argument if name == "$skip" else at <= (argument["size"] if name == "$sample" else argument))
        elif name == "$unwind":
            c = unwind(c, argument, hit)
        elif name in ("$group", "$count", "$sortByCount"):
            if name == "$group" and (not isinstance(argument, dict) or "_id" not in argument):
                raise QueryError(15955, "a group specification must include an _id")
            group = argument if name == "$group" else {"_id": None, argument: {"$sum": 1}} if name == "$count" else {"_id": argument, "count": {"$sum": 1}}
            key = group_key(group["_id"], c.scope())
            was_sorted = c.sorted
            c = grouped(c, F.when(there, V.sort_key(key, True).getField("v") if key.kind == V.ARRAY else key.col), {k: v for k, v in group.items() if k != "_id"})
            if name == "$count":
                c = replace(c, df=c.df.drop("_id"))
            elif name == "$sortByCount":
                c = sort_columns(c, [("count", False), ("_id", True)])
            elif was_sorted:
                c = sort_columns(c, [("_id", True)])
        elif name == "$bucket":
            key, output = bucket_key(argument, c.scope(), there)
            c = sort_columns(grouped(c, key, output), [("_id", True)])
        elif name == "$facet":
            c = _correlated_facet(c, argument, mark, hit)
        elif name in ("$out", "$merge"):
            raise QueryError(51047, f"{name} is not allowed within a $lookup's sub-pipeline")
        elif name not in STAGES:
            raise QueryError(40324, f"Unrecognized pipeline stage name: '{name}'")
        else:
            c = STAGES[name](c, argument)
    return c


def _correlated_facet(c: Context, spec, mark: str, hit: str) -> Context:
    """One document for each outer row, with an array for each facet; the input is written once and read by every facet."""
    from quillspark.sources.storage import checkpointed

    if not isinstance(spec, dict) or not spec:
        raise QueryError(40169, "the $facet specification must be a non-empty object")
    c = replace(c, df=checkpointed(c.df))
    own = [x for x in c.df.columns if x.startswith(("__out", "__let", ROW, "__hit")) and x not in (mark, hit)]
    out = c.df.groupBy(mark).agg(*[F.first(F.col(f"`{x}`")).alias(x) for x in own]).withColumn(hit, F.lit(True))
    for name, pipeline in spec.items():
        df, packed = _gathered(done := _correlated(c, pipeline, mark, hit), F.col(hit), mark)
        out = out.join(df.groupBy(F.col(mark).alias("__at")).agg(packed.alias(name)), F.col(mark) == F.col("__at"), "left").drop("__at")
    return replace(done, df=out, order=[], sorted=False)


@stage("$graphLookup")
def _graph_lookup(c: Context, spec) -> Context:
    """Breadth-first over joins, a level at a time, each document once for each root; levels are checkpointed.

    The walk starts from the document's own ``connectFromField``, as the reference semantics have it.
    """
    for k in ("from", "startWith", "connectFromField", "connectToField", "as"):
        if k not in spec:
            raise QueryError(40105, f"missing '{k}' for a $graphLookup")
    if not isinstance(spec["startWith"], str):
        raise QueryError(40102, "startWith must be a string")
    depth = spec.get("maxDepth")
    if depth is not None and (isinstance(depth, bool) or not isinstance(depth, int) or depth < 0):
        raise QueryError(40101, "maxDepth requires a nonnegative argument")
    other = _foreign(c, spec["from"])
    if other is None:
        return c.with_fields(assign(c.scope().fields, spec["as"].split("."), _none()))
    from quillspark.sources.storage import checkpointed

    base = checkpointed(c.df.withColumn(ROW, F.monotonically_increasing_id()))
    begin, remote = top(fields_of(base), spec["connectFromField"]), fields_of(other)
    to, back = top(remote, spec["connectToField"]), top(remote, spec["connectFromField"])
    each = lambda v: F.explode(v.col) if v.kind == V.ARRAY else v.col
    nodes = other.select(F.xxhash64(F.to_json(row(other))).alias("__node"), row(other).alias("__r"), each(to).alias("__to"), back.col.alias("__back"))
    frontier = base.select(ROW, each(begin).alias("__at")).filter("__at is not null").distinct()
    found, level = None, 0
    while depth is None or level <= depth:
        hits = frontier.join(nodes, F.col("__at") == F.col("__to")).drop("__at", "__to").dropDuplicates([ROW, "__node"])
        if found is not None:
            hits = hits.join(found.select(ROW, "__node"), [ROW, "__node"], "left_anti")
        hits = checkpointed(hits.withColumn("__depth", F.lit(level).cast("bigint")))
        if hits.limit(1).count() == 0:
            break
        found = hits if found is None else found.unionByName(hits)
        back_type = hits.schema["__back"].dataType
        frontier = hits.select(ROW, (F.explode("__back") if isinstance(back_type, T.ArrayType) else F.col("__back")).alias("__at")).filter("__at is not null").distinct()
        level += 1
    t = T.StructType([f for f in other.schema.fields if not f.name.startswith("__")])
    if found is None:
        return _set(c, base, spec["as"], F.array().cast(T.ArrayType(t)), t)
    value = F.col("__r")
    if "depthField" in spec:
        value = value.withField(spec["depthField"], F.col("__depth"))
    packed = found.select(ROW, "__depth", "__node", value.alias("__r")).groupBy(ROW).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__depth")).alias("d"), "__node", "__r"))), lambda x: x["__r"]).alias("__found"))
    kind = packed.schema["__found"].dataType
    joined = base.join(packed, ROW, "left")
    return _set(c, joined, spec["as"], F.coalesce("__found", F.array().cast(kind)), kind.elementType)
