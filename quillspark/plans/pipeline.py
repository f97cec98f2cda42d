"""Aggregation pipelines compiled stage by stage to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import NOT_IMPLEMENTED, QueryError
from quillspark.functions import values as V
from quillspark.functions.expressions import Scope, compile_expression
from quillspark.functions.paths import fields_of, plain, top, visible
from quillspark.functions.values import Value
from quillspark.operators.accumulators import Order, aggregates
from quillspark.operators.filters import row_filter
from quillspark.operators.projection import Fields, add_fields, assign, exclude, project, tree_of

ORDINAL = "__ord"
#: Where a row stands: the number of its partition in the bits from PART_BITS on, its number in there below.
PLACE, PART_BITS = "__place", 33


@dataclass(frozen=True)
class Context:
    """A pipeline's state between stages: the rows, the columns that order them, names of other collections, variables."""

    df: DataFrame
    order: Order = field(default_factory=list)
    collections: Callable[[str], DataFrame | None] = lambda name: None
    variables: dict[str, Value] = field(default_factory=dict)
    sorted: bool = False

    def scope(self) -> Scope:
        return Scope(fields_of(self.df), self.variables)

    def with_fields(self, fields: Fields) -> Context:
        hidden = [F.col(c) for c in self.df.columns if c.startswith("__")]
        return replace(self, df=self.df.select(*[v.col.alias(k) for k, v in fields.items()], *hidden))

    def ordered(self) -> DataFrame:
        """The rows in the known order."""
        return self.df.orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c, asc in self.order]) if self.order else self.df


STAGES: dict[str, Callable[[Context, object], Context]] = {}


def stage(name: str):
    def register(f):
        STAGES[name] = f
        return f

    return register


def start(df: DataFrame, collections=lambda name: None) -> Context:
    order = [(ORDINAL, True)] if ORDINAL in df.columns else []
    return Context(df, order, collections)


def compile_stages(context: Context, pipeline: list[dict]) -> Context:
    from quillspark.plans import lookup  # noqa: F401  registers its stages

    k = 0
    while k < len(pipeline):
        spec = pipeline[k]
        if not isinstance(spec, dict) or len(spec) != 1:
            raise QueryError(40323, "A pipeline stage specification object must contain exactly one field.")
        (name, argument), = spec.items()
        if name == "$lookup" and (merged := lookup.joined_with_next(context, argument, pipeline[k + 1 :])):
            context, used = merged
            k += 1 + used
            continue
        if name == "$lookup" and isinstance(argument, dict) and "pipeline" not in argument:
            context = lookup.equality(context, argument, lookup.fields_used(argument.get("as"), pipeline[k + 1 :]))
            k += 1
            continue
        if name == "$skip" and (following := pipeline[k + 1 : k + 2]):
            if list(following[0]) == ["$limit"]:
                context = page(context, argument, following[0]["$limit"])
                k += 2
                continue
            if only_drops_fields(following[0]):  # then fewer columns are put in order
                pipeline = [*pipeline[:k], following[0], spec, *pipeline[k + 2 :]]
                continue
        if name in ("$out", "$merge") and k != len(pipeline) - 1:
            raise QueryError(40601, f"{name} can only be the final stage in the pipeline")
        if name not in STAGES:
            raise QueryError(40324, f"Unrecognized pipeline stage name: '{name}'")
        context = STAGES[name](context, argument)
        k += 1
    return context


def run_pipeline(df: DataFrame, pipeline: list[dict], collections=lambda name: None) -> DataFrame:
    """The pipeline's documents as a DataFrame; ``collections(name)`` gives other collections for lookups."""
    done = compile_stages(start(df, collections), pipeline)
    out = done.ordered() if done.sorted else done.df
    return out.select(*[F.col(f"`{c}`") for c in visible(out)])


def row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in visible(df)])


@stage("$match")
def _match(c: Context, spec) -> Context:
    return replace(c, df=c.df.filter(row_filter(spec, c.scope())))


@stage("$project")
def _project(c: Context, spec) -> Context:
    return c.with_fields(project(spec, c.scope()))


@stage("$addFields")
def _add_fields(c: Context, spec) -> Context:
    return c.with_fields(add_fields(spec, c.scope()))


@stage("$unset")
def _unset(c: Context, spec) -> Context:
    paths = [spec] if isinstance(spec, str) else spec
    if not isinstance(paths, list) or not paths or any(not isinstance(p, str) or not p for p in paths):
        raise QueryError(31002, "$unset specification must be a string or an array")
    return c.with_fields(exclude(c.scope().fields, tree_of(paths)))


@stage("$replaceRoot")
def _replace_root(c: Context, spec) -> Context:
    if not isinstance(spec, dict) or "newRoot" not in spec:
        raise QueryError(40231, "no newRoot specified for the $replaceRoot stage")
    root = compile_expression(spec["newRoot"], c.scope())
    if not isinstance(root.type, T.StructType):
        raise QueryError(40228, f"'newRoot' expression must evaluate to an object, but resulting value was of type: {root.type.simpleString()}")
    return c.with_fields({n: Value(root.col.getField(n), root.type[n].dataType) for n in root.type.fieldNames()})


def group_key(spec, scope: Scope) -> Value:
    key = compile_expression(spec, scope)
    return Value(F.lit(None).cast("string"), T.StringType()) if key.kind == V.NULL else key


def sort_columns(c: Context, keys: list[tuple[str, bool]]) -> Context:
    """Hidden columns that hold what the rows are sorted by; ties stay in the order they were in."""
    fields = c.scope().fields
    kept = [x for x in c.df.columns if not x.startswith("__s_")]
    before = [(f"__t_{k}", asc) for k, (_, asc) in enumerate(c.order)] if c.order else []
    cols = [V.sort_key(top(fields, path), asc).alias(f"__s_{k}") for k, (path, asc) in enumerate(keys)]
    ties = [F.col(old).alias(new) for (old, _), (new, _) in zip(c.order, before, strict=True)]
    kept = [x for x in kept if not x.startswith("__t_")]
    df = c.df.select(*[F.col(f"`{x}`") for x in kept], *cols, *ties)
    return replace(c, df=df, order=[(f"__s_{k}", asc) for k, (_, asc) in enumerate(keys)] + before, sorted=True)


@stage("$group")
def _group(c: Context, spec) -> Context:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise QueryError(15955, "a group specification must include an _id")
    scope = c.scope()
    rest = {k: v for k, v in spec.items() if k != "_id"}
    for k in rest:
        if "." in k:
            raise QueryError(40235, f"The field name '{k}' cannot contain '.'")
    key = group_key(spec["_id"], scope)
    aggs = aggregates(rest, scope, c.order)
    if spec["_id"] is None:  # one group, and none of no rows
        out = c.df.agg(*aggs, F.count(F.lit(1)).alias("__n")).filter("__n > 0").select(key.col.alias("_id"), *[F.col(f"`{k}`") for k in rest])
    else:
        k = V.sort_key(key, True).getField("v") if key.kind == V.ARRAY else key.col
        out = c.df.groupBy(k.alias("_id")).agg(*aggs) if aggs else c.df.select(k.alias("_id")).distinct()
    return sort_columns(replace(c, df=out, order=[], sorted=False), [("_id", True)]) if c.sorted else replace(c, df=out, order=[], sorted=False)


@stage("$count")
def _count(c: Context, spec) -> Context:
    if not isinstance(spec, str) or not spec or spec.startswith("$") or "." in spec:
        raise QueryError(40156, "the count field must be a non-empty string")
    return replace(c, df=c.df.agg(F.count(F.lit(1)).alias(spec)).filter(F.col(f"`{spec}`") > 0), order=[], sorted=False)


@stage("$sortByCount")
def _sort_by_count(c: Context, spec) -> Context:
    counted = _group(c, {"_id": spec, "count": {"$sum": 1}})
    return sort_columns(replace(counted, order=[]), [("count", False), ("_id", True)])


@stage("$bucket")
def _bucket(c: Context, spec) -> Context:
    key, output = bucket_key(spec, c.scope())
    return sort_columns(replace(c, df=c.df.groupBy(key.alias("_id")).agg(*aggregates(output, c.scope(), c.order)), order=[]), [("_id", True)])


def bucket_key(spec, scope: Scope, hit: Column | None = None) -> tuple[Column, dict]:
    """Each document's bucket, and the accumulators; where ``hit`` is given, other rows are in no bucket."""
    if not isinstance(spec, dict) or not {"groupBy", "boundaries"} <= set(spec):
        raise QueryError(40198, "$bucket requires 'groupBy' and 'boundaries' to be specified.")
    bounds = spec["boundaries"]
    if not isinstance(bounds, list) or len(bounds) < 2:
        raise QueryError(40192, "The $bucket 'boundaries' field must have at least 2 values")
    literals = [V.literal(b) for b in bounds]
    if len({x.kind for x in literals}) > 1:
        raise QueryError(40193, "All values in the 'boundaries' option to $bucket must have the same type")
    if any(not a < b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise QueryError(40194, "The 'boundaries' option to $bucket must be sorted in ascending order")
    value = compile_expression(spec["groupBy"], scope)
    t = V.common_type([x.type for x in literals])
    fallback = V.literal(spec["default"]) if "default" in spec else None
    u = V.common_type([t, fallback.type]) if fallback else t
    u = u or T.StringType()
    # names of another type than the boundaries' make the key text, which then sorts as text
    out = F.when(F.lit(False) if hit is None else hit.isNull(), F.lit(None).cast(u))
    for low, high, name in zip(literals, literals[1:], literals, strict=False):
        inside = value.col.isNotNull() & ~V.less(value, low) & V.less(value, high) if value.kind == low.kind else F.lit(False)
        out = out.when(inside, name.col.cast(u))
    out = out.otherwise(fallback.col.cast(u) if fallback else F.raise_error(F.lit("[40066] $switch could not find a matching branch for an input, and no default was specified.")).cast(u))
    return out, spec.get("output", {"count": {"$sum": 1}})


def _direction(v) -> bool:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v == 0:
        raise QueryError(15975, "$sort key ordering must be 1 (for ascending) or -1 (for descending)")
    return v > 0


@stage("$sort")
def _sort(c: Context, spec) -> Context:
    if not isinstance(spec, dict) or not spec:
        raise QueryError(15976, "$sort stage must have at least one sort key")
    return sort_columns(c, [(k, _direction(v)) for k, v in spec.items()])


def _skipped(spec) -> int:
    if isinstance(spec, bool) or not isinstance(spec, int) or spec < 0:
        raise QueryError(15956, "Argument to $skip must be a non-negative number")
    return spec


@stage("$skip")
def _skip(c: Context, spec) -> Context:
    """The rows are written once, in order and with their places; each task then tells by the place what to skip.

    Spark's own offset takes all rows through one task.
    """
    if not _skipped(spec):
        return c
    from quillspark.sources.storage import checkpointed

    kept = [F.col(f"`{x}`") for x in c.df.columns if not x.startswith(("__s_", "__t_", PLACE))]
    placed = checkpointed(c.ordered().select(*kept, F.monotonically_increasing_id().alias(PLACE)))
    first, left = 0, spec
    for part, n in sorted(placed.groupBy(F.shiftright(PLACE, PART_BITS)).count().collect()):  # a row for each partition
        first = (part << PART_BITS) + min(left, n)
        left -= min(left, n)
        if not left:
            break
    return replace(c, df=placed.filter(F.col(PLACE) >= first), order=[(PLACE, True)])


@stage("$limit")
def _limit(c: Context, spec) -> Context:
    return page(c, 0, spec)


def page(c: Context, skip, limit) -> Context:
    """``$skip`` and ``$limit``: of each task's rows, the first ``skip + limit`` at most go on."""
    skip = _skipped(skip)
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise QueryError(15958, "the limit must be positive")
    return replace(c, df=(c.ordered().offset(skip) if skip else c.ordered()).limit(limit))


def only_drops_fields(spec) -> bool:
    """Whether a stage is a ``$project`` that names the fields it keeps and computes none."""
    fields = spec.get("$project") if isinstance(spec, dict) and len(spec) == 1 else None
    return isinstance(fields, dict) and bool(fields) and all(isinstance(v, (bool, int)) and v for v in fields.values())


@stage("$sample")
def _sample(c: Context, spec) -> Context:
    if not isinstance(spec, dict) or not isinstance(spec.get("size"), int) or spec["size"] < 0:
        raise QueryError(28746, "size argument to $sample must be a non-negative number")
    return replace(c, df=c.df.orderBy(F.rand()).limit(spec["size"]), sorted=False)


@stage("$unwind")
def _unwind(c: Context, spec) -> Context:
    return unwind(c, spec)


def unwind(c: Context, spec, hit: str | None = None) -> Context:
    """``hit`` names a column that is nulled where a row has nothing to unwind, in place of dropping the row."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    path = spec.get("path")
    if not isinstance(path, str) or not path.startswith("$") or len(path) < 2:
        raise QueryError(28818, f"path option to $unwind stage should be prefixed with a '$': {path}")
    keep, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    if index is not None and (not index or index.startswith("$")):
        raise QueryError(28822, "includeArrayIndex option to $unwind stage should not be prefixed with a '$'")
    parts = path[1:].split(".")
    fields = c.scope().fields
    value = plain(fields[parts[0]], parts[1:]) if parts[0] in fields else V.missing()
    marked = lambda df, there: df.withColumn(hit, F.when(F.col(hit) & there, True))
    if value.kind != V.ARRAY:
        there = value.col.isNotNull()
        c = replace(c, df=c.df if keep else marked(c.df, there) if hit else c.df.filter(there))
        return c.with_fields(assign(c.scope().fields, index.split("."), Value(F.lit(None).cast("bigint"), T.LongType()))) if index else c
    explode = F.posexplode_outer if keep or hit else F.posexplode
    others = [F.col(f"`{x}`") for x in c.df.columns]
    df = c.df.select(*others, explode(value.col).alias("__pos", "__elem"))
    if hit and not keep:
        df = marked(df, F.col("__pos").isNotNull())
    order = [*c.order, ("__pos", True)] if c.order else []
    done = replace(c, df=df)
    new = assign(done.scope().fields, parts, Value(F.col("__elem"), value.type.elementType))
    if index:
        new = assign(new, index.split("."), Value(F.col("__pos").cast("bigint"), T.LongType()))
    done = done.with_fields(new)
    df = done.df.drop("__elem")
    if order:
        df, order = df.withColumnRenamed("__pos", f"__u_{len(order)}"), [*c.order, (f"__u_{len(order)}", True)]
    else:
        df = df.drop("__pos")
    return replace(done, df=df, order=order)


@stage("$redact")
def _redact(c: Context, spec) -> Context:
    if "$$DESCEND" in str(spec):
        raise QueryError(NOT_IMPLEMENTED, "$$DESCEND is not yet implemented")
    return replace(c, df=c.df.filter(kept_by(spec, c.scope())))


def kept_by(spec, scope: Scope) -> Column:
    """Whether ``$redact`` keeps a document."""
    value = compile_expression(spec, scope)
    if value.kind != V.STRING:
        raise QueryError(17053, "$redact's expression should not return anything aside from the variables $$KEEP, $$DESCEND, and $$PRUNE")
    return value.col == "$$KEEP"


@stage("$facet")
def _facet(c: Context, spec) -> Context:
    """Every facet becomes one row; the rows, one each, are put side by side."""
    if not isinstance(spec, dict) or not spec:
        raise QueryError(40169, "the $facet specification must be a non-empty object")
    out = None
    if len(spec) > 1 and c.df.columns:  # the input is written once and read by every facet
        from quillspark.sources.storage import checkpointed

        c = replace(c, df=checkpointed(c.df))
    for name, pipeline in spec.items():
        done = compile_stages(c, pipeline)
        keys = [F.col(k) for k, _ in done.order] if done.sorted else []
        if done.sorted and len({asc for _, asc in done.order}) == 1:
            gathered = F.transform(F.sort_array(F.collect_list(F.struct(*keys, row(done.df).alias("__r"))), done.order[0][1]), lambda x: x["__r"])
        elif done.sorted:
            ranked = done.ordered().withColumn("__rank", F.monotonically_increasing_id())
            done = replace(done, df=ranked)
            gathered = F.transform(F.sort_array(F.collect_list(F.struct("__rank", row(done.df).alias("__r")))), lambda x: x["__r"])
        else:
            gathered = F.collect_list(row(done.df))
        one = done.df.agg(gathered.alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return replace(c, df=out, order=[], sorted=False)


@stage("$geoNear")
def _geo_near(c: Context, spec) -> Context:
    raise QueryError(NOT_IMPLEMENTED, "$geoNear is not yet implemented")
