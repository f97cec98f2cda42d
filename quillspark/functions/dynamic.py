"""Documents without a common schema: one VARIANT column, with order and equality through a comparable key.

VARIANT can't be grouped, sorted or compared, so every value is given a key: its type class, and its value as a number
or as text. Here null and missing differ: a path that isn't there is SQL null, a JSON null is a null variant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import BAD_VALUE, QueryError
from quillspark.functions import values as V

#: Type classes as in the total order; null and missing come first.
_RANKS = (("BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT", V.NUMBER), ("STRING", V.STRING), ("OBJECT.*", V.OBJECT), ("ARRAY.*", V.ARRAY), ("BINARY", V.BINARY), ("BOOLEAN", V.BOOL), ("DATE|TIMESTAMP.*", V.DATE))
_NAMES = {"double": "DOUBLE|FLOAT|DECIMAL.*", "string": "STRING", "object": "OBJECT.*", "array": "ARRAY.*", "bool": "BOOLEAN", "date": "DATE|TIMESTAMP.*", "null": "VOID", "int": "BIGINT|INT", "long": "BIGINT", "number": _RANKS[0][0]}


def at(doc: Column, path: str) -> Column:
    """The value at a path; a number is an array's index."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.try_variant_get(doc, f"${steps}", "variant")


def rank(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    out = F.when(v.isNull() | F.is_variant_null(v), V.NULL)
    for pattern, k in _RANKS:
        out = out.when(kind.rlike(f"^({pattern})$"), k)
    return out.otherwise(V.NULL)


def key(v: Column) -> Column:
    """Equal for equal values, and in the total order: numbers by value whatever their width.

    Whole numbers that one double stands for (beyond 2**53) are told apart by ``x``, their value as a long.
    """
    r = rank(v)
    number = F.when(r == V.NUMBER, F.try_variant_get(v, "$", "double")).when(r == V.BOOL, F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(r == V.DATE, F.unix_micros(F.try_variant_get(v, "$", "timestamp")).cast("double"))
    exact = F.when(r == V.NUMBER, F.coalesce(F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "double").cast("bigint")))
    text = F.when(r == V.STRING, F.try_variant_get(v, "$", "string")).when(r.isin(V.OBJECT, V.ARRAY), F.to_json(v))
    return F.struct(r.alias("r"), number.alias("n"), exact.alias("x"), text.alias("t"))


def literal(value) -> Column:
    import json

    return F.parse_json(F.lit(json.dumps(value)))


def elements(v: Column) -> Column:
    """An array's elements, or null."""
    return F.try_variant_get(v, "$", "array<variant>")


def _any(v: Column, test) -> Column:
    return F.coalesce(test(v), F.lit(False)) | F.coalesce(F.exists(elements(v), test), F.lit(False))


def _operator(name: str, argument, v: Column) -> Column:
    if name == "$eq":
        k = key(literal(argument))
        return _any(v, lambda e: key(e) == k)
    if name == "$in":
        return V.any_of([_operator("$eq", a, v) for a in argument])
    if name in ("$ne", "$nin"):
        return ~_operator({"$ne": "$eq", "$nin": "$in"}[name], argument, v)
    if name in ("$gt", "$gte", "$lt", "$lte"):
        k = key(literal(argument))
        compare = {"$gt": lambda a: a > k, "$gte": lambda a: a >= k, "$lt": lambda a: a < k, "$lte": lambda a: a <= k}[name]
        return _any(v, lambda e: (key(e)["r"] == k["r"]) & (k["r"] != V.NULL) & compare(key(e)))
    if name == "$exists":
        return v.isNotNull() if argument else v.isNull()
    if name == "$type":
        wanted = argument if isinstance(argument, list) else [argument]
        if any(w not in _NAMES for w in wanted):
            raise QueryError(BAD_VALUE, f"Unknown type name alias: {argument}")
        pattern = "|".join(_NAMES[w] for w in wanted)
        return _any(v, lambda e: F.schema_of_variant(e).rlike(f"^({pattern})$"))
    if name == "$size":
        return F.coalesce(F.size(elements(v)) == argument, F.lit(False))
    if name == "$regex":
        return _any(v, lambda e: F.try_variant_get(e, "$", "string").rlike(argument))
    if name == "$not":
        return ~V.all_of([_operator(k, a, v) for k, a in argument.items()])
    raise QueryError(BAD_VALUE, f"unknown operator: {name}")


@dataclass(frozen=True)
class Dynamic:
    """A collection of documents of any shape, in the column ``doc``."""

    df: DataFrame

    @staticmethod
    def from_json(df: DataFrame, column: str) -> Dynamic:
        return Dynamic(df.select(F.try_parse_json(F.col(column)).alias("doc")).filter("doc is not null"))

    def condition(self, spec: dict) -> Column:
        parts = []
        for path, c in spec.items():
            if path in ("$and", "$or", "$nor"):
                each = [self.condition(s) for s in c]
                parts.append(V.all_of(each) if path == "$and" else V.any_of(each) if path == "$or" else ~V.any_of(each))
            elif isinstance(c, dict) and any(k.startswith("$") for k in c):
                parts.extend(_operator(k, a, at(F.col("doc"), path)) for k, a in c.items())
            else:
                parts.append(_operator("$eq", c, at(F.col("doc"), path)))
        return V.all_of(parts)

    def match(self, spec: dict) -> Dynamic:
        return Dynamic(self.df.filter(self.condition(spec)))

    def sort(self, spec: dict) -> Dynamic:
        return Dynamic(self.df.orderBy(*[key(at(F.col("doc"), p)).asc() if d > 0 else key(at(F.col("doc"), p)).desc() for p, d in spec.items()]))

    def group(self, path: str | None, accumulators: dict[str, dict]) -> DataFrame:
        """``_id`` as a variant, and ``$sum``, ``$avg``, ``$min``, ``$max`` or ``$push`` of paths (``$sum`` of a number counts)."""
        aggs = []
        for name, acc in accumulators.items():
            (op, argument), = acc.items()
            if op == "$sum" and not isinstance(argument, str):
                aggs.append((F.count(F.lit(1)) * argument).alias(name))
                continue
            v = at(F.col("doc"), argument.lstrip("$"))
            number = F.when(rank(v) == V.NUMBER, F.try_variant_get(v, "$", "double"))
            known = F.when(rank(v) != V.NULL, F.struct(key(v).alias("k"), F.to_json(v).alias("v")))
            made = {"$sum": lambda n=number: F.coalesce(F.sum(n), F.lit(0.0)), "$avg": lambda n=number: F.avg(n), "$min": lambda k=known: F.parse_json(F.min(k)["v"]), "$max": lambda k=known: F.parse_json(F.max(k)["v"]), "$push": lambda v=v: F.collect_list(v)}
            if op not in made:
                raise QueryError(15952, f"unknown group operator '{op}'")
            aggs.append(made[op]().alias(name))
        of = at(F.col("doc"), path.lstrip("$")) if path else F.lit(None).cast(T.VariantType())
        keyed = self.df.select("doc", key(of).alias("__key"), F.to_json(of).alias("__id"))
        return keyed.groupBy("__key").agg(F.parse_json(F.min("__id")).alias("_id"), *aggs).drop("__key")

    def distinct(self, path: str) -> DataFrame:
        """A path's distinct values as variants, arrays taken apart; null is a value, missing isn't."""
        v = at(F.col("doc"), path)
        each = F.explode(F.when(rank(v) == V.ARRAY, elements(v)).otherwise(F.array(v)))
        rows = self.df.filter(v.isNotNull()).select(each.alias("v")).select(key(F.col("v")).alias("k"), F.to_json("v").alias("t"))
        return rows.groupBy("k").agg(F.min("t").alias("t")).orderBy("k").select(F.parse_json("t").alias("value"))

    def to_json(self) -> DataFrame:
        return self.df.select(F.to_json("doc").alias("doc"))
