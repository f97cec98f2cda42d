"""Databases and collections: segments of Parquet, numbered manifests, unique keys, and a log of changes.

A collection is a list of segments. An insert appends one; an update appends the changed documents, which hide their
earlier versions; a delete appends the hidden documents' numbers. What a collection is made of stands in a manifest; each
write makes the next numbered manifest, created only if it isn't there, so readers see whole versions, and of two writers
one is refused. After COMPACT parts the collection is rewritten as one segment. Metadata goes through the Hadoop file
system, so any store that Spark writes to will do.
"""

from __future__ import annotations

import datetime
import json
import secrets
import socket
import uuid
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import BAD_VALUE, DUPLICATE_KEY, IMMUTABLE_FIELD, NAMESPACE_EXISTS, NAMESPACE_NOT_FOUND, WRITE_CONFLICT, QueryError
from quillspark.functions import values as V
from quillspark.functions.expressions import Scope
from quillspark.functions.paths import fields_of, top, visible
from quillspark.functions.values import Value
from quillspark.operators.filters import compile_filter, row_filter
from quillspark.operators.projection import find_projection
from quillspark.operators.updates import Update, changed_fields, conformed, merged_struct, seed
from quillspark.plans import pipeline as P
from quillspark.sources.storage import utc_times

CHANGES = "ts long, op string, ns string, id string, doc string, delta string, wall timestamp"
#: Numbers the segment that a document's version stands in.
SEGMENT = "__seg"
#: Segments and deletions after which a collection is rewritten.
COMPACT = 24
#: Manifests and clock points that are kept for readers at work.
KEPT = 8


def object_id() -> str:
    return secrets.token_hex(12)


def infer(value) -> T.DataType:
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, infer(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return T.ArrayType(unify([infer(v) for v in value]))
    return V.literal(value).type


def unify(types: list[T.DataType]) -> T.DataType:
    out: T.DataType = T.NullType()
    for t in types:
        got = V.common_type([out, t]) or merged_struct(t, out)
        if got is None:
            raise QueryError(14, f"a field can't hold both {out.simpleString()} and {t.simpleString()} on the typed path")
        out = got
    return out


def to_rows(documents: list[dict]) -> tuple[list, T.StructType]:
    t = unify([infer(d) for d in documents])

    def shaped(v, t):
        if v is None:
            return None
        if isinstance(t, T.StructType):
            return Row(*[shaped(v.get(f.name), f.dataType) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return [shaped(x, t.elementType) for x in v]
        return float(v) if isinstance(t, T.DoubleType) else v

    return [shaped(d, t) for d in documents], t


def delta_of(spec: dict) -> dict:
    """What an update sets and unsets, as a document; a replacement is the document itself."""
    if not any(k.startswith("$") for k in spec):
        return spec
    out: dict = {}
    for path, value in [*spec.get("$set", {}).items(), *spec.get("$unset", {}).items()]:
        *parents, last = path.split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def align(df: DataFrame, t: T.StructType) -> DataFrame:
    """The columns of ``t``, in its types."""
    fields = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    return df.select(*[conformed(fields.get(f.name, V.missing()), f.dataType).col.alias(f.name) for f in t.fields])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    t = unify([a.schema, b.schema])
    return align(a, t).unionByName(align(b, t))


class Engine:
    """A folder of databases. ``read_only`` refuses every write; ``log`` keeps changes for streams."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, log: bool = True):
        self.spark, self.root, self.read_only, self.log = spark, root.rstrip("/"), read_only, log
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __getitem__(self, name: str) -> Database:
        return Database(self, name)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p) if s.isDirectory()) if self.fs.exists(p) else []

    def databases(self) -> list[str]:
        return [n for n in self.names(self.root) if not n.startswith("_")]

    def read_json(self, path: str) -> dict | None:
        p = self._path(path)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create_json(self, path: str, value: dict) -> bool:
        """Creates a file as a whole; false if it is there already."""
        jvm = self.spark.sparkContext._jvm
        temporary = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        target = self._path(path)
        if self.fs.exists(target):
            self.fs.delete(temporary, False)
            return False
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = getattr(rename, "NONE")
        try:  # fails if the target is there by now
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, target, how)
        except Py4JJavaError:
            self.fs.delete(temporary, False)
            return False
        return True

    def write_bytes(self, path: str, value: bytes) -> None:
        stream = self.fs.create(self._path(path), True)
        stream.write(bytearray(value))
        stream.close()

    def numbers(self, folder: str) -> list[int]:
        """The numbered files of a folder, ascending."""
        p = self._path(folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def create_next(self, folder: str, known: int, value: dict) -> bool:
        """Creates the number after the known newest one."""
        made = self.create_json(f"{folder}/{known + 1:012d}.json", value)
        for old in self.numbers(folder)[:-KEPT] if made else ():
            self.fs.delete(self._path(f"{folder}/{old:012d}.json"), False)
        return made

    def delete(self, path: str) -> bool:
        return self.fs.delete(self._path(path), True)

    def writable(self) -> None:
        if self.read_only:
            raise QueryError(20, "the engine is read-only")

    def now(self) -> int:
        """The newest point of the logical clock."""
        return max(self.numbers(f"{self.root}/_clock"), default=0)

    def tick(self) -> int:
        """A new point of the logical clock, which no other writer has."""
        while True:
            at = self.now()
            if self.create_next(f"{self.root}/_clock", at, {}):
                return at + 1

    def log_change(self, op: str, ns: str, changed: DataFrame | None = None, delta: dict | None = None, doc: dict | None = None) -> None:
        if not self.log:
            return
        if changed is None:
            rows = self.spark.createDataFrame([(None, json.dumps(doc) if doc else None)], "id string, doc string")
        else:
            rows = changed.select(F.to_json(F.struct("_id")).alias("id"), F.to_json(P.row(changed)).alias("doc"))
        # the changes of one write share one point of the clock and are told apart by their keys
        stamped = rows.select(
            F.lit(self.tick()).cast("long").alias("ts"), F.lit(op).alias("op"), F.lit(ns).alias("ns"), "id",
            F.col("doc") if op != "delete" else F.lit(None).cast("string").alias("doc"), F.lit(json.dumps(delta, default=str) if delta else None).cast("string").alias("delta"), F.current_timestamp().alias("wall"),
        )
        stamped.write.mode("append").parquet(f"{self.root}/_changes")

    def rename(self, old: str, new: str, drop_target: bool = False) -> None:
        """Renames a collection by full names, also into another database."""
        self.writable()
        if old == new:
            return
        (a, x), (b, y) = old.split(".", 1), new.split(".", 1)
        if self[a][x].meta() is None:
            raise QueryError(NAMESPACE_NOT_FOUND, "source namespace does not exist")
        if self[b][y].meta() is not None:
            if not drop_target:
                raise QueryError(NAMESPACE_EXISTS, "target namespace exists")
            self[b][y].drop()
        self.fs.mkdirs(self._path(self[b].path))
        self.fs.rename(self._path(self[a][x].path), self._path(self[b][y].path))


class Database:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.name, self.path = engine, name, f"{engine.root}/{name}"

    def __getitem__(self, name: str) -> Collection:
        if not name or "$" in name or len(f"{self.name}.{name}") > 128:
            raise QueryError(73, f"Invalid collection name: {name}")
        return Collection(self, name)

    def collections(self) -> list[str]:
        return [n for n in self.engine.names(self.path) if not n.startswith("_")]

    def frame(self, name: str) -> DataFrame | None:
        """What other collections are for a lookup."""
        return self[name].frame()

    def create(self, name: str) -> Collection:
        self.engine.writable()
        if self[name].meta() is not None:
            raise QueryError(NAMESPACE_EXISTS, f"a collection '{self.name}.{name}' already exists")
        self[name]._save_meta(EMPTY)
        return self[name]

    def drop(self) -> None:
        self.engine.writable()
        if self.collections():
            self.engine.log_change("dropDatabase", f"{self.name}.$cmd")
        self.engine.delete(self.path)

    def rename(self, old: str, new: str, drop_target: bool = False) -> None:
        self.engine.rename(f"{self.name}.{old}", f"{self.name}.{new}", drop_target)

    def namespaces(self) -> DataFrame:
        """``system.namespaces``: a row for each collection."""
        return self.engine.spark.createDataFrame([(f"{self.name}.{n}",) for n in self.collections()], "name string")

    def system_indexes(self) -> DataFrame:
        """``system.indexes``: a row for each key of each collection."""
        rows = [(k, f"{self.name}.{n}", i["key"], bool(i.get("sparse"))) for n in self.collections() for k, i in self[n].indexes().items()]
        return self.engine.spark.createDataFrame(rows, "name string, ns string, key array<string>, sparse boolean")

    def stats(self) -> dict:
        each = [self[n].stats() for n in self.collections()]
        return {"db": self.name, "collections": len(each), "objects": sum(s["count"] for s in each), "dataSize": sum(s["size"] for s in each), "indexes": sum(s["nindexes"] for s in each), "ok": 1}


#: A new collection's manifest. ``gone`` lists what hides documents of earlier segments: folders and segment numbers.
EMPTY: dict = {"segments": [], "gone": [], "next": 0, "seg": 0, "unique": {}, "old": []}


class Collection:
    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name
        self.engine, self.spark = database.engine, database.engine.spark
        self.path, self.ns = f"{database.path}/{name}", f"{database.name}.{name}"

    # --- storage ---

    def meta(self) -> dict | None:
        """The newest manifest, with its number."""
        numbers = self.engine.numbers(f"{self.path}/_meta")
        return self.engine.read_json(f"{self.path}/_meta/{numbers[-1]:012d}.json") | {"number": numbers[-1]} if numbers else None

    def _save_meta(self, meta: dict) -> None:
        """The next manifest; refused if another writer was faster."""
        kept = {k: v for k, v in meta.items() if k != "number"}
        if not self.engine.create_next(f"{self.path}/_meta", meta.get("number", 0), kept):
            raise QueryError(WRITE_CONFLICT, f"another write to {self.ns} came first; try again")

    def _current(self) -> dict:
        """The manifest to write after; a missing collection is made."""
        return self.meta() or self.database.create(self.name).meta()

    def frame(self, meta: dict | None = None) -> DataFrame | None:
        """The documents with their natural order, or None where there is no collection."""
        meta = meta or self.meta()
        if meta is None:
            return None
        alike: dict[str, list[str]] = {}
        for segment in meta["segments"]:
            alike.setdefault(segment["schema"], []).append(f"{self.path}/{segment['path']}")
        if not alike:
            return self._nothing()
        out = None
        for schema, paths in alike.items():
            df = utc_times(self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*paths))
            out = df if out is None else union(out, df)
        if meta["gone"]:
            gone = None
            for g in meta["gone"]:
                hidden = self.spark.read.schema(T.StructType([T.StructField(P.ORDINAL, T.LongType())])).parquet(f"{self.path}/{g['path']}").select(F.col(P.ORDINAL).alias("__gone"), F.lit(g["seg"]).alias("__until"))
                gone = hidden if gone is None else gone.union(hidden)
            out = out.join(gone, (F.col(P.ORDINAL) == F.col("__gone")) & (F.col(SEGMENT) < F.col("__until")), "left_anti")
        return out.drop(SEGMENT, "__known")

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([T.StructField("_id", T.StringType())]))

    def documents(self) -> DataFrame:
        df = self.frame()
        return self._nothing() if df is None else df

    def _write(self, df: DataFrame, meta: dict) -> tuple[dict, DataFrame]:
        """A segment that no manifest names yet, and what was written."""
        self.engine.writable()
        name, number = f"s-{uuid.uuid4().hex[:12]}", meta["seg"] + 1
        typed = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields], F.lit(number).cast("long").alias(SEGMENT))
        typed.write.parquet(f"{self.path}/{name}")
        written = self.spark.read.parquet(f"{self.path}/{name}")
        return {"path": name, "seg": number, "schema": written.schema.json()}, written.drop(SEGMENT)

    def _commit(self, meta: dict, segment: dict | None, written: DataFrame | None, hides: dict | None = None, replace: bool = False, unique: bool = True) -> None:
        """Checks unique keys and names the new parts in the next manifest; a refused segment is deleted."""
        number = (segment or hides)["seg"]
        after = meta | {"seg": number, "segments": [*([] if replace else meta["segments"]), *([segment] if segment else [])], "gone": [*([] if replace else meta["gone"]), *([hides] if hides else [])]}
        try:
            if written is not None:
                if unique:
                    others = self.frame(meta | {"gone": after["gone"]}) if meta["segments"] and not replace else None
                    for name, index in ({"_id_": {"key": ["_id"], "sparse": False}} | meta["unique"]).items():
                        self._check_unique(written, name, index, others)
                last = written.agg(F.max(P.ORDINAL)).first()[0]
                after["next"] = max(meta["next"], (-1 if last is None else last) + 1)
            if replace:
                after["old"] = [x["path"] for x in (*meta["segments"], *meta["gone"])]
            self._save_meta(after)
        except QueryError:
            if segment:
                self.engine.delete(f"{self.path}/{segment['path']}")
            raise
        if replace:  # readers of the version before may still be at work on it; those before it are done
            for path in meta["old"]:
                self.engine.delete(f"{self.path}/{path}")
        elif len(after["segments"]) + len(after["gone"]) > COMPACT:
            self._replace(self.frame(), unique=False)

    def _replace(self, df: DataFrame, unique: bool = True) -> None:
        """The collection as one new segment."""
        meta = self._current()
        segment, written = self._write(df, meta)
        self._commit(meta, segment, written, replace=True, unique=unique)

    def _keys(self, df: DataFrame, index: dict) -> tuple[DataFrame, list[str]]:
        """The rows' values of an index's keys, arrays taken apart."""
        fields = fields_of(df)
        keys = [top(fields, k) for k in index["key"]]
        if sum(k.kind == V.ARRAY for k in keys) > 1:
            raise QueryError(171, "cannot index parallel arrays")
        names = [f"k{n}" for n in range(len(keys))]
        cols = []
        for name, k in zip(names, keys, strict=True):
            col = F.explode_outer(F.array_distinct(k.col)) if k.kind == V.ARRAY else k.col
            cols.append((col if k.kind != V.NULL else F.lit(None).cast("string")).alias(name))
        rows = df.select(*cols, *[c for c in (P.ORDINAL,) if c in df.columns])
        return (rows.filter(V.any_of([F.col(n).isNotNull() for n in names])) if index.get("sparse") else rows), names

    def _taken(self, rows: DataFrame, names: list[str], others: DataFrame, index: dict) -> DataFrame:
        """Those of the rows whose keys other documents have: a semi join, so only keys of the others are read."""
        theirs, _ = self._keys(others, index)
        pairs = []
        for n in names:
            t = V.common_type([rows.schema[n].dataType, theirs.schema[n].dataType])
            if t is None:
                return rows.limit(0)  # no value of one type equals one of the other
            pairs.append((F.col(n).cast(t), F.col(f"__{n}").cast(t)))
        theirs = theirs.select(*[F.col(n).alias(f"__{n}") for n in names])
        return rows.join(theirs, V.all_of([a.eqNullSafe(b) for a, b in pairs]), "left_semi")

    def _check_unique(self, df: DataFrame, name: str, index: dict, others: DataFrame | None = None) -> None:
        rows, names = self._keys(df, index)
        twice = rows.groupBy(*names).count().filter("count > 1").limit(1).collect()
        twice = twice or (self._taken(rows, names, others, index).limit(1).collect() if others is not None else [])
        if twice:
            raise QueryError(DUPLICATE_KEY, f"E11000 duplicate key error collection: {self.ns} index: {name} dup key: {[twice[0][k] for k in names]}")

    def _log(self, op: str, changed: DataFrame, spec: dict | None = None) -> None:
        self.engine.log_change(op, self.ns, changed, delta_of(spec) if spec else None)

    # --- reading ---

    def find(self, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        df = self.documents()
        return find(df, filter, projection, sort, skip, limit)

    def aggregate(self, pipeline: list[dict]) -> DataFrame:
        """The pipeline's documents; after ``$out`` or ``$merge`` there are none."""
        last = next(iter(pipeline[-1])) if pipeline else None
        if last in ("$out", "$merge"):
            out = P.run_pipeline(self.documents(), pipeline[:-1], self.database.frame)
            (out_to if last == "$out" else merge_into)(self, out, pipeline[-1][last])
            return self.spark.createDataFrame([], T.StructType([T.StructField("_id", T.StringType())]))
        if pipeline and "$indexStats" in pipeline[0]:
            return P.run_pipeline(self.index_stats(), pipeline[1:], self.database.frame)
        return P.run_pipeline(self.documents(), pipeline, self.database.frame)

    def count(self, filter: dict | None = None, skip: int = 0, limit: int = 0) -> int:
        return self.find(filter, skip=skip, limit=limit).count()

    def distinct(self, path: str, filter: dict | None = None) -> DataFrame:
        return distinct(self.documents(), path, filter)

    # --- writing ---

    def _numbered(self, documents: list[dict] | DataFrame, meta: dict) -> DataFrame:
        """New documents with ids and their places in the natural order."""
        if isinstance(documents, DataFrame):
            new = documents if "_id" in documents.columns else documents.withColumn("_id", F.expr("substring(md5(uuid()), 1, 24)"))
            return new.withColumn(P.ORDINAL, F.monotonically_increasing_id() + meta["next"])
        if any(isinstance(d.get("_id"), list) for d in documents):
            raise QueryError(BAD_VALUE, "can't use an array for _id")
        rows, t = to_rows([{"_id": d.get("_id", object_id())} | d | {P.ORDINAL: meta["next"] + k} for k, d in enumerate(documents)])
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(f.name, T.LongType() if f.name == P.ORDINAL else f.dataType) for f in t.fields]))

    def insert(self, documents: list[dict] | DataFrame) -> int:
        """Appends one segment; only keys of what is there are read, to check that the new ones are unique."""
        self.engine.writable()
        meta = self._current()
        if not isinstance(documents, DataFrame) and not documents:
            return 0
        new = self._numbered(documents, meta)
        if meta["segments"]:
            union(self.frame(meta).limit(0), new.limit(0))  # raises where types clash
        segment, written = self._write(new, meta)
        self._commit(meta, segment, written)
        self._log("insert", written)
        return len(documents) if isinstance(documents, list) else written.count()

    def insert_some(self, documents: list[dict], ordered: bool = True) -> tuple[int, list[dict]]:
        """Inserts what can be inserted, as one version, and tells what can't: ``(n, [{index, code, errmsg}])``.

        Ordered, what follows the first failure is left out. One query tells which of the batch's keys are taken; the
        batch itself (a client's, so of bounded size) is walked here.
        """
        try:
            return self.insert(documents), []
        except QueryError as e:
            if e.code != DUPLICATE_KEY:
                if len(documents) == 1:
                    return 0, [{"index": 0, "code": e.code, "errmsg": e.message}]
                return self._insert_each(documents, ordered)
        meta = self._current()
        new, errors = self._numbered(documents, meta), {}
        claims: list[tuple[int, str, tuple]] = []
        for name, index in ({"_id_": {"key": ["_id"], "sparse": False}} | meta["unique"]).items():
            rows, names = self._keys(new, index)
            claims += [(r[P.ORDINAL] - meta["next"], name, tuple(r[n] for n in names)) for r in rows.collect()]
            for r in self._taken(rows, names, self.frame(meta), index).collect() if meta["segments"] else ():
                errors.setdefault(r[P.ORDINAL] - meta["next"], (name, [r[n] for n in names]))
        seen: set = set()
        for k in range(len(documents)):
            mine = [(name, key) for at, name, key in claims if at == k]
            again = next(((name, list(key)) for name, key in mine if (name, key) in seen), None)
            if k not in errors and again:
                errors[k] = again
            if k in errors and ordered:
                errors, documents = {k: errors[k]}, documents[:k]
                break
            if k not in errors:
                seen.update(mine)
        n = self.insert([d for k, d in enumerate(documents) if k not in errors])
        return n, [{"index": k, "code": DUPLICATE_KEY, "errmsg": f"E11000 duplicate key error collection: {self.ns} index: {name} dup key: {key}"} for k, (name, key) in sorted(errors.items())]

    def _insert_each(self, documents: list[dict], ordered: bool) -> tuple[int, list[dict]]:
        """One by one, where a batch has documents that can't be typed together."""
        n, errors = 0, []
        for k, d in enumerate(documents):
            try:
                n += self.insert([d])
            except QueryError as e:
                errors.append({"index": k, "code": e.code, "errmsg": e.message})
                if ordered:
                    break
        return n, errors

    def delete(self, filter: dict, limit: int = 0) -> int:
        """Appends the numbers of the documents that go."""
        self.engine.writable()
        meta = self.meta()
        df = self.frame(meta) if meta else None
        if df is None or P.ORDINAL not in df.columns:
            return 0
        gone = df.filter(compile_filter(filter, Scope(fields_of(df))))
        if limit:
            gone = gone.orderBy(P.ORDINAL).limit(limit)
        name = f"d-{uuid.uuid4().hex[:12]}"
        gone.write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(gone.schema).parquet(f"{self.path}/{name}")
        n = written.count()
        if not n:
            self.engine.delete(f"{self.path}/{name}")
            return 0
        self._commit(meta, None, None, {"path": name, "seg": meta["seg"] + 1})
        self._log("delete", written)
        return n

    def update(self, filter: dict, update: dict, multi: bool = False, upsert: bool = False, array_filters: list[dict] | None = None) -> dict:
        """``{"n", "nModified", "upserted"}``."""
        self.engine.writable()
        change = Update(update, filter, array_filters)
        if multi and change.replaces:
            raise QueryError(10158, "multi update only works with $ operators")
        meta = self.meta()
        df = self.frame(meta) if meta else None
        if df is not None and P.ORDINAL in df.columns:
            match = compile_filter(filter, Scope(fields_of(df)))
            hit = df.filter(match).select(P.ORDINAL)
            if not multi:
                one = hit.orderBy(P.ORDINAL).limit(1).collect()
                match, n = (F.col(P.ORDINAL) == one[0][0] if one else F.lit(False)), len(one)
            else:
                n = hit.count()
            if n:
                return {"n": n, "nModified": self._change(df, meta, match, change, update), "upserted": None}
        if not upsert:
            return {"n": 0, "nModified": 0, "upserted": None}
        return {"n": 1, "nModified": 0, "upserted": self._upserted(filter, change, update)}

    def _change(self, df: DataFrame, meta: dict, match, change: Update, spec: dict) -> int:
        """Appends the documents that the update makes others; each is compared with itself in the same row."""
        fields = fields_of(df)
        if change.replaces and "_id" in change.spec and df.filter(match & ~V.equal(fields["_id"], V.literal(change.spec["_id"]))).limit(1).count():
            raise QueryError(IMMUTABLE_FIELD, "the (immutable) field '_id' was found to have been altered")
        new = changed_fields(fields, change, F.lit(True))
        now = F.to_json(F.struct(*[v.col.alias(k) for k, v in new.items()]))
        out = df.filter(match).filter(~now.eqNullSafe(F.to_json(P.row(df)))).select(*[v.col.alias(k) for k, v in new.items()], P.ORDINAL)
        union(df.limit(0), out.limit(0))  # raises where types clash
        segment, written = self._write(out, meta)
        modified = written.count()
        if not modified:
            self.engine.delete(f"{self.path}/{segment['path']}")
            return 0
        self._commit(meta, segment, written, {"path": segment["path"], "seg": segment["seg"]})
        self._log("update", written, spec)
        return modified

    def _upserted(self, filter: dict, change: Update, spec: dict):
        base = seed(filter)
        start: dict = {}
        for k, v in base.items():
            at = start
            *parents, last = k.split(".")
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = v
        start = {"_id": start.get("_id", spec.get("_id", object_id()))} | start
        rows, t = to_rows([start])
        one = self.spark.createDataFrame(rows, t)
        fields = Update.apply(change, fields_of(one), True)
        doc = one.select(*[v.col.alias(k) for k, v in fields.items()])
        self.insert(doc)
        return start["_id"]

    def find_and_modify(self, query: dict, update: dict | None = None, remove: bool = False, sort: dict | None = None, new: bool = False, upsert: bool = False, fields: dict | None = None, array_filters: list[dict] | None = None) -> dict | None:
        found = self.find(query, None, sort, 0, 1)
        row = found.limit(1).collect()
        shown = lambda key: [r.asDict(True) for r in self.find({"_id": key}, fields).collect()]
        if not row:
            if upsert and update:
                made = self.update(query, update, upsert=True, array_filters=array_filters)["upserted"]
                return shown(made)[0] if new else None
            return None
        key = row[0]["_id"]
        before = shown(key)[0]
        if remove:
            self.delete({"_id": key}, 1)
            return before
        self.update(query | {"_id": key}, update or {}, array_filters=array_filters)
        return shown(key)[0] if new else before

    def drop(self) -> bool:
        self.engine.writable()
        had = self.meta() is not None
        if had:
            self.engine.log_change("drop", f"{self.database.name}.$cmd", doc={"drop": self.name})
        self.engine.delete(self.path)
        return had

    # --- keys and figures ---

    def indexes(self) -> dict[str, dict]:
        meta = self.meta()
        return {} if meta is None else {"_id_": {"key": ["_id"], "sparse": False}} | meta["unique"]

    def index_stats(self) -> DataFrame:
        """``$indexStats``: name, key, host, spec and accesses of each index; uses aren't counted, as scans prune by statistics."""
        rows = []
        for name, i in self.indexes().items():
            key = dict(zip(i["key"], i.get("directions", [1] * len(i["key"])), strict=True))
            rows.append((name, key, socket.gethostname(), (key, name, 2), (0, datetime.datetime.now(datetime.timezone.utc))))
        kind = "name string, key map<string,int>, host string, spec struct<key:map<string,int>,name:string,v:int>, accesses struct<ops:long,since:timestamp>"
        return self.spark.createDataFrame(rows, kind)

    def create_index(self, keys: dict | str, unique: bool = False, sparse: bool = False, name: str | None = None) -> str:
        """A unique key is checked at every write; any other index needs nothing, as scans prune by statistics."""
        self.engine.writable()
        keys = {keys: 1} if isinstance(keys, str) else keys
        name = name or "_".join(f"{k}_{v}" for k, v in keys.items())
        meta = self._current()
        if unique:
            index = {"key": list(keys), "directions": [-1 if v == -1 else 1 for v in keys.values()], "sparse": sparse}
            if meta["segments"]:
                self._check_unique(self.frame(meta), name, index)
            self._save_meta(meta | {"unique": meta["unique"] | {name: index}})
        return name

    def drop_index(self, name: str) -> None:
        self.engine.writable()
        meta = self.meta()
        if meta is None or name != "*" and name not in meta["unique"]:
            raise QueryError(27, f"index not found with name [{name}]")
        self._save_meta(meta | {"unique": {} if name == "*" else {k: v for k, v in meta["unique"].items() if k != name}})

    def stats(self) -> dict:
        meta = self.meta()
        size = 0
        for segment in meta["segments"] if meta else ():
            size += self.engine.fs.getContentSummary(self.engine._path(f"{self.path}/{segment['path']}")).getLength()
        n = self.documents().count()
        return {"ns": self.ns, "count": n, "size": size, "avgObjSize": size / n if n else 0, "nindexes": len(self.indexes()), "ok": 1}

    def validate(self) -> dict:
        if self.meta() is None:
            raise QueryError(NAMESPACE_NOT_FOUND, f"Collection '{self.ns}' does not exist to validate.")
        return {"ns": self.ns, "nrecords": self.documents().count(), "nIndexes": len(self.indexes()), "valid": True, "ok": 1}


def find(df: DataFrame, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
    """Filter, sort, skip, limit, projection of any DataFrame."""
    c = P.start(utc_times(df))
    if filter:
        c = P.STAGES["$match"](c, filter)
    if sort and next(iter(sort)) == "$natural":
        if sort["$natural"] not in (1, -1):
            raise QueryError(BAD_VALUE, "$natural takes 1 or -1")
        if c.order:
            c = replace(c, order=[(P.ORDINAL, sort["$natural"] == 1)], sorted=True)
    elif sort:
        c = P.STAGES["$sort"](c, sort)
    if limit > 0:
        c = P.page(c, skip, limit)
    elif skip:
        c = P.STAGES["$skip"](c, skip)
    out = c.ordered() if c.sorted else c.df
    if projection:
        fields = find_projection(projection, Scope(fields_of(out)))
        return out.select(*[v.col.alias(k) for k, v in fields.items()])
    return out.select(*[F.col(f"`{x}`") for x in visible(out)])


def distinct(df: DataFrame, path: str, filter: dict | None = None) -> DataFrame:
    """The distinct values at a path, arrays taken apart, in ascending order."""
    df = utc_times(df)
    scope = Scope(fields_of(df))
    if filter:
        df = df.filter(row_filter(filter, scope))
    value = top(scope.fields, path)
    if value.missing:
        return df.select(F.lit(None).cast("string").alias("value")).limit(0)
    col = F.explode(value.col) if value.kind == V.ARRAY else value.col
    return df.select(col.alias("value")).distinct().orderBy("value")


def out_to(source: Collection, df: DataFrame, spec) -> None:
    """``$out``: the documents replace the collection."""
    if not isinstance(spec, str):
        raise QueryError(16990, "$out only supports a string argument")
    target = source.database[spec]
    new = df if "_id" in df.columns else df.withColumn("_id", F.expr("substring(md5(uuid()), 1, 24)"))
    target._replace(new.withColumn(P.ORDINAL, F.monotonically_increasing_id()))


def merge_into(source: Collection, df: DataFrame, spec) -> None:
    """``$merge``: one join on the keys makes the new versions of matched documents and new ones; others aren't touched."""
    spec = {"into": spec} if isinstance(spec, str) else spec
    into, on = spec.get("into"), spec.get("on", ["_id"])
    on = [on] if isinstance(on, str) else on
    matched, not_matched = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
    database = source.database if isinstance(into, str) else source.engine[into.get("db", source.database.name)]
    target = database[into if isinstance(into, str) else into["coll"]]
    if on != ["_id"] and not any(set(i["key"]) == set(on) for i in target.indexes().values()):
        raise QueryError(51183, "Cannot find index to verify that join fields will be unique")
    if matched not in ("replace", "keepExisting", "merge", "fail") and not isinstance(matched, list):
        raise QueryError(BAD_VALUE, f"Enumeration value '{matched}' for field '$merge.whenMatched' is not a valid value.")
    if not_matched not in ("insert", "discard", "fail"):
        raise QueryError(BAD_VALUE, f"Enumeration value '{not_matched}' for field '$merge.whenNotMatched' is not a valid value.")
    meta = target._current()
    merged, _ = merged_frames(df, target.documents(), on, matched, not_matched, spec.get("let"), how="right_outer")
    known = F.col(P.ORDINAL).isNotNull()
    if matched == "keepExisting":
        merged = merged.filter(~known)
    numbered = merged.withColumn("__known", known).withColumn(P.ORDINAL, F.coalesce(P.ORDINAL, F.monotonically_increasing_id() + meta["next"]))
    segment, written = target._write(numbered, meta)
    target._commit(meta, segment, written.drop("__known"), {"path": segment["path"], "seg": segment["seg"]})
    for op, rows in (("update", written.filter("__known")), ("insert", written.filter("not __known"))):
        if rows.limit(1).count():
            target._log(op, rows.drop("__known"))


def merged_frames(df: DataFrame, old: DataFrame, on: list[str], matched="merge", not_matched: str = "insert", let: dict | None = None, how: str = "full_outer") -> tuple[DataFrame, list[str]]:
    """What ``$merge`` makes of old documents and new ones; a right outer join leaves out the old ones that nothing matches."""
    if P.ORDINAL not in old.columns:
        old = old.withColumn(P.ORDINAL, F.lit(None).cast("long"))
    t = unify([T.StructType([f for f in old.schema.fields if f.name != P.ORDINAL]), df.schema])
    olds = align(old, T.StructType([*t.fields, T.StructField(P.ORDINAL, T.LongType())]))
    new = align(df, t)
    names = t.fieldNames()
    o = olds.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__old"), F.col(P.ORDINAL))
    w = new.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__new"))
    same = V.all_of([F.col(f"__old.`{k}`").eqNullSafe(F.col(f"__new.`{k}`")) for k in on])
    both = o.withColumn("__had", F.lit(True)).join(w.withColumn("__got", F.lit(True)), same, how)
    had, got = F.col("__had").isNotNull(), F.col("__got").isNotNull()
    fail = lambda m: F.raise_error(F.lit(f"[{DUPLICATE_KEY if 'matched' in m else 13113}] {m}"))
    if isinstance(matched, list):
        from quillspark.operators.projection import add_fields, exclude, project, tree_of

        oldv, newv = Value(F.col("__old"), t), Value(F.col("__new"), t)
        fields = {n: Value(F.col("__old").getField(n), t[n].dataType) for n in names}
        given = {k: v for k, v in (let or {}).items()}
        inner = {n: Value(F.col("__new").getField(n), t[n].dataType) for n in names}
        from quillspark.functions.expressions import compile_expression

        variables = {"new": newv} | {k: compile_expression(v, Scope(inner)) for k, v in given.items()}
        for step in matched:
            (name, argument), = step.items()
            s = Scope(fields, variables)
            if name not in ("$addFields", "$project", "$unset", "$replaceRoot"):
                raise QueryError(40324, f"{name} is not allowed within a $merge pipeline")
            if name == "$addFields":
                fields = add_fields(argument, s)
            elif name == "$project":
                fields = project(argument, s)
            elif name == "$unset":
                fields = exclude(fields, tree_of([argument] if isinstance(argument, str) else argument))
            else:
                root = compile_expression(argument["newRoot"], s)
                fields = {n: Value(root.col.getField(n), root.type[n].dataType) for n in root.type.fieldNames()}
        names_out = [*names, *[n for n in fields if n not in names]]
        values = {n: fields.get(n, V.missing()) for n in names_out}
        kinds = {n: (t[n].dataType if n in names else values[n].type) for n in names_out}
        kinds = {n: unify([kinds[n], values[n].type]) for n in names_out}
        pick = lambda n, side: conformed(Value(F.col(side).getField(n), t[n].dataType), kinds[n]).col if n in names else F.lit(None).cast(kinds[n])
        cols = [F.when(had & got, conformed(values[n], kinds[n]).col).when(had, pick(n, "__old")).otherwise(pick(n, "__new")).alias(n) for n in names_out]
    else:
        own = {f.name for f in df.schema.fields}

        def merged(n):
            x, y = F.col("__old").getField(n), F.col("__new").getField(n)
            if matched == "fail":
                both_ = fail("a document matched in $merge with whenMatched: fail").cast(t[n].dataType)
            elif matched == "keepExisting":
                both_ = x
            elif matched == "replace":
                both_ = F.coalesce(y, x) if n == "_id" else y
            else:
                both_ = F.coalesce(y, x) if n in own else x
            return F.when(had & got, both_).when(had, x).otherwise(y).alias(n)

        cols = [merged(n) for n in names]
    if not_matched == "fail":
        both = both.withColumn("__had", F.when(~had, fail("$merge could not find a document to update").cast("boolean")).otherwise(F.col("__had")))
    elif not_matched == "discard":
        both = both.filter("__had is not null")
    return both.select(*cols, P.ORDINAL), on

