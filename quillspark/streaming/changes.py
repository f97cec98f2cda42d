"""Change streams over the engine's log of changes: tailable cursors, batches and Structured Streaming."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillspark.errors import QueryError
from quillspark.plans.pipeline import run_pipeline
from quillspark.sources.catalog import CHANGES, Collection
from quillspark.sources.storage import shared_folder

#: Stages that need no state, so that they run on a stream.
STATELESS = {"$match", "$project", "$addFields", "$unset", "$replaceRoot", "$redact"}
#: What ends a collection's stream.
TERMINAL = ("drop", "dropDatabase")


def token(ts: int, key: str | None = None) -> str:
    """A resume token: the clock's point in hex, and the changed document's key, which tells changes of one write apart."""
    return f"{ts:016x}" + (key or "").encode().hex()


def position(resume: str | dict) -> tuple[int, str]:
    text = resume["_data"] if isinstance(resume, dict) else resume
    return int(text[:16], 16), bytes.fromhex(text[16:]).decode()


def _token_column() -> Column:
    return F.concat(F.lpad(F.lower(F.hex("ts")), 16, "0"), F.coalesce(F.lower(F.hex(F.col("id").cast("binary"))), F.lit("")))


def log(collection: Collection, stream: bool) -> DataFrame:
    """The collection's own entries, and those of its database."""
    spark, path = collection.spark, f"{collection.engine.root}/_changes"
    collection.engine.fs.mkdirs(collection.engine._path(path))
    reader = spark.readStream if stream else spark.read
    return reader.schema(CHANGES).parquet(path).filter(F.col("ns").isin(collection.ns, f"{collection.database.name}.$cmd"))


def events(collection: Collection, pipeline: list[dict] | None = None, resume_after: str | dict | None = None, start_at: int | None = None, full_document: str = "default", stream: bool = True) -> DataFrame:
    """A collection's changes as a streaming (or, with ``stream=False``, batch) DataFrame; from now on unless told otherwise.

    ``_id`` (the resume token), ``operationType, ns, documentKey, fullDocument, updateDescription, clusterTime, wallTime``;
    documents have the collection's types. A resume token is exclusive, ``start_at`` inclusive. An update's full document is
    what it set and unset; ``full_document="updateLookup"`` joins the current documents instead. A batch is in order of
    time; a stream's files come in order of time.
    """
    for spec in pipeline or []:
        if next(iter(spec)) not in STATELESS:
            raise QueryError(20, f"{next(iter(spec))} is not allowed in a change stream")
    ts, key = position(resume_after) if resume_after is not None else (start_at - 1, None) if start_at is not None else (collection.engine.now(), None)
    after = F.col("ts") > ts
    if key:
        after = after | (F.col("ts") == ts) & (F.col("id") > key)
    rows = log(collection, stream).filter(after)
    current = collection.frame()
    kind = T.StructType([f for f in current.schema.fields if not f.name.startswith("__")]) if current is not None else None
    rows = rows.withColumn("full", F.when(F.col("op") == "update", F.col("delta")).when(F.col("op") == "insert", F.col("doc")))
    if full_document == "updateLookup" and current is not None:
        now = current.select(F.to_json(F.struct("_id")).alias("id"), F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in kind.fields])).alias("now"))
        rows = rows.join(now, "id", "left").withColumn("full", F.when(F.col("op") == "update", F.coalesce("now", "full")).otherwise(F.col("full")))
    typed = lambda c, t: F.from_json(c, t) if t is not None else F.col(c)  # noqa: E731  a dropped collection's documents stay text
    names = F.split("ns", r"\.", 2)
    shaped = rows.select(
        F.struct(_token_column().alias("_data")).alias("_id"), F.col("op").alias("operationType"), F.struct(names[0].alias("db"), F.when(names[1] != "$cmd", names[1]).alias("coll")).alias("ns"),
        typed("id", T.StructType([kind["_id"]]) if kind is not None else None).alias("documentKey"), typed("full", kind).alias("fullDocument"),
        F.when(F.col("op") == "update", F.col("delta")).alias("updateDescription"), F.col("ts").alias("clusterTime"), F.col("wall").alias("wallTime"),
    )
    if not stream:
        shaped = shaped.orderBy("clusterTime", "_id._data")
    return run_pipeline(shaped, pipeline) if pipeline else shaped


def invalidated(collection: Collection, resume_after: str | dict) -> bool:
    """Whether the collection was dropped at or before a resume token: a stream resumed there only says so."""
    gone = F.get_json_object("doc", "$.drop") == collection.name
    return log(collection, False).filter((F.col("ts") <= position(resume_after)[0]) & ((F.col("op") == "dropDatabase") | (F.col("op") == "drop") & gone)).limit(1).count() > 0


class ChangeCursor:
    """A tailable cursor: each ``take`` gives the changes since the one before, in order of time, and it never runs out.

    Resumed after the collection's end, it says ``invalidate`` and nothing else.
    """

    def __init__(self, collection: Collection, pipeline: list[dict] | None = None, resume_after: str | dict | None = None, start_after: str | dict | None = None, start_at: int | None = None, full_document: str = "default"):
        self.collection, self.pipeline, self.full_document = collection, pipeline, full_document
        resume = start_after if start_after is not None else resume_after
        self.invalid = start_after is None and resume_after is not None and invalidated(collection, resume_after)
        if resume is not None:
            self.after: str = resume["_data"] if isinstance(resume, dict) else resume
        else:  # the last point before the first that is wanted, whatever its documents' keys
            self.after = token(start_at - 1 if start_at is not None else collection.engine.now(), "\U0010ffff")
        events(collection, pipeline, resume_after=self.after, full_document=full_document, stream=False)  # errors come now

    def take(self, size: int, wait: float = 0.0) -> list[dict]:
        """At most ``size`` changes; with none, it looks again for ``wait`` seconds."""
        if self.invalid:
            return [{"_id": {"_data": self.after}, "operationType": "invalidate"}]
        until = time.monotonic() + wait
        while True:
            at = self.collection.engine.now()
            if at >= position(self.after)[0]:
                found = [r.asDict(True) for r in events(self.collection, None, self.after, None, self.full_document, False).limit(size).collect()]
                if found:
                    upto, start = found[-1]["_id"]["_data"], self.after
                    self.after = upto
                    return found if not self.pipeline else self._shown(start, size)
            if time.monotonic() >= until:
                return []
            time.sleep(min(0.2, max(0.0, until - time.monotonic())))

    def _shown(self, start: str, size: int) -> list[dict]:
        """The same changes through the pipeline."""
        tokens = events(self.collection, None, start, None, self.full_document, False).limit(size)
        return [r.asDict(True) for r in run_pipeline(tokens, self.pipeline).collect()]


def watch(collection: Collection, pipeline: list[dict] | None = None, start_at: int | None = 1, **options) -> DataFrame:
    """The changes so far, from the log's beginning unless told otherwise, taken through a stream that ends when it has caught up."""
    folder = f"{shared_folder(collection.spark)}/changes-{uuid.uuid4().hex[:10]}"
    if options.get("resume_after") is not None:
        start_at = None
    stream = events(collection, pipeline, start_at=start_at, **options)
    start(stream, folder).awaitTermination()
    return collection.spark.read.schema(stream.schema).parquet(folder)


def start(stream: DataFrame, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream into Parquet files in a shared folder until it has caught up; its checkpoint is where it resumes."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint or f"{folder}/_checkpoint").outputMode("append").trigger(availableNow=True).start()
