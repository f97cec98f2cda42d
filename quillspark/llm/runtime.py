"""What the operators share: scratch tables in the shared folder, code shipping, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.storage import shared_folder

#: A side of at most this many rows of a few longs is broadcast (tens of MB at most); beyond it, joins shuffle.
BROADCAST_ROWS = 500_000


def prepare(spark: SparkSession) -> None:
    """Ship this package to Python workers (once for each context) and bound Arrow batches."""
    context = spark.sparkContext
    if not getattr(context, "_quillspark_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("quillspark", os.path.relpath(path, root)))
        context.addPyFile(archive)
        context._quillspark_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def give_back() -> None:
    """Hands what this process has freed back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def trimmed(run):
    """``run`` for mapInArrow, by a worker that gives back what it freed: workers idle beside later steps, and all count as the executor's."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def driver_gives_back(spark: SparkSession) -> None:
    """``give_back`` for the driver, whose JVM has compilers, codecs and a heap that grow with the number of jobs.

    Garbage is collected, and the heap shrinks, where it holds more than half of what it may. Native memory is given back by
    a command of HotSpot (Linux, JDK 17.0.9 or later); elsewhere it stays.
    """
    give_back()
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 2:
        jvm.java.lang.System.gc()
    arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # the last two are null: the command takes none
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    with contextlib.suppress(Py4JJavaError):  # there is no such command
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)


@contextlib.contextmanager
def measured_broadcasts(spark: SparkSession):
    """Inside, a side without a hint is broadcast only for a size that a shuffle has measured.

    Spark's estimates start from the bytes of compressed files and don't know how long arrays are, so a side that explodes
    some can be hundreds of times larger than its estimate; all of it would go through the driver.
    """
    fixed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {fixed: spark.conf.get(fixed), measured: spark.conf.get(measured, None)}
    try:
        spark.conf.set(measured, before[measured] or before[fixed])
        spark.conf.set(fixed, "-1")
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    A table goes with ``drop`` or when the driver's JVM ends. With each, the driver gives back what it no longer needs.
    ``measured``: as its tables are made, sides are broadcast as in ``measured_broadcasts``.
    """

    def __init__(self, spark: SparkSession, measured: bool = False):
        self.spark, self.measured = spark, measured
        self.root = f"{shared_folder(spark)}/quillspark-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with measured_broadcasts(self.spark) if self.measured else contextlib.nullcontext():
            df.write.option("compression", "zstd").parquet(path)
        driver_gives_back(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for status in self._fs.listStatus(self._path(self.root)):
            if any(status.getPath().getName().startswith(f"{n}-") for n in names):
                self._fs.delete(status.getPath(), True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is (joins then shuffle).

    ``df`` should be a saved table of narrow rows: counting it reads footers only.
    """
    return F.broadcast(df) if df.count() <= limit else df


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra columns never clash with working names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def drawn(rows: DataFrame, total: int, sample: int, salt: str) -> DataFrame:
    """About ``sample`` of ``rows(doc_id, text, ...)`` (all, if there are no more; twice as many at most), with the hash ``place``.

    Rows are drawn by hash of id and text. Only hashes are compared, so no row is sorted or shuffled; the same rows are
    drawn whatever the partitions, and sorting the few by ``place`` gives one order whatever the partitions.
    """
    placed = rows.withColumn("place", F.xxhash64("doc_id", "text", F.lit(salt)))
    if total <= sample:
        return placed
    chosen = placed.filter(F.col("place") < F.lit(-(1 << 63) + (1 << 64) * sample // total))
    return chosen.limit(2 * sample) if chosen.count() > 2 * sample else chosen  # only where one row is repeated very often
