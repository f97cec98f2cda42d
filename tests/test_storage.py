"""Databases inside one process, where executors are processes of their own."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from quillspark.sources import storage
from quillspark.sources.storage import embedded, read, write

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"

CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
print(sorted(map(tuple, __spark_entry__.queries()["source_jdbc"](spark, "/root/testdata/sf0.001").collect())))
"""


def test_jdbc_query_with_executors_of_their_own(tmp_path):
    import duckdb

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "_PYSPARK"))} | {"PYTHONPATH": root, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    import pyspark

    home = tmp_path / "home"  # the executors' folders go there
    (home / "work").mkdir(parents=True)
    for x in os.listdir(pyspark.__path__[0]):
        if x != "work":
            (home / x).symlink_to(f"{pyspark.__path__[0]}/{x}")
    out = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], cwd=tmp_path, env=env | {"SPARK_HOME": str(home)}, capture_output=True, text=True, timeout=240)
    want = duckdb.sql("SELECT n_nationkey, n_name FROM '/root/testdata/sf0.001/nation.parquet' WHERE n_regionkey >= 2 ORDER BY 1").fetchall()
    assert out.stdout.strip().splitlines()[-1:] == [str(want)], out.stderr[-2000:]


def test_embedded_database_in_parts(spark, monkeypatch):
    monkeypatch.setattr(storage, "EMBEDDED_ROWS", 300)
    where = {"url": "jdbc:derby:memory:parts;create=true", "dbtable": "t", "driver": DERBY, "batchsize": "70"}
    df = spark.range(0, 1000, 1, 3).select(
        F.col("id").cast("int").alias("k"), F.shiftleft("id", 40).alias("big"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("s"), (F.col("id") / 7).alias("d"),
        F.when(F.col("id") % 5 > 0, F.timestamp_seconds(F.col("id") * 86_399)).alias("at"), (F.col("id") / 100).cast("decimal(10,2)").alias("m"), (F.col("id") % 2 > 0).alias("b"),
    )
    write(df, "", "jdbc", **where)
    back = read(spark, "", "jdbc", **where)
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(back.toDF(*df.columns)) == rows(df) and len(back.inputFiles()) >= 4
    write(df.limit(5), "", "jdbc", mode="append", **where)
    write(df, "", "jdbc", mode="ignore", **where)
    assert read(spark, "", "jdbc", **where).count() == 1005
    write(df.limit(0), "", "jdbc", mode="overwrite", **where)
    assert read(spark, "", "jdbc", **where).count() == 0


def test_only_databases_of_a_process_are_embedded():
    inside = ("jdbc:derby:memory:x", "jdbc:derby:/a/b", "jdbc:h2:mem:x", "jdbc:h2:~/x", "jdbc:hsqldb:file:x", "jdbc:sqlite:x.db")
    servers = ("jdbc:derby://h:1527/x", "jdbc:h2:tcp://h/x", "jdbc:h2:ssl://h/x", "jdbc:hsqldb:hsql://h/x", "jdbc:postgresql://h/x", "jdbc:mysql://h/x")
    assert all(embedded("jdbc", {"url": x}) for x in inside) and not any(embedded("jdbc", {"url": x}) for x in servers) and not embedded("csv", {"url": inside[0]})
