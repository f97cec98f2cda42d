"""Looking ahead in a global order without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.runtime import Scratch


def with_next(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``next``, the struct of ``order`` of the row after it (null for the last row); order columns are unique.

    Rows are sorted over range partitions, each of which looks ahead for itself; a partition's last row takes the first
    row of the next partition. Only one row for each partition meets in one task, and that table is broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    ranged = scratch.save(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    firsts = scratch.save(ranged.groupBy("part").agg(F.min(key).alias("first")), "firsts")
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))  # a row for each partition
    ahead: Column = F.lead(key).over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("next", ahead).join(F.broadcast(after), "part", "left").withColumn("next", F.coalesce("next", "after")).drop("part", "after")
