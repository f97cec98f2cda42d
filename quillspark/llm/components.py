"""Connected components of a graph of links, by minimum labels and pointer jumping; all in shuffled joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.runtime import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` -> ``(node, label)``: each node that has a link, with the smallest node it can reach.

    Repeated links, both directions and loops are fine; no links give no rows. Each round takes the smallest label
    among the neighbours (a sum-like aggregate, combined before its shuffle) and then the label of the label, so the
    number of rounds grows with the logarithm of the longest path. Only a count reaches the driver.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "cc_edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "cc_labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        spread = scratch.save(
            labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")), "cc_spread"
        )
        roots = spread.select(F.col("node").alias("label"), F.col("label").alias("root"))
        stepped = scratch.save(
            spread.join(roots, "label", "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")), "cc_step"
        )
        changed = stepped.filter("label <> old").limit(1).count()
        scratch.drop("cc_spread")
        labels = stepped.select("node", "label")
        if not changed:
            return labels
