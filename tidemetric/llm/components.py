"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemetric.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    A round takes the smallest label among a node's neighbours and then that label's own
    label, so labels travel twice as far each round. Every round is checkpointed; labels
    stay in Spark and the loop sees one number a round. No edges give no rows.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        moved = cut(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "root"))
        changed = moved.filter("new < root").limit(1).count()
        labels = moved.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
