"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.llm.scratch import keep


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge; the root is the component's least node.

    Each round gives a node the least label among its neighbours and then that label's own
    label, so long chains halve. A hub is reduced by partial minima before the shuffle, and
    the join on a hub is one that Spark splits. Nulls have no edges; loops and repeated
    edges change nothing. No step sees more than one edge or one node at a time.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = keep(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(
            F.col("u").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select(
            "node", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        hop = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        moved = keep(lower.join(hop, "low").select(
            "node", F.least("low", "next").alias("root"), (F.least("low", "next") != F.col("was")).alias("moved")))
        labels = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return labels
