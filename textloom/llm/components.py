"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node that can be reached.

    Each round every node takes the smallest label among itself and its neighbours, then its label's label; labels
    reach across a component in a number of rounds near the logarithm of its width. Nodes, edges and labels stay in Spark."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = settle(both, "edges")
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = settle(step.join(up, "component", "left").select("node", F.coalesce(F.least("component", "up"), "component").alias("component"), "before"), "labels")
        moved = step.where("component <> before").limit(1).count()
        discard(labels)
        labels = step.select("node", "component")
        if not moved:
            discard(both)
            return labels
