"""Connected components by smallest labels with pointer jumping; nothing of the graph leaves the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.durable import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``edges`` (``a``, ``b``; either order, repeats allowed).

    Each round a node takes the smallest label around it and then its label's label, so the rounds grow with the
    logarithm of a path's length; each round's labels are written, which cuts the lineage.
    """
    both = materialise(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        around = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "node")
        )
        taken = labels.join(around, "node").select("node", F.least("component", "near").alias("near"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("near"), F.col("component").alias("next"))
        step = materialise(taken.join(up, "near", "left").select("node", F.least("near", "next").alias("component"), "was"))
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels
