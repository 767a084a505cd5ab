"""Connected components by minimum labels with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """a, b -> node, component (smallest node reachable) of every node with an edge.

    Each step takes the smallest label among the neighbours (combined map-side, so a hub costs nothing extra)
    and then the label of that label; the steps needed grow with the logarithm of the longest path. Labels are
    written to the shared folder after each step.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "other").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = materialize(near.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component")), "cc-labels")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
