"""Connected components by contraction, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of the edges.

    Each round hooks every component to the smallest one beside it, follows those hooks to their roots by
    pointer jumping, and contracts. All tables are written to the shared folder, none reaches the driver."""
    larger, smaller = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    left = materialize(edges.select(larger, smaller).where("a > b").distinct(), "edges")
    label = materialize(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while not left.isEmpty():
        parent = materialize(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "parents")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("__up"))
            jumped = materialize(parent.join(up, "parent", "left").select("node", F.coalesce("__up", "parent").alias("parent"), F.col("__up").isNotNull().alias("moved")), "parents")
            moved = not jumped.where("moved").isEmpty()
            discard(parent)
            parent = jumped
            if not moved:
                break
        root = parent.select("node", "parent")
        new = label.join(root.select(F.col("node").alias("component"), F.col("parent").alias("__root")), "component", "left")
        new = materialize(new.select("node", F.coalesce("__root", "component").alias("component")), "labels")
        ends = left.join(root.select(F.col("node").alias("a"), F.col("parent").alias("__a")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("parent").alias("__b")), "b", "left")
        ends = ends.select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b")).where("a <> b")
        rest = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        discard(left, label, parent)
        left, label = rest, new
    return label
