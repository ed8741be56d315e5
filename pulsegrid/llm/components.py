"""Connected components by minimum labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, label (the smallest node of its component) for every node of an edge.

    A node takes the smallest label around it, then its label's label, so chains shorten by halves. Labels only
    fall, so rounds end by themselves.
    Both joins meet on plain exchanges of written tables, which adaptive execution can split for hubs.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = materialize(both.filter("u != v"))
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels.node == near.u).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        lower = materialize(lower)
        jumped = lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        labels = materialize(jumped.select("node", F.coalesce("next", "label").alias("label"), (F.coalesce("next", "label") != F.col("was")).alias("moved")))
        if labels.filter("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def contract(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels (node, label) joined up by more edges (a, b): components of the labels, then nodes renamed."""
    if labels is None:
        return connected_components(edges)
    if edges.isEmpty():
        return labels
    named = edges
    for end in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    merged = connected_components(named.filter("a != b").distinct())
    renamed = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    new = merged.join(labels.select("node"), "node", "left_anti")
    return materialize(renamed.unionByName(new))
