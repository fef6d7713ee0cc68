"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout.storage import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of all nodes of the links ``a, b``; equal labels for one component.

    In each round every node follows its smallest neighbour, if that is smaller than itself, down to
    a node that has none; then the links are redrawn between these, and those within one fall away.
    At least half of the nodes that still have links go in a round. Rounds are written tables;
    the driver only learns whether links are left.
    """
    edges = materialize(links.select("a", "b").where("a != b").distinct(), "links")
    labels = None
    while True:
        ends = edges.union(edges.select(F.col("b"), F.col("a")))
        down = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        roots = _follow(materialize(down, "labels"))
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("node").alias("label"), F.col("label").alias("_further"))
            labels = labels.join(step, "label", "left").select("node", F.coalesce("_further", "label").alias("label"))
            labels = materialize(labels, "labels")
        left = edges.join(roots.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a").select("_a", "b")
        both = left.join(roots.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b").where("_a != _b")
        edges = materialize(both.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels


def _follow(labels: DataFrame) -> DataFrame:
    """Labels replaced by the label of their label until none changes; each pass doubles the reach."""
    while True:
        next_ = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialize(labels.join(next_, "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels
