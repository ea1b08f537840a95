"""Connected components by minimum labels with pointer jumping; only joins and aggregates over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b); label is the smallest node of its component.

    Each round a node takes the smallest label among its own and its neighbours', offers it to the node that its old
    label names, and then jumps to its label's label. Aggregates combine before the shuffle, so a node with very many
    neighbours is no hot group.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
    both = materialize(both.filter("node <> to").distinct(), "edges", compact=True)
    labels = materialize(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label")), "labels", compact=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("low"))
        step = labels.join(near, "node")
        # the smaller label goes to the node itself and to the node that its old label names
        offers = step.select("node", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        offers = offers.union(step.filter("low < label").select("label", "low", F.lit(None).cast("bigint")))
        low = offers.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = low.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        new = materialize(new, "labels", compact=True)
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels
