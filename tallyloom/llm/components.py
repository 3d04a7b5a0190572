"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b); a label is one of its component's nodes.

    In a round each node points to its smallest neighbour, or to itself if it is
    smaller, and then to where that one points. Edges are rewritten to the nodes
    pointed to, and vanish inside a node. Every node but local minima is merged,
    so rounds are few, also for long chains. Each round starts from files.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
        beyond = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
        pointed = stored(near.join(beyond, "p", "left").select("a", F.least("p", F.coalesce("q", "p")).alias("p")), "pointers")
        if labels is None:
            labels = pointed.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            step = pointed.select(F.col("a").alias("label"), "p")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
            labels = stored(labels, "labels")
        ends = left.join(pointed, "a").select("b", F.col("p").alias("x")).join(pointed.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        left = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
