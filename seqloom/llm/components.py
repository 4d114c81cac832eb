"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.store import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b: long); the label is the component's least node.

    Each round gives a node the least label among its neighbours and itself, then the label of its label, until no label
    changes, so the rounds grow with the logarithm of long paths and not with their length in the usual case. Labels are
    written to the shared folder each round. Edges with a null, and from a node to itself, are left out. Sums over
    neighbours are pre-aggregated; joins are plain equi-joins that adaptive execution splits at hot nodes.
    """
    edges = edges.dropna().where(F.col("a") != F.col("b"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "graph-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "graph-labels")
    while not both.isEmpty():
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        after = labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "heard").alias("next"), F.col("label").alias("was"))
        # The label's own label may be lower still.
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        after = after.join(jump, F.col("next") == F.col("_n"), "left").select("node", F.least("next", F.coalesce("_l", "next")).alias("label"), "was")
        after = materialize(after, "graph-labels")
        changed = not after.where(F.col("label") != F.col("was")).isEmpty()
        discard(labels)
        labels = after
        if not changed:
            break
    discard(both)
    return labels.select("node", "label")
