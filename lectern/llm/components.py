"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node it is connected with.

    Each round gives every node the smallest root among its neighbours' and then the root of its
    root, so chains shrink by more than half.  Minima are taken before the shuffle, thus a node
    with many neighbours sends as little as any other.  Rounds end when nothing changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        roots = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = cut_lineage(step.join(roots, "root").select("node", "old", F.least("root", "above").alias("root")))
        changed = not step.filter("old <> root").isEmpty()
        labels = step.select("node", "root")
        if not changed:
            return labels
