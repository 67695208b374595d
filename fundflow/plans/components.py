"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.plans.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of one orderable type, no nulls -> (node, root) for every
    linked node; the root is the component's least node.

    Each round hangs every node below its least neighbour, halves the paths
    and contracts the links, until none is left; every round is written to the
    shared folder. A node with very many links only ever meets a minimum.
    """
    left = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "other")
        hung = parent = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            parent = parent.join(up, "root").select("node", F.col("higher").alias("root"))
        parent = stored(parent, "parents")
        discard(hung)
        higher = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        was, labels = labels, parent if labels is None else stored(labels.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "labels")
        a, b = (parent.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        met, left = left, stored(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(met, *[was, parent] if was is not None else [])
    discard(left)
    return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0) if labels is None else labels
