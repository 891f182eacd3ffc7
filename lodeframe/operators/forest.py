"""Forests out of parent links: the path of every node from its root, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def paths(nodes: DataFrame, tree: str, node: str, parent: str, depth: int) -> DataFrame:
    """(tree, node, path: array of the nodes from the root to it) for nodes (tree, node, parent: null at a root).

    depth: most nodes on a path. Each round joins every node with where its link points and doubles what is known, so
    there are as many rounds as depth has binary digits. A parent that is no node of the tree makes its children roots.
    """
    known = nodes.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("up"))
    real = known.select(F.col("t").alias("rt"), F.col("n").alias("rn"))
    known = known.join(real, (F.col("t") == F.col("rt")) & (F.col("up") == F.col("rn")), "left").select("t", "n", F.col("rn").alias("up"), F.array("n").alias("path"))
    for _ in range(max(1, depth - 1).bit_length()):
        above = known.select(F.col("t").alias("at"), F.col("n").alias("an"), F.col("up").alias("next"), F.col("path").alias("lead"))
        known = known.join(above, (F.col("t") == F.col("at")) & (F.col("up") == F.col("an")), "left").select(
            "t", "n", F.col("next").alias("up"), F.when(F.col("lead").isNull(), F.col("path")).otherwise(F.concat("lead", "path")).alias("path"))
    return known.select(F.col("t").alias(tree), F.col("n").alias(node), "path")
