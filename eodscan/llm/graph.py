"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def groups(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for edges (a, b).

    Every node points at its smallest neighbour or itself, pointers are doubled until they reach a root, and the links
    are contracted to links between different roots; so each round handles only the links that are left."""
    links = common.stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = None
    while True:
        roots = common.stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
        while True:
            up = roots.select(F.col("node").alias("label"), F.col("label").alias("above"))
            lifted = roots.join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("moved"))
            lifted = common.stored(lifted, "labels")
            roots = lifted.select("node", "label")
            if lifted.filter("moved").isEmpty():
                break
        if labels is None:
            labels = roots
        else:
            now = roots.select(F.col("node").alias("label"), F.col("label").alias("now"))
            labels = common.stored(labels.join(now, "label", "left").select("node", F.coalesce("now", "label").alias("label")), "labels")
        of_a = roots.select(F.col("node").alias("a"), F.col("label").alias("root_a"))
        of_b = roots.select(F.col("node").alias("b"), F.col("label").alias("root_b"))
        left = links.join(of_a, "a").join(of_b, "b").filter("root_a <> root_b")
        links = common.stored(left.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
        if links.isEmpty():
            return labels
