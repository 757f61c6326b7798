"""Connected components by alternating large and small stars, in a number of rounds that grows with the logarithm of a path's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b: long). Null edges and loops count for nothing.

    A large star ties each node's greater neighbours to the least of it and its neighbours, a small star its lesser
    ones; when every node hangs on one that hangs on none, these are the components. Each round's edges are written to
    the shared folder, so the plan stays short and a lost executor costs no round. A hub's edges are folded to a minimum
    before they are shuffled; Spark splits its part of the joins.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a != b")
    tree = written(clean.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near")).distinct(), "edges")
    while not _is_forest_of_stars(tree):
        both = tree.union(tree.select("near", "node"))
        least = both.groupBy("node").agg(F.least("node", F.min("near")).alias("least"))
        wide = written(both.where("near > node").join(least, "node").select(F.col("near").alias("node"), F.col("least").alias("near")).distinct(), "edges")
        least = wide.groupBy("node").agg(F.min("near").alias("least"))
        small = wide.join(least, "node").where("near != least").select(F.col("near").alias("node"), F.col("least").alias("near"))
        fresh = written(small.union(least.select("node", F.col("least").alias("near"))).distinct(), "edges")
        for done in (tree, wide):
            drop_path(tree.sparkSession, done.written_path)
        tree = fresh
    return tree.toDF("node", "component").union(tree.select("near", "near").distinct())


def _is_forest_of_stars(tree: DataFrame) -> bool:
    """Whether each node has one edge to a lesser one, which has none."""
    inner = tree.select(F.col("near").alias("node")).join(tree.select("node"), "node", "left_semi")
    return inner.isEmpty() and tree.groupBy("node").count().where("count > 1").isEmpty()
