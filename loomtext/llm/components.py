"""Connected components of a graph given as an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the smallest node that it reaches.

    In each round every node of the contracted graph points to its smallest neighbour if that is
    smaller than itself, pointers are followed two steps, and edges are rewritten to the nodes
    pointed at; an edge within one node goes.  Hot nodes are safe: minima are combined before the
    shuffle and joins have a unique side, so that a skewed partition can be split.
    No edges: no rows.  Edges with a null end are ignored.
    """
    live = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    roots = scratch.keep(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("root", F.col("node")))
    while not live.isEmpty():
        # Only the larger end of an edge has a smaller neighbour.
        step = scratch.keep(live.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y")))
        two = step.select(F.col("x").alias("y"), F.col("y").alias("z"))
        step2 = scratch.keep(step.join(two, "y", "left").select("x", F.coalesce("z", "y").alias("y")))
        new_roots = scratch.keep(roots.join(step2, roots["root"] == step2["x"], "left").select("node", F.coalesce("y", "root").alias("root")))
        left = live.join(step2.select(F.col("x").alias("a"), F.col("y").alias("a2")), "a", "left").select(F.coalesce("a2", "a").alias("a"), "b")
        both = left.join(step2.select(F.col("x").alias("b"), F.col("y").alias("b2")), "b", "left").select("a", F.coalesce("b2", "b").alias("b"))
        new_live = scratch.keep(both.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(live, roots, step, step2)
        live, roots = new_live, new_roots
    scratch.drop(live)
    return roots
