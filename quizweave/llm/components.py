"""Connected components of edge tables, with joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def roots(forest: DataFrame) -> DataFrame:
    """(node, parent), at most one row a node and without cycles, to (node, root): pointers are doubled until none moves."""
    now = written(forest.toDF("node", "root"))
    while True:
        old, up = now, now.select(F.col("node").alias("root"), F.col("root").alias("up"))
        now = written(now.select("node", "root").join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        dropped(old)
        if now.where("moved").isEmpty():
            return now


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs to (node, root): equal roots for connected nodes, for each node that has an edge.

    Every node is hooked to its least neighbour if that is less, trees are flattened, edges go over to the roots, and
    so on until no edge is left between roots. The roots that still have edges at least halve in number each time.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    whole = None
    while not edges.isEmpty():
        hooked = roots(edges.groupBy("a").agg(F.min("b").alias("parent")))
        nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        here = nodes.join(hooked.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        old = [edges, hooked]
        if whole is None:
            whole = written(here)
        else:
            up = here.select(F.col("node").alias("root"), F.col("root").alias("up"))
            old.append(whole)
            whole = written(whole.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        moved = edges.join(whole.toDF("a", "root_a"), "a").join(whole.toDF("b", "root_b"), "b")
        edges = written(moved.select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")).where("a <> b").distinct())
        dropped(*old)
    if whole is None:
        whole = written(edges.toDF("node", "root"))
    dropped(edges)
    return whole
