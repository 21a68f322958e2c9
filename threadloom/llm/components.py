"""Connected components of an edge list, by hooking, pointer jumping and contraction, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut_lineage


def _roots(parents: DataFrame) -> DataFrame:
    """Follows ``(node, parent)`` to the end by doubling. A parent that is no node is a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = cut_lineage(parents.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        parents = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of ``edges(a, b)`` but the roots; a root is the least node.

    In each round a node hooks to its least smaller neighbour, which leaves at most half of the
    nodes that have an edge; edges are then rewritten between roots. Hubs are summed before the
    shuffle. Nothing but counts of remaining edges comes to the driver.
    """
    links = cut_lineage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                        .filter("hi <> lo").distinct())
    found = None
    while not links.isEmpty():
        # a node with smaller neighbours hooks to the least; the others stay
        hooks = _roots(links.groupBy("hi").agg(F.min("lo").alias("parent")).withColumnRenamed("hi", "node"))
        if found is None:
            found = hooks
        else:
            above = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            found = cut_lineage(found.join(above, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent")).unionByName(hooks))
        for end in ("hi", "lo"):
            root = hooks.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_root"))
            links = links.join(root, end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        links = cut_lineage(links.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
                            .filter("hi <> lo").distinct())
    if found is None:
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return found.select("node", F.col("parent").alias("root"))
