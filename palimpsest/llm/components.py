"""Connected components by joins: every node follows its least neighbour, chains are shortened by doubling, edges contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for each node of ``edges`` ``(a, b)``; ``root`` is the least node of its component.

    Each round at least halves the nodes that still have edges, and a chain of n nodes is shortened in log n steps, so there are
    few rounds whatever the graph; each is written to the shared folder.  Self-loops only name their node; nulls aren't allowed.
    """
    edges = saved(edges.select("a", "b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    labels, edges = None, edges.where("a <> b")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = saved(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "parents")
        while True:
            above = parents.select(F.col("v").alias("root"), F.col("root").alias("up"))
            stepped = saved(parents.join(above, "root", "left").select("v", F.coalesce("up", "root").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "parents")
            parents = stepped.select("v", "root")
            if stepped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            now = parents.select(F.col("v").alias("root"), F.col("root").alias("up"))
            labels = saved(labels.join(now, "root", "left").select("v", F.coalesce("up", "root").alias("root")), "labels")
        left, right = (parents.select(F.col("v").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        edges = saved(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return nodes.join(labels, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
