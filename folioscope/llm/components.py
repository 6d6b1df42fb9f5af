"""Connected components by repeated local contraction, all in DataFrame operations.

Every node points at the smallest node of its closed neighbourhood, by a hash order; edges are
redrawn between the nodes pointed at, and the rounds go on until no edge is left. Each round
keeps components whole, since the ends of an edge point at nodes that are equal or joined by the
redrawn edge. The hash order makes long paths shrink by a constant factor a round in expectation.
Hubs are met by partial aggregation and by joins against one row per node, which adaptive
execution can split. Nothing but emptiness is told to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import cut


class Forest:
    """Union-find over the links of one task; ``stars`` gives a star for every set."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple]:
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def _ranked(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), c.alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any orderable type; returns ``(node, root)`` for every node of an edge.

    Repeated edges, loops and either direction are allowed; edges with a null end are ignored.
    ``root`` is a node of the component, the same for all its nodes, not always the smallest.
    No edges: no rows.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = ends.groupBy("a").agg(F.min(_ranked(F.col("b"))).alias("m"))
        parent = cut(nearest.select(F.col("a").alias("node"), F.least(_ranked(F.col("a")), F.col("m"))["n"].alias("up")))
        rounds.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = cut(edges.join(left, "a").join(right, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("up").alias("root"))
    for parent in rounds[-2::-1]:
        later = roots.select(F.col("node").alias("up"), F.col("root").alias("then"))
        roots = parent.join(later, "up", "left").select("node", F.coalesce("then", "up").alias("root"))
    return roots
