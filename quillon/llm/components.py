"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._batch import drop_written, written


def components(edges: DataFrame, driver_edges: int = 200_000) -> DataFrame:
    """(node, root) of every node of edges (a, b), where root is the least node of its component.

    Up to driver_edges edges (a few MB) are joined by a union-find on the driver; beyond that, large-star and small-star
    rounds run on the cluster until nothing changes, each round written to the shared folder. An empty table of edges
    has no components; loops and repeated edges are allowed, edges with a null end are left out.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    few = edges.limit(driver_edges + 1).toPandas()
    if len(few) <= driver_edges:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in zip(few["a"].tolist(), few["b"].tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in root]
        return edges.sparkSession.createDataFrame(rows, "node long, root long")
    return _stars(edges)


def _stars(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # every neighbour above a node goes to the least node of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # then every node and its lower neighbours to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = written(small.where("a != b").distinct())
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            roots = after.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        if before is not None:
            drop_written(before)
        before, now = now, after
