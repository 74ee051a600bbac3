"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Edges up to which the driver solves the rest alone (16 bytes each); beyond, rounds go on in Spark.
DRIVER_EDGES = 100_000


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches; only nodes with an edge.

    Each round joins an aggregate (the least neighbour of each node, combined map-side) back to the edges, so
    a node with very many neighbours is neither gathered nor a hot task beyond what AQE splits. Stops when nothing changes.
    Small graphs, by a count, are solved in the driver: its memory is bounded by driver_edges.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        n, s = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if n <= driver_edges:
            return _small(now, spark)
        if (n, s) == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select("b", "b").distinct())
        mark = (n, s)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node's smaller neighbours, and itself, meet its least one
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down).where("a <> b").distinct()
        after = written(small, "edges")
        discard(now)
        now = after


def _small(edges: DataFrame, spark) -> DataFrame:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in edges.collect():
        a, b = find(r.a), find(r.b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return spark.createDataFrame([(x, find(x)) for x in sorted(parent)], "node bigint, component bigint")
