"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouping (with map-side minima) and a join on the vertex, so no adjacency list is
gathered anywhere. Steps end in a table in the shared folder; the number of steps grows with the
logarithm of the longest path, and star-shaped edges need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger (a) to the smaller (b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex that has an edge to another; the component is its smallest vertex.

    `edges` has columns a and b of one orderable type. Edges from a vertex to itself and edges with a
    null end are ignored; an empty table has no components.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        was, now = now, stored(_small_star(_large_star(now)), "edges")
        forget(was)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
