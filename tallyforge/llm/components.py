"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread

#: Edges that one task writes.
TASK_ROWS = 200_000


def _written(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` without loops and repetitions, of at most about ``rows`` rows, which settle in how many tasks."""
    return cut(edges.where("a <> b").distinct().coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS)), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node of its component) from ``a``, ``b`` of one orderable type.

    Every node links itself to the least of its neighbours, first those above it, then those
    below it, until nothing changes.  A step only takes minima (added up in each task before
    any shuffle) and joins them back; a node with very many neighbours needs no list of
    them, and its edges are dealt to several tasks.  Edges may repeat or be loops; without
    edges there are no components.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = edges.count()
    while n and not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = join_spread(both.where("b > a"), least, ["a"], "n", ["b"], n).select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = _written(large, n)  # a > b
        least = large.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
        small = join_spread(large, least, ["a"], "n", ["b"], n)
        edges = _written(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*"), n)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, to a node that has none."""
    ends = edges.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    counts = ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counts.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()
