"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codonlake.session import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` that is not its own root.

    The root is the smallest node of the component. Each round hangs larger
    neighbours, then smaller ones, below the smallest (large star, small
    star); a round is a table in the shared folder, so lineage stays short.
    Nothing but a row count and a checksum reaches the driver. Loops of a node
    to itself and nulls are dropped; an empty table gives an empty one.
    """
    now = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).filter("a > b")
    now, before = stored(now.distinct(), "links"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(seen)
        now = stored(_small_star(_large_star(now)).distinct(), "links")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))
