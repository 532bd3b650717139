"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as (node, root): root is the smallest node reachable; nodes without an edge are absent.

    Each round every node passes its smallest neighbour on to its larger, then to its smaller ones.
    Minima are partial aggregates and go back by an equi-join, so that a node with very many
    neighbours is never gathered. Rounds are cut by tables in the shared folder; their number grows
    with the logarithm of the longest chain.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        # Large star: both directions; larger neighbours get the minimum.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: smaller neighbours and the node itself get the minimum.
        large = staged(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = staged(small.where("a != b").distinct(), "edges")
