"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """Per node of `edges` (a, b) the smallest node it is connected to: node, root.

    Large star: every neighbour above a node moves to the node's smallest neighbour; small
    star: the same for those below. Each is a combined minimum and a join, so no list of
    neighbours is gathered, and the depth halves from round to round.
    """
    edges = materialise(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        down = large.where(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("_m"))
        small = down.join(least, "a").select(F.col("b").alias("_b"), "a", "_m")
        stars = small.select("a", F.col("_m").alias("b")).unionByName(
            small.select(F.col("_b").alias("a"), F.col("_m").alias("b"))
        )
        last, edges = edges, materialise(stars.where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(last)
        now = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if before is not None and (now["n"], now["sum"]) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (now["n"], now["sum"])
