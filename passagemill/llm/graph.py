"""Connected components of links between nodes named by numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagemill.session import reliable_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node reached.

    Large-star and small-star steps by turns; each leaves at most one row per edge, and
    the number of rounds grows with the logarithm of the longest path.
    """
    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) if small else \
            e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        # a node's least neighbour by aggregation, then back on the edges: no list of neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        # order-free summary of the edge set, to see that a round has changed nothing
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = reliable_checkpoint(edges.where("a <> b").select("a", "b"))
    before = state(current)
    while before[0]:
        current = reliable_checkpoint(star(star(current, small=False), small=True))
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
