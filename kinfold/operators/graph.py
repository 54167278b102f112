"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
import pyspark.sql.functions as F

from kinfold.session import checkpointed


def connected_components(vertices: DataFrame, edges: DataFrame, id_column: str = "id", most_rounds: int = 1000) -> DataFrame:
    """(id, component): the least id that each vertex reaches, itself where it has no edge.

    Edges (src, dst) have no direction; those with an end that isn't a vertex, or NULL, don't count.
    Each round links neighbours to the least id of their neighbourhood, which shortens paths, so the
    rounds grow with the logarithm of the longest one. Each round's edges are checkpointed.
    """
    ids = vertices.select(F.col(id_column).alias("id")).where("id IS NOT NULL").distinct()
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    known = known.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    e = checkpointed(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        # Large star: neighbours above a vertex go to the least of its neighbourhood.
        both = e.union(e.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # Small star: a vertex and its lower neighbours go to the lowest of them.
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low, F.col("b") == F.col("u")).select("m", F.col("a").alias("v")).union(low.select("m", "u")).where("m <> v").distinct().toDF("a", "b")
        new = checkpointed(small)
        # It is over when every edge is a star's: one centre for each leaf, no centre itself a leaf.
        leaves = new.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        chained = new.select(F.col("a").alias("b")).distinct().join(leaves.select("b"), "b", "left_semi")
        done = not leaves.where("n > 1").select("b").union(chained).limit(1).head(1)
        e = new
        if done:
            break
    return ids.join(e.select(F.col("b").alias("id"), F.col("a").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
