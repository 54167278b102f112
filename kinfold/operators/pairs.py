"""Pairs of entities: normalised, from blocks, clusters and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
import pyspark.sql.functions as F


def unordered(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with the lower id first, as often as they come; pairs of one, or with NULL, go."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b")))


def normalized(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered pairs once each, the lower id first; pairs of one, or with NULL, go."""
    return unordered(pairs, a, b).distinct()


def within(rows: DataFrame, keys: list[str], id_column: str = "er_id") -> DataFrame:
    """All pairs of rows that share the keys: an equality join, never a product of the table."""
    x, y = (rows.select(*keys, F.col(id_column).alias(n)) for n in ("a", "b"))
    return x.join(y, keys).where("a < b").select("a", "b").distinct()


def candidate_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of rows of one block, and of one run of it where blocks are salted."""
    return within(blocks, ["block_key", *[c for c in ("salt_id",) if c in blocks.columns]])


def cluster_pairs(clusters: DataFrame) -> DataFrame:
    """Pairs of one cluster (cluster_id, entity_id)."""
    return within(clusters, ["cluster_id"], "entity_id")


def lineage_pairs(entities: DataFrame) -> DataFrame:
    """(entity, source) for every source id that an entity has."""
    return normalized(entities.select(F.col("er_id").alias("a"), F.explode("source_ids").alias("b")))


def predicted(decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """Positive decisions and lineage together."""
    yes = normalized(decisions.where("is_match"), "entity_a_id", "entity_b_id")
    return yes.union(lineage_pairs(entities)).distinct()


def clusters_of(entities: DataFrame) -> DataFrame:
    """(cluster_id, entity_id): an entity, its own id and its sources'."""
    members = F.explode(F.array_distinct(F.concat(F.array("er_id"), F.coalesce("source_ids", F.array().cast("array<bigint>")))))
    return entities.select(F.col("er_id").alias("cluster_id"), members.alias("entity_id"))
