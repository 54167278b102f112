"""Matchers: from blocks to pairs (rules, in the JVM) or to merged rows (grouped functions)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
import pyspark.sql.functions as F

from kinfold.functions.text import normalize_name
from kinfold.operators.lineage import ERROR, SINGLETON, restore, skipped


class Embedder(Protocol):
    """Adds an `embedding` column to rows."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


class Blocker(Protocol):
    """Rows to (er_id, block_key, block_size)."""

    def __call__(self, df: DataFrame, iteration: int) -> DataFrame: ...


class Matcher(Protocol):
    """Rows and their blocks to decisions (entity_a_id, entity_b_id, is_match, confidence, reasoning)."""

    def __call__(self, rows: DataFrame, blocks: DataFrame, iteration: int) -> DataFrame: ...


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words of all words of two normalised names."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    """The greater of edit similarity and word overlap of two normalised names; 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    edit = F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longest), F.lit(0.0))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.greatest(edit, word_overlap(a, b)))


def similarity_from(a: str, b: str, threshold: float) -> Column:
    """`name_similarity` of two columns where it reaches the threshold, less or 0 elsewhere: names
    whose lengths differ too much aren't compared, and the edit distance stops at its limit."""
    x, y = F.col(a), F.col(b)
    longest = F.greatest(F.length(x), F.length(y))
    limit = f"cast(floor((1 - {threshold!r}) * greatest(length({a}), length({b})) + 1e-9) as int)"
    steps = F.expr(f"levenshtein({a}, {b}, {limit})")
    edit = F.when((F.abs(F.length(x) - F.length(y)) <= F.expr(limit)) & (steps >= 0), 1 - F.try_divide(steps.cast("double"), longest)).otherwise(0.0)
    overlap = word_overlap(x, y)
    return F.when((x == "") | (y == ""), 0.0).when(overlap >= 1, 1.0).otherwise(F.greatest(edit, overlap))


class RuleMatcher:
    """Rows of one block whose names are alike by `name_similarity`. Deterministic, without Python.

    Rows of a block with equal names, in whichever of its salted runs, are linked to the first of
    them: as many pairs as rows. Unequal names are compared once each within a run, and a pair
    that passes links the first row of either name. So a hot name costs no more than its rows, and
    no link between different names is lost. Whole names are compared, whatever their length;
    empty ones match nothing.
    """

    def __init__(self, threshold: float = 0.85):
        self.threshold = threshold

    def __call__(self, rows: DataFrame, blocks: DataFrame, iteration: int = 1) -> DataFrame:
        salted = [c for c in ("salt_id",) if c in blocks.columns]
        named = rows.select("er_id", normalize_name(F.coalesce("name", F.lit(""))).alias("n")).where("n <> ''")
        held = named.join(blocks.select("er_id", "block_key", *salted), "er_id").withColumn("h", F.xxhash64("n"))
        first = held.groupBy("block_key", "h", "n").agg(F.min("er_id").alias("a"), F.count(F.lit(1)).alias("m"))
        equal = held.join(first.where("m > 1").select("block_key", "h", F.col("n").alias("n_a"), "a"), ["block_key", "h"]).where("n = n_a AND er_id <> a").select("a", F.col("er_id").alias("b"), F.lit(1.0).alias("confidence"))
        each = held.groupBy("block_key", *salted, "h", "n").agg(F.min("er_id").alias("er_id"))
        a, b = (each.select("block_key", *salted, *[F.col(c).alias(f"{c}_{end}") for c in ("er_id", "h", "n")]) for end in ("a", "b"))
        met = a.join(b, ["block_key", *salted]).where("h_a < h_b OR (h_a = h_b AND n_a < n_b)")
        alike = met.withColumn("confidence", similarity_from("n_a", "n_b", self.threshold)).where(F.col("confidence") >= self.threshold)
        pairs = equal.union(alike.select(F.least("er_id_a", "er_id_b"), F.greatest("er_id_a", "er_id_b"), "confidence"))
        return pairs.groupBy(F.col("a").alias("entity_a_id"), F.col("b").alias("entity_b_id")).agg(F.max("confidence").alias("confidence")).select(
            "entity_a_id", "entity_b_id", F.lit(True).alias("is_match"), "confidence", F.lit("names alike").alias("reasoning")
        )


RESOLVED = "local_id bigint, name string, description string, source_local array<bigint>"


class GroupedMatcher:
    """Blocks to merged rows through a function from one block's pandas frame (local_id, name,
    description, entity_type) to a frame of RESOLVED's columns, such as a language model's client.

    A block is one group, so it is never split between calls. A failing call sends its rows on as
    they are, marked as error recovery; a row alone in its block isn't sent at all, and is marked.
    """

    def __init__(self, function: Callable):
        self.function = function

    def resolve(self, rows: DataFrame, blocks: DataFrame, iteration: int = 1) -> DataFrame:
        keys = ["block_key", "salt_id"]
        b = blocks if "salt_id" in blocks.columns else blocks.withColumn("salt_id", F.lit(0))
        # A row goes to one block alone, so that nothing is resolved twice.
        one = b.groupBy("er_id").agg(F.min(F.struct(*keys)).alias("k")).select("er_id", "k.*")
        placed = rows.join(one, "er_id", "left").withColumns({"block_key": F.coalesce("block_key", F.concat(F.lit("alone_"), F.col("er_id").cast("string"))), "salt_id": F.coalesce("salt_id", F.lit(0))})
        size = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        placed = placed.join(size, keys)
        alone = skipped(placed.where("__n = 1").select(*rows.columns), SINGLETON, iteration)
        many = placed.where("__n > 1").drop("__n")
        f = self.function

        def run(pdf):  # noqa: ANN001, ANN202
            import pandas as pd

            own = pdf.sort_values("er_id").reset_index(drop=True)
            key = {k: own[k].iloc[0] for k in keys}
            try:
                asked = own[["name", "description", "entity_type"]].copy()
                asked.insert(0, "local_id", range(len(own)))
                got = pd.DataFrame(f(asked)).reindex(columns=["local_id", "name", "description", "source_local"])
                got["failed"] = False
            except Exception:  # noqa: BLE001 - the contract: a failed block is passed through
                got = pd.DataFrame({"local_id": range(len(own)), "name": None, "description": None, "source_local": None, "failed": True})
            return got.assign(**key)[[*keys, "local_id", "name", "description", "source_local", "failed"]]

        from kinfold.session import checkpointed

        asked = many.select(*keys, "er_id", "name", "description", "entity_type")
        answers = checkpointed(asked.groupBy(*keys).applyInPandas(run, f"block_key string, salt_id int, {RESOLVED}, failed boolean"))
        bad = answers.where("failed").select(*keys).distinct()
        failed = skipped(many.join(bad, keys, "left_semi").select(*rows.columns), ERROR, iteration)
        fine = many.join(bad, keys, "left_anti")
        back = restore(answers.where("NOT failed"), fine, keys, iteration).select(*rows.columns)
        return back.unionByName(failed).unionByName(alone)
