"""The resolve loop: block, match, link, merge, until a round no longer shrinks the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
import pyspark.sql.functions as F

from kinfold.operators.blocking import blocking_stats, first_blocks, name_blocks, salt, vector_blocks
from kinfold.operators.entities import dense_id, embedding_text, to_entities
from kinfold.operators.graph import connected_components
from kinfold.operators.lineage import SINGLETON, skipped
from kinfold.operators.matching import Blocker, GroupedMatcher, Matcher, RuleMatcher
from kinfold.operators.merge import merge_components
from kinfold.operators.metrics import er_report, uuid_coverage
from kinfold.plans.config import ResolveConfig
from kinfold.session import checkpointed

AUTO_ROUNDS = 20


@dataclass
class Round:
    """What one round did."""

    iteration: int
    input_count: int
    output_count: int
    reduction_pct: float
    overall_reduction_pct: float
    blocks: int
    singleton_blocks: int
    largest_block: int
    reduction_ratio: float
    coverage_pct: float


def has_converged(reduction_pct: float, threshold: float) -> bool:
    """Whether a round's reduction, in percent, is below the threshold, a fraction."""
    return reduction_pct < threshold * 100


def hashed_embedding(rows: DataFrame, fields: list[str] | None = None, size: int = 64) -> DataFrame:
    """A vector of the text's letter trigrams by hashed signs: the default without a model, all in the JVM.

    A value that a function inside reads again and again is bound as the only element of an array,
    as Spark works an outer expression out anew for each element.
    """
    bound = lambda value, f: F.transform(F.array(value), f)[0]
    starts = lambda t: F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1)))
    hashes = lambda t: F.transform(starts(t), lambda i: F.xxhash64(F.substr(t, i, F.lit(3))))
    signed = lambda x: (F.pmod(x, F.lit(size)) + 1) * F.when(x > 0, 1).otherwise(-1)
    n_of = lambda marks, m: F.size(marks) - F.size(F.array_remove(marks, m))
    dims = lambda marks: F.transform(F.sequence(F.lit(1), F.lit(size)).cast("array<bigint>"), lambda d: (n_of(marks, d) - n_of(marks, -d)).cast("double"))
    marks = bound(F.lower(embedding_text(fields)), lambda t: F.transform(hashes(t), signed))
    return rows.withColumn("embedding", bound(marks, dims))


def spread(rows: DataFrame, each: int = 20_000) -> DataFrame:
    """Rows in parts of about `each`, and enough of them for all cores: a small file comes as one part."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // each), "er_id")


def default_blocker(config: ResolveConfig) -> Blocker:
    def block(rows: DataFrame, iteration: int) -> DataFrame:
        if config.blocking_method == "name":
            return name_blocks(rows)
        if config.blocking_method == "semantic":
            embedded = rows if "embedding" in rows.columns else checkpointed(hashed_embedding(spread(rows), config.blocking_fields).select("er_id", "embedding"))
            return vector_blocks(embedded, target=config.target_block_size, iteration=iteration)
        raise ValueError(f"unknown blocking method {config.blocking_method!r}")

    return block


def one_round(rows: DataFrame, config: ResolveConfig, blocker: Blocker, matcher: Matcher | GroupedMatcher, iteration: int) -> tuple[DataFrame, DataFrame]:
    """(rows after the round, blocks): one lazy plan but for components and the matcher's own cuts."""
    blocks = checkpointed(salt(blocker(rows, iteration), config.max_block_size))
    used = first_blocks(blocks, config.limit_blocks) if config.limit_blocks else blocks
    if isinstance(matcher, GroupedMatcher):
        return matcher.resolve(rows, used, iteration), blocks
    pairs = matcher(rows, used, iteration)
    linked = connected_components(rows.select(F.col("er_id").alias("id")), pairs.where("is_match").select(F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst")))
    merged = merge_components(rows.join(linked.select(F.col("id").alias("er_id"), "component"), "er_id")).drop("component")
    lone = used.groupBy("er_id").agg(F.max("block_size").alias("n")).where("n > 1").select("er_id")
    return merged.join(lone, "er_id", "left_semi").unionByName(skipped(merged.join(lone, "er_id", "left_anti"), SINGLETON, iteration)), blocks


def resolve(df: DataFrame, config: ResolveConfig | None = None, blocker: Blocker | None = None, matcher: Matcher | GroupedMatcher | None = None) -> tuple[DataFrame, list[Round]]:
    """Resolved entities and what each round did.

    Rows get ids 0.. unless the configuration names an id column; ids and uuids stay the same from
    round to round, so lineage can be followed. Each round's rows are checkpointed once: nothing is
    matched twice. It stops when a round's reduction is below the threshold, and with
    max_iterations 0 also when it falls to nothing or to a tenth of the round before.
    """
    config = config or ResolveConfig()
    blocker, matcher = blocker or default_blocker(config), matcher or RuleMatcher(config.match_threshold)
    if config.id_field is None:
        df = dense_id(df, "__id")
    entities = to_entities(df, config.id_field or "__id", config.name_field, config.text_fields, config.entity_type)
    rows = checkpointed(entities)
    start = before = rows.count()
    history = rows.select(F.col("er_uuid").alias("uuid"))
    done: list[Round] = []
    for i in range(1, (config.max_iterations or AUTO_ROUNDS) + 1):
        out, blocks = one_round(rows, config, blocker, matcher, i)
        rows = checkpointed(out)
        after = rows.count()
        stats, coverage = blocking_stats(blocks).first(), uuid_coverage(rows, history).first()
        share = lambda a, b: 100.0 * (a - b) / a if a else 0.0
        done.append(Round(i, before, after, share(before, after), share(start, after), stats["total_blocks"], stats["singleton_blocks"], stats["max_block_size"], stats["reduction_ratio"], coverage["coverage_pct"]))
        shrunk = done[-1].reduction_pct
        if has_converged(shrunk, config.convergence_threshold):
            break
        if config.max_iterations == 0 and i > 1 and (shrunk <= 0 or shrunk < 0.1 * done[-2].reduction_pct):
            break
        before = after
    return rows, done


def report(rows: DataFrame, done: list[Round], history: DataFrame | None = None) -> DataFrame:
    """The evaluation of a finished run."""
    first, last = (done[0].input_count, done[-1].input_count) if done else (0, 0)
    return er_report(rows, first, last, history)
