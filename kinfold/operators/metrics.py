"""Evaluation: pairs, clusters, lineage coverage and the whole report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
import pyspark.sql.functions as F

from kinfold.operators.blocking import pairs_of
from kinfold.operators.pairs import unordered

COVERAGE = 99.99
ERROR_RATE = 1.0
DUPLICATE_RATE = 1.0


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def _rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 to tp, predicted and truth; 0 on empty denominators."""
    tp, p, t = F.col("true_positives"), F.col("predicted"), F.col("truth")
    return df.select(
        "true_positives",
        (p - tp).alias("false_positives"),
        (t - tp).alias("false_negatives"),
        ratio(tp, p).alias("precision"),
        ratio(tp, t).alias("recall"),
        ratio(2 * tp, p + t).alias("f1_score"),
    )


def _sides(predicted: DataFrame, truth: DataFrame, more: list[str] | None = None, parts: int = 200) -> DataFrame:
    """One row: true positives, predicted and true pairs, each pair of a side counted once.

    Rows of both sides go to `parts` tasks by pair as they are: hardly any pair comes twice in a task
    that reads, so combining there first would only fill its memory. The number is fixed, as many
    as Spark writes without sorting, whatever the session would join them to.
    """
    keys = ["a", "b", *(more or [])]
    given = lambda df: df.where("a IS NOT NULL AND b IS NOT NULL")
    both = given(predicted).select(*keys, F.lit(1).alias("p"), F.lit(0).alias("t")).union(given(truth).select(*keys, F.lit(0), F.lit(1)))
    sides = both.repartition(parts, *keys).groupBy(*keys).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sides.agg(total(F.col("p") * F.col("t")).alias("true_positives"), total("p").alias("predicted"), total("t").alias("truth"))


def directed_metrics(predicted: DataFrame, truth: DataFrame, more: list[str] | None = None) -> DataFrame:
    """One row: counts, precision, recall, F1 of two sets of pairs (a, b, ...), whose order counts."""
    return _rates(_sides(predicted, truth, more))


def pair_metrics(predicted: DataFrame, truth: DataFrame, cross_source_only: bool = False, offset: int = 100_000) -> DataFrame:
    """One row: counts, precision, recall, F1 of two pair sets (a, b), in any order, by one grouping.

    Pairs are counted by side in a single shuffle, without a join. `cross_source_only` leaves out
    predicted pairs of one table, told by the ids' offset, which ids of the first must stay below.
    """
    p = unordered(predicted)
    if cross_source_only:
        p = p.where((F.col("a") < offset) & (F.col("b") >= offset))
    return directed_metrics(p, unordered(truth))


def pair_completeness(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of true pairs among the candidates; 0 without true pairs."""
    return _sides(unordered(candidates), unordered(truth)).select(ratio(F.col("true_positives"), F.col("truth")).alias("pair_completeness"))


def cluster_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairwise rates of two clusterings (cluster_id, entity_id), from the sizes of their cells.

    No pair is ever made: linear in the entities. Each side must have an entity once; see
    `overlapping_cluster_metrics` for sides that don't.
    """
    p, t = (d.select("entity_id", F.col("cluster_id").alias(n)).where("entity_id IS NOT NULL") for d, n in ((predicted, "p"), (truth, "t")))
    cells = p.join(t, "entity_id").groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"))
    made = lambda d, c: d.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda d, n: d.agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0.0)).cast("bigint").alias(n))
    one = pairs(cells, "true_positives").crossJoin(pairs(made(p, "p"), "predicted")).crossJoin(pairs(made(t, "t"), "truth"))  # one row each
    return _rates(one)


def overlapping_cluster_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """The same for clusterings in which an entity may be in several clusters: by their pairs."""
    from kinfold.operators.pairs import cluster_pairs

    return pair_metrics(cluster_pairs(predicted), cluster_pairs(truth))


def uuid_coverage(entities: DataFrame, history: DataFrame) -> DataFrame:
    """One row: source uuids in all, those that `history` (uuid) has, coverage in percent (100 without
    any), the first ten that are missing, and whether coverage reaches 99.99."""
    asked = entities.select(F.explode("source_uuids").alias("uuid"))
    known = history.select("uuid").distinct().withColumn("known", F.lit(1))
    each = asked.groupBy("uuid").agg(F.count(F.lit(1)).alias("n")).join(known, "uuid", "left")
    total = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("valid"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("uuid")))), 1, 10).alias("missing"),
    )
    share = ratio(F.col("valid") * 100, F.col("total"), 100.0)
    return total.select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), share.alias("coverage_pct"), "missing", (share >= COVERAGE).alias("passed"))


def skip_reasons(entities: DataFrame) -> DataFrame:
    """reason, n: how often skipped rows give each reason; 'unknown' where they give none."""
    return entities.where("match_skip").groupBy(F.coalesce("match_skip_reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def reduction(before: Column, after: Column) -> Column:
    """How much smaller, in percent; 0 where there was nothing."""
    return ratio((before - after) * 100, before)


def er_report(results: DataFrame, original: int, previous: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row that sums up resolved rows: copies of (er_id, er_uuid) count once.

    Reductions are against `previous` rows (or `original`) and `original`, rounded to 2. It passes
    when coverage (if there is a history), error rate and duplicate rate all do.
    """
    raw = results.agg(F.count(F.lit(1)).alias("raw_count"))
    unique = results.dropDuplicates(["er_id", "er_uuid"])
    skipped = F.coalesce("match_skip", F.lit(False))
    reason = F.coalesce("match_skip_reason", F.lit("unknown"))
    named = ("error_recovery", "singleton_block", "missing_in_match_output", "unknown")
    n_of = lambda c: F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0))
    sums = unique.agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.count_if(skipped).alias("skipped"),
        *[F.count_if(skipped & (reason == r)).alias(r) for r in named],
        F.count_if(skipped & ~reason.isin(*named)).alias("other"),
        F.coalesce(F.sum(n_of(F.col("source_ids"))), F.lit(0)).alias("source_ids"),
        F.coalesce(F.sum(n_of(F.col("source_uuids"))), F.lit(0)).alias("source_uuids"),
        F.count_if(n_of(F.col("source_ids")) > 0).alias("entities_with_merges"),
    )
    one = raw.crossJoin(sums)
    if history is not None:
        c = uuid_coverage(unique, history)
        one = one.crossJoin(c.select("coverage_pct", F.col("invalid").alias("invalid_uuids"), F.col("missing").alias("missing_uuids"), F.col("passed").alias("coverage_passed")))
    else:
        one = one.withColumns({"coverage_pct": F.lit(None).cast("double"), "invalid_uuids": F.lit(None).cast("bigint"), "missing_uuids": F.lit(None).cast("array<string>"), "coverage_passed": F.lit(True)})
    error, copies = ratio(F.col("error_recovery") * 100, F.col("unique_count")), ratio((F.col("raw_count") - F.col("unique_count")) * 100, F.col("raw_count"))
    before = F.lit(original if previous is None else previous)
    ok = F.col("coverage_passed") & (error < ERROR_RATE) & (copies < DUPLICATE_RATE)
    return one.withColumns(
        {
            "duplicates": F.col("raw_count") - F.col("unique_count"),
            "processed": F.col("unique_count") - F.col("skipped"),
            "iteration_reduction_pct": F.round(reduction(before, F.col("unique_count")), 2),
            "overall_reduction_pct": F.round(reduction(F.lit(original), F.col("unique_count")), 2),
            "error_rate_pct": error,
            "duplicate_rate_pct": copies,
            "status": F.when(ok, "PASS").otherwise("FAIL"),
        }
    )


def format_report(report: dict[str, Any]) -> str:
    """The report's row as lines of text."""
    width = max(map(len, report))
    return "\n".join(["Entity resolution report", "=" * (width + 16), *[f"{k:<{width}}  {'-' if v is None else f'{v:.4g}' if isinstance(v, float) else v}" for k, v in report.items()]])
