"""Local ids for a matcher, and back: restored lineage, recovered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
import pyspark.sql.functions as F

MISSING = "missing_in_match_output"
ERROR = "error_recovery"
SINGLETON = "singleton_block"


def local_ids(rows: DataFrame, keys: list[str], id_column: str = "er_id") -> DataFrame:
    """Numbers each block's rows 0..n-1 by id as `local_id`; earlier sources are taken out of sight,
    as a matcher could take them for local ids."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(id_column)) - 1
    hidden = {c: F.lit(None).cast(dict(rows.dtypes)[c]) for c in ("source_ids", "source_uuids") if c in rows.columns}
    return rows.withColumn("local_id", place.cast("bigint")).withColumns(hidden)


def _marked(rows: DataFrame, reason: str, iteration: int) -> DataFrame:
    history = F.coalesce("match_skip_history", F.array().cast("array<int>"))
    return rows.withColumns({"match_skip": F.lit(True), "match_skip_reason": F.lit(reason), "match_skip_history": F.concat(history, F.array(F.lit(iteration)))})


def skipped(rows: DataFrame, reason: str, iteration: int) -> DataFrame:
    """Rows that pass a round unmatched, with the reason and the round in their history."""
    return _marked(rows, reason, iteration)


def restore(resolved: DataFrame, rows: DataFrame, keys: list[str], iteration: int = 1) -> DataFrame:
    """A matcher's output (keys, local_id, name, description, source_local array) as envelope rows.

    Sources that the block has become their ids followed by what they had swallowed before, then
    the row's own earlier sources; each once, without the row itself. Local ids that the block
    doesn't have name nothing and go. Input rows that are neither resolved nor a source of one come
    back alone, marked as missing. So each input row is in exactly one output row's lineage, unless
    the matcher gave it to several.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("er_id")) - 1
    numbered = rows.withColumn("__local", place.cast("bigint"))
    out = resolved.select(*keys, F.col("local_id").alias("__local"), F.col("name").alias("__name"), F.col("description").alias("__description"), F.coalesce("source_local", F.array().cast("array<bigint>")).alias("__sources"))
    out = out.dropDuplicates([*keys, "__local"])
    used = out.select(*keys, F.explode(F.concat(F.array("__local"), "__sources")).alias("__local")).distinct()
    lost = _marked(numbered.join(used, [*keys, "__local"], "left_anti"), MISSING, iteration).drop("__local")
    own_ids, own_uuids = F.coalesce("source_ids", F.array().cast("array<bigint>")), F.coalesce("source_uuids", F.array().cast("array<string>"))
    named = out.select(*keys, F.col("__local").alias("__head"), F.posexplode("__sources").alias("__n", "__local"))
    known = numbered.select(*keys, "__local", F.concat(F.array("er_id"), own_ids).alias("__ids"), F.concat(F.array("er_uuid"), own_uuids).alias("__uuids"))
    gathered = named.join(known, [*keys, "__local"]).groupBy(*keys, "__head").agg(F.array_sort(F.collect_list(F.struct("__n", "__ids", "__uuids"))).alias("__all"))
    kept = numbered.join(out.drop("__sources"), [*keys, "__local"]).join(gathered.withColumnRenamed("__head", "__local"), [*keys, "__local"], "left")
    some = F.coalesce("__all", F.array().cast("array<struct<__n: int, __ids: array<bigint>, __uuids: array<string>>>"))
    flat = lambda f, own: F.array_distinct(F.concat(F.flatten(F.transform(some, lambda x: x[f])), own))
    ids = F.array_remove(flat("__ids", own_ids), F.col("er_id"))
    uuids = F.filter(flat("__uuids", own_uuids), lambda u: u.isNotNull() & ~u.eqNullSafe(F.col("er_uuid")))
    none = lambda c: F.when(F.size(c) > 0, c)
    back = kept.withColumns({"source_ids": none(ids), "source_uuids": none(uuids), "name": F.coalesce("__name", "name"), "description": F.coalesce("__description", "description")})
    return back.select(*rows.columns).unionByName(lost.select(*rows.columns))


def restore_decisions(decisions: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions on local ids as decisions on ids; those with an end that the block doesn't have keep
    both as they are, as nothing can be said about them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("er_id")) - 1
    ids = rows.select(*keys, place.cast("bigint").alias("__local"), "er_id")
    a = ids.select(*keys, F.col("__local").alias("entity_a_id"), F.col("er_id").alias("__a"))
    b = ids.select(*keys, F.col("__local").alias("entity_b_id"), F.col("er_id").alias("__b"))
    both = decisions.join(a, [*keys, "entity_a_id"], "left").join(b, [*keys, "entity_b_id"], "left")
    ok = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.withColumns({"entity_a_id": F.when(ok, F.col("__a")).otherwise(F.col("entity_a_id")), "entity_b_id": F.when(ok, F.col("__b")).otherwise(F.col("entity_b_id"))}).select(*decisions.columns)


def missing_ids(rows: DataFrame, resolved: DataFrame, id_column: str = "er_id") -> DataFrame:
    """Ids of input rows that the resolved rows neither are nor hold as a source."""
    used = resolved.select(F.explode(F.concat(F.array("er_id"), F.coalesce("source_ids", F.array().cast("array<bigint>")))).alias(id_column))
    return rows.select(id_column).join(used, id_column, "left_anti")
