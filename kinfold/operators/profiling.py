"""Profiles of all columns in one pass, and a resolve configuration from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
import pyspark.sql.functions as F
import pyspark.sql.types as T

from kinfold.functions.fields import decide, votes


def _text(c: str, kind: T.DataType) -> Column:
    """The value as a string; NULL for NULL, NaN and ''."""
    v = F.col(f"`{c}`")
    if isinstance(kind, T.DoubleType | T.FloatType):
        v = F.when(~F.isnan(v), v)
    s = v.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(v)
    return F.nullif(s, F.lit(""))


def _samples(rows: DataFrame, n: int) -> DataFrame:
    """The least n values of each column. The rank's limit is applied within tasks before the shuffle."""
    rank = F.dense_rank().over(Window.partitionBy("field").orderBy("value"))
    top = rows.where("value IS NOT NULL").select("field", "value", rank.alias("r")).where(F.col("r") <= n)
    return top.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("sample_values"))


def profile_columns(df: DataFrame, approximate: bool = False, samples: int = 5) -> DataFrame:
    """One row for each column: type, completeness and uniqueness (rounded to 4), sample values, and
    whether it is fit for blocking and for matching.

    Each row becomes (column, value) rows, whose counts and votes are added up in their task, so one
    row for each column leaves it. Distinct values are counted by two 64-bit hashes, combined in
    tasks too; no value itself is shuffled but the few that may be samples. Only one row for each
    column comes to the driver. `approximate` counts distinct values by sketch instead.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), _text(c, k).alias("value")) for c, k in kinds.items()])).alias("x")).select("x.field", "x.value") if kinds else None
    if long is None:
        return df.sparkSession.createDataFrame([], PROFILE)
    present = F.col("value").isNotNull()
    visible = present & (F.trim(F.col("value")) != "")
    looks = votes(F.col("value"))
    found = long.groupBy("field").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(present).alias("present"),
        F.count_if(visible).alias("visible"),
        *([F.approx_count_distinct("value").alias("distinct")] if approximate else []),
        *[F.count_if(visible & c).alias(f"as_{kind}") for kind, c in looks.items()],
    )
    if not approximate:
        hashed = long.where(present).select("field", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(7), "value").alias("h2")).distinct()
        found = found.join(hashed.groupBy("field").agg(F.count(F.lit(1)).alias("distinct")), "field", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    found = found.join(_samples(long, samples), "field", "left")
    out = []
    for r in found.collect():
        kind = decide(r["field"], r["visible"], {k: r[f"as_{k}"] for k in looks})
        completeness = r["present"] / r["rows"] if r["rows"] else 0.0
        uniqueness = min(1.0, r["distinct"] / r["present"]) if r["present"] else 0.0
        out.append((r["field"], kind, round(completeness, 4), round(uniqueness, 4), r["sample_values"] or [], kind in ("name", "identifier") and completeness >= 0.5, kind in MATCHED))
    seen = {o[0] for o in out}
    out += [(c, decide(c, 0, {}), 0.0, 0.0, [], False, decide(c, 0, {}) in MATCHED) for c in kinds if c not in seen]
    return df.sparkSession.createDataFrame(sorted(out), PROFILE)


MATCHED = frozenset("email identifier name text url".split())
PROFILE = "field string, inferred_type string, completeness double, uniqueness double, sample_values array<string>, is_blocking boolean, is_matching boolean"


def duplicate_rate(profile: DataFrame) -> DataFrame:
    """One row: 1 - the mean uniqueness of the name columns, between 0 and 1; 0 without any."""
    mean = F.avg(F.when(F.col("inferred_type") == "name", F.col("uniqueness")))
    return profile.agg(F.coalesce(F.least(F.greatest(1 - mean, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("estimated_duplicate_rate"))


def suggested_config(profile: DataFrame, rows: int) -> dict[str, object]:
    """A resolve configuration by rule: fullest, most distinct name column; text columns; block size."""
    fields = profile.collect()
    names = sorted((f for f in fields if f["inferred_type"] == "name"), key=lambda f: (-f["completeness"], -f["uniqueness"], f["field"]))
    return {
        "name_field": names[0]["field"] if names else None,
        "text_fields": [f["field"] for f in fields if f["inferred_type"] == "text"],
        "entity_type": "entity",
        "max_iterations": 5,
        "convergence_threshold": 0.01,
        "blocking": {"method": "semantic" if rows > 30 else "name", "target_block_size": 30, "max_block_size": 100},
    }
