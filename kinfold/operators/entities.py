"""From any table to entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
import pyspark.sql.functions as F
import pyspark.sql.types as T

from kinfold.operators.schema import ENVELOPE, conform
from kinfold.session import checkpointed

NAME_COLUMNS = tuple("title name product_name company_name entity_name".split())
TWO_TABLE_NAMES = tuple("title name product_name product_title book_title".split())
Names = list[str] | None
RIGHT_OFFSET = 100_000


def _strings(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string"]


def name_column(df: DataFrame, wanted: tuple[str, ...] = NAME_COLUMNS) -> str:
    """The first wanted name that a column has, case aside; else the first string column but `id`;
    else the first column."""
    lower = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)
    hit = next((lower[w] for w in wanted if w in lower), None)
    return hit or next((c for c in _strings(df) if c.lower() != "id"), df.columns[0])


def text_columns(df: DataFrame, name: str) -> list[str]:
    """String columns but the name and `id`."""
    return [c for c in _strings(df) if c != name and c.lower() != "id"]


def dense_id(df: DataFrame, out: str = "er_id", order: str | None = None, start: int = 0) -> DataFrame:
    """Consecutive numbers from `start`, in the order of `order` (of arrival without it).

    No task sees more than its own partition: partitions are counted first, and each row is its
    partition's offset plus its place. The input is checkpointed, as both passes must see the same
    partitions. Ties in `order` get some order among themselves.
    """
    held = checkpointed(df.repartitionByRange(F.col(order).asc_nulls_last()).sortWithinPartitions(F.col(order).asc_nulls_last()) if order else df)
    mark = held.withColumn("__m", F.monotonically_increasing_id())
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in mark.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    offsets, total = [], start
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    before = df.sparkSession.createDataFrame(offsets, "__p bigint, __before bigint")
    return mark.withColumn("__p", part.cast("bigint")).join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + place).drop("__m", "__p", "__before")


def present(c: str, kind: T.DataType) -> Column:
    """NULL where a value is NULL or NaN."""
    return F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) if isinstance(kind, T.DoubleType | T.FloatType) else F.col(f"`{c}`")


def to_entities(df: DataFrame, id_column: str, name: str | None = None, texts: Names = None, entity_type: str = "entity", prefix: str = "", right: bool = False, two: bool = False) -> DataFrame:
    """Envelope rows. The name falls back to `entity_<id>`, or of `two` tables to the column `id` and
    then to "unknown", where an empty name counts as none. The description joins the text columns
    that aren't NULL, attributes hold every value that is there, as strings, under `prefix`. With
    `right`, ids are moved out of the left table's way and kept under it."""
    name = name or name_column(df)
    texts = text_columns(df, name) if texts is None else texts
    kinds = {f.name: f.dataType for f in df.schema.fields}
    value = {c: present(c, k).cast("string") for c, k in kinds.items() if isinstance(k, T.AtomicType)} | {c: F.to_json(f"`{c}`") for c, k in kinds.items() if not isinstance(k, T.AtomicType)}
    ident = F.col(f"`{id_column}`").cast("bigint") + (RIGHT_OFFSET if right else 0)
    pairs = [F.struct(F.lit(prefix + c).alias("k"), v.alias("v")) for c, v in value.items() if c != id_column]
    attributes = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())) if pairs else F.lit(None)
    fallback = F.coalesce(value.get("id", F.lit(None).cast("string")), F.lit("unknown")) if two else F.concat(F.lit("entity_"), ident.cast("string"))
    shown = F.nullif(F.coalesce(value[name], fallback), F.lit("")) if two else value[name]
    rows = df.select(
        ident.alias("er_id"),
        F.sha2(F.concat_ws("|", F.lit(entity_type), ident.cast("string")), 256).substr(1, 32).alias("er_uuid"),
        F.coalesce(shown, F.lit("unknown") if two else fallback).alias("name"),
        F.concat_ws(" ", *[value[c] for c in texts]).alias("description"),
        F.lit(entity_type).alias("entity_type"),
        attributes.alias("attributes"),
    )
    return conform(rows, ENVELOPE)


def two_tables(left: DataFrame, right: DataFrame, id_column: str, **how: object) -> DataFrame:
    """Both tables as one set of entities, with left and right attributes told apart."""
    return to_entities(left, id_column, prefix="l_", two=True, **how).unionByName(to_entities(right, id_column, prefix="r_", right=True, two=True, **how))


def embedding_text(fields: list[str] | None = None) -> Column:
    """The name and the named attributes that aren't empty, in that order."""
    return F.concat_ws(" ", F.col("name"), *[F.nullif(F.element_at("attributes", F.lit(f)), F.lit("")) for f in fields or []])
