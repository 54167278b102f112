"""Exact dedup by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
import pyspark.sql.functions as F
import pyspark.sql.types as T

from kinfold.llm.common import numbered, position


def _orders(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orders(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _orders(kind.elementType)
    return not isinstance(kind, T.MapType | T.VariantType)


def exact_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id", salts: int = 16) -> DataFrame:
    """One row for each distinct content of `text`, with all its columns and the number of `copies`.

    Rows are combined three times: within their partition and then by (digest, salt), which the
    map and reduce sides of one grouping do, and by digest over the salts' winners. So no task
    gets more than 1/salts of a hot text's locally distinct rows. Every stage groups by the text
    itself besides the digest, so a digest collision can't merge two texts.

    The kept row has the lowest `order`, NULL last; among equal `order` the rows' other columns
    decide, compared as JSON, so the result doesn't depend on partitioning. NULL texts are a
    content of their own and '' another. An input column named `copies` stays and the count is
    then named `copies_1` (and so on). Empty input gives no rows.
    """
    names, o, t = docs.columns, position(docs, order), position(docs, text)
    count = "copies"
    k = 0
    while count.lower() in {n.lower() for n in names}:
        k += 1
        count = f"copies_{k}"
    cols = [f"__c{i}" for i in range(len(names))]
    rest = [c for i, c in enumerate(cols) if i not in (o, t)]
    key = F.col(f"__c{t}")
    tie = [F.col(c) if _orders(docs.schema[int(c[3:])].dataType) else F.to_json(F.struct(c)) for c in rest]
    rank = F.struct(F.col(f"__c{o}").isNull(), F.col(f"__c{o}"), *tie)
    rows = numbered(docs).select(
        F.xxhash64(key).alias("__d"),
        F.pmod(F.xxhash64(F.lit(5), F.col(f"__c{o}")), F.lit(salts)).cast("int").alias("__s"),
        key.alias("__t"),
        rank.alias("__rank"),
        F.struct(F.col(f"__c{o}").alias("__o"), *rest).alias("__row"),
    )
    best = [F.min_by("__row", "__rank").alias("__row"), F.min("__rank").alias("__rank")]
    local = rows.groupBy("__d", "__s", "__t").agg(*best, F.count(F.lit(1)).alias("__n"))
    won = local.groupBy("__d", "__t").agg(*best, F.sum("__n").alias("__n"))
    back = {o: F.col("__row.__o"), t: F.col("__t")}
    out = won.select(*[back.get(i, F.col(f"__row.{c}")).alias(c) for i, c in enumerate(cols)], F.col("__n").alias("__count"))
    return out.toDF(*names, count)
