"""Blocks: by keys, by vectors, cut to size, measured."""

from __future__ import annotations

from math import isqrt

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
import pyspark.sql.functions as F

from kinfold.functions.text import name_keys
from kinfold.functions.vectors import dot, norm
from kinfold.session import checkpointed


def effective_target(target: int, iteration: int, floor: int = 10) -> int:
    """Blocks shrink round by round."""
    return max(floor, target // max(1, iteration))


def with_size(assigned: DataFrame) -> DataFrame:
    """er_id, block_key and the block's size."""
    sizes = assigned.groupBy("block_key").agg(F.count(F.lit(1)).cast("int").alias("block_size"))
    return assigned.join(sizes, "block_key").select("er_id", "block_key", "block_size")


def key_blocks(df: DataFrame, key: Column, id_column: str = "er_id") -> DataFrame:
    """Rows that share a key. `key` is a string or an array of strings; NULL and '' block nothing."""
    keyed = df.select(F.col(id_column).alias("er_id"), key.alias("block_key"))
    if dict(keyed.dtypes)["block_key"].startswith("array"):
        keyed = keyed.select("er_id", F.explode("block_key").alias("block_key")).distinct()
    return with_size(keyed.where("block_key IS NOT NULL AND block_key <> ''"))


def name_blocks(df: DataFrame, name: str = "name", id_column: str = "er_id") -> DataFrame:
    """Blocks by every key of the name."""
    return key_blocks(df, name_keys(F.col(name)), id_column)


def assign_nearest(rows: DataFrame, centroids: DataFrame, id_column: str = "er_id", vector: str = "embedding", most_mb: int = 64) -> DataFrame:
    """Each row's centroid of greatest inner product, lowest `centroid` among equals; NULL for a NULL vector.

    `centroids` (centroid, center) goes to every task if its numbers take `most_mb` or less; each row
    is then one task's work, without a shuffle. A larger set goes in parts of that size, one after
    another, and rows keep their best so far in a checkpoint between them.
    """
    numbers = centroids.agg(F.coalesce(F.sum(F.size("center")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, int(-(-8 * numbers // (most_mb * 2**20))))
    kind = "struct<s: double, k: bigint>"
    found = rows.select(id_column, F.col(vector).alias("__v"), F.lit(None).cast(kind).alias("__best"))
    for p in range(parts):
        mine = centroids if parts == 1 else centroids.where(F.pmod(F.xxhash64("centroid"), F.lit(parts)) == p)
        packed = mine.agg(F.array_sort(F.collect_list(F.struct("centroid", "center"))).alias("__all"))
        best = F.reduce(
            F.transform("__all", lambda c: F.struct(dot(F.col("__v"), c["center"]).alias("s"), (-c["centroid"]).alias("k"))),
            F.col("__best"),
            lambda a, x: F.when(x["s"].isNotNull() & (a.isNull() | (x > a)), x.cast(kind)).otherwise(a),
        )
        found = found.crossJoin(F.broadcast(packed)).select(id_column, "__v", best.alias("__best"))  # one row, of a checked size
        if parts > 1:
            found = checkpointed(found)
    return found.select(id_column, (-F.col("__best.k")).alias("centroid"))


def vector_blocks(df: DataFrame, id_column: str = "er_id", vector: str = "embedding", target: int = 30, iteration: int = 1, seed: int = 42, train_rows: int | None = None) -> DataFrame:
    """Blocks of about `target` rows by spherical k-means; a single one where there are no more rows.

    There are min(rows / target, sqrt(rows)) centroids, fitted to all rows, or to about `train_rows`
    of them by hash if that is given; all rows are assigned. Vectors without a direction (all zero)
    are a block of their own. NULL vectors block nothing. Fewer than two centroids make one block.
    """
    rows = df.select(F.col(id_column).alias("er_id"), F.col(vector).alias("v")).where("v IS NOT NULL")
    flat = norm(F.col("v")) == 0
    count = rows.agg(F.count_if(~flat).alias("n"), F.count(F.lit(1)).alias("every")).first()
    n, size = count["n"], effective_target(target, iteration)
    k = min(n // size, isqrt(n))
    if count["every"] <= size:
        return with_size(rows.select("er_id", F.lit("block_0").alias("block_key")))
    zero = rows.where(flat).select("er_id", F.lit("block_zero").alias("block_key"))
    if k < 2:
        return with_size(rows.where(~flat).select("er_id", F.lit("block_0").alias("block_key")).union(zero))
    vectors = rows.where(~flat).select("er_id", array_to_vector("v").alias("features"))
    share = min(1.0, train_rows / n) if train_rows else 1.0
    fit = vectors if share == 1.0 else vectors.where(F.pmod(F.xxhash64("er_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    model = KMeans(k=k, distanceMeasure="cosine", seed=seed, initSteps=2, maxIter=20).fit(fit)
    put = model.transform(vectors).select("er_id", F.concat(F.lit("block_"), F.col("prediction").cast("string")).alias("block_key"))
    return with_size(put.union(zero))


def salt(blocks: DataFrame, most: int, order: str = "er_id") -> DataFrame:
    """Cuts blocks of more than `most` rows to runs of that length in `order`: adds `salt_id`, 0 for
    the others. One window over the block key, by which `key_blocks` has its rows together already."""
    place = F.row_number().over(Window.partitionBy("block_key").orderBy(order)) - 1
    run = F.when(F.col("block_size") > most, F.floor(place / most)).otherwise(0)
    return blocks.withColumn("salt_id", run.cast("int"))


def first_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """The rows of the first n block keys, by key; see `other_blocks` for the rest."""
    return blocks.join(blocks.select("block_key").distinct().orderBy("block_key").limit(n), "block_key", "left_semi")


def other_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """The rows that `first_blocks` leaves: they pass on unmatched and aren't lost."""
    return blocks.join(blocks.select("block_key").distinct().orderBy("block_key").limit(n), "block_key", "left_anti")


def nested(rows: DataFrame, blocks: DataFrame, kind: str = "name") -> DataFrame:
    """One row for each block with its entities, lowest er_id first."""
    inside = F.array_sort(F.collect_list(F.struct("er_id", *[c for c in rows.columns if c != "er_id" and not dict(rows.dtypes)[c].startswith("map")])))
    joined = rows.join(blocks.select("er_id", "block_key"), "er_id")
    return joined.groupBy("block_key").agg(inside.alias("entities"), F.count(F.lit(1)).alias("block_size")).withColumn("block_key_type", F.lit(kind))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def reduction_ratio(candidates: Column, total: Column) -> Column:
    """1 - candidate pairs / all pairs; 0 where there are none."""
    return F.coalesce(F.lit(1.0) - F.try_divide(candidates.cast("double"), total.cast("double")), F.lit(0.0))


def blocking_stats(blocks: DataFrame) -> DataFrame:
    """One row: blocks, rows, average and greatest size, single-row blocks, pairs, reduction ratio."""
    size = blocks.groupBy("block_key").agg(F.count(F.lit(1)).alias("n"))
    s = size.agg(
        F.count(F.lit(1)).alias("total_blocks"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_entities"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_block_size"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_block_size"),
        F.count_if(F.col("n") == 1).alias("singleton_blocks"),
        F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0.0)).cast("bigint").alias("candidate_pairs"),
    )
    return s.withColumn("reduction_ratio", reduction_ratio(F.col("candidate_pairs"), pairs_of(F.col("total_entities"))))
