"""Incremental blocking: each micro-batch of entities meets the stored key index."""

from __future__ import annotations

from pyspark.sql import DataFrame
import pyspark.sql.functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions.text import name_keys


def keyed(entities: DataFrame) -> DataFrame:
    """er_id and each of its name's keys, with the key's bucket, which partitions the index."""
    rows = entities.select("er_id", F.explode(name_keys(F.col("name"))).alias("block_key")).distinct()
    return rows.withColumn("bucket", F.pmod(F.xxhash64("block_key"), F.lit(64)).cast("int"))


def ingest(stream: DataFrame, index: str, pairs: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Appends each batch's keys to `index` and the candidate pairs that it makes, with earlier rows
    and within itself, to `pairs`; each pair comes with its later row's batch. A batch that is run
    again after a failure replaces its own folders, so nothing is written twice."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        keyed(df).write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/batch={number}")
        every = spark.read.option("basePath", index).schema("er_id bigint, block_key string, batch bigint, bucket int").parquet(index).where(F.col("batch") <= number)
        new = every.where(F.col("batch") == number).select("bucket", "block_key", F.col("er_id").alias("x"))
        met = new.join(every.select("bucket", "block_key", F.col("er_id").alias("y"), "batch"), ["bucket", "block_key"])
        # Within the batch each pair is met from both sides; with earlier rows from one.
        met = met.where((F.col("batch") < number) & (F.col("x") != F.col("y")) | (F.col("batch") == number) & (F.col("x") < F.col("y")))
        met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().write.mode("overwrite").parquet(f"{pairs}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
