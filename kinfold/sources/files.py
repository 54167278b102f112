"""Readers and writers of entity tables, blocks, decisions and results."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
import pyspark.sql.functions as F
import pyspark.sql.types as T

from kinfold.operators.schema import DECISIONS


def load(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """A table by its path: iceberg://table, or a .parquet, .csv, .tsv or .jsonl file or folder."""
    if path.startswith("iceberg://"):
        return iceberg(spark, path.removeprefix("iceberg://"), **options)
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".csv", ".tsv"):
        return delimited(spark, path, "\t" if kind == ".tsv" else ",", **options)
    if kind in (".jsonl", ".json"):
        return spark.read.json(path)
    raise ValueError(f"unsupported file format {kind or path!r}")


def delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, quoted fields that may span lines, as UTF-8, or as Latin-1 where it isn't.

    A scan for a line that isn't valid UTF-8, which stops at the first, decides between them.
    """

    def read(encoding: str) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)

    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).head(1)
    return read("ISO-8859-1" if broken else "UTF-8")


def delimited_in_zip(spark: SparkSession, path: str, name: str, into: str, sep: str = ",") -> DataFrame:
    """A member of a zip file, by the end of its name, unpacked to `into` (a folder that executors share)."""
    with zipfile.ZipFile(path) as z:
        hits = sorted((n for n in z.namelist() if PurePosixPath(n).name == PurePosixPath(name).name), key=len)
        if not hits:
            raise FileNotFoundError(f"{name} is not in {path}")
        out = Path(into) / PurePosixPath(name).name
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_bytes(z.read(hits[0]))
    return delimited(spark, str(out), sep)


def iceberg_conf(warehouse: str, catalog: str = "local") -> dict[str, str]:
    """Session settings of a file-based Iceberg catalog; its runtime jar must be on the class path."""
    at = f"spark.sql.catalog.{catalog}"
    return {"spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions", at: "org.apache.iceberg.spark.SparkCatalog", f"{at}.type": "hadoop", f"{at}.warehouse": warehouse}


def iceberg(spark: SparkSession, table: str, snapshot: int | None = None) -> DataFrame:
    return spark.table(table) if snapshot is None else spark.read.option("snapshot-id", snapshot).table(table)


def write_iceberg(df: DataFrame, table: str) -> None:
    df.writeTo(table).using("iceberg").createOrReplace()


def write_snapshot(df: DataFrame, folder: str, iteration: int) -> None:
    """A round's table, next to those of other rounds: time travel without a table format."""
    df.write.mode("overwrite").parquet(f"{folder}/iteration={iteration}")


def read_snapshot(spark: SparkSession, folder: str, iteration: int | None = None) -> DataFrame:
    """A round's table, the latest one without a number."""
    every = spark.read.option("basePath", folder).parquet(folder)
    at = iteration if iteration is not None else every.agg(F.max("iteration")).first()[0]
    return spark.read.parquet(f"{folder}/iteration={at}")


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a schema: one pass, and columns that no line has are NULL."""
    return spark.read.schema(schema).json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISIONS).json(path)


def read_truth(spark: SparkSession, path: str, left: str = "ltable_id", right: str = "rtable_id", offset: int = 0) -> DataFrame:
    """Distinct (a, b) of the labelled pairs that match; the right side's ids moved by `offset`."""
    rows = delimited(spark, path)
    if "label" in rows.columns:
        rows = rows.where("label = 1")
    return rows.select(F.col(left).cast("bigint").alias("a"), (F.col(right).cast("bigint") + offset).alias("b")).distinct()


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flattened(entities: DataFrame) -> DataFrame:
    """Attributes as columns of their own (numbered where the envelope has the name), lists as JSON."""
    keys = [r["k"] for r in entities.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().orderBy("k").collect()]
    taken = {c.lower() for c in entities.columns}
    out = [F.to_json(c).alias(c) if dict(entities.dtypes)[c].startswith("array") else F.col(c) for c in entities.columns if c != "attributes"]
    for k in keys:
        name = k
        while name.lower() in taken:
            name = f"attr_{name}"
        taken.add(name.lower())
        out.append(F.element_at("attributes", F.lit(k)).alias(name))
    return entities.select(*out)


def write_output(entities: DataFrame, folder: str, summary: dict[str, Any] | None = None) -> None:
    """resolved.parquet and resolved.csv, and summary.json if there is one."""
    flat = flattened(entities)
    flat.write.mode("overwrite").parquet(f"{folder}/resolved.parquet")
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/resolved.csv")
    if summary is not None:
        write_json(summary, f"{folder}/summary.json")


def write_json(value: dict[str, Any], path: str, spark: SparkSession | None = None) -> None:
    """A small result, such as one row of metrics, as a JSON file: on the driver's disk, or with a
    session on whatever file system the path names."""
    text = json.dumps(value, indent=2, default=str)
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def match_totals(resolutions: DataFrame) -> DataFrame:
    """One row: rows before and after matching, and the reduction in percent."""
    total = resolutions.agg(F.coalesce(F.sum("original_count"), F.lit(0)).alias("original_count"), F.coalesce(F.sum("resolved_count"), F.lit(0)).alias("resolved_count"))
    return total.withColumn("reduction_pct", F.coalesce(F.try_divide((F.col("original_count") - F.col("resolved_count")) * 100.0, F.col("original_count")), F.lit(0.0)))
