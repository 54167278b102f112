"""Two-table benchmarks with known matches: read from disk, sampled, evaluated."""

from __future__ import annotations

import shutil
import urllib.request
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
import pyspark.sql.functions as F

from kinfold.operators.entities import RIGHT_OFFSET, TWO_TABLE_NAMES, dense_id, name_column, to_entities
from kinfold.operators.metrics import directed_metrics
from kinfold.sources.files import delimited, delimited_in_zip, read_truth

#: File names inside the public archives: left table, right table, mapping, the mapping's columns.
REGISTRY = {
    "abt-buy": ("Abt.csv", "Buy.csv", "abt_buy_perfectMapping.csv", "idAbt", "idBuy"),
    "dblp-acm": ("DBLP2.csv", "ACM.csv", "DBLP-ACM_perfectMapping.csv", "idDBLP", "idACM"),
    "dblp-scholar": ("DBLP1.csv", "Scholar.csv", "DBLP-Scholar_perfectMapping.csv", "idDBLP", "idScholar"),
}
DETAILS = {"abt-buy": ("products", "hard"), "dblp-acm": ("bibliographic", "easy"), "dblp-scholar": ("bibliographic", "medium")}


@dataclass
class TwoTables:
    """Left and right rows with `pos` 0.., and the true pairs (a, b), right ids moved by RIGHT_OFFSET."""

    name: str
    left: DataFrame
    right: DataFrame
    truth: DataFrame

    def entities(self) -> DataFrame:
        def side(df: DataFrame, right: bool) -> DataFrame:
            return to_entities(df, "pos", name_column(df.drop("pos"), TWO_TABLE_NAMES), prefix="r_" if right else "l_", right=right, two=True)

        return side(self.left, False).unionByName(side(self.right, True))

    def evaluate(self, predicted: DataFrame, cross_source_only: bool = False) -> DataFrame:
        """Rates of predicted pairs (a, b), in any order. A left table of more than RIGHT_OFFSET rows
        shares ids with the right one: a pair that can be read as (left, right) as it stands is."""
        last = self.left.agg(F.greatest(F.max("pos") + 1, F.lit(RIGHT_OFFSET)).alias("__end"))

        def sided(df: DataFrame) -> DataFrame:
            """Pairs of both tables as (left, right), others with the lower id first, told apart by `side`."""
            across = lambda x, y: (F.col(x) < F.col("__end")) & (F.col(y) >= RIGHT_OFFSET)
            kind = F.when(across("a", "b"), 1).when(across("b", "a"), 2).otherwise(0)
            k = df.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").crossJoin(F.broadcast(last)).select("a", "b", kind.alias("k"))  # one row
            a, b = (F.when(F.col("k") == 1, F.col(x)).when(F.col("k") == 2, F.col(y)).otherwise(f("a", "b")) for x, y, f in (("a", "b", F.least), ("b", "a", F.greatest)))
            return k.select(a.alias("a"), b.alias("b"), (F.col("k") > 0).alias("side")).where("side OR a < b")

        p = sided(predicted)
        return directed_metrics(p.where("side") if cross_source_only else p, sided(self.truth), ["side"])

    def sample_right(self, n: int, seed: int = 42) -> DataFrame:
        """All right rows that have a match, and others up to n rows, chosen by hash."""
        matched = self.truth.select((F.col("b") - RIGHT_OFFSET).alias("pos")).distinct()
        keep = self.right.join(matched, "pos", "left_semi")
        more = max(0, n - keep.count())
        rest = self.right.join(matched, "pos", "left_anti").orderBy(F.xxhash64("pos", F.lit(seed)), "pos").limit(more)
        return keep.unionByName(rest)


def positions(mapping: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """A mapping of string ids as pairs of positions; entries with an unknown id go."""
    x = left.select(F.col("id").cast("string").alias("__a"), F.col("pos").alias("a"))
    y = right.select(F.col("id").cast("string").alias("__b"), (F.col("pos") + RIGHT_OFFSET).alias("b"))
    m = mapping.select(F.col(a).cast("string").alias("__a"), F.col(b).cast("string").alias("__b"))
    return m.join(x, "__a").join(y, "__b").select("a", "b").distinct()


def fetch(name: str, folder: str, url: str) -> str:
    """The archive of a registered data set as `folder`/data.zip, from any address that the standard
    library opens; one that is there already is kept. Gives the folder, for `read`."""
    if name not in REGISTRY:
        raise ValueError(f"unknown data set {name!r}; there are {', '.join(sorted(REGISTRY))}")
    out = Path(folder) / "data.zip"
    if not out.exists():
        out.parent.mkdir(parents=True, exist_ok=True)
        part = out.with_suffix(".part")
        with urllib.request.urlopen(url) as source, part.open("wb") as sink:  # noqa: S310 - the caller's address
            shutil.copyfileobj(source, sink)
        part.rename(out)
    return str(out.parent)


def read(spark: SparkSession, name: str, folder: str) -> TwoTables:
    """From a folder with data.zip (a registered archive) or tableA.csv, tableB.csv and labelled splits."""
    root = Path(folder)
    archive = root / "data.zip"
    if archive.exists() and name in REGISTRY:
        files = REGISTRY[name]
        left, right, mapping = (delimited_in_zip(spark, str(archive), f, str(root / "unpacked")) for f in files[:3])
        left, right = dense_id(left, "pos"), dense_id(right, "pos")
        return TwoTables(name, left, right, positions(mapping, left, right, *files[3:]))
    tables = [root / "tableA.csv", root / "tableB.csv"]
    if all(t.exists() for t in tables):
        left, right = (delimited(spark, str(t)) for t in tables)
        splits = [read_truth(spark, str(root / f), offset=RIGHT_OFFSET) for f in sorted(f"{part}.csv" for part in ("test", "train", "valid")) if (root / f).exists()]
        empty = spark.createDataFrame([], "a bigint, b bigint")
        return TwoTables(name, left.withColumn("pos", F.col("id").cast("bigint")), right.withColumn("pos", F.col("id").cast("bigint")), reduce(DataFrame.union, splits, empty).distinct())
    raise FileNotFoundError(f"neither data.zip of a known dataset nor tableA.csv and tableB.csv in {folder}")
