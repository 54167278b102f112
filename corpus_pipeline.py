"""A training corpus from raw documents, in five stages. Each works on what the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import table
from kinfold.llm.decontaminate import Decontaminator, drop_leaks
from kinfold.llm.line_dedup import dedup_lines
from kinfold.llm.near_dedup import near_dedup
from kinfold.llm.pieces import segment
from kinfold.llm.queries import TOKENIZERS
from kinfold.llm.toxicity import drop_toxic, train
from kinfold.session import shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go.

    Those with NULL text stay; those that are empty or without words are scored like labelled ones
    without any of the lexicon's terms. Repeated rows go or stay alike. Without labels all stay.
    """
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def dedup_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line stays where it comes first, by doc_id, NULL last; documents left without text go.

    Those whose text is NULL, empty or blank stay as they are; of repeated equal rows the first stays.
    """
    return dedup_lines(docs, n_chars="n_chars")


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the lowest doc_id, NULL last.

    Those with NULL text or without words are in no group and stay; repeated equal rows are a group.
    """
    return near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Those with NULL or empty text stay; repeated rows go or stay alike. Without benchmark all stay.
    """
    return drop_leaks(docs, Decontaminator(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled segmentations, which decode to its text, besides its other columns.

    NULL text has NULL in the new columns, the empty one no samples; repeated rows get equal samples.
    """
    return segment(docs, f"{TOKENIZERS}/piece_bpe_32k.model", keep=[c for c in docs.columns if c not in ("doc_id", "text")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_repeated_lines),
    ("near dedup", dedup_near_copies),
    ("decontamination", decontaminate),
    ("segmentation", encode),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each stage's result but the last is written and read again, so a
    lost executor costs no more than the stage that is running. A stage's table is removed when the
    next one's is written; the last one stays, as the result is made from it. An empty table gives
    no rows."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"

    def step(docs: DataFrame, stage: tuple[int, tuple[str, Callable]]) -> DataFrame:
        k, (_, function) = stage
        out = function(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
        return spark.read.parquet(f"{folder}/{k}")

    return functools.reduce(step, enumerate(STAGES), table(spark, sf_dir, "documents"))
