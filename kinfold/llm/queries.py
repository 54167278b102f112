"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
import pyspark.sql.functions as F

from kinfold.llm import toxicity as tox
from kinfold.llm import url_filter
from kinfold.llm.common import table
from kinfold.llm.decontaminate import Decontaminator, leaks
from kinfold.llm.exact_dedup import exact_dedup
from kinfold.llm.hmm import lm_scores
from kinfold.llm.licenses import license_scan
from kinfold.llm.line_dedup import dedup_lines
from kinfold.llm.near_dedup import near_groups
from kinfold.llm.pieces import segment
from kinfold.llm.token_counts import token_counts

TOKENIZERS = "/opt/tokenizers"

Query = Callable[[SparkSession, str], DataFrame]


#: Host words that label a URL bad. The labels table says nothing about URLs: its rates are alike for all hosts.
SEED_WORDS = r"(^|[.-])(adult|porn|xxx|sex|casino|poker|bets?|slots|pills|pharma|viagra|spam|ads|adserver|tracker|malware|warez)([.-]|$)"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leaks(docs, Decontaminator(docs, table(spark, sf_dir, "benchmark")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.tiktoken")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, bad: the pages' URLs labelled by the seed words of their hosts."""
    pages = table(spark, sf_dir, "pages").select("url")
    return pages.select("url", url_filter.host_of(F.col("url")).rlike(SEED_WORDS).cast("int").alias("bad"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_scores(pages, url_filter.train(labelled_urls(spark, sf_dir)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), n_chars="n_chars")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tox.toxicity(docs, tox.train(docs, table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    return license_scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "keep")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return segment(table(spark, sf_dir, "documents"), f"{tokenizers}/piece_bpe_32k.model")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def queries(tokenizers: str = TOKENIZERS) -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_token_counts": partial(op3_token_counts, tokenizers=tokenizers),
        "op4_url_filter": op4_url_filter,
        "op5_line_dedup": op5_line_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_license_scan": op7_license_scan,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_sentencepiece": partial(op9_sentencepiece, tokenizers=tokenizers),
        "op10_exact_dedup": op10_exact_dedup,
    }


EDGE = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"

ORACLE_SQL = {
    "op5_line_dedup": f"""
        WITH split AS (
          SELECT doc_id, lang, source, text, string_split(text, chr(10)) AS parts FROM documents),
        lines AS (
          SELECT doc_id, i, parts[i] AS line, trim(parts[i], {EDGE}) AS bare
          FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY bare ORDER BY doc_id, i) AS rn FROM lines),
        kept AS (
          SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM ranked WHERE bare = '' OR rn = 1 GROUP BY doc_id),
        whole AS (
          SELECT s.doc_id, coalesce(k.text, '') AS text, s.lang, s.source, s.text AS before FROM split s LEFT JOIN kept k USING (doc_id))
        SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM whole
        WHERE trim(text, {EDGE} || chr(10)) <> '' OR before IS NULL OR trim(before, {EDGE} || chr(10)) = ''""",
    "op10_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars, copies FROM (
          SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, lang, source, n_chars) AS rn,
                 count(*) OVER (PARTITION BY text) AS copies
          FROM documents) WHERE rn = 1""",
}
