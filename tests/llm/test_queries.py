"""Every training-data query on the smallest tables: it runs, has its columns and a row for each row."""

import os

import pytest

import corpus_pipeline
from kinfold.llm import queries

DATA = "/root/testdata/sf0.001"
QUERIES = queries.queries(os.environ.get("TOKENIZERS", queries.TOKENIZERS)) | {"pipeline": corpus_pipeline.run}
COLUMNS = {
    "op1_decontamination": "doc_id item_id cosine lcs answer kind",
    "op2_lm_scoring": "doc_id n_words log_likelihood perplexity score",
    "op3_token_counts": "doc_id n_tokens fit_128 fit_512 fit_2048 prefix_counts",
    "op4_url_filter": "page_id url bad_score bad",
    "op5_line_dedup": "doc_id text lang source n_chars",
    "op6_toxicity": "doc_id score toxic terms neighbours",
    "op7_license_scan": "doc_id path license cosine line via from_path",
    "op8_minhash_near_dedup": "doc_id group_id keep",
    "op9_sentencepiece": "doc_id n_pieces exact samples",
    "op10_exact_dedup": "doc_id text lang source n_chars copies",
    "pipeline": "doc_id lang source n_chars n_pieces exact samples",
}
WHOLE = {"op2_lm_scoring": "documents", "op3_token_counts": "documents", "op4_url_filter": "pages", "op6_toxicity": "documents", "op7_license_scan": "documents", "op9_sentencepiece": "documents"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = QUERIES[name](spark, DATA)
    assert out.columns == COLUMNS[name].split() and set(COLUMNS) == set(QUERIES)
    n = len(out.collect())
    assert n > 0 and (name not in WHOLE or n == spark.read.parquet(f"{DATA}/{WHOLE[name]}.parquet").count())
