import os

import pytest
from compare import connect, differences

import corpus_pipeline
from tenura.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TENURA_TEST_DATA", "/root/testdata/sf0.001")

COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "score", "predicted"},
    "op3_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op6_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7_nearest": {"query_id", "rank", "vec_id", "score"},
    "op8_simhash": {"doc_id", "fingerprint", "component_id"},
    "op9_html": {"page_id", "url", "text", "n_chars"},
    "op10_language": {"doc_id", "held_out", "lang_pred", "score"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, DATA)
    assert COLUMNS[name] <= set(got.columns)
    if name not in ("op7_nearest", "op9_html"):
        assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(DATA), ORACLES[name]) == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "identify_language",
        "drop_near_duplicates",
        "drop_benchmark_passages",
        "redact_secrets",
        "encode_pieces",
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert encoded.where("NOT round_trip").count() == 0
