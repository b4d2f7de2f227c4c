import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < docs.count() and out.count() == out.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "suffix_dedup", "decontaminate", "byte_bpe"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns and first.count() == docs.count()
