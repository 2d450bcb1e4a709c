"""The corpus pipeline on the small table."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "byte_bpe"]
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
        assert k == 4 or docs.columns == columns
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    whole = corpus_pipeline.run(spark, SF)
    assert whole.exceptAll(docs).isEmpty() and docs.exceptAll(whole).isEmpty()
    assert whole.filter(F.col("n_tokens").isNull()).isEmpty()
