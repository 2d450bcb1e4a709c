"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and is written as Parquet before the next
begins. All but the last return the columns of documents.

Defined cases: null and empty texts pass the first three stages as they are, are never taken by the mix (no words) and so
end there; a document that loses all its lines goes; rows that repeat an id are judged one by one, and of equal ones the
n-gram stage keeps one; a row with a null id keeps its lines and stays in the n-gram stage; an empty table gives an empty
result; texts of any length are read whole; columns that documents don't have are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldsense.llm import byte_bpe, line_dedup, ngram_jaccard, source_mixing, toxicity
from fieldsense.llm.common import DOCUMENT_COLUMNS, Scratch, discard, materialize, noted_in


def _after_the_last(stage, scratch: Scratch):
    """A stage that first deletes what earlier stages left in the shared folder: their results are written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.clear()
        with noted_in(scratch):
            return stage(spark, docs, sf_dir)

    return run


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), outputs=byte_bpe.DIGESTS)


def stages() -> list:
    """The stages of one pipeline; two pipelines in one driver take one list each."""
    scratch = Scratch()
    named = {
        "toxicity": toxicity.toxicity_stage,
        "line_dedup": line_dedup.line_dedup_stage,
        "ngram_jaccard_join": ngram_jaccard.near_duplicates_stage,
        "source_mixing": source_mixing.mix_stage,
        "byte_bpe": _encode,
    }
    return [(name, _after_the_last(stage, scratch)) for name, stage in named.items()]


STAGES = stages()

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's result is deleted when the next one's is written; the last result is lazy
    and reads the last but one."""
    docs, before, own = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT_COLUMNS), None, stages()
    for k, (name, stage) in enumerate(own):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(own):
            docs = materialize(docs, f"after-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
