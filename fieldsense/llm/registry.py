"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from fieldsense.llm.byte_bpe import op9_byte_bpe
from fieldsense.llm.embedding_neardup import SQL as NEARDUP_SQL
from fieldsense.llm.embedding_neardup import op5_embedding_neardup
from fieldsense.llm.exact_topk import SQL as TOPK_SQL
from fieldsense.llm.exact_topk import op2_exact_topk
from fieldsense.llm.importance import SQL as IMPORTANCE_SQL
from fieldsense.llm.importance import op12_importance_resampling
from fieldsense.llm.language_id import op3_language_id
from fieldsense.llm.line_dedup import op1_line_dedup
from fieldsense.llm.ngram_jaccard import SQL as JACCARD_SQL
from fieldsense.llm.ngram_jaccard import op6_ngram_jaccard_join
from fieldsense.llm.periodic_runs import SQL as RUNS_SQL
from fieldsense.llm.periodic_runs import op13_periodic_runs
from fieldsense.llm.quality_rules import SQL as QUALITY_SQL
from fieldsense.llm.quality_rules import op11_quality_rules
from fieldsense.llm.sharding import op7_sharding
from fieldsense.llm.source_mixing import op10_source_mixing
from fieldsense.llm.token_counts import op4_token_counts
from fieldsense.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_neardup": op5_embedding_neardup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_source_mixing": op10_source_mixing,
    "op11_quality_rules": op11_quality_rules,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op2_exact_topk": TOPK_SQL,
    "op5_embedding_neardup": NEARDUP_SQL,
    "op6_ngram_jaccard_join": JACCARD_SQL,
    "op11_quality_rules": QUALITY_SQL,
    "op12_importance_resampling": IMPORTANCE_SQL,
    "op13_periodic_runs": RUNS_SQL,
}
