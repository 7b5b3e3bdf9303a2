"""Queries of the subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from tessera.llm import (
    op1_quality_classifier,
    op2_ngram_jaccard_join,
    op3_token_counts,
    op4_quotation_linking,
    op5_best_fit_packing,
    op6_suffix_array_dedup,
    op7_soft_mixing,
    op8_exact_dedup,
    op9_substring_dedup,
    op10_topk_search,
)

MODULES = (
    op1_quality_classifier,
    op2_ngram_jaccard_join,
    op3_token_counts,
    op4_quotation_linking,
    op5_best_fit_packing,
    op6_suffix_array_dedup,
    op7_soft_mixing,
    op8_exact_dedup,
    op9_substring_dedup,
    op10_topk_search,
)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
