"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, conversation_repair, exact_dedup, html_extraction, importance, language_id, ngram_join, packing, periodic_runs, pii, substring_dedup, topk_search, toxicity

QUERIES = {
    "op1_importance_resampling": importance.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_language_id": language_id.query,
    "op4_ngram_jaccard_join": ngram_join.query,
    "op5_exact_topk": topk_search.query,
    "op6_bpe_round_trip": bpe.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_best_fit_packing": packing.query,
    "op9_toxicity": toxicity.query,
    "op10_pii": pii.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_html_extraction": html_extraction.query,
    "op13_conversation_repair": conversation_repair.query,
}
ORACLES = {"op2_exact_dedup": exact_dedup.SQL, "op4_ngram_jaccard_join": ngram_join.SQL, "op5_exact_topk": topk_search.SQL}
