"""Queries of the training-data operators."""

from __future__ import annotations

from . import html_extract, language_id, mixing, ngram_join, packing, quality_rules, token_counts, toxicity, url_filters, winnowing

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": language_id.op2_language_id,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_fingerprints": winnowing.op8_fingerprints,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op7_url_filters": url_filters.ORACLE_SQL,
}
