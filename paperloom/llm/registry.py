"""Queries of this subpackage by name, and the SQL that must give the same rows."""

from __future__ import annotations

from paperloom.llm import html_text, importance, jaccard, lm, merkle, mixing, near_dup, packing, quality, suffix_dedup, topk, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_packing": packing.query,
    "op3_quality_rules": quality.query,
    "op4_html_text": html_text.query,
    "op5_near_dup": near_dup.query,
    "op6_topk": topk.query,
    "op7_mixing": mixing.query,
    "op8_warc": warc.query,
    "op9_lm_score": lm.query,
    "op10_url_filter": url_filter.query,
    "op11_importance": importance.query,
    "op12_merkle": merkle.query,
    "op13_jaccard": jaccard.query,
}
ORACLES = {
    "op3_quality_rules": quality.SQL,
    "op6_topk": topk.SQL,
    "op7_mixing": mixing.SQL,
    "op8_warc": warc.SQL,
    "op10_url_filter": url_filter.SQL,
    "op11_importance": importance.SQL,
    "op12_merkle": merkle.SQL,
}
