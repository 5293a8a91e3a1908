"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from granula.llm import cross_polytope, importance, lexical, lm_scoring, media, mixing, near_dedup, pii, quality_rules, secret_scan, sentence_pieces, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op10_lm_scoring": lm_scoring.op10_lm_scoring,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_neighbours": cross_polytope.op12_neighbours,
        "op13_importance": importance.op13_importance,
        "op2_media_columns": media.op2_media_columns,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_pii": pii.op5_pii,
        "op6_sentence_pieces": sentence_pieces.op6_sentence_pieces,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_toxicity": toxicity.op9_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: their checksums, distances, merges and approximate results are tested against plain Python."""
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op11_lexical_search": lexical.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op8_secret_scan": secret_scan.ORACLE,
    }
