"""Registered queries of this subpackage and the SQL of those that have it."""

from __future__ import annotations

from textloom.llm import exact, html, licenses, mixing, pieces, quality, ring, simhash, suffixes, topk


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_html": html.op2_html,
        "op3_licenses": licenses.op3_licenses,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_exact_dedup": exact.op5_exact_dedup,
        "op6_simhash": simhash.op6_simhash,
        "op7_quality": quality.op7_quality,
        "op8_topk": topk.op8_topk,
        "op9_sharding": ring.op9_sharding,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffixes.SQL, "op5_exact_dedup": exact.SQL, "op8_topk": topk.SQL, "op10_mixing": mixing.SQL}
