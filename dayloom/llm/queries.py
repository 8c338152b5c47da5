"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from dayloom.llm import (
    op1_neighbours, op2_tokens, op3_contamination, op4_substrings, op5_jaccard, op6_chat, op7_packing, op8_quality, op9_secrets, op10_lines,
    op11_language, op12_negatives, op13_phrases,
)

QUERIES = {
    "op1_neighbours": op1_neighbours.query,
    "op2_tokens": op2_tokens.query,
    "op3_contamination": op3_contamination.query,
    "op4_substrings": op4_substrings.query,
    "op5_jaccard": op5_jaccard.query,
    "op6_chat": op6_chat.query,
    "op7_packing": op7_packing.query,
    "op8_quality": op8_quality.query,
    "op9_secrets": op9_secrets.query,
    "op10_lines": op10_lines.query,
    "op11_language": op11_language.query,
    "op12_negatives": op12_negatives.query,
    "op13_phrases": op13_phrases.query,
}
SQL: dict[str, str] = {
    "op3_contamination": op3_contamination.SQL, "op5_jaccard": op5_jaccard.SQL, "op6_chat": op6_chat.SQL,
    "op12_negatives": op12_negatives.SQL, "op13_phrases": op13_phrases.SQL,
}
