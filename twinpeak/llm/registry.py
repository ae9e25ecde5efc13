"""Corpus queries: name -> (Spark callable, SQL text or None)."""

from . import (
    alignment,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    sentencepieces,
    substring_dedup,
    turn_repair,
)

QUERIES = {
    "op1_sentencepiece": (sentencepieces.op1, None),
    "op2_source_mixing": (mixing.op2, mixing.SQL),
    "op3_substring_dedup": (substring_dedup.op3, None),
    "op4_ngram_jaccard_join": (jaccard_join.op4, jaccard_join.SQL),
    "op5_quality_classifier": (quality_classifier.op5, None),
    "op6_exact_dedup": (exact_dedup.op6, exact_dedup.SQL),
    "op7_quality_rules": (quality_rules.op7, quality_rules.SQL),
    "op8_line_dedup": (line_dedup.op8, line_dedup.SQL),
    "op9_secret_scans": (secrets.op9, secrets.SQL),
    "op10_language_id": (language_id.op10, None),
    "op11_packing": (packing.op11, None),
    "op12_token_alignment": (alignment.op12, None),
    "op13_conversation_repair": (turn_repair.op13, None),
}
