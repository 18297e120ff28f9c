"""Queries of the training-data operators: name → (spark, sf_dir) → DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from encore.llm import bpe, chat, exact_dedup, langid, licenses, lm, mixing, near_dedup, quality, secrets, spelling, toxicity, vector_codes

QUERIES = {
    "op3_lm_scores": lm.op3_lm_scores,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op9_license_scan": licenses.op9_license_scan,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_language_id": langid.op5_language_id,
    "op10_chat_format": chat.op10_chat_format,
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op3_lm_scores": lm.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op9_license_scan": licenses.ORACLE_SQL,
    "op4_quality_rules": quality.ORACLE_SQL,
    "op10_chat_format": chat.ORACLE_SQL,
    "op1_secret_scan": secrets.ORACLE_SQL,
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
