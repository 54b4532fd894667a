"""The queries of this subpackage, with their oracles."""

from __future__ import annotations

from tidemark.llm import conversation_repair, decontaminate, divergence, language_id, lm_score, mixing, pii, quality_classifier, quality_rules, simhash, substring_dedup, token_count, toxicity

QUERIES = {
    "op1_pii": pii.query,
    "op2_language_id": language_id.query,
    "op3_decontaminate": decontaminate.query,
    "op4_lm_score": lm_score.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_quality_rules": quality_rules.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_mixing": mixing.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_token_count": token_count.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_source_divergence": divergence.query,
    "op13_toxicity": toxicity.query,
}
ORACLES = {"op1_pii": pii.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "op7_substring_dedup": substring_dedup.ORACLE, "op8_mixing": mixing.ORACLE, "op12_source_divergence": divergence.ORACLE}
