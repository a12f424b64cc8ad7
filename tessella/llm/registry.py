"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, secrets, token_counts, token_files, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLES = {"op1_secrets": secrets.ORACLE, "op2_lm_scoring": lm_scoring.ORACLE, "op10_decontamination": decontaminate.ORACLE}
