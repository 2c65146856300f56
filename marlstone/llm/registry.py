"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from marlstone.llm import embeddings, jaccard, licenses, lines, mixing, packing, quality, secrets, substring, tokens

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_embedding_near_dedup": embeddings.op6_embedding_near_dedup,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLES = {
    "op2_quality_rules": quality.ORACLE,
    "op3_ngram_jaccard": jaccard.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op6_embedding_near_dedup": embeddings.ORACLE,
    "op7_line_dedup": lines.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
}
