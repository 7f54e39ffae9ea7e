"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import importance, jaccard, language_id, licences, mixing, packing, quality, secrets, token_counts, token_files, vectors, whitening

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_exact_top_k": vectors.op2_exact_top_k,
    "op3_language_id": language_id.op3_language_id,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_multi_index": vectors.op5_multi_index,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_token_files": token_files.op9_token_files,
    "op10_packing": packing.op10_packing,
    "op11_license_scan": licences.op11_license_scan,
    "op12_whitening": whitening.op12_whitening,
    "op13_importance_resampling": importance.op13_importance_resampling,
    "packed_conversations": packing.packed_conversations,
}

ORACLE_SQL = vectors.ORACLE_SQL | jaccard.ORACLE_SQL | mixing.ORACLE_SQL | importance.ORACLE_SQL
