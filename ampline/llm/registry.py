"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from ampline.llm import chat_format, collocations, decontaminate, dual_tree, exact_dedup, jaccard_join, language, license_scan, mixing, quality_classifier, token_counts, token_files, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_language_id": language.op8_language_id,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_token_files": token_files.op10_token_files,
    "op11_centroid_clusters": dual_tree.op11_centroid_clusters,
    "op12_quality": quality_classifier.op12_quality,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op3_chat_format": chat_format.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op11_centroid_clusters": dual_tree.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
