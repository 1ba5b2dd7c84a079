"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from filigree.llm import centroids, fingerprints, licenses, line_dedup, mixing, ngram_join, packing, quality, substring_dedup, token_counts, token_shards, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op1_license_passages": licenses.op1_license_passages,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_token_shards": token_shards.op11_token_shards,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op3_near_duplicates": fingerprints.op3_near_duplicates,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_quality_rules": quality.op9_quality_rules,
}

ORACLE_SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op12_centroid_clustering": centroids.OP12_SQL,
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_quality_rules": quality.OP9_SQL,
}
