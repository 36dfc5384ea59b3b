"""Registered queries of the package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowbook.llm import centroid_clustering, decontaminate, line_dedup, packing, quality_classifier, quality_rules, quality_rules_sql, secret_scan, sentencepiece_bpe, sharding, simhash, spelling, toxicity, warc

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": quality_rules.query,
    "op2_warc_boundary_chain": warc.query,
    "op3_fourier_quality_classifier": quality_classifier.query,
    "op4_kd_tree_sharding": sharding.query,
    "op5_suffix_array_line_dedup": line_dedup.query,
    "op6_trigram_secret_scan": secret_scan.query,
    "op7_compression_toxicity": toxicity.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_order_preserving_packing": packing.query,
    "op10_rare_seed_decontamination": decontaminate.query,
    "op11_pca_filtered_clustering": centroid_clustering.query,
    "op12_reduced_alphabet_spelling": spelling.query,
    "op13_vectorised_sentencepiece": sentencepiece_bpe.query,
}

SQL: dict[str, str] = {
    "op1_quality_divergence": quality_rules_sql.QUERY_SQL,
    "op2_warc_boundary_chain": warc.QUERY_SQL,
    "op11_pca_filtered_clustering": centroid_clustering.QUERY_SQL,
}
