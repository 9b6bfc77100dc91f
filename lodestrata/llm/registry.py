"""Queries and SQL of this package."""

from __future__ import annotations

from . import embeddings, language, line_dedup, mixing, near_duplicates, packing, quality_model, quality_rules, repeated_passages, resharding

QUERIES = {f.__name__: f for f in (
    quality_model.op1_factorisation_machine_quality,
    embeddings.op2_pca_tiled_near_dedup,
    packing.op3_vector_bin_packing,
    mixing.op4_poisson_mixing,
    quality_rules.op5_adaptive_quality_rules,
    resharding.op6_min_cost_flow_resharding,
    repeated_passages.op7_external_induced_sorting,
    line_dedup.op8_fuzzy_line_dedup,
    near_duplicates.op9_circulant_minhash,
    language.op10_compression_language_id,
)}
ORACLE_SQL = {"op4_poisson_mixing": mixing.OP4_SQL, "op5_adaptive_quality_rules": quality_rules.OP5_SQL}
