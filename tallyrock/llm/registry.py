"""The training-data queries by name, and DuckDB SQL for those that SQL can express."""

from . import fingerprints, language_id, line_dedup, mixing, near_dedup, packing, quality, repeats, sharding, token_files


def queries() -> dict:
    found = (language_id.op1_language_id, quality.op2_quality_rules, near_dedup.op3_minhash_near_dedup, packing.op4_best_fit_packing, fingerprints.op5_syncmer_fingerprints, sharding.op6_hilbert_sharding, line_dedup.op7_line_dedup, mixing.op8_source_mixing, token_files.op9_token_files, repeats.op10_suffix_array_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": near_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op10_suffix_array_dedup": repeats.ORACLE}
