"""Queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import ann, chat, lm, mixing, neardup, packing, pii, quality, repetition, suffixes


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_poisson_mix": mixing.op1_poisson_mix,
        "op2_semi_crf_pii": pii.op2_semi_crf_pii,
        "op3_repetition_rules": repetition.op3_repetition_rules,
        "op4_minhash_dedup": neardup.op4_minhash_dedup,
        "op5_pairwise_quality": quality.op5_pairwise_quality,
        "op6_maxent_lm": lm.op6_maxent_lm,
        "op7_role_repair": chat.op7_role_repair,
        "op8_suffix_dedup": suffixes.op8_suffix_dedup,
        "op9_best_two_fit": packing.op9_best_two_fit,
        "op10_multi_index": ann.op10_multi_index,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict:
    return {"op1_poisson_mix": mixing.SQL, "op3_repetition_rules": repetition.SQL, "op4_minhash_dedup": neardup.SQL, "op8_suffix_dedup": suffixes.SQL}
