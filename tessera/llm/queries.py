"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, jaccard_join, language, line_dedup, packing, secrets, sharding, substring_dedup, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_language_id": language.op2_language_id,
        "op3_jump_sharding": sharding.op3_jump_sharding,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_secret_ownership": secrets.op8_secret_ownership,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_window_dedup": substring_dedup.op10_window_dedup,
        "page_language_id": language.page_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jump_sharding": sharding.OP3_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op5_line_dedup": line_dedup.OP5_SQL,
        "op6_jaccard_join": jaccard_join.OP6_SQL,
        "op8_secret_ownership": secrets.OP8_SQL,
        "op10_window_dedup": substring_dedup.OP10_SQL,
    }
