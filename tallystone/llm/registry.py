"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import alignment, chat_formatting, decontamination, exact_dedup, language_id, manifest, mixing, near_dedup, sharding, simhash, suffix_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.query,
        "op2_language_id": language_id.query,
        "op3_mixing": mixing.query,
        "op4_decontamination": decontamination.query,
        "op5_sharding": sharding.query,
        "op6_near_dedup": near_dedup.query,
        "op7_chat_formatting": chat_formatting.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_toxicity": toxicity.query,
        "op10_suffix_dedup": suffix_dedup.query,
        "op11_manifest": manifest.query,
        "op12_alignment": alignment.query,
        "op13_simhash": simhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.ORACLE_SQL,
        "op6_near_dedup": near_dedup.ORACLE_SQL,
        "op7_chat_formatting": chat_formatting.ORACLE_SQL,
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_manifest": manifest.ORACLE_SQL,
    }
