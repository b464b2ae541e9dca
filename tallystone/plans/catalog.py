"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallystone.plans import agreement_queries, clause_queries, concept_queries, document_queries, evidence_queries, finance_queries, recovery_queries, source_queries, store_queries, text_queries, validation_queries

_PARTS = (agreement_queries, text_queries, finance_queries, clause_queries, concept_queries, document_queries, recovery_queries, evidence_queries, source_queries, store_queries, validation_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search end to end: scan, join, text functions, vector distance, windows, top-k."""
    return text_queries.hybrid_contract_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
