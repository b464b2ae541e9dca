"""Routing of questions to the evidence that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import wordlists as L
from tallystone.functions.text import normalize_question

# The sources of each route, and the confidence of a decision.
ROUTES = {
    "contract": ("contract",),
    "legal": ("legal",),
    "financial": ("financial",),
    "contract_and_legal": ("contract", "legal"),
    "contract_and_financial": ("contract", "financial"),
    "all": ("contract", "legal", "financial"),
    "general": (),
}
BASE, PER_SIGNAL, MOST, NONE, INJECTED = 0.5, 0.15, 0.95, 0.4, 0.95
PHRASES = {
    "ownership": L.ASKS_CONTRACT_OWNERSHIP,
    "structure": L.ASKS_CONTRACT_STRUCTURE,
    "financial_term": L.ASKS_FINANCIAL_TERM,
    "compute": L.ASKS_FINANCIAL_COMPUTE_TRIGGER,
    "legal_term": L.ASKS_LEGAL_TERM,
    "rights": L.ASKS_RIGHTS_QUESTION,
    "actor": L.ASKS_COMPARISON_ACTOR,
    "action": L.ASKS_COMPARISON_ACTION_STEM,
    "compare": L.ASKS_COMPARISON_EXPLICIT,
    "define": L.ASKS_DEFINITIONAL,
    "injection": L.ASKS_INJECTION,
}


def _any(normalised: Column, phrases: tuple[str, ...]) -> Column:
    """Substring match; the phrases are normalised like the question, once, when the plan is made."""
    out = F.lit(False)
    for p in phrases:
        out |= F.contains(normalised, normalize_question(F.lit(p)))
    return out


def question_signals(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``question`` (normalised) and a boolean per signal; a null text asks nothing."""
    out = rows.withColumn("question", F.coalesce(normalize_question(F.col(text)), F.lit("")))
    out = out.withColumns({name: _any(F.col("question"), phrases) for name, phrases in PHRASES.items()})
    out = out.withColumn("about_contract", F.expr("ownership or structure"))
    return out.withColumn("comparison", F.expr("compare or (rights and actor and action) or (legal_term and about_contract)"))


def route_questions(rows: DataFrame, text: str = "text") -> DataFrame:
    """Signals with ``route`` and ``confidence``; an attempt to override instructions queries nothing."""
    out = question_signals(rows, text)
    route = (
        F.when(F.col("injection"), "general")
        .when(F.expr("comparison and financial_term"), "all")
        .when(F.col("comparison"), "contract_and_legal")
        .when(F.expr("about_contract and financial_term"), "contract_and_financial")
        .when(F.col("about_contract"), "contract")
        .when(F.col("financial_term"), "financial")
        .when(F.col("legal_term"), "legal")
        .otherwise("general")
    )
    matched = sum(F.col(c).cast("int") for c in ("about_contract", "financial_term", "legal_term", "comparison"))
    scored = F.least(F.lit(MOST), F.round(BASE + PER_SIGNAL * matched, 2))
    confidence = F.when(F.col("injection"), INJECTED).when(route == "general", NONE).otherwise(scored)
    return out.withColumn("route", route).withColumn("confidence", confidence)


def missing_sources(rows: DataFrame, available: list[str]) -> DataFrame:
    """``rows`` with ``required`` and ``unavailable`` sources of their route; the route itself stays."""
    table = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    out = rows.withColumn("required", F.element_at(table, F.col("route")))
    return out.withColumn("unavailable", F.array_except("required", F.array(*[F.lit(s) for s in available]).cast("array<string>")))
