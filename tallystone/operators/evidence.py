"""Evidence pools: ranking, budgets, citation allow-lists, and what the evidence supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.text import estimate_tokens

# The budget in estimated tokens, and the flat allowances.
TOKEN_BUDGET, BASE_TOKENS, ITEM_TOKENS = 4000, 50, 20
POOL_LIMITS = {"contract": 6, "legal": 6, "financial": 8, "analysis": 6}


def clamp_relevance(score: Column) -> Column:
    finite = F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite, F.lit(0.0))))


def dedupe_and_rank(items: DataFrame, by: list[str], key: str, limit: int | Column, relevance: str = "relevance", ordinal: str = "ordinal") -> DataFrame:
    """Of each group the best ``limit`` items by relevance, one per key; ties go by ``ordinal``."""
    order = [F.desc(relevance), F.col(ordinal)]
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))).filter("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def trim_to_budget(items: DataFrame, by: list[str], budget: int = TOKEN_BUDGET, text: str = "excerpt", relevance: str = "relevance", ordinal: str = "ordinal") -> DataFrame:
    """Items of each group without the least relevant ones, dropped until the estimate fits ``budget``.

    The most relevant one stays whatever its size; of equal items the earlier goes first. Returns the
    items with ``tokens``. An item costs ITEM_TOKENS at least, so only so many of the most relevant can
    stay: the tasks cut each group to them before anything is shuffled.
    """
    best = Window.partitionBy(*by).orderBy(F.desc(relevance), F.desc(ordinal))
    few = items.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= max((budget - BASE_TOKENS) // ITEM_TOKENS, 1))
    out = few.withColumn("tokens", estimate_tokens(F.col(text)) + ITEM_TOKENS)
    upto = F.sum("tokens").over(best.rowsBetween(Window.unboundedPreceding, 0)) + BASE_TOKENS
    return out.withColumn("_keep", (upto <= budget) | (F.col("_n") == 1)).filter("_keep").drop("_keep", "_n")


def allowed_citations(cited: DataFrame, allowed: DataFrame, on: list[str], by: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Cited rows that the allow-list has, the first of each kept."""
    kept = cited.join(allowed.select(*by, *on).distinct(), [*by, *on], "left_semi")
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *on).orderBy(ordinal))).filter("_n = 1").drop("_n")


def unknown_citations(cited: DataFrame, retrieved: DataFrame, on: list[str]) -> DataFrame:
    return cited.join(retrieved, on, "left_anti")


def evidence_status(n_contract: Column, n_legal: Column, n_facts: Column, n_warnings: Column) -> Column:
    """'none' without evidence, 'partial' with a warning, else 'sufficient'."""
    return F.when(n_contract + n_legal + n_facts == 0, "none").when(n_warnings > 0, "partial").otherwise("sufficient")


# Relevance of financial facts and of findings of the analysis, and the authorities.
FACT_RELEVANCE = {
    "monthly_payment": 1.0, "total_cost": 0.95, "annual_commitment": 0.9, "contract_duration": 0.85, "fee": 0.8, "penalty": 0.8, "total_known_fees": 0.75, "total_known_penalties": 0.75, "financing_cost": 0.72,
    "upfront_exposure": 0.7, "total_exposure": 0.7, "fees_to_base_cost_ratio": 0.6, "penalties_to_base_cost_ratio": 0.6,
}
FACT_LABELS = {
    "monthly_payment": "Monthly payment", "annual_commitment": "Annual commitment", "contract_duration": "Contract duration", "total_cost": "Total known cost", "financing_cost": "Financing cost",
    "total_known_fees": "Total known fees", "total_known_penalties": "Total known penalties", "upfront_exposure": "Upfront exposure", "total_exposure": "Total known exposure",
    "fees_to_base_cost_ratio": "Fees-to-base-cost ratio", "penalties_to_base_cost_ratio": "Penalties-to-base-cost ratio",
}
SUMMARY_RELEVANCE, CLAUSE_RELEVANCE, MISSING_RELEVANCE = 0.9, 0.8, 0.5
FACT_AUTHORITY, ANALYSIS_AUTHORITY, CONTRACT_AUTHORITY = "financial_metrics_engine", "contract_analysis_engine", "user_contract"
# What each route needs evidence of.
ROUTE_NEEDS = {"contract": "c", "legal": "l", "financial": "f", "contract_and_legal": "cl", "contract_and_financial": "cf", "all": "clf", "general": ""}


def _fact(key: Column, label: Column, excerpt: Column, relevance: Column, citation: Column) -> Column:
    return F.struct(key.alias("fact_key"), label.alias("label"), excerpt.alias("excerpt"), relevance.alias("relevance"), citation.alias("citation"))


def financial_facts(metrics: DataFrame, fees: DataFrame, penalties: DataFrame) -> DataFrame:
    """What a contract's metrics state, a row per fact: contract_id, fact_key, label, excerpt, relevance,
    citation, authority.

    ``metrics``: contract_id and, as text or null, a column per key of FACT_LABELS. ``fees``: contract_id, id,
    label, said, frequency. ``penalties``: contract_id, id, label, said, trigger. Only what is said is a fact.
    """
    total = [F.when(F.col(k).isNotNull(), _fact(F.lit(k), F.lit(label), F.concat(F.lit(f"{label}: "), F.col(k)), F.lit(FACT_RELEVANCE[k]), F.lit(f"financialMetrics.{k}"))) for k, label in FACT_LABELS.items()]
    facts = metrics.select("contract_id", F.explode(F.array_compact(F.array(*total))).alias("f"))
    for rows, name, extra in ((fees, "fee", F.when(F.col("frequency") != "unknown", F.concat(F.lit(" ("), F.col("frequency"), F.lit(")")))), (penalties, "penalty", F.concat(F.lit(" (trigger: "), F.col("trigger"), F.lit(")")))):
        title = F.concat(F.lit(f"{name.capitalize()}: "), F.col("label"))
        one = _fact(F.concat(F.lit(f"{name}:"), F.col("id")), title, F.concat(title, F.lit(" — "), F.col("said"), F.coalesce(extra, F.lit(""))), F.lit(FACT_RELEVANCE[name]), F.concat(F.lit(f"financialMetrics.{name}["), F.col("id"), F.lit("]")))
        facts = facts.unionByName(rows.filter("said IS NOT NULL").select("contract_id", one.alias("f")))
    return facts.select("contract_id", "f.*", F.lit(FACT_AUTHORITY).alias("authority"))


def analysis_facts(analyses: DataFrame, clauses: DataFrame, most: int = POOL_LIMITS["analysis"]) -> DataFrame:
    """The same of an analysis: its summary unless blank, its first clauses, and what it misses.

    ``analyses``: contract_id, summary, missing (array of field names). ``clauses``: contract_id, ordinal,
    title, summary, numbered from 0 in order; the first ``most`` of a contract count.
    """
    fields = F.array_join("missing", ", ")
    summary = F.when(F.coalesce(F.trim("summary"), F.lit("")) != "", _fact(F.lit("contract_summary"), F.lit("Contract summary"), F.col("summary"), F.lit(SUMMARY_RELEVANCE), F.lit("contractAnalysis.contractSummary")))
    gaps = F.when(F.size("missing") > 0, _fact(F.lit("missing_information"), F.lit("Missing information"), F.concat(F.lit("Missing information: "), fields), F.lit(MISSING_RELEVANCE), F.lit("contractAnalysis.missingInformation")))
    facts = analyses.select("contract_id", F.explode(F.array_compact(F.array(summary, gaps))).alias("f"))
    n = (F.row_number().over(Window.partitionBy("contract_id").orderBy("ordinal")) - 1).cast("string")
    numbered = clauses.withColumn("_n", n).filter(F.col("_n").cast("int") < most)
    one = _fact(F.concat(F.lit("important_clause:"), F.col("_n")), F.concat(F.lit("Clause: "), F.col("title")), F.concat(F.col("title"), F.lit(" — "), F.col("summary")), F.lit(CLAUSE_RELEVANCE), F.concat(F.lit("contractAnalysis.importantClauses["), F.col("_n"), F.lit("]")))
    return facts.unionByName(numbered.select("contract_id", one.alias("f"))).select("contract_id", "f.*", F.lit(ANALYSIS_AUTHORITY).alias("authority"))


def contract_citation(section: Column, chunk_order: Column) -> Column:
    """A passage by its section, else by its number from 1."""
    return F.concat(F.lit("Your contract — "), F.coalesce(section, F.concat(F.lit("passage "), (chunk_order + 1).cast("string"))))


def contract_evidence(hits: DataFrame) -> DataFrame:
    """Hits of a search (chunk_id, section, chunk_order, score, excerpt; more columns stay) as evidence."""
    return hits.withColumns({"source": F.lit("contract"), "authority": F.lit(CONTRACT_AUTHORITY), "citation": contract_citation(F.col("section"), F.col("chunk_order")), "relevance": clamp_relevance(F.col("score"))})


def legal_evidence(hits: DataFrame) -> DataFrame:
    """Hits of a search (chunk_id, authority, official_source_url, score, excerpt; more columns stay) as evidence."""
    return hits.withColumns({"source": F.lit("legal"), "citation": F.col("official_source_url"), "relevance": clamp_relevance(F.col("score"))})


def citation_allowlist(contract: DataFrame, legal: DataFrame, by: list[str]) -> DataFrame:
    """What an answer may cite: both kinds of evidence as ``by``, source, citation, label, authority, excerpt."""
    ours = contract.select(*by, "source", "citation", F.coalesce("section", F.concat(F.lit("Passage "), (F.col("chunk_order") + 1).cast("string"))).alias("label"), "authority", "excerpt")
    law = legal.select(*by, "source", "citation", F.coalesce("article_number", "section", "document_title").alias("label"), "authority", "excerpt")
    return ours.unionByName(law)


def sanitized(cited: DataFrame, allowed: DataFrame, on: list[str], by: list[str], ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """The citations that stay, and per answer how many were dropped: unknown ones and repeats."""
    kept = allowed_citations(cited, allowed, on, by, ordinal)
    counts = cited.groupBy(*by).agg(F.count("*").alias("_all")).join(kept.groupBy(*by).agg(F.count("*").alias("_kept")), by, "left")
    return kept, counts.select(*by, (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("dropped"))


def answer_confidence(route: Column, status: Column, n_citations: Column, n_facts: Column) -> Column:
    """'high' for the general route and for sufficient evidence that is cited as the route asks."""
    needs = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUTE_NEEDS.items() for x in kv]), route), F.lit(""))
    cites = ~needs.rlike("[cl]") | (n_citations > 0)
    facts = ~needs.contains("f") | (n_facts > 0)
    return F.when(route == "general", "high").when(status == "none", "low").when(status == "partial", "medium").otherwise(F.when(cites & facts, "high").otherwise("medium"))


def merged_unavailable(*lists: Column) -> Column:
    """Names of figures that several calculators could not give, each once, in order."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def grounded_context(items: DataFrame, by: str, question: str = "question", route: str = "route") -> DataFrame:
    """One text per answer (``by``): route, question, then its pools in order, each item under its number.

    ``items``: by, question, route, pool ('contract', 'legal', 'financial' or 'analysis', or null for an
    answer without evidence), rank, citation, excerpt. Question and excerpts stand between marks that say
    they are data. Pools are bounded by their limits and the token budget before they come here.
    """
    quoted = lambda t: F.concat(F.lit("--- BEGIN DATA ---\n"), t, F.lit("\n--- END DATA ---"))
    place = F.array_position(F.array(*[F.lit(p) for p in POOL_LIMITS]), F.col("pool"))
    line = F.concat(F.lit("["), F.upper(F.substring("pool", 1, 1)), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.lit("\n"), quoted(F.col("excerpt")))
    one = F.when(F.col("pool").isNotNull(), F.struct(place.alias("p"), F.col("rank").alias("r"), line.alias("t")))
    lists = items.groupBy(by).agg(F.first(route).alias("_route"), F.first(question).alias("_question"), F.array_sort(F.collect_list(one)).alias("_items"))
    body = F.when(F.size("_items") > 0, F.array_join(F.transform("_items", lambda x: x["t"]), "\n\n")).otherwise("No evidence was found for this question.")
    return lists.select(by, F.concat_ws("\n\n", F.concat(F.lit("Route: "), F.col("_route")), F.concat(F.lit("Question:\n"), quoted(F.col("_question"))), body).alias("context"))
