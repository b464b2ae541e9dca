"""Queries over evidence and answers, with their SQL; line items, orders and conversations stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators import display, evidence
from tallystone.plans.clause_queries import _CLAUSES
from tallystone.plans.document_queries import _view
from tallystone.session import table

_METRICS = "SELECT o_orderkey AS contract_id, " + ", ".join(f"CASE WHEN o_orderkey % {i + 2} > 0 THEN {i} || ' SAR' END AS {k}" for i, k in enumerate(evidence.FACT_LABELS)) + " FROM orders"
_COSTS = """SELECT l_orderkey AS contract_id, CAST(l_linenumber * 1000000 + l_partkey AS VARCHAR(20)) AS id, 'Item ' || l_returnflag AS label, l_extendedprice AS amount, CASE l_linenumber % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'monthly' END AS frequency,
  CASE WHEN l_suppkey % 2 = 0 THEN 'late' END AS trigger, CASE WHEN l_partkey % 5 = 0 THEN 'unavailable' WHEN l_partkey % 5 = 1 THEN 'estimated' ELSE 'known' END AS status, l_linestatus FROM lineitem"""


def financial_facts(spark: SparkSession, d: str) -> DataFrame:
    costs = _view(spark, d, _COSTS, "lineitem").withColumn("said", display.exact_money(F.col("amount"), F.lit("SAR"), F.col("status")))
    return evidence.financial_facts(_view(spark, d, _METRICS, "orders"), costs.filter("l_linestatus = 'F'"), costs.filter("l_linestatus = 'O'"))


_SAID = "format('{:,.2f}', amount) || ' SAR' || CASE WHEN status = 'estimated' THEN ' (estimated)' ELSE '' END"
_FACTS_SQL = " UNION ALL ".join(f"SELECT contract_id, '{k}' AS fact_key, '{label}' AS label, '{label}: ' || {k} AS excerpt, {evidence.FACT_RELEVANCE[k]}::DOUBLE AS relevance, 'financialMetrics.{k}' AS citation, 'financial_metrics_engine' AS authority FROM ({_METRICS}) WHERE {k} IS NOT NULL" for k, label in evidence.FACT_LABELS.items()) + "".join(
    f" UNION ALL SELECT contract_id, '{n}:' || id, '{n.capitalize()}: ' || label, '{n.capitalize()}: ' || label || ' — ' || {_SAID} || {extra}, 0.8::DOUBLE, 'financialMetrics.{n}[' || id || ']', 'financial_metrics_engine' FROM ({_COSTS}) WHERE l_linestatus = '{s}' AND status <> 'unavailable'"
    for n, s, extra in (("fee", "F", "CASE WHEN frequency <> 'unknown' THEN ' (' || frequency || ')' ELSE '' END"), ("penalty", "O", "coalesce(' (trigger: ' || trigger || ')', '')"))
)

_ANALYSES = "SELECT conv_id AS contract_id, CASE WHEN conv_id % 4 = 0 THEN ' ' ELSE 'Contract ' || conv_id END AS summary, CASE WHEN conv_id % 3 = 0 THEN {0} WHEN conv_id % 3 = 1 THEN {1} ELSE {2} END AS missing FROM conversations WHERE turn = 0"


def analysis_facts(spark: SparkSession, d: str) -> DataFrame:
    analyses = _view(spark, d, _ANALYSES.format("array('a')", "array('a', 'b')", "cast(array() AS array<string>)"), "conversations")
    return evidence.analysis_facts(analyses, _view(spark, d, _CLAUSES, "conversations"))


_ANALYSIS_SQL = f"""WITH a AS ({_ANALYSES.format("['a']", "['a', 'b']", "[]::VARCHAR[]")}), f AS (
SELECT contract_id, 'contract_summary' AS fact_key, 'Contract summary' AS label, summary AS excerpt, 0.9::DOUBLE AS relevance, 'contractAnalysis.contractSummary' AS citation FROM a WHERE trim(summary) <> ''
UNION ALL SELECT contract_id, 'missing_information', 'Missing information', 'Missing information: ' || array_to_string(missing, ', '), 0.5, 'contractAnalysis.missingInformation' FROM a WHERE len(missing) > 0
UNION ALL SELECT contract_id, 'important_clause:' || n, 'Clause: ' || title, title || ' — ' || summary, 0.8, 'contractAnalysis.importantClauses[' || n || ']' FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY ordinal) - 1 AS n FROM ({_CLAUSES})) WHERE n < 6)
SELECT *, 'contract_analysis_engine' AS authority FROM f"""

_HITS = """SELECT conv_id, turn, role, 'c' || turn AS chunk_id, CASE WHEN turn % 2 = 0 THEN 'Section ' || turn END AS section, turn AS chunk_order, CAST(turn AS DOUBLE) / 3 - 0.5 AS score, text AS excerpt, 'Authority ' || role AS authority,
  'https://law.example/' || turn AS official_source_url, CASE WHEN turn % 3 = 0 THEN 'Article ' || turn END AS article_number, 'Law' AS document_title FROM conversations"""


def _allowlist(spark: SparkSession, d: str) -> DataFrame:
    hits = _view(spark, d, _HITS, "conversations")
    return evidence.citation_allowlist(evidence.contract_evidence(hits.filter("role = 'user'")), evidence.legal_evidence(hits.filter("role = 'assistant'")), ["conv_id"])


def citation_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return _allowlist(spark, d)


_ALLOW_SQL = f"""SELECT conv_id, CASE WHEN role = 'user' THEN 'contract' ELSE 'legal' END AS source, CASE WHEN role = 'user' THEN 'Your contract — ' || coalesce(section, 'passage ' || (chunk_order + 1)) ELSE official_source_url END AS citation,
  CASE WHEN role = 'user' THEN coalesce(section, 'Passage ' || (chunk_order + 1)) ELSE coalesce(article_number, section, document_title) END AS label, CASE WHEN role = 'user' THEN 'user_contract' ELSE authority END AS authority, excerpt FROM ({_HITS}) WHERE role IN ('user', 'assistant')"""

_CITED = """SELECT conv_id, turn AS ordinal, CASE WHEN turn % 2 = 0 THEN 'contract' ELSE 'legal' END AS source, CASE WHEN turn % 2 = 0 THEN 'Your contract — Section ' || (turn - turn % 4) ELSE 'https://law.example/' || turn END AS citation FROM conversations"""


def sanitized_answers(spark: SparkSession, d: str) -> DataFrame:
    """Per answer: citations kept and dropped, evidence status and confidence; routes by rule."""
    allowed = _allowlist(spark, d)
    kept, dropped = evidence.sanitized(_view(spark, d, _CITED, "conversations"), allowed, ["source", "citation"], ["conv_id"])
    n = kept.groupBy("conv_id").agg(F.count("*").alias("n_kept"))
    per = allowed.groupBy("conv_id").agg(F.count_if(F.col("source") == "contract").alias("n_contract"), F.count_if(F.col("source") == "legal").alias("n_legal"))
    rows = dropped.join(n, "conv_id", "left").join(per, "conv_id", "left").na.fill(0)
    routes = tuple(evidence.ROUTE_NEEDS)
    route = F.element_at(F.array(*[F.lit(r) for r in routes]), (F.col("conv_id") % len(routes) + 1).cast("int"))
    status = evidence.evidence_status(F.col("n_contract"), F.col("n_legal"), F.lit(0), F.col("conv_id") % 5)
    return rows.select("conv_id", "n_kept", "dropped", status.alias("status"), evidence.answer_confidence(route, status, F.col("n_kept"), F.col("conv_id") % 2).alias("confidence"))


_SANITIZED_SQL = f"""WITH a AS ({_ALLOW_SQL}), c AS ({_CITED}), k AS (SELECT conv_id, count(DISTINCT (source, citation)) AS n FROM c WHERE (conv_id, source, citation) IN (SELECT conv_id, source, citation FROM a) GROUP BY 1),
p AS (SELECT conv_id, count(*) FILTER (WHERE source = 'contract') AS nc, count(*) FILTER (WHERE source = 'legal') AS nl FROM a GROUP BY 1),
r AS (SELECT conv_id, count(*) AS n_all, coalesce(any_value(k.n), 0) AS n_kept, coalesce(any_value(nc), 0) + coalesce(any_value(nl), 0) AS e, ([{', '.join(repr(r) for r in evidence.ROUTE_NEEDS)}])[conv_id % 7 + 1] AS route FROM c LEFT JOIN k USING (conv_id) LEFT JOIN p USING (conv_id) GROUP BY conv_id),
s AS (SELECT *, CASE WHEN e = 0 THEN 'none' WHEN conv_id % 5 > 0 THEN 'partial' ELSE 'sufficient' END AS status FROM r)
SELECT conv_id, n_kept, n_all - n_kept AS dropped, status, CASE WHEN route = 'general' THEN 'high' WHEN status = 'none' THEN 'low' WHEN status = 'partial' THEN 'medium'
  WHEN (route = 'financial' OR n_kept > 0) AND (route IN ('contract', 'legal', 'contract_and_legal') OR conv_id % 2 > 0) THEN 'high' ELSE 'medium' END AS confidence FROM s"""


def grounded_context(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the allow-list, the best of each pool, deduplicated and within the token budget, as text."""
    pools = _allowlist(spark, d).select("conv_id", F.col("source").alias("pool"), "citation", "excerpt", (F.length("citation") / 100).alias("relevance"))
    best = evidence.dedupe_and_rank(pools, ["conv_id", "pool"], "citation", 6, ordinal="citation")
    fits = evidence.trim_to_budget(best, ["conv_id"], budget=400, ordinal="citation")
    ranked = fits.select("conv_id", "pool", "citation", "excerpt", F.expr("row_number() OVER (PARTITION BY conv_id, pool ORDER BY relevance DESC, citation)").alias("rank"))
    asked = table(spark, d, "conversations").filter("turn = 0").select("conv_id", F.col("text").alias("question"), F.lit("contract_and_legal").alias("route"))
    return evidence.grounded_context(asked.join(ranked, "conv_id", "left"), "conv_id")


_CONTEXT_SQL = f"""WITH a AS ({_ALLOW_SQL}), x AS (SELECT *, length(citation) / 100 AS rel FROM a),
b AS (SELECT * FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id, source, citation ORDER BY rel DESC) = 1) QUALIFY row_number() OVER (PARTITION BY conv_id, source ORDER BY rel DESC, citation) <= 6),
t AS (SELECT *, CAST(ceil(length(excerpt) / 4) AS BIGINT) + 20 AS tk FROM b),
w AS (SELECT *, sum(tk) OVER (PARTITION BY conv_id) + 50 - coalesce(sum(tk) OVER (PARTITION BY conv_id ORDER BY rel, citation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, row_number() OVER (PARTITION BY conv_id ORDER BY rel DESC, citation DESC) AS last FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, source ORDER BY rel DESC, citation) AS n FROM w WHERE rest <= 400 OR last = 1),
l AS (SELECT conv_id, string_agg('[' || upper(substr(source, 1, 1)) || n || '] ' || citation || chr(10) || '--- BEGIN DATA ---' || chr(10) || excerpt || chr(10) || '--- END DATA ---', chr(10) || chr(10) ORDER BY source, n) AS body FROM r GROUP BY 1)
SELECT c.conv_id, 'Route: contract_and_legal' || chr(10) || chr(10) || 'Question:' || chr(10) || '--- BEGIN DATA ---' || chr(10) || c.text || chr(10) || '--- END DATA ---' || chr(10) || chr(10) || coalesce(l.body, 'No evidence was found for this question.') AS context
FROM conversations c LEFT JOIN l USING (conv_id) WHERE c.turn = 0"""


def queries() -> dict:
    return {f.__name__: f for f in (financial_facts, analysis_facts, citation_allowlist, sanitized_answers, grounded_context)}


def oracle_sql() -> dict[str, str]:
    return {"financial_facts": _FACTS_SQL, "analysis_facts": _ANALYSIS_SQL, "citation_allowlist": _ALLOW_SQL, "sanitized_answers": _SANITIZED_SQL, "grounded_context": _CONTEXT_SQL}
