"""Queries over financial concepts, with their SQL.

Line items stand for the items of agreements; the view gives them types, roles and bilingual labels by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import wordlists as L
from tallystone.operators import concepts
from tallystone.plans.clause_queries import _CLAUSES
from tallystone.plans.finance_queries import _FACTOR
from tallystone.session import table

_TYPES = ("auto_finance", "personal_finance", "mortgage", "credit_card", "lease", "insurance", "employment", "subscription", "other")
_ROLES = (
    "recurring_outflow", "one_time_outflow", "upfront_liquidity", "refundable", "conditional_cost", "rate_or_percentage", "financing_principal", "credit_limit", "coverage_limit", "income", "benefit", "conditional_income",
    "informational_total", "recurring_outflow", "refund", "other",
)
_LABELS = (
    "Administrative charge", "رسوم إدارية", "Brokerage", "Cost of financing", "Balloon at the end", "Monthly rent", "إيجار الوحدة", "Basic salary", "بدل نقل", "Annual bonus", "Overdue amount", "إنهاء مبكر",
    "Early repayment", "رسوم تحصيل", "Cancellation", "Bounced cheque", "Something else, up to 500", "مبلغ بحد أقصى",
)
_KINDS = {
    "obligation": ("upfront_payment", "deposit", "insurance", "tax", "balloon_payment", "recurring_payment", "unknown"),
    "fee": ("administration", "processing", "service", "other", "maintenance", "other", "renewal"),
    "penalty": ("late_payment", "default", "other", "cancellation", "other"),
    "informational": ("principal", "monthly_income", "rate", "stated_due_at_signing", "salary_component", "asset_value", "total_fixed_compensation", "outstanding_balance"),
}


def _pick(samples: tuple[str, ...], by: str) -> str:
    return f"CASE ({by}) % {len(samples)} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(samples)) + " END"


_ITEMS = f"""
SELECT l_orderkey AS contract_id, {_pick(_TYPES, 'l_orderkey')} AS contract_type, (l_linenumber * 1000000 + l_partkey) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS ordinal, {_pick(tuple(_KINDS), 'l_partkey')} AS source, {_pick(_LABELS, 'l_suppkey + l_linenumber')} AS label,
  CASE WHEN l_partkey % 13 <> 0 THEN round(l_extendedprice / 10000) * 100 END AS amount,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_orderkey % 5 = 0 AND l_returnflag = 'R' THEN 'USD' ELSE 'SAR' END AS currency,
  CASE WHEN l_partkey % 4 > 0 AND l_suppkey % 5 < 2 THEN round(l_discount * 100, 2) END AS percentage,
  CASE WHEN l_partkey % 4 < 2 THEN CASE l_linenumber % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'one_time' WHEN 3 THEN 'annual' ELSE 'monthly' END END AS frequency,
  CASE WHEN l_partkey % 4 = 0 AND l_quantity > 20 THEN l_quantity END AS n_payments,
  CASE WHEN l_partkey % 4 < 2 AND l_tax >= 0.02 THEN l_tax < 0.07 END AS mandatory, CASE WHEN l_partkey % 4 < 3 AND l_discount > 0.07 THEN true END AS conditional,
  CASE WHEN l_partkey % 4 < 2 AND l_quantity < 10 THEN true END AS refundable, {_pick(_ROLES, 'l_suppkey * 3 + l_linenumber')} AS financial_role,
  CASE WHEN l_partkey % 4 = 2 THEN {_pick(("per incident", "not exceeding 3 months", "عند التأخير"), 'l_suppkey')} END AS trigger,
  CASE l_partkey % 4 {' '.join(f'WHEN {i} THEN {_pick(kinds, "l_orderkey + l_linenumber")}' for i, kinds in enumerate(_KINDS.values()))} END AS kind
FROM lineitem
"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_ITEMS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))


def _map(pairs: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _says(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w.lower()}')" for w in words) + ")"


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_RENT = "CASE WHEN frequency = 'annual' THEN 'annual_rent' ELSE 'monthly_rent' END"
_CONCEPT = f"""coalesce(CASE source {' '.join(f"WHEN '{s}' THEN {_map(m, 'kind')}" for s, m in L.TYPE_CONCEPTS.items())} END,
  CASE WHEN source = 'informational' THEN 'other' {' '.join(f"WHEN {_says('label', w)} THEN {_RENT if c == 'monthly_rent' else repr(c)}" for c, w in L.LABEL_CONCEPTS.items())}
    WHEN (source = 'penalty' AND financial_role <> 'conditional_income') OR financial_role = 'conditional_cost' THEN 'conditional_payment'
    WHEN financial_role = 'recurring_outflow' THEN CASE WHEN contract_type = 'lease' THEN {_RENT} ELSE coalesce({_map(L.RECURRING_CONCEPTS, 'contract_type')}, 'recurring_payment') END
    ELSE {_map(L.ROLE_CONCEPTS, 'financial_role')} END, 'other')"""
_CONCEPTS = f"""ci AS (
  SELECT *, {_CONCEPT} AS concept, {_says("label || ' ' || coalesce(trigger, '')", L.SAYS_STATED_CAP)} AS is_cap,
    CASE WHEN {_in('financial_role', L.INFORMATIONAL_ROLES)} THEN 'informational' WHEN financial_role = 'conditional_cost' OR coalesce(conditional, false) THEN 'conditional' WHEN coalesce(mandatory, false) THEN 'guaranteed' ELSE 'informational' END AS bucket
  FROM ({_ITEMS}) WHERE amount IS NOT NULL OR percentage IS NOT NULL),
fc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, concept, currency, amount ORDER BY ordinal) AS rn FROM ci) WHERE rn = 1 OR concept = 'other' OR currency IS NULL OR coalesce(amount, 0) = 0)"""


def financial_concepts(spark: SparkSession, d: str) -> DataFrame:
    return concepts.grouped(concepts.financial_concepts(_items(spark, d))).select("contract_id", "ordinal", "concept", "bucket", "is_cap", "group")


_CONCEPT_SQL = f"""WITH {_CONCEPTS} SELECT contract_id, ordinal, concept, bucket, is_cap, CASE
  WHEN contract_type = 'employment' THEN CASE WHEN source = 'informational' AND kind = 'monthly_income' THEN 'whatYouWillReceive' WHEN source = 'informational' AND kind IN ('salary_component', 'total_fixed_compensation') THEN 'compensationBreakdown'
    WHEN financial_role = 'conditional_income' THEN 'conditionalOrNonGuaranteed' WHEN financial_role = 'conditional_cost' THEN 'potentialDeductions' WHEN financial_role = 'benefit' THEN 'otherBenefits'
    WHEN bucket = 'guaranteed' THEN 'compensationBreakdown' WHEN bucket = 'conditional' THEN 'conditionalOrNonGuaranteed' ELSE 'otherBenefits' END
  WHEN bucket = 'conditional' THEN 'conditionalAmounts' WHEN financial_role IN ('financing_principal', 'credit_limit', 'coverage_limit') THEN 'financingAndCredit' WHEN financial_role = 'rate_or_percentage' THEN 'ratesAndPercentages'
  WHEN {_in('concept', L.FEE_LIKE_CONCEPTS)} THEN 'feesAndCosts' WHEN bucket = 'guaranteed' THEN 'whatYoullPay' ELSE 'otherStatedAmounts' END AS "group" FROM fc"""


def concept_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = concepts.grouped(concepts.financial_concepts(_items(spark, d)))
    return rows.groupBy("contract_type", "group").agg(F.count("*").alias("n"), F.countDistinct("concept").alias("n_concepts"))


def applicable_amounts(spark: SparkSession, d: str) -> DataFrame:
    out = concepts.applicable_amounts(concepts.financial_concepts(_items(spark, d)))
    names = ("monthly_outflow", "upfront_liquidity", "employment_income")
    return out.select("contract_id", *[F.round(F.col(f"{n}.total"), 2).alias(n) for n in names], *[F.col(f"{n}.currency").alias(f"{n}_currency") for n in names])


def _sum(value: str, where: str) -> str:
    known = f"FILTER (WHERE ({where}) AND amount IS NOT NULL AND currency IS NOT NULL)"
    return f"CASE WHEN min(currency) {known} = max(currency) {known} THEN CAST(sum(CAST({value} AS DECIMAL(38,6))) {known} AS DOUBLE) END"


def _currency(where: str) -> str:
    known = f"FILTER (WHERE ({where}) AND amount IS NOT NULL AND currency IS NOT NULL)"
    return f"min(currency) {known}"


_UPFRONT = "bucket = 'guaranteed' AND financial_role IN ('upfront_liquidity', 'refundable')"
_WIDE = f"({_UPFRONT}) OR (bucket = 'guaranteed' AND financial_role = 'one_time_outflow') OR first_rent"
_MONTHLY = "bucket = 'guaranteed' AND financial_role = 'recurring_outflow'"
_IS_RENT = f"contract_type = 'lease' AND {_MONTHLY} AND concept = 'monthly_rent' AND amount IS NOT NULL AND currency IS NOT NULL"
_KNOWN_INFO = "source = 'informational' AND amount IS NOT NULL AND currency IS NOT NULL AND kind ="
_APPLICABLE_SQL = f"""WITH {_CONCEPTS},
r AS (SELECT *, ({_IS_RENT}) AND ordinal = min(ordinal) FILTER (WHERE {_IS_RENT}) OVER (PARTITION BY contract_id) AS first_rent FROM fc),
p AS (SELECT contract_id, {_sum(f'coalesce(amount * ({_FACTOR}), 0)', _MONTHLY)} AS m, {_currency(_MONTHLY)} AS mc, {_sum('amount', _UPFRONT)} AS nn, {_currency(_UPFRONT)} AS nc, {_sum('amount', _WIDE)} AS w, {_currency(_WIDE)} AS wc,
  min_by(amount, ordinal) FILTER (WHERE {_KNOWN_INFO} 'stated_due_at_signing') AS s, min_by(currency, ordinal) FILTER (WHERE {_KNOWN_INFO} 'stated_due_at_signing') AS sc,
  min_by(amount, ordinal) FILTER (WHERE {_KNOWN_INFO} 'monthly_income') AS i, min_by(currency, ordinal) FILTER (WHERE {_KNOWN_INFO} 'monthly_income') AS ic FROM r GROUP BY contract_id),
q AS (SELECT *, coalesce(wc = sc AND abs(w - s) < 0.01, false) AS fits FROM p)
SELECT contract_id, CASE WHEN m > 0 THEN round(m, 2) END AS monthly_outflow, CASE WHEN m > 0 THEN mc END AS monthly_outflow_currency, CASE WHEN fits THEN round(w, 2) WHEN nn > 0 THEN round(nn, 2) END AS upfront_liquidity,
  CASE WHEN fits THEN wc WHEN nn > 0 THEN nc END AS upfront_liquidity_currency, round(i, 2) AS employment_income, ic AS employment_income_currency FROM q"""


_DURATIONS = "SELECT o_orderkey AS contract_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 60 END AS months, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey % 10 END AS years, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 900 END AS days FROM orders"


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_DURATIONS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def duration_facts(spark: SparkSession, d: str) -> DataFrame:
    return concepts.duration_facts(_durations(spark, d), concepts.financial_concepts(_items(spark, d)))


_DURATION = f"SELECT contract_id, CAST(coalesce(months, years, days) AS DOUBLE) AS value, CASE WHEN months IS NOT NULL THEN 'months' WHEN years IS NOT NULL THEN 'years' ELSE 'days' END AS unit FROM ({_DURATIONS}) WHERE coalesce(months, years, days) IS NOT NULL"
_DURATION_SQL = f"""WITH {_CONCEPTS} SELECT contract_id, 'contractDuration' AS fact, value, unit, NULL AS concept FROM ({_DURATION})
UNION ALL SELECT contract_id, 'installmentCount', CAST(n_payments AS DOUBLE), NULL, concept FROM fc WHERE bucket = 'guaranteed' AND n_payments > 0"""


def key_figures(spark: SparkSession, d: str) -> DataFrame:
    return concepts.key_figures(concepts.financial_concepts(_items(spark, d)), _durations(spark, d)).select("contract_id", "place", "key", "amount", "currency", "percentage", "unit")


_KEY_SQL = f"""WITH {_CONCEPTS},
f AS (SELECT contract_id, concept AS key, amount, currency, percentage, NULL AS unit FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, concept ORDER BY ordinal) AS n FROM fc) WHERE n = 1 AND CASE WHEN concept = 'interest_rate' THEN percentage IS NOT NULL ELSE amount IS NOT NULL END
  UNION ALL SELECT contract_id, 'duration', value, NULL, NULL, unit FROM ({_DURATION})),
k AS (SELECT *, list_position([{', '.join(repr(x) for x in L.KEY_FIGURES)}], key) AS r FROM f)
SELECT contract_id, CAST(place AS INTEGER) AS place, key, amount, currency, percentage, unit FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY r) AS place FROM k WHERE r > 0) WHERE place <= 5"""


def contingent_flags(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return concepts.unresolved_contingent(items.filter("source = 'fee'"), items.filter("source = 'penalty'"))


_FLAG_SQL = f"SELECT contract_id, bool_or(amount IS NULL OR currency IS NULL) AS unquantified FROM ({_ITEMS}) WHERE source = 'penalty' OR (source = 'fee' AND conditional) GROUP BY contract_id"


def informational_amounts(spark: SparkSession, d: str) -> DataFrame:
    keys = tuple(L.INFORMATIONAL_TYPES)
    rows = _items(spark, d).withColumns({"special_key": F.when(F.col("source") == "informational", F.expr(_pick(keys, "contract_id + ordinal"))), "role": F.when(F.col("ordinal") % 7 == 2, "asset_value").otherwise("unknown"), "source_field": F.format_string("numbers[%020d]", F.col("ordinal"))})
    return concepts.informational_amounts(rows).select("contract_id", "ordinal", "id", "info_type")


_INFORMATIONAL_SQL = f"""WITH i AS (SELECT *, CASE WHEN source = 'informational' THEN {_pick(tuple(L.INFORMATIONAL_TYPES), 'contract_id + ordinal')} END AS k FROM ({_ITEMS}))
SELECT contract_id, ordinal, 'informational-' || (row_number() OVER (PARTITION BY contract_id ORDER BY ordinal) - 1) AS id, coalesce({_map(L.INFORMATIONAL_TYPES, 'k')}, 'asset_value') AS info_type FROM i WHERE k IS NOT NULL OR ordinal % 7 = 2"""


def financial_items(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    return concepts.financial_items(*[rows.filter(F.col("source") == s).drop("source") for s in _KINDS]).select("place", "source", "contract_id", "ordinal", "kind", "label", "amount", "percentage", "frequency", "n_payments", "mandatory", "conditional", "refundable", "trigger")


_ITEM_SQL = f"""SELECT CAST(l_place AS INTEGER) AS place, source, contract_id, ordinal, kind, label, amount, percentage, frequency, n_payments, mandatory, conditional, refundable, trigger
FROM (SELECT *, list_position([{', '.join(repr(s) for s in _KINDS)}], source) - 1 AS l_place FROM ({_ITEMS}))"""


def executive_findings(spark: SparkSession, d: str) -> DataFrame:
    clauses = spark.sql(_CLAUSES.replace("FROM conversations", "FROM {c}"), c=table(spark, d, "conversations")).withColumn("risk", F.expr("CASE (contract_id + ordinal) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END"))
    missing = table(spark, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("contract_id"), F.col("turn").alias("ordinal"), F.expr("CASE WHEN turn % 3 = 0 THEN ' ' ELSE 'turn ' || turn END").alias("reason"))
    return concepts.executive_findings(clauses, concepts.financial_concepts(_items(spark, d)), missing)


_NUMBER = r"regexp_replace(format('{:,.2f}', {0}), '\.?0+$', '')"
_SAID = f"coalesce({_NUMBER.replace('{0}', 'amount')} || coalesce(' ' || currency, ''), {_NUMBER.replace('{0}', 'percentage')} || '%')"
_FINDINGS_SQL = f"""WITH {_CONCEPTS},
c AS (SELECT contract_id, 0 AS k, n, 'risk_clause' AS kind, nullif(trim(title), '') AS title, coalesce(nullif(trim(explanation), ''), nullif(trim(summary), '')) AS detail
  FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY (contract_id + ordinal) % 4, ordinal) AS n FROM ({_CLAUSES}) WHERE (contract_id + ordinal) % 4 < 2) WHERE n <= 3),
o AS (SELECT contract_id, 1, n, 'conditional_cost', CASE WHEN concept = 'other' THEN nullif(trim(label), '') ELSE concept END, CASE WHEN is_cap THEN 'up to ' ELSE '' END || {_SAID} || coalesce(' — ' || trigger, '')
  FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY coalesce(amount, percentage) DESC, ordinal) AS n FROM fc WHERE bucket = 'conditional') WHERE n <= 2),
m AS (SELECT conv_id, 2, 1, 'missing_information', 'Incomplete information', 'turn ' || min(turn) FROM conversations WHERE role = 'user' AND turn % 3 <> 0 GROUP BY conv_id),
u AS (SELECT * FROM c UNION ALL SELECT * FROM o UNION ALL SELECT * FROM m)
SELECT contract_id, kind, title, detail, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY k, n) AS place FROM u WHERE title IS NOT NULL AND detail IS NOT NULL) WHERE place <= 5"""


def queries() -> dict:
    names = (financial_concepts, concept_groups, applicable_amounts, duration_facts, key_figures, contingent_flags, informational_amounts, financial_items, executive_findings)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    types = f"SELECT contract_id, any_value(contract_type) AS contract_type FROM ({_ITEMS}) GROUP BY 1"
    return {
        "financial_concepts": _CONCEPT_SQL,
        "concept_groups": f'SELECT contract_type, "group", count(*) AS n, count(DISTINCT concept) AS n_concepts FROM ({_CONCEPT_SQL}) JOIN ({types}) USING (contract_id) GROUP BY 1, 2',
        "applicable_amounts": _APPLICABLE_SQL,
        "duration_facts": _DURATION_SQL,
        "key_figures": _KEY_SQL,
        "contingent_flags": _FLAG_SQL,
        "informational_amounts": _INFORMATIONAL_SQL,
        "financial_items": _ITEM_SQL,
        "executive_findings": _FINDINGS_SQL,
    }
