"""Queries over obligations, fees, questions, budgets and findings; with their SQL.

The driver's tables hold no agreements, so line items stand in for obligations, fees and candidates:
the views below give them frequencies, currencies and flags by rule, alike in both languages.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import money as M
from tallystone.functions import wordlists as L
from tallystone.operators import finance, presentation, routing
from tallystone.session import table

_VIEW = """
SELECT l_orderkey AS contract_id, l_linenumber AS ordinal, {concat} AS id, l_extendedprice AS raw_amount,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS amount,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_orderkey % 5 = 0 AND l_returnflag = 'R' THEN 'USD' ELSE 'SAR' END AS currency,
  CASE l_linenumber % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'one_time' WHEN 3 THEN 'annual' ELSE 'monthly' END AS frequency,
  CASE WHEN l_tax < 0.02 THEN NULL ELSE l_tax < 0.06 END AS mandatory,
  CASE WHEN l_discount > 0.07 THEN true END AS conditional,
  l_linestatus = 'F' AS is_deposit,
  CASE WHEN l_quantity < 10 THEN true WHEN l_quantity < 20 THEN false END AS refundable,
  CASE WHEN l_suppkey % 3 = 0 THEN 'recurring_payment' WHEN l_suppkey % 3 = 1 THEN 'deposit' ELSE 'unknown' END AS category,
  CASE WHEN l_partkey % 2 = 0 THEN 'type_details' ELSE 'extracted_number' END AS source_kind,
  CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  l_returnflag AS label
FROM lineitem
"""
_SQL_VIEW = f"({_VIEW.format(concat=chr(39) + 'item-' + chr(39) + ' || l_linenumber')})"


def _items(spark: SparkSession, d: str, more: str = "") -> DataFrame:
    return spark.sql(_VIEW.format(concat="concat('item-', l_linenumber)").replace("\nFROM lineitem", more + "\nFROM {lineitem}"), lineitem=table(spark, d, "lineitem"))


def _flat(df: DataFrame, *names: str) -> list:
    return [F.col(f"{n}.{part}").alias(f"{n}_{part}") for n in names for part in ("value", "currency")]


def recurring_commitment(spark: SparkSession, d: str) -> DataFrame:
    out = finance.recurring_commitment(_items(spark, d))
    return out.select("contract_id", *_flat(out, "monthly_equivalent", "annual_equivalent", "actual_monthly"), "mixed", F.array_join("included_ids", ",").alias("included"))


def _sum_sql(amount: str, where: str, name: str, fn: str = "sum") -> str:
    ok = f"FILTER (WHERE ({where}) AND {amount} IS NOT NULL AND currency IS NOT NULL)"
    one = f"min(currency) {ok} = max(currency) {ok}"
    return f"CASE WHEN {one} THEN CAST(round({fn}(CAST({amount} AS DECIMAL(38,6))) {ok}, 2) AS DOUBLE) END AS {name}_value, CASE WHEN {one} THEN min(currency) {ok} END AS {name}_currency"


_FACTOR = "CASE frequency WHEN 'monthly' THEN 1.0::DOUBLE WHEN 'quarterly' THEN 1.0::DOUBLE / 3 WHEN 'annual' THEN 1.0::DOUBLE / 12 END"
_COMMIT_SQL = f"""
WITH i AS (SELECT *, amount * ({_FACTOR}) AS m, coalesce(mandatory, false) AND frequency <> 'one_time' AND amount IS NOT NULL AND currency IS NOT NULL AS q FROM {_SQL_VIEW}),
a AS (SELECT contract_id, {_sum_sql('m', 'q', 'monthly_equivalent')}, {_sum_sql('(m * 12)', 'q', 'annual_equivalent')}, {_sum_sql('amount', "q AND frequency = 'monthly'", 'x')},
  coalesce(min(currency) FILTER (WHERE q) < max(currency) FILTER (WHERE q), false) AS mixed, coalesce(string_agg(id, ',' ORDER BY ordinal) FILTER (WHERE q), '') AS included FROM i GROUP BY contract_id)
SELECT contract_id, monthly_equivalent_value, monthly_equivalent_currency, annual_equivalent_value, annual_equivalent_currency,
  CASE WHEN NOT mixed AND x_value > 0 THEN x_value END AS actual_monthly_value, CASE WHEN NOT mixed AND x_value > 0 THEN x_currency END AS actual_monthly_currency, mixed, included FROM a
"""


def fee_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = finance.fee_collection(_items(spark, d))
    return out.select("contract_id", *_flat(out, "total", "mandatory", "upfront", "recurring", "conditional"), "has_undefined", "status")


_INCLUDE = "NOT coalesce(refundable, false) AND NOT (is_deposit AND refundable IS NULL)"
_FEE_SQL = f"""
SELECT *, CASE WHEN total_value IS NULL THEN 'unavailable' WHEN has_undefined THEN 'estimated' ELSE 'known' END AS status FROM (
SELECT contract_id, {_sum_sql('amount', 'true', 'total')}, {_sum_sql('amount', 'coalesce(mandatory, false) AND NOT coalesce(conditional, false) AND ' + _INCLUDE, 'mandatory')},
  {_sum_sql('amount', "frequency = 'one_time'", 'upfront')}, {_sum_sql('amount', "frequency <> 'one_time'", 'recurring')}, {_sum_sql('amount', 'coalesce(conditional, false)', 'conditional')},
  bool_or(amount IS NULL OR currency IS NULL) AS has_undefined FROM {_SQL_VIEW} GROUP BY contract_id)
"""


def penalty_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = finance.penalty_collection(_items(spark, d))
    return out.select("contract_id", *_flat(out, "total", "highest"), "has_undefined", "status")


_PENALTY_SQL = f"""
SELECT *, CASE WHEN total_value IS NULL THEN 'unavailable' WHEN has_undefined THEN 'estimated' ELSE 'known' END AS status FROM (
SELECT contract_id, {_sum_sql('amount', 'true', 'total')}, {_sum_sql('amount', 'true', 'highest', 'max')}, bool_or(amount IS NULL OR currency IS NULL) AS has_undefined FROM {_SQL_VIEW} GROUP BY contract_id)
"""


def exposure_by_currency(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).filter(finance.normal_path(F.col("mandatory"), F.col("conditional")) & (finance.refundability(F.col("is_deposit"), F.col("refundable")) == "include"))
    return finance.totals_by_currency(items)


def _cost_rows(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    a, c, one = F.col("amount"), F.col("currency"), F.col("frequency") == "one_time"
    sure = finance.guaranteed(F.col("mandatory"), F.col("conditional"))
    per = items.groupBy("contract_id").agg(
        finance.known_sum(a, c, sure & one & (F.col("category") != "unknown")).alias("upfront_obligations"),
        finance.known_sum(a, c, sure & one & (F.col("category") == "unknown")).alias("balloon"),
        finance.known_sum(a, c, sure & ~one & (F.col("ordinal") == 3)).alias("mandatory_fees"),
        finance.known_sum(a * M.monthly_factor(F.col("frequency")), c, sure & ~one & (F.col("ordinal") != 3)).alias("monthly_equivalent"),
        finance.known_sum(a, c, F.coalesce(F.col("conditional"), F.lit(False))).alias("penalties"),
    )
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contract_id"),
        finance.money(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 4 != 0, "SAR")).alias("stated_total"),
        finance.money(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 3 != 0, "SAR")).alias("principal"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 24).cast("int")).alias("months"),
        finance.money(F.col("o_totalprice"), F.lit("SAR")).alias("income"),
    )
    return finance.total_cost(per.join(orders, "contract_id"))


def total_cost_difference(spark: SparkSession, d: str) -> DataFrame:
    out = _cost_rows(spark, d)
    return out.select("contract_id", *_flat(out, "scheduled", "repayment", "core", "financing_cost"), "difference")


def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    r = _cost_rows(spark, d)
    ratios = {"fees_to_base": "mandatory_fees", "penalties_to_base": "penalties", "upfront_to_base": "upfront_obligations", "balloon_to_base": "balloon", "cost_increase": "financing_cost"}
    return r.select("contract_id", *[finance.ratio(F.col(x), F.col("principal")).alias(name) for name, x in ratios.items()], finance.ratio(F.col("monthly_equivalent"), F.col("income")).alias("recurring_to_income"))


def _combine(parts: list[str], name: str) -> str:
    """SQL of a sum of money pairs under the one-currency rule."""
    value = " + ".join(f"coalesce({p}_value, 0)" for p in parts)
    lo, hi = (f"{fn}({', '.join(f'{p}_currency' for p in parts)})" for fn in ("least", "greatest"))
    return f"CASE WHEN {lo} = {hi} THEN CAST(round(CAST({value} AS DECIMAL(38,6)), 2) AS DOUBLE) END AS {name}_value, CASE WHEN {lo} = {hi} THEN {lo} END AS {name}_currency"


_SURE = "coalesce(mandatory, false) AND NOT coalesce(conditional, false)"
_COST_CTE = f"""
WITH i AS (SELECT *, amount * ({_FACTOR}) AS m, {_SURE} AS sure, frequency = 'one_time' AS one FROM {_SQL_VIEW}),
p AS (SELECT contract_id, {_sum_sql('amount', "sure AND one AND category <> 'unknown'", 'upfront')}, {_sum_sql('amount', "sure AND one AND category = 'unknown'", 'balloon')},
  {_sum_sql('amount', 'sure AND NOT one AND ordinal = 3', 'fees')}, {_sum_sql('m', 'sure AND NOT one AND ordinal <> 3', 'monthly')}, {_sum_sql('amount', 'coalesce(conditional, false)', 'penalties')} FROM i GROUP BY contract_id),
o AS (SELECT p.*, o_totalprice AS income_value, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS stated_value, CASE WHEN o_orderkey % 4 <> 0 THEN 'SAR' END AS stated_currency,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS principal_value, CASE WHEN o_orderkey % 3 <> 0 THEN 'SAR' END AS principal_currency,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 24 END AS months FROM p JOIN orders ON o_orderkey = contract_id),
s AS (SELECT *, CASE WHEN months IS NOT NULL THEN CAST(round(CAST(monthly_value * months AS DECIMAL(38,6)), 2) AS DOUBLE) END AS scheduled_value, CASE WHEN months IS NOT NULL THEN monthly_currency END AS scheduled_currency FROM o),
r AS (SELECT *, {_combine(['scheduled', 'balloon'], 'repayment')} FROM s),
c AS (SELECT *, {_combine(['upfront', 'repayment', 'fees'], 'core')} FROM r),
f AS (SELECT *, coalesce(repayment_currency = principal_currency AND principal_value <> 0 AND repayment_value >= principal_value, false) AS fits FROM c),
g AS (SELECT *, CASE WHEN fits THEN CAST(round(CAST(repayment_value - principal_value AS DECIMAL(38,6)), 2) AS DOUBLE) END AS financing_cost_value, CASE WHEN fits THEN principal_currency END AS financing_cost_currency,
  CASE WHEN stated_currency = core_currency AND stated_value <> 0 THEN abs((stated_value - core_value) / abs(stated_value)) END AS rel FROM f)
"""
_COST_SQL = f"""{_COST_CTE}
SELECT contract_id, scheduled_value, scheduled_currency, repayment_value, repayment_currency, core_value, core_currency, financing_cost_value, financing_cost_currency,
  CASE WHEN rel IS NULL THEN 'unavailable' WHEN rel < 0.005 THEN 'match' WHEN rel < 0.02 THEN 'rounding' WHEN rel < 0.1 THEN 'warning' ELSE 'conflict' END AS difference FROM g
"""


def _ratio_sql(n: str, name: str) -> str:
    return f"CASE WHEN {n}_currency = principal_currency AND principal_value <> 0 THEN CAST(round(CAST({n}_value / principal_value * 100 AS DECIMAL(38,6)), 2) AS DOUBLE) END AS {name}"


_INCOME = "CASE WHEN monthly_currency = 'SAR' AND income_value <> 0 THEN CAST(round(CAST(monthly_value / income_value * 100 AS DECIMAL(38,6)), 2) AS DOUBLE) END AS recurring_to_income"
_RATIO_SQL = f"{_COST_CTE} SELECT contract_id, {_ratio_sql('fees', 'fees_to_base')}, {_ratio_sql('penalties', 'penalties_to_base')}, {_ratio_sql('upfront', 'upfront_to_base')}, {_ratio_sql('balloon', 'balloon_to_base')}, {_ratio_sql('financing_cost', 'cost_increase')}, {_INCOME} FROM g"


def single_currency_backfill(spark: SparkSession, d: str) -> DataFrame:
    return finance.backfill_currency(_items(spark, d)).select("contract_id", "ordinal", "currency")


def currency_distribution(spark: SparkSession, d: str) -> DataFrame:
    return finance.currency_distribution(_items(spark, d))


def _candidates(spark: SparkSession, d: str, more: str = "") -> DataFrame:
    return _items(spark, d, more).withColumns({"target_kind": F.lit("obligation"), "special_key": F.lit(None).cast("string"), "evidence": F.col("label"), "source_field": F.col("id"), "start_date": F.lit(None).cast("date"), "amount": F.round("amount", -4)})


def conflict_resolution(spark: SparkSession, d: str) -> DataFrame:
    return finance.resolve_conflicts(_candidates(spark, d)).select("contract_id", "ordinal", "rivals", "conflict")


_SLOTS = "contract_id, category, coalesce(currency, ''), frequency, label"
_RANK = "CASE source_kind WHEN 'type_details' THEN 0 ELSE 1 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id"
_CONFLICT_SQL = f"""
WITH i AS (SELECT *, round(amount / 10000, 0) * 10000 AS a FROM {_SQL_VIEW})
SELECT contract_id, ordinal, count(*) OVER s - 1 AS rivals, coalesce(min(a) OVER s <> max(a) OVER s, false) OR (count(a) OVER s > 0 AND count(a) OVER s < count(*) OVER s) AS conflict FROM i
WINDOW s AS (PARTITION BY {_SLOTS}) QUALIFY row_number() OVER (PARTITION BY {_SLOTS} ORDER BY {_RANK}, ordinal) = 1
"""


def structural_dedupe(spark: SparkSession, d: str) -> DataFrame:
    # a row's own place in its contract: several lines may share a number
    own = (F.col("ordinal") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    keyed = _candidates(spark, d, ", l_partkey, l_suppkey, l_quantity, l_shipdate")
    stated = {"ordinal": own, "category": F.when(F.col("l_quantity") > 25, "unknown").otherwise(F.col("category")), "amount": F.round("amount", -5), "label": F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("l_partkey") % len(_LABELS) + 1).cast("int")), "start_date": F.when(F.col("l_suppkey") % 4 == 0, F.to_date("l_shipdate"))}
    return finance.deduplicate(keyed.withColumns(stated)).select("contract_id", "ordinal", "merged")


_LABELS = ("Monthly  Rent", "rent of the flat", "القسط", "قسط شهري", "", "Car loan", "loan")


def _fold_sql() -> str:
    labels = ", ".join(f"'{x}'" for x in _LABELS)
    label = rf"regexp_replace(trim(regexp_replace(lower(([{labels}])[l_partkey % {len(_LABELS)} + 1]), '\s+', ' ', 'g')), '(^|\s)ال(\S)', '\1\2', 'g')"
    same = lambda c: f"(h.{c} IS NULL OR d.{c} IS NULL OR h.{c} = d.{c})"
    me = "struct_pack(mandatory := {0}mandatory, conditional := {0}conditional, day := {0}day, words := {0}words)"
    view = _SQL_VIEW.replace("\nFROM lineitem", ", l_partkey, l_suppkey, l_quantity, l_shipdate\nFROM lineitem")
    return f"""
WITH RECURSIVE i AS (SELECT * REPLACE ((ordinal * 10000000 + l_partkey) * 100000 + l_suppkey AS ordinal, CASE WHEN l_quantity > 25 THEN 'unknown' ELSE category END AS category), round(round(amount / 10000, 0) / 10, 0) * 100000 AS a,
  CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_shipdate AS DATE) END AS day, list_filter(string_split({label}, ' '), lambda w: w <> '') AS words FROM {view}),
m AS (SELECT *, dense_rank() OVER (ORDER BY contract_id, category, frequency, currency, a) AS g, row_number() OVER (PARTITION BY contract_id, category, frequency, currency, a ORDER BY ordinal) AS n FROM i),
f(g, n, heads, c) AS (
  SELECT g, n, [{me.format('')}], 1::BIGINT FROM m WHERE n = 1
  UNION ALL
  SELECT g, n, CASE WHEN hit IS NULL THEN list_append(heads, me) ELSE heads END, coalesce(hit, len(heads) + 1) FROM (
    SELECT d.g, d.n, heads, {me.format('d.')} AS me, nullif(list_position(list_transform(heads, lambda h: {same('mandatory')} AND {same('conditional')} AND {same('day')} AND NOT (d.category = 'unknown' AND NOT list_has_any(h.words, d.words))), true), 0)::BIGINT AS hit
    FROM f JOIN m d ON d.g = f.g AND d.n = f.n + 1))
SELECT contract_id, ordinal, count(*) OVER (PARTITION BY g, c) AS merged FROM m JOIN f USING (g, n)
QUALIFY row_number() OVER (PARTITION BY g, c ORDER BY {_RANK}, ordinal) = 1
"""


def contract_durations(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("contract_id")).agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    day = lambda c: F.date_format(c, "d/M/yyyy")
    return dates.select("contract_id", F.datediff(M.iso_date(day("e")), M.iso_date(day("s"))).alias("days"))


def installment_mode(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("contract_id"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return presentation.most_repeated(numbers.withColumn("value", F.col("value") * 100), ["contract_id"], 100, 100_000).select("contract_id", "value", "times")


_MODE_SQL = """
SELECT l_suppkey AS contract_id, l_quantity * 100 AS value, count(*) AS times FROM lineitem WHERE l_quantity * 100 BETWEEN 100 AND 100000 GROUP BY 1, 2 HAVING count(*) >= 2
QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY times DESC, min(l_orderkey * 10 + l_linenumber)) = 1
"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("role = 'user'")


def question_signals(spark: SparkSession, d: str) -> DataFrame:
    return routing.question_signals(_questions(spark, d)).select("conv_id", "turn", *routing.PHRASES, "about_contract", "comparison")


def question_routes(spark: SparkSession, d: str) -> DataFrame:
    return routing.route_questions(_questions(spark, d)).select("conv_id", "turn", "route", "confidence")


def route_availability(spark: SparkSession, d: str) -> DataFrame:
    out = routing.missing_sources(routing.route_questions(_questions(spark, d)), ["contract"])
    return out.groupBy("route").agg(F.count("*").alias("n"), F.sum(F.size("unavailable")).alias("n_unavailable"))


def _plain(phrase: str) -> str:
    """A phrase as normalised questions have it, for the SQL."""
    out = re.sub("[ً-ْٰـ]", "", phrase.lower()).translate(str.maketrans("إأآىة", "ااايه"))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", out)).strip()


def _signals_sql() -> str:
    q = r"trim(regexp_replace(regexp_replace(translate(lower(text), 'إأآىة', 'ااايه'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    flags = ", ".join(f"({' OR '.join(f'''contains(q, '{_plain(p)}')''' for p in phrases)}) AS {name}" for name, phrases in routing.PHRASES.items())
    return f"""SELECT *, compare OR (rights AND actor AND action) OR (legal_term AND about_contract) AS comparison FROM (SELECT *, ownership OR structure AS about_contract FROM (
      SELECT conv_id, turn, {flags} FROM (SELECT conv_id, turn, {q} AS q FROM conversations WHERE role = 'user')))"""


def _routes_sql() -> str:
    return f"""SELECT conv_id, turn, route, CAST(CASE WHEN injection THEN 0.95 WHEN route = 'general' THEN 0.4 ELSE least(0.95, round(0.5 + 0.15 * (about_contract::INT + financial_term::INT + legal_term::INT + comparison::INT), 2)) END AS DOUBLE) AS confidence FROM (
      SELECT *, CASE WHEN injection THEN 'general' WHEN comparison AND financial_term THEN 'all' WHEN comparison THEN 'contract_and_legal' WHEN about_contract AND financial_term THEN 'contract_and_financial'
        WHEN about_contract THEN 'contract' WHEN financial_term THEN 'financial' WHEN legal_term THEN 'legal' ELSE 'general' END AS route FROM ({_signals_sql()}))"""


_AVAILABLE_SQL = "SELECT route, count(*) AS n, CAST(sum(CASE route WHEN 'general' THEN 0 WHEN 'contract' THEN 0 WHEN 'all' THEN 2 ELSE 1 END) AS BIGINT) AS n_unavailable FROM ({0}) GROUP BY route"


def text_classification(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat_ws(" ", F.col("p_name"), F.element_at(F.array(*[F.lit(x) for x in _SAMPLES]), (F.col("p_partkey") % len(_SAMPLES) + 1).cast("int")))
    t = table(spark, d, "part").select("p_partkey", label.alias("t"))
    f = M.frequency_of(F.col("t"))
    return t.select("p_partkey", f.alias("frequency"), M.obligation_type(f, F.col("t")).alias("obligation"), M.fee_type(F.col("t")).alias("fee"), M.penalty_type(F.col("t")).alias("penalty"), M.mandatory_in(F.col("t")).cast("string").alias("mandatory"), M.conditional_in(F.col("t")).cast("string").alias("conditional"), M.timing_in(F.col("t")).alias("timing"), M.refundable_in(F.col("t")).cast("string").alias("refundable"), M.scenario_in(F.col("t")).alias("scenario"))


_SAMPLES = (
    "Monthly   Installment due at signing", "Security deposit, refundable", "Annual service fee", "Late fee if overdue", "Down payment (non-refundable)",
    "Balloon payment at maturity", "Early settlement amount", "Optional insurance premium per year", "Outstanding balance upon default", "VAT, mandatory", "",
)


def _words_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w.lower().replace(chr(39), chr(39) * 2)}')" for w in words if w.isascii()) + ")"


def _lists_sql(lists: dict, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_words_sql(v)} THEN '{k}'" for k, v in lists.items()) + f" ELSE {otherwise} END"


def _classify_sql() -> str:
    samples = ", ".join(f"'{s}'" for s in _SAMPLES)
    scenario = {"early_settlement_scenario": L.SAYS_EARLY_SETTLEMENT_BALANCE + L.SAYS_EARLY_SETTLEMENT_PAYMENT, "default_scenario": L.SAYS_DEFAULT_SCENARIO, "cancellation_scenario": L.SAYS_CANCELLATION_SCENARIO, "insurance_claim_scenario": L.SAYS_INSURANCE_CLAIM}
    cond, late, now = (_words_sql(x) for x in (L.SAYS_CONDITIONAL, L.SAYS_DUE_LATER, L.SAYS_DUE_NOW))
    return rf"""WITH x AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || ([{samples}])[p_partkey % {len(_SAMPLES)} + 1]), '\s+', ' ', 'g')) AS t FROM part),
f AS (SELECT *, {_lists_sql(L.FREQUENCIES)} AS frequency FROM x)
SELECT p_partkey, frequency, coalesce({_lists_sql(L.OBLIGATION_TYPES)}, CASE WHEN frequency IN ('daily', 'weekly', 'monthly', 'quarterly', 'semi_annual', 'annual') THEN 'recurring_payment' WHEN frequency = 'one_time' THEN 'one_time_payment' ELSE 'unknown' END) AS obligation,
  {_lists_sql(L.FEE_TYPES, "'other'")} AS fee, {_lists_sql(L.PENALTY_TYPES, "'other'")} AS penalty,
  CASE WHEN {_words_sql(L.SAYS_MANDATORY)} THEN 'true' WHEN {_words_sql(L.SAYS_OPTIONAL)} THEN 'false' WHEN {cond} THEN NULL ELSE 'true' END AS mandatory, CASE WHEN {cond} THEN 'true' END AS conditional,
  CASE WHEN {late} THEN 'due_later' WHEN {now} THEN 'due_now' END AS timing, CASE WHEN {_words_sql(L.SAYS_NON_REFUNDABLE)} THEN 'false' WHEN {_words_sql(L.SAYS_REFUNDABLE)} THEN 'true' END AS refundable,
  {_lists_sql(scenario)} AS scenario FROM f"""


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), F.count("*").alias("n"))
    c = table(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.round("c_acctbal", 2).alias("monthly_income"), (F.col("c_nationkey") * 50.0).alias("essential_expenses"), F.lit(250.0).alias("existing_debt"), F.when(F.col("c_custkey") % 3 != 0, F.round(F.col("c_acctbal") * 4, 2)).alias("savings"), (F.col("most") / 100).alias("monthly_commitment"), F.round(F.col("n") * 100.0, 2).alias("upfront_costs"))


_BUDGET_CTE = """WITH s AS (SELECT o_custkey, max(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT c_custkey, round(c_acctbal, 2) AS income, c_nationkey * 50.0::DOUBLE AS spend, 250.0::DOUBLE AS debt, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal * 4, 2) END AS savings, a / 100 AS new, n * 100.0::DOUBLE AS upfront FROM customer LEFT JOIN s ON o_custkey = c_custkey)"""


def budget_impact(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n=4: F.round(c, n).alias(c)
    return finance.budget_impact(_budgets(spark, d)).select("c_custkey", r("available_before"), r("available_after"), r("contract_ratio"), r("outflow_ratio"), r("remaining_savings"))


_BUDGET_SQL = _BUDGET_CTE + """ SELECT c_custkey, round(income - spend - debt, 4) AS available_before, round(income - spend - debt - new, 4) AS available_after, CASE WHEN income > 0 THEN round(new / income * 100, 4) END AS contract_ratio,
  CASE WHEN income > 0 THEN round((spend + debt + new) / income * 100, 4) END AS outflow_ratio, round(savings - upfront, 4) AS remaining_savings  FROM b"""


def employment_budget_impact(spark: SparkSession, d: str) -> DataFrame:
    rows = _budgets(spark, d).withColumns({"guaranteed_income": F.col("monthly_commitment"), "deductions": F.lit(10.0), "upfront_payment": F.lit(None).cast("double")})
    both = finance.employment_budget_impact(rows, "replace_current_income").withColumn("mode", F.lit("replace")).unionByName(finance.employment_budget_impact(rows, "add_to_current_income").withColumn("mode", F.lit("add")))
    return both.select("c_custkey", "mode", F.round("income_after", 4).alias("income_after"), F.round("remaining_after", 4).alias("remaining_after"), F.round("income_change", 4).alias("income_change"))


_EMPLOYMENT_SQL = _BUDGET_CTE + """ SELECT c_custkey, mode, round(after, 4) AS income_after, round(after - spend - debt - 10, 4) AS remaining_after, round(change, 4) AS income_change FROM (
  SELECT *, 'replace' AS mode, new AS after, new - income AS change FROM b UNION ALL SELECT *, 'add', income + new, new FROM b)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    risk = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").when(F.col("doc_id") % 2 == 0, "low")
    return docs.join(labels, "doc_id", "left").select("source", "doc_id", risk.alias("risk"), presentation.first_sentence(F.col("text")).alias("summary"))


def worst_risk(spark: SparkSession, d: str) -> DataFrame:
    return presentation.worst_risk(_findings(spark, d), ["source"])


def tiered_findings(spark: SparkSession, d: str) -> DataFrame:
    return presentation.top_findings(_findings(spark, d), ["source"], "doc_id").select("source", "doc_id", "risk", "place", "summary")


_RISK = "CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' WHEN doc_id % 2 = 0 THEN 'low' END"
_FINDINGS_SQL = rf"""SELECT source, doc_id, risk, place, summary FROM (SELECT source, doc_id, {_RISK} AS risk, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, doc_id) AS INTEGER) AS place,
  regexp_replace(CASE WHEN regexp_matches(text, '[.!?؟]') THEN regexp_extract(text, '(?s)^.*?[.!?؟]') ELSE text END, '^\s+|\s+$', '', 'g') AS summary FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0) WHERE place <= 5"""


def json_validate(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    e = table(spark, d, "events").select("event_id", k.alias("k"))
    return e.select("event_id", "k", F.when(F.col("k").isNull(), "missing").when(F.col("k") > 90, "too_large").alias("issue"))


def queries() -> dict:
    names = (
        recurring_commitment, fee_rollup, penalty_rollup, exposure_by_currency, total_cost_difference, safe_ratios, single_currency_backfill, currency_distribution,
        conflict_resolution, structural_dedupe, contract_durations, installment_mode, question_signals, question_routes, route_availability, text_classification,
        budget_impact, employment_budget_impact, worst_risk, tiered_findings, json_validate,
    )
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    w = "OVER (PARTITION BY contract_id)"
    return {
        "recurring_commitment": _COMMIT_SQL,
        "fee_rollup": _FEE_SQL,
        "penalty_rollup": _PENALTY_SQL,
        "exposure_by_currency": f"SELECT contract_id, currency, CAST(round(sum(CAST(amount AS DECIMAL(38,6))), 2) AS DOUBLE) AS total FROM {_SQL_VIEW} WHERE amount IS NOT NULL AND currency IS NOT NULL AND NOT coalesce(conditional, false) AND coalesce(mandatory, true) AND {_INCLUDE} GROUP BY 1, 2",
        "total_cost_difference": _COST_SQL,
        "safe_ratios": _RATIO_SQL,
        "single_currency_backfill": f"SELECT contract_id, ordinal, coalesce(currency, CASE WHEN amount IS NOT NULL AND min(currency) {w} = max(currency) {w} THEN max(currency) {w} END) AS currency FROM {_SQL_VIEW}",
        "currency_distribution": f"SELECT contract_id, string_agg(currency || ': ' || n, ', ' ORDER BY n DESC, currency) AS distribution FROM (SELECT contract_id, currency, count(*) AS n FROM {_SQL_VIEW} WHERE currency IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1",
        "conflict_resolution": _CONFLICT_SQL,
        "structural_dedupe": _fold_sql(),
        "contract_durations": "SELECT l_orderkey AS contract_id, CAST(date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS INTEGER) AS days FROM lineitem GROUP BY 1",
        "installment_mode": _MODE_SQL,
        "question_signals": _signals_sql(),
        "question_routes": _routes_sql(),
        "route_availability": _AVAILABLE_SQL.format(_routes_sql()),
        "text_classification": _classify_sql(),
        "budget_impact": _BUDGET_SQL,
        "employment_budget_impact": _EMPLOYMENT_SQL,
        "worst_risk": f"SELECT source, min_by(r, CASE r WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS risk FROM (SELECT source, {_RISK} AS r FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source",
        "tiered_findings": _FINDINGS_SQL,
        "json_validate": "SELECT event_id, k, CASE WHEN k IS NULL THEN 'missing' WHEN k > 90 THEN 'too_large' END AS issue FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
    }
