"""The whole agreement engine over every order: nested facts, metrics and the audit of the calculation.

An order is an agreement of one of nine types; its line items are obligations, fees, penalties and
loose numbers, whose texts (in English and Arabic), amounts and currencies follow from the lines' keys
and prices by the rules below, alike in both languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import wordlists as L
from tallystone.functions.text import plain_keyword
from tallystone.operators import contracts as C
from tallystone.operators import finance as fin
from tallystone.plans.finance_queries import _combine, _flat, _sum_sql
from tallystone.session import table, written

TYPES = (*C.DETAILS, "other")
OBLIGATIONS = (
    "Monthly installment", "القسط الشهري", "Monthly rent", "Annual rent of the lease", "Down payment", "الدفعة المقدمة", "Security deposit", "Refundable security deposit",
    "Non-refundable deposit, payable at signing", "Balloon payment at maturity", "Housing allowance", "بدل النقل", "Total fixed monthly compensation", "Performance bonus", "Medical insurance",
    "Vehicle value", "Total amount due at signing", "Early settlement amount", "Optional  maintenance plan", "Annual service charge", "Outstanding balance upon default", "إجمالي التكلفة", "Misc", "",
)
FEES = (
    "Administrative fee", "رسوم إدارية إلزامية", "Registration fee due at signing", "Refundable deposit", "Non-refundable deposit", "Deposit", "Wire transfer fee", "Optional service fee",
    "Annual maintenance fee", "Early termination fee", "Brokerage fee, mandatory", "Late fee", "عربون", "Insurance fee, if applicable", "Monthly account fee", "Cash price paperwork",
)
PENALTIES = (
    ("Late payment penalty", "per late-payment incident"), ("Early termination compensation", "if the tenant terminates early"), ("غرامة التأخير", None), (None, "upon default"), ("Compensation", "payable to the employee, without just cause"),
    ("Cancellation charge", "if cancelled"), ("Returned cheque", None), ("Property damage", "in case of damage"),
)
NUMBERS = (
    ("Vehicle value", "SAR"), ("Total cost", "saudi riyal"), ("Monthly payment", "ريال"), ("Term", "months"), ("Outstanding balance", "SR"), ("Profit rate", "%"), ("إجمالي الأقساط", "SAR"), ("Total due at signing", "sar"),
    ("Down payment", "SAR"), ("Purchase price", None), ("Monthly installment", "usd"), ("Total payments", "x"),
)
_UNITS = ("SAR", "sar", "ريال", "Saudi Riyal", "SAR", "SR", "SAR", "SAR", "SAR", None)
#: What an order states in the typed fields, as expressions of both languages over b (its price, whole) and c (its customer).
_PER_CENT = {"interest_rate": "8.75", "interest_rate_apr": "24.5"}
FIELDS = {
    "auto_finance": {"financed_amount": "CASE WHEN c % 5 > 0 THEN b END", "down_payment": "floor(b / 10)", "loan_term_months": "CASE WHEN c % 3 > 0 THEN 48 END", "monthly_installment": "floor(b / 48)", "balloon_payment": "CASE WHEN c % 2 = 0 THEN floor(b / 5) END"},
    "personal_finance": {"loan_amount": "b", "loan_term_months": "CASE WHEN c % 3 > 0 THEN 36 END", "monthly_installment": "floor(b / 30)"},
    "mortgage": {"loan_amount": "b * 10", "down_payment": "b", "loan_term_years": "CASE WHEN c % 4 > 0 THEN 20 END", "monthly_installment": "floor(b / 20)"},
    "credit_card": {"credit_limit": "b", "annual_fee": "300", "late_fee": "150", "cash_advance_fee": "75"},
    "lease": {"monthly_rent": "floor(b / 60)", "security_deposit": "floor(b / 30)", "lease_term_months": "CASE WHEN c % 3 > 0 THEN 12 END"},
    "insurance": {"premium_amount": "floor(b / 100)", "deductible": "500", "coverage_amount": "b", "policy_term_months": "CASE WHEN c % 3 > 0 THEN 12 END"},
    "employment": {"base_salary": "floor(b / 40)"},
    "subscription": {"billing_amount": "floor(b / 500)"},
}
for _kind, _rate in (("auto_finance", "interest_rate"), ("personal_finance", "interest_rate"), ("mortgage", "interest_rate"), ("credit_card", "interest_rate_apr")):
    FIELDS[_kind][_rate] = _PER_CENT[_rate]
OFTEN = {"premium_frequency": ("annual", "Monthly", None), "salary_frequency": ("monthly", "per month", "شهري"), "billing_frequency": ("monthly", "every quarter", "سنوي")}
#: The rules of a line, over the columns of lineitem, b and k (the order's key).
_AMOUNT = "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(CASE l_partkey % 6 WHEN 0 THEN floor(b / 48) WHEN 1 THEN floor(b / 60) * 12 WHEN 2 THEN floor(b / 60) WHEN 3 THEN floor(b / 10) ELSE floor(l_extendedprice) END AS DOUBLE) END"
_KIND = "(l_partkey + l_linenumber) % 10"
_DOLLARS = "k % 7 = 0 AND l_suppkey % 3 = 0"
_STARTS = ("Start date", "تاريخ البداية", "Signed on")
_ENDS = ("Expiry date", "تاريخ الانتهاء", "Paid until")


def _pick(values: tuple, at: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"CAST({at} AS INT)") + 1)


def agreements(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a row of nested facts (``contracts.CONTRACT``)."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.floor("o_totalprice").cast("double").alias("b"), F.col("o_orderdate").alias("day"),
    ).withColumn("contract_type", _pick(TYPES, f"k % {len(TYPES)}"))
    fields = {}
    for kind, stated in FIELDS.items():
        for name, value in stated.items():
            fields[name] = F.when(F.col("contract_type") == kind, F.expr(value).cast("double")).otherwise(fields.get(name, F.lit(None).cast("double")))
    for name, words in OFTEN.items():
        fields[name] = _pick(words, "c % 3")
    names = spark.createDataFrame([], C.CONTRACT).schema["details"].dataType.names
    details = F.struct(*[fields[n].alias(n) for n in names])

    lines = table(spark, d, "lineitem").join(orders.select("k", "b").hint("merge"), F.col("l_orderkey") == F.col("k"))
    unit = F.when(F.expr(_DOLLARS), "USD").otherwise(_pick(_UNITS, f"l_suppkey % {len(_UNITS)}"))
    penalty = lambda part: _pick(tuple(p[part] for p in PENALTIES), f"l_suppkey % {len(PENALTIES)}")
    number = lambda part: _pick(tuple(n[part] for n in NUMBERS), f"l_suppkey % {len(NUMBERS)}")
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr(_KIND).alias("kind"), F.expr(_AMOUNT).alias("amount"), unit.alias("unit"),
        _pick(OBLIGATIONS, f"l_suppkey % {len(OBLIGATIONS)}").alias("due"), _pick(FEES, f"l_suppkey % {len(FEES)}").alias("fee"), penalty(0).alias("penalty"), penalty(1).alias("condition"),
        F.when(F.expr("l_suppkey % 5 = 0"), "Percent").otherwise(unit).alias("penalty_unit"), number(0).alias("label"), number(1).alias("number_unit"),
        _pick(("monthly", None, "سنوي", "one time"), "l_partkey % 4").alias("often"), F.when(F.expr("l_partkey % 5 = 0"), "01/02/2024").alias("due_date"),
        F.expr("CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("recurs"),
    )
    grouped = lines.groupBy(F.col("k").alias("_k")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    of = lambda lo, hi, make: F.transform(F.filter("x", lambda x: x["kind"].between(lo, hi)), make)
    start, end = F.date_format("day", "dd/MM/yyyy"), F.date_format(F.date_add("day", (F.col("c") % 900 + 30).cast("int")), "yyyy-MM-dd")
    rows = orders.join(grouped.hint("merge"), F.col("k") == F.col("_k"), "left")
    return rows.select(
        F.col("k").cast("string").alias("contract_id"), "contract_type", details.alias("details"),
        of(0, 3, lambda x: F.struct(x["due"].alias("description"), x["amount"].alias("amount"), x["unit"].alias("currency"), x["often"].alias("frequency"), x["due_date"].alias("due_date"))).alias("obligations"),
        of(4, 5, lambda x: F.struct(x["fee"].alias("description"), x["amount"].alias("amount"), x["unit"].alias("currency"), x["recurs"].alias("is_recurring"))).alias("fees"),
        of(6, 7, lambda x: F.struct(x["penalty"].alias("description"), x["amount"].alias("amount"), x["penalty_unit"].alias("currency"), x["condition"].alias("condition"))).alias("penalties"),
        of(8, 9, lambda x: F.struct(x["label"].alias("label"), x["amount"].alias("value"), x["number_unit"].alias("unit"))).alias("numbers"),
        F.array(F.struct(_pick(_STARTS, "c % 3").alias("label"), start.alias("date")), F.struct(_pick(_ENDS, "k % 3").alias("label"), end.alias("date"))).alias("dates"),
    )


_MONEY = (
    "monthly_equivalent", "annual_equivalent", "upfront_obligations", "balloon", "fees_total", "mandatory_fees", "upfront_fees", "conditional_fees", "penalties_total", "highest_penalty", "largest_payment",
    "principal", "stated_total", "deductible", "due_at_signing", "monthly_income", "scheduled", "repayment", "core", "financing_repayment", "financing_cost", "difference_amount", "upfront_exposure", "contingent_exposure",
)
_PLAIN = (
    "contract_id", "contract_type", "currency", "months", "years", "days", "duration_source", "difference", "mixed_recurring", "mixed_currency", "conflicts", "unquantified_contingent",
    "fees_to_base", "penalties_to_base", "upfront_to_base", "balloon_to_base", "cost_increase", "recurring_to_income",
)


def financial_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = C.financial_metrics(written(agreements(spark, d), "agreements"))
    totals = F.array_join(F.transform("totals_by_currency", lambda t: F.concat(t["currency"], F.lit(" "), F.format_string("%.2f", t["total"]))), ", ")
    return out.select(*_PLAIN, F.col("estimated_cost.status").alias("cost_status"), totals.alias("totals_by_currency"), *_flat(out, *_MONEY))


def calculation_audit(spark: SparkSession, d: str) -> DataFrame:
    return C.calculation_audit(written(agreements(spark, d), "agreements"))


def _q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list_sql(values: tuple, at: str) -> str:
    return f"([{', '.join(_q(v) for v in values)}])[CAST({at} AS INTEGER) + 1]"


def _norm_sql(text: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower(coalesce({text}, '')), '\s+', ' ', 'g')), '(^|\s)ال(\S)', '\1\2', 'g')"


def _has_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(plain_keyword(w))})" for w in words) + ")"


def _first_sql(text: str, lists: dict[str, tuple[str, ...]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_has_sql(text, words)} THEN '{name}'" for name, words in lists.items()) + f" ELSE {otherwise} END"


def _case_sql(key: str, table_: dict[str, str], otherwise: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {otherwise} END"


def _code_sql(unit: str) -> str:
    return f"CASE WHEN regexp_matches(trim({unit}), '^[A-Za-z]{{3}}$') THEN upper(trim({unit})) ELSE {_case_sql(f'lower(trim({unit}))', L.CURRENCY_NAMES)} END"


def _typed_sql() -> str:
    rows = []
    for kind, fields in C.DETAILS.items():
        for n, (field, name, label, target, what, often, mandatory, conditional, count) in enumerate(fields):
            special = target in ("special", "rate")
            value = f"CAST({FIELDS[kind][field]} AS DOUBLE)"
            by_word = often in OFTEN
            said = _list_sql(OFTEN[often], "c % 3") if by_word else _q(often)
            flag = lambda x: "NULL::BOOLEAN" if x is None else str(x).lower()
            rows.append(
                f"SELECT cid, ctype, 0 AS part, {n} AS i, '{'special' if special else target}' AS target, {_q(what if special else None)} AS skey, {_q(None if special else what)} AS cat, '{label}' AS label,"
                f" {'NULL::DOUBLE' if target == 'rate' else value} AS amount, NULL::VARCHAR AS currency, {said} AS often, {str(by_word).lower()} AS by_word, {f'CAST({FIELDS[kind][count]} AS DOUBLE)' if count else 'NULL::DOUBLE'} AS n_payments,"
                f" {flag(mandatory)} AS mandatory, {flag(conditional)} AS conditional, NULL::VARCHAR AS start_date, NULL::VARCHAR AS trigger, 'type_details' AS source, 'typeDetails.{name}' AS field, '{label}' AS evidence, 'high' AS confidence, NULL::BOOLEAN AS recurs"
                f" FROM o WHERE ctype = '{kind}' AND {value} IS NOT NULL"
            )
    return " UNION ALL ".join(rows)


def _ctes() -> str:
    """The candidates of every order, from the flat lines to those that win their slot (``fin``)."""
    by = "PARTITION BY cid"
    recurring = "('daily', 'weekly', 'monthly', 'quarterly', 'semi_annual', 'annual')"
    once = "('" + "', '".join(C._ONE_TIME_TYPES) + "')"
    line = lambda kind, n, label, amount, unit, often, due, trigger, source, field, evidence, confidence, where, recurs="NULL::BOOLEAN": (
        f"SELECT cid, ctype, {n} AS part, i, '{kind[0]}' AS target, {_q(kind[1])} AS skey, NULL::VARCHAR AS cat, {label} AS label, {amount} AS amount, {unit} AS currency, {often} AS often, true AS by_word, NULL::DOUBLE AS n_payments,"
        f" NULL::BOOLEAN AS mandatory, NULL::BOOLEAN AS conditional, {due} AS start_date, {trigger} AS trigger, '{source}' AS source, '{field}[' || i || ']' AS field, {evidence} AS evidence, '{confidence}' AS confidence, {recurs} AS recurs FROM n WHERE {where}"
    )
    none = "NULL::VARCHAR"
    due = ("due", "amount", "unit", "financial_obligation", "financialObligations", "medium", "g = 0")
    loose = ("num", "amount", "nunit", "extracted_number", "extractedNumbers", "low", "g = 3")
    stated = lambda key, words, x, n: line(("special", key), n, x[0], x[1], x[2], none, none, none, x[3], x[4], x[0], x[5], f"{x[6]} AND amount IS NOT NULL AND {_has_sql(_norm_sql(x[0]), words)}")
    raw = " UNION ALL ".join([
        _typed_sql(),
        line(("obligation", None), 1, "due", "amount", "unit", "often", "due_date", none, "financial_obligation", "financialObligations", "due", "medium", "g = 0"),
        line(("fee", None), 2, "fee", "amount", "unit", none, none, none, "fee_item", "fees", "fee", "medium", "g = 1", "recurs"),
        line(("penalty", None), 3, "pen", "CASE WHEN l_suppkey % 5 <> 0 THEN amount END", "CASE WHEN l_suppkey % 5 <> 0 THEN unit END", none, none, "cond", "penalty_item", "penalties", "coalesce(pen, cond)", "medium", "g = 2"),
        line(("obligation", None), 4, "num", "amount", "nunit", none, none, none, "extracted_number", "extractedNumbers", "num", "low", f"g = 3 AND amount IS NOT NULL AND {_code_sql('nunit')} IS NOT NULL"),
        stated("statedTotalCost", L.SAYS_TOTAL_COST, due, 5), stated("statedTotalCost", L.SAYS_TOTAL_COST, loose, 6),
        stated("statedDueAtSigning", L.SAYS_DUE_AT_SIGNING_TOTAL, due, 7), stated("statedDueAtSigning", L.SAYS_DUE_AT_SIGNING_TOTAL, loose, 8),
    ])
    scenario = {
        "early_settlement_scenario": L.SAYS_EARLY_SETTLEMENT_BALANCE + L.SAYS_EARLY_SETTLEMENT_PAYMENT, "default_scenario": L.SAYS_DEFAULT_SCENARIO,
        "cancellation_scenario": L.SAYS_CANCELLATION_SCENARIO, "insurance_claim_scenario": L.SAYS_INSURANCE_CLAIM,
    }
    rank = "CASE source WHEN 'type_details' THEN 0 WHEN 'financial_obligation' THEN 1 WHEN 'fee_item' THEN 2 WHEN 'penalty_item' THEN 2 ELSE 3 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, length(coalesce(evidence, '')) DESC, field, ordinal"
    same = lambda c: f"(h.{c} IS NULL OR d.{c} IS NULL OR h.{c} = d.{c})"
    return f"""
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS cid, o_orderkey AS k, o_custkey AS c, floor(o_totalprice) AS b, CAST(o_orderdate AS DATE) AS day, {_list_sql(TYPES, f'o_orderkey % {len(TYPES)}')} AS ctype FROM orders),
l AS (SELECT o.*, lineitem.*, {_AMOUNT} AS amount, CASE WHEN {_DOLLARS} THEN 'USD' ELSE {_list_sql(_UNITS, f'l_suppkey % {len(_UNITS)}')} END AS unit,
  CASE WHEN {_KIND} < 4 THEN 0 WHEN {_KIND} < 6 THEN 1 WHEN {_KIND} < 8 THEN 2 ELSE 3 END AS g FROM lineitem JOIN o ON k = l_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY cid, g ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, {_list_sql(OBLIGATIONS, f'l_suppkey % {len(OBLIGATIONS)}')} AS due, {_list_sql(FEES, f'l_suppkey % {len(FEES)}')} AS fee,
  {_list_sql(tuple(p[0] for p in PENALTIES), f'l_suppkey % {len(PENALTIES)}')} AS pen, {_list_sql(tuple(p[1] for p in PENALTIES), f'l_suppkey % {len(PENALTIES)}')} AS cond, {_list_sql(tuple(x[0] for x in NUMBERS), f'l_suppkey % {len(NUMBERS)}')} AS num,
  {_list_sql(tuple(x[1] for x in NUMBERS), f'l_suppkey % {len(NUMBERS)}')} AS nunit, CASE l_partkey % 4 WHEN 0 THEN 'monthly' WHEN 2 THEN 'سنوي' WHEN 3 THEN 'one time' END AS often, CASE WHEN l_partkey % 5 = 0 THEN '01/02/2024' END AS due_date,
  CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END AS recurs FROM l),
raw AS ({raw}),
ph AS (SELECT label AS a, evidence AS e, trigger AS tr, {_norm_sql('label')} AS t1, {_norm_sql("concat_ws(' ', label, evidence)")} AS t2, {_norm_sql("concat_ws(' ', label, evidence, trigger)")} AS t3, {_norm_sql("concat_ws(' ', label, trigger)")} AS tp FROM (SELECT DISTINCT label, evidence, trigger FROM raw)),
pf AS (SELECT *, {_first_sql('t1', L.FREQUENCIES)} AS freq, {_first_sql('t1', L.OBLIGATION_TYPES)} AS otype, {_first_sql('t1', L.FEE_TYPES, "'other'")} AS ftype, {_first_sql('tp', L.PENALTY_TYPES, "'other'")} AS ptype,
  CASE WHEN {_has_sql('t1', L.SAYS_MANDATORY)} THEN true WHEN {_has_sql('t1', L.SAYS_OPTIONAL)} THEN false WHEN {_has_sql('t1', L.SAYS_CONDITIONAL)} THEN NULL ELSE true END AS mand, CASE WHEN {_has_sql('t1', L.SAYS_CONDITIONAL)} THEN true END AS cond,
  CASE WHEN {_has_sql('t1', L.SAYS_NON_REFUNDABLE)} THEN false WHEN {_has_sql('t1', L.SAYS_REFUNDABLE)} THEN true END AS refu, {_has_sql('t1', L.SAYS_DEPOSIT)} AS depo,
  {_has_sql('t2', L.SAYS_ASSET_VALUE)} AS asset, {_has_sql('t2', L.SAYS_TOTAL_COST)} AS total, {_first_sql('t3', scenario)} AS scen, {_has_sql('t2', L.SAYS_EARLY_SETTLEMENT_BALANCE)} AS early, {_has_sql('t2', C.RENT_WORDS)} AS rent,
  {_has_sql('t2', L.SAYS_NON_CASH_BENEFIT)} AS benefit, {_has_sql('t2', L.SAYS_CONDITIONAL_COMPENSATION)} AS bonus, {_has_sql('t2', L.SAYS_STATED_TOTAL_COMPENSATION)} AS pay_total, {_has_sql('t2', L.SAYS_COMPENSATION_COMPONENT)} AS pay_part, {_has_sql('t3', L.SAYS_EMPLOYEE_ENTITLEMENT)} AS entitled,
  list_filter(string_split(t1, ' '), lambda w: w <> '') AS toks FROM ph),
c1 AS (SELECT raw.*, pf.* EXCLUDE (a, e, tr, t2, t3, tp, cond), pf.cond AS says_cond, CASE WHEN by_word THEN {_first_sql(_norm_sql('often'), L.FREQUENCIES)} ELSE often END AS said FROM raw JOIN pf ON label IS NOT DISTINCT FROM a AND evidence IS NOT DISTINCT FROM e AND trigger IS NOT DISTINCT FROM tr),
c2 AS (SELECT *, CASE WHEN part = 1 THEN coalesce(said, freq) WHEN part = 4 THEN freq WHEN part = 2 THEN CASE WHEN recurs = false THEN 'one_time' ELSE freq END WHEN part = 0 THEN said END AS f0 FROM c1),
c3 AS (SELECT * EXCLUDE (cat), CASE WHEN part IN (1, 4) THEN coalesce(otype, CASE WHEN f0 IN {recurring} THEN 'recurring_payment' WHEN f0 = 'one_time' THEN 'one_time_payment' ELSE 'unknown' END) WHEN part = 2 THEN ftype WHEN part = 3 THEN ptype ELSE cat END AS cat FROM c2),
c4 AS (SELECT cid, ctype, row_number() OVER ({by} ORDER BY part, i) - 1 AS ordinal, target, skey, cat, label, amount, {_code_sql('currency')} AS currency, CASE WHEN part IN (1, 4) THEN coalesce(f0, CASE WHEN cat IN {once} THEN 'one_time' END) ELSE f0 END AS frequency, n_payments,
  CASE WHEN part = 1 THEN coalesce(mand, NOT coalesce(says_cond, false)) WHEN part = 2 THEN mand ELSE mandatory END AS mandatory, CASE WHEN part IN (1, 2) THEN says_cond WHEN part = 3 THEN true ELSE conditional END AS conditional, CASE WHEN part IN (1, 2) THEN refu END AS refundable,
  start_date, source, field, evidence, confidence, depo, asset, total, scen, early, rent, benefit, bonus, pay_total, pay_part, entitled, toks, t1 FROM c3),
c5 AS (SELECT *, coalesce(scen, CASE WHEN role IN ('asset_value', 'reference_value') THEN 'reference_only' END, 'normal_contract_path') AS context FROM (SELECT *, CASE WHEN skey IS NOT NULL THEN {_case_sql('skey', C.SPECIAL_ROLES)} WHEN target = 'fee' THEN CASE WHEN coalesce(mandatory, false) AND NOT coalesce(conditional, false) THEN 'mandatory_fee' ELSE 'conditional_fee' END
  WHEN target = 'penalty' THEN 'penalty' WHEN asset THEN 'asset_value' WHEN total THEN 'reference_value' WHEN scen IS NOT NULL THEN CASE WHEN early THEN 'scenario_balance' ELSE 'scenario_payment' END ELSE {_case_sql('cat', C.TYPE_ROLES, "'unknown'")} END AS role FROM c4)),
c6 AS (SELECT * REPLACE (CASE WHEN to_key IS NOT NULL THEN 'special' ELSE target END AS target, coalesce(to_key, skey) AS skey, CASE WHEN to_key IS NOT NULL THEN 'reference_value' WHEN is_benefit THEN 'non_cash_benefit' WHEN is_bonus OR (ctype = 'employment' AND target = 'penalty' AND entitled) THEN 'conditional_income' ELSE role END AS role,
    CASE WHEN to_key IS NOT NULL THEN 'reference_only' ELSE context END AS context, CASE WHEN is_benefit OR is_bonus THEN false ELSE mandatory END AS mandatory, CASE WHEN is_bonus THEN true ELSE conditional END AS conditional) FROM (
  SELECT *, CASE WHEN ctype = 'lease' AND target = 'obligation' AND frequency = 'annual' AND rent AND abs(amount - 12 * max(CASE WHEN field = 'typeDetails.monthlyRent' THEN amount END) OVER ({by})) <= 0.01 THEN 'recurringEquivalent'
      WHEN pays AND NOT is_benefit AND NOT is_bonus AND pay_total THEN 'statedTotalCompensation' WHEN pays AND NOT is_benefit AND NOT is_bonus AND pay_part THEN 'salaryComponent' END AS to_key
  FROM (SELECT *, pays AND benefit AS is_benefit, pays AND NOT benefit AND bonus AS is_bonus FROM (SELECT *, ctype = 'employment' AND target IN ('obligation', 'fee') AS pays FROM c5)))),
pay AS (SELECT cid, sum(CAST(amount AS DECIMAL(38,6))) FILTER (WHERE skey = 'salaryComponent' AND amount IS NOT NULL)::DOUBLE AS parts, arg_min(currency, ordinal) FILTER (WHERE skey = 'salaryComponent' AND amount IS NOT NULL AND currency IS NOT NULL) AS part_currency,
  arg_min(struct_pack(a := amount, c := currency, l := label), ordinal) FILTER (WHERE skey = 'statedTotalCompensation' AND amount IS NOT NULL) AS t, max(ordinal) + 1 AS ordinal FROM c6 WHERE ctype = 'employment' GROUP BY cid),
inc AS (SELECT cid, ordinal, coalesce(abs(t.a - parts) <= 0.01, false) AS agrees, parts, part_currency, t FROM pay WHERE parts IS NOT NULL OR t IS NOT NULL),
c7 AS (SELECT cid, ctype, ordinal, target, skey, cat, label, amount, currency, frequency, n_payments, mandatory, conditional, refundable, start_date, source, field, evidence, confidence, depo, toks, t1, role, context FROM c6
  UNION ALL SELECT cid, 'employment', ordinal, 'special', 'monthlyIncome', NULL, 'Guaranteed monthly employment income', CASE WHEN agrees OR parts IS NULL THEN t.a ELSE parts END, CASE WHEN agrees THEN coalesce(t.c, part_currency) WHEN parts IS NULL THEN t.c ELSE part_currency END,
    'monthly', NULL, true, false, NULL, NULL, 'type_details', 'employment.guaranteedMonthlyIncome', CASE WHEN agrees OR parts IS NULL THEN t.l ELSE 'sum of guaranteed salary components' END, 'high', false, ['guaranteed', 'monthly', 'employment', 'income'], 'guaranteed monthly employment income', 'income', 'normal_contract_path' FROM inc),
c8 AS (SELECT * REPLACE (coalesce(currency, CASE WHEN amount IS NOT NULL THEN own END) AS currency) FROM (SELECT *, CASE WHEN min(currency) OVER ({by}) = max(currency) OVER ({by}) THEN max(currency) OVER ({by}) END AS own FROM c7)),
m AS (SELECT *, coalesce(cat, 'unknown') IN ('unknown', 'other') AS vague, row_number() OVER (PARTITION BY cid, target, skey, cat, frequency, currency, printf('%.2f', amount) ORDER BY ordinal) AS mn, dense_rank() OVER (ORDER BY cid, target, skey, cat, frequency, currency, printf('%.2f', amount)) AS grp FROM c8),
fold(grp, mn, heads, cl) AS (
  SELECT grp, mn, [struct_pack(mandatory := mandatory, conditional := conditional, start_date := start_date, toks := toks)], 1::BIGINT FROM m WHERE mn = 1
  UNION ALL
  SELECT grp, mn, CASE WHEN hit IS NULL THEN list_append(heads, me) ELSE heads END, coalesce(hit, len(heads) + 1) FROM (
    SELECT d.grp, d.mn, heads, struct_pack(mandatory := d.mandatory, conditional := d.conditional, start_date := d.start_date, toks := d.toks) AS me,
      nullif(list_position(list_transform(heads, lambda h: {same('mandatory')} AND {same('conditional')} AND {same('start_date')} AND NOT (d.vague AND NOT list_has_any(h.toks, d.toks))), true), 0)::BIGINT AS hit
    FROM fold JOIN m d ON d.grp = fold.grp AND d.mn = fold.mn + 1)),
dd AS (SELECT m.* FROM m JOIN fold USING (grp, mn) QUALIFY row_number() OVER (PARTITION BY grp, cl ORDER BY {rank}) = 1),
sl AS (SELECT *, CASE WHEN target = 'special' THEN 'special|' || skey || CASE WHEN skey IN ('statedTotalCost', 'salaryComponent') THEN '|' || t1 ELSE '' END ELSE concat_ws('|', target, coalesce(cat, ''), coalesce(currency, ''), coalesce(frequency, ''), t1) END AS slot FROM dd),
rk AS (SELECT *, min(ordinal) OVER s AS position, coalesce(min(amount) OVER s <> max(amount) OVER s, false) OR (count(amount) OVER s > 0 AND count(amount) OVER s < count(*) OVER s) AS conflict, row_number() OVER (PARTITION BY cid, slot ORDER BY {rank}) AS place,
  first(field) OVER (PARTITION BY cid, slot ORDER BY {rank}) AS winner FROM sl WINDOW s AS (PARTITION BY cid, slot)),
fin AS (SELECT *, target = 'fee' AS fee, target = 'penalty' AS pen, coalesce(mandatory, false) AND NOT coalesce(conditional, false) AS sure, coalesce(frequency = 'one_time', false) AS one, coalesce(cat = 'balloon_payment', false) AS balloon,
  target = 'obligation' AND role NOT IN {fin.EXCLUDED_ROLES} AND context NOT IN {fin.EXCLUDED_CONTEXTS} AS due,
  CASE WHEN target = 'fee' AND depo OR target <> 'fee' AND coalesce(cat = 'deposit', false) THEN CASE WHEN refundable THEN 'out' WHEN refundable IS NULL THEN 'open' ELSE 'in' END WHEN target = 'fee' AND coalesce(refundable, false) THEN 'out' ELSE 'in' END AS stays,
  CASE frequency WHEN 'daily' THEN 365::DOUBLE / 12 WHEN 'weekly' THEN 52::DOUBLE / 12 WHEN 'monthly' THEN 1::DOUBLE WHEN 'quarterly' THEN 1::DOUBLE / 3 WHEN 'semi_annual' THEN 1::DOUBLE / 6 WHEN 'annual' THEN 1::DOUBLE / 12 END AS factor FROM rk)"""


def _metrics_ctes() -> str:
    """Metrics of every order (``mt``) from the final candidates."""
    last = lambda key: f"arg_max(struct_pack(a := amount, c := currency, f := factor), position) FILTER (WHERE target = 'special' AND skey = '{key}')"
    mixed = lambda where: f"coalesce(min(currency) FILTER (WHERE ({where}) AND amount IS NOT NULL) < max(currency) FILTER (WHERE ({where}) AND amount IS NOT NULL), false)"
    money = lambda x, name, factor="": f"CASE WHEN {x}.a{factor} IS NOT NULL AND {x}.c IS NOT NULL THEN CAST(round(CAST({x}.a{factor} AS DECIMAL(38,6)), 2) AS DOUBLE) END AS {name}_value, CASE WHEN {x}.a{factor} IS NOT NULL AND {x}.c IS NOT NULL THEN {x}.c END AS {name}_currency"
    term = {"auto_finance": "loan_term_months", "personal_finance": "loan_term_months", "lease": "lease_term_months", "insurance": "policy_term_months"}
    months = "CASE ctype " + " ".join(f"WHEN '{k}' THEN CAST({FIELDS[k][v]} AS DOUBLE)" for k, v in term.items()) + " END"
    date = "CASE WHEN c % 3 < 2 AND k % 3 < 2 THEN CAST(c % 900 + 30 AS INTEGER) END"
    ratio = lambda n, name: f"CASE WHEN {n}_currency = principal_currency AND principal_value <> 0 THEN CAST(round(CAST({n}_value / principal_value * 100 AS DECIMAL(38,6)), 2) AS DOUBLE) END AS {name}"
    sums = ", ".join([
        _sum_sql("(amount * factor)", "recurs", "monthly_equivalent"), _sum_sql("(amount * factor * 12)", "recurs", "annual_equivalent"), _sum_sql("amount", "once AND NOT balloon", "upfront_obligations"), _sum_sql("amount", "once AND balloon", "balloon"),
        _sum_sql("amount", "fee", "fees_total"), _sum_sql("amount", "sure_fee", "mandatory_fees"), _sum_sql("amount", "fee AND one", "upfront_fees"), _sum_sql("amount", "fee AND coalesce(conditional, false)", "conditional_fees"),
        _sum_sql("amount", "pen", "penalties_total"), _sum_sql("amount", "pen", "highest_penalty", "max"), _sum_sql("amount", "upfront", "up"), _sum_sql("amount", "once OR sure_fee", "largest_payment", "max"),
    ])
    return f"""
ff AS (SELECT *, due AND coalesce(mandatory, false) AND factor IS NOT NULL AS recurs, due AND sure AND one AND stays = 'in' AS once, fee AND sure AND stays = 'in' AS sure_fee, due AND coalesce(mandatory, false) AND one AND NOT balloon AS upfront,
  fee AND NOT coalesce(conditional, false) AND coalesce(mandatory, true) AND stays = 'in' AS exposed, due AND sure AND NOT one AS other_due FROM fin WHERE place = 1),
pr AS (SELECT cid, max(own) AS currency, {sums}, {mixed('recurs')} AS mixed_recurring, {mixed('upfront')} AS mixed_up, coalesce(min(currency) < max(currency), false) AS mixed_currency, count(*) FILTER (WHERE conflict) AS conflicts,
  bool_or(amount IS NULL OR currency IS NULL) FILTER (WHERE pen OR (fee AND coalesce(conditional, false))) AS unquantified_contingent, arg_min(struct_pack(a := amount, c := currency), field) FILTER (WHERE due AND balloon) AS bal,
  {last('principal')} AS p, {last('statedTotalCost')} AS st, {last('insuranceDeductible')} AS de, {last('monthlyIncome')} AS ic, {last('statedDueAtSigning')} AS si FROM ff GROUP BY cid),
ct AS (SELECT cid, arg_min(n_payments, position) AS counted FROM ff WHERE target = 'obligation' AND cat = 'recurring_payment' AND frequency = 'monthly' AND n_payments > 0 GROUP BY cid),
du AS (SELECT cid, ctype, {months} AS stated, CASE WHEN ctype = 'mortgage' THEN CAST({FIELDS['mortgage']['loan_term_years']} AS DOUBLE) END AS yrs, {date} AS apart, counted FROM o LEFT JOIN ct USING (cid)),
tm AS (SELECT cid, ctype, coalesce(stated, CASE WHEN yrs IS NULL AND apart IS NULL THEN counted END) AS months, CASE WHEN stated IS NULL THEN yrs END AS years, CASE WHEN stated IS NULL AND yrs IS NULL THEN apart END AS days,
  CASE WHEN stated IS NOT NULL OR yrs IS NOT NULL THEN 'stated' WHEN apart IS NOT NULL THEN 'dates' WHEN counted IS NOT NULL THEN 'instalments' END AS duration_source FROM du),
m0 AS (SELECT tm.*, pr.* EXCLUDE (cid, mixed_recurring, mixed_up, mixed_currency, conflicts), coalesce(mixed_recurring, false) AS mixed_recurring, coalesce(mixed_up, false) AS mixed_up, coalesce(mixed_currency, false) AS mixed_currency, coalesce(conflicts, 0) AS conflicts,
  {money('p', 'principal')}, {money('st', 'stated_total')}, {money('de', 'deductible')}, {money('si', 'due_at_signing')}, {money('bal', 'bp')}, {money('ic', 'monthly_income', '*ic.f')} FROM tm LEFT JOIN pr USING (cid)),
m1 AS (SELECT *, CASE WHEN months IS NOT NULL THEN CAST(round(CAST(monthly_equivalent_value * months AS DECIMAL(38,6)), 2) AS DOUBLE) END AS scheduled_value, CASE WHEN months IS NOT NULL THEN monthly_equivalent_currency END AS scheduled_currency FROM m0),
m2 AS (SELECT *, {_combine(['scheduled', 'balloon'], 'repayment')} FROM m1),
m3 AS (SELECT *, {_combine(['upfront_obligations', 'repayment', 'mandatory_fees'], 'core')}, CASE WHEN principal_value IS NOT NULL THEN repayment_value END AS financing_repayment_value, CASE WHEN principal_value IS NOT NULL THEN repayment_currency END AS financing_repayment_currency,
  {_combine(['up', 'upfront_fees'], 'ue')}, {_combine(['conditional_fees', 'penalties_total', 'deductible'], 'contingent_exposure')} FROM m2),
m4 AS (SELECT *, coalesce(financing_repayment_currency = principal_currency AND principal_value <> 0 AND financing_repayment_value >= principal_value, false) AS fits, coalesce(stated_total_currency = core_currency, false) AS comparable,
  CASE WHEN NOT mixed_up THEN ue_value END AS upfront_exposure_value, CASE WHEN NOT mixed_up THEN ue_currency END AS upfront_exposure_currency FROM m3),
m5 AS (SELECT *, CASE WHEN fits THEN CAST(round(CAST(financing_repayment_value - principal_value AS DECIMAL(38,6)), 2) AS DOUBLE) END AS financing_cost_value, CASE WHEN fits THEN principal_currency END AS financing_cost_currency,
  CASE WHEN comparable THEN CAST(round(CAST(abs(stated_total_value - core_value) AS DECIMAL(38,6)), 2) AS DOUBLE) END AS difference_amount_value, CASE WHEN comparable THEN core_currency END AS difference_amount_currency,
  CASE WHEN comparable AND stated_total_value <> 0 THEN abs((stated_total_value - core_value) / abs(stated_total_value)) END AS rel,
  CASE WHEN core_value IS NULL THEN 'unavailable' WHEN duration_source IN ('stated', 'dates') THEN 'known' ELSE 'estimated' END AS cost_status FROM m4),
mt AS (SELECT *, CASE WHEN rel IS NULL THEN 'unavailable' WHEN rel < 0.005 THEN 'match' WHEN rel < 0.02 THEN 'rounding' WHEN rel < 0.1 THEN 'warning' ELSE 'conflict' END AS difference, {ratio('mandatory_fees', 'fees_to_base')}, {ratio('penalties_total', 'penalties_to_base')}, {ratio('upfront_exposure', 'upfront_to_base')},
  {ratio('bp', 'balloon_to_base')}, {ratio('financing_cost', 'cost_increase')}, CASE WHEN monthly_equivalent_currency = monthly_income_currency AND monthly_income_value <> 0 THEN CAST(round(CAST(monthly_equivalent_value / monthly_income_value * 100 AS DECIMAL(38,6)), 2) AS DOUBLE) END AS recurring_to_income FROM m5),
tc AS (SELECT cid, string_agg(currency || ' ' || printf('%.2f', total), ', ' ORDER BY currency) AS totals_by_currency FROM (SELECT cid, currency, CAST(round(sum(CAST(amount AS DECIMAL(38,6))), 2) AS DOUBLE) AS total FROM (
  SELECT ff.cid, ff.currency, amount FROM ff JOIN mt USING (cid) WHERE once OR exposed OR (other_due AND coalesce(ff.currency <> scheduled_currency, true)) UNION ALL SELECT cid, scheduled_currency, scheduled_value FROM mt WHERE scheduled_value IS NOT NULL)
  WHERE amount IS NOT NULL AND currency IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


def _metrics_sql() -> str:
    shown = ", ".join([("cid AS contract_id" if c == "contract_id" else "ctype AS contract_type" if c == "contract_type" else f"mt.{c}") for c in _PLAIN] + [f"{m}_{part}" for m in _MONEY for part in ("value", "currency")])
    return f"WITH RECURSIVE {_ctes()}, {_metrics_ctes()} SELECT {shown}, cost_status, totals_by_currency FROM mt LEFT JOIN tc USING (cid)"


def _audit_sql() -> str:
    row = lambda kind, name, value, field, detail, source, where: f"SELECT cid AS contract_id, '{kind}' AS kind, {name} AS name, CAST({value} AS DOUBLE) AS value, {field} AS source_field, {detail} AS detail FROM {source} WHERE {where}"
    none, rows = "NULL::VARCHAR", []
    for column, name, formula in C._FORMULAS:
        rows += [row("formula", _q(name), f"{column}_value", none, _q(formula), "mt", f"{column}_value IS NOT NULL"), row("unavailable", _q(name), "NULL", none, none, "mt", f"{column}_value IS NULL")]
    for column, name, formula in C.RATIOS:
        rows += [row("formula", _q(name), column, none, _q(formula), "mt", f"{column} IS NOT NULL"), row("unavailable", _q(name), "NULL", none, none, "mt", f"{column} IS NULL")]
    rows += [row("unavailable", "'totalCost.calculatedCoreObligations'", "NULL", none, none, "mt", "core_value IS NULL"), row("unavailable", "'totalCost.calculatedBaseCost'", "NULL", none, none, "mt", "principal_value IS NULL")]
    rows += [row("warning", "'recurring_commitment_mixed_currency'", "NULL", none, "'MIXED_CURRENCY'", "mt", "mixed_recurring"), row("warning", "'contract_currency_ambiguous'", "NULL", none, "'MIXED_CURRENCY'", "mt", "mixed_currency")]
    rows += [
        row("conflict", "CASE WHEN target = 'special' THEN skey ELSE target || ':' || coalesce(cat, 'unknown') || ':' || t1 END", "amount", "field", "winner", "fin", "place > 1 AND conflict"),
        row("excluded", "'not_a_payment_obligation:' || role || ':' || context", "amount", "field", none, "fin", "place = 1 AND target = 'obligation' AND NOT due"),
        row("excluded", "'currency_unresolved'", "amount", "field", none, "fin", "place = 1 AND amount IS NOT NULL AND currency IS NULL AND (due OR fee OR pen OR target = 'special' OR role = 'asset_value')"),
        row("excluded", "'deposit_refundability_unresolved'", "amount", "field", none, "fin", "place = 1 AND stays = 'open' AND sure AND (fee OR (due AND one))"),
    ]
    return f"WITH RECURSIVE {_ctes()}, {_metrics_ctes()} " + " UNION ALL ".join(rows)


def queries() -> dict:
    return {f.__name__: f for f in (financial_metrics, calculation_audit)}


def oracle_sql() -> dict[str, str]:
    return {"financial_metrics": _metrics_sql(), "calculation_audit": _audit_sql()}
