"""From extracted agreements to financial metrics.

An agreement is a row of nested facts (CONTRACT). Facts become candidate rows, which are classified,
given a currency, deduplicated and resolved against rivals, and then rolled up per contract. All of it
is column expressions, windows and aggregates on ``contract_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions import money as M
from tallystone.functions import wordlists as L
from tallystone.functions.text import has_any, normalize_label
from tallystone.operators import finance as fin
from tallystone.session import written

CONTRACT = (
    "contract_id string, contract_type string, details struct<financed_amount double, down_payment double, interest_rate double, loan_term_months double, monthly_installment double, "
    "balloon_payment double, loan_amount double, loan_term_years double, credit_limit double, annual_fee double, interest_rate_apr double, late_fee double, cash_advance_fee double, "
    "monthly_rent double, security_deposit double, lease_term_months double, premium_amount double, premium_frequency string, deductible double, coverage_amount double, policy_term_months double, "
    "base_salary double, salary_frequency string, billing_amount double, billing_frequency string>, "
    "obligations array<struct<description string, amount double, currency string, frequency string, due_date string>>, "
    "fees array<struct<description string, amount double, currency string, is_recurring boolean>>, "
    "penalties array<struct<description string, amount double, currency string, condition string>>, "
    "numbers array<struct<label string, value double, unit string>>, dates array<struct<label string, date string>>"
)

_ONE_TIME_TYPES = ("upfront_payment", "balloon_payment", "deposit", "one_time_payment")
_COLUMNS = (
    "target_kind string, special_key string, category string, label string, amount double, currency string, percentage double, frequency string, n_payments double, start_date string, "
    "mandatory boolean, conditional boolean, refundable boolean, timing string, trigger string, source_kind string, source_field string, evidence string, confidence string"
)
_FACT = "code int, label string, trigger string, amount double, unit string, often string, n_payments double, start_date string, is_recurring boolean, place int"
#: What is the same for all facts of a source.
_SOURCE = "part string, target_kind string, special_key string, category string, label string, often string, mandatory boolean, conditional boolean, source_kind string, field string, confidence string"
#: What is read of a fact's texts: facts that are alike in these say the same.
_STATED = ("label", "trigger", "unit", "often")
#: Different statements, and bytes of them, up to which each is read once and sent to all its facts.
STATEMENTS, STATEMENT_BYTES = 20_000, 4 << 20
RENT_WORDS = ("rent", "lease", "إيجار", "ايجار")
#: What the rules of leases and employment read from the texts, which go no further: type of contract, words, text.
_SAID = {
    "_rent": ("lease", RENT_WORDS, "_said"),
    "_says_benefit": ("employment", L.SAYS_NON_CASH_BENEFIT, "_said"),
    "_says_bonus": ("employment", L.SAYS_CONDITIONAL_COMPENSATION, "_said"),
    "_says_total": ("employment", L.SAYS_STATED_TOTAL_COMPENSATION, "_said"),
    "_says_part": ("employment", L.SAYS_COMPENSATION_COMPONENT, "_said"),
    "_says_entitled": ("employment", L.SAYS_EMPLOYEE_ENTITLEMENT, "_full"),
}
TOTALS = {"statedTotalCost": L.SAYS_TOTAL_COST, "statedDueAtSigning": L.SAYS_DUE_AT_SIGNING_TOTAL}
# What each typed field states: (field, name, label, kind, special key or category, frequency, mandatory, conditional, count of payments).
DETAILS = {
    "auto_finance": (
        ("financed_amount", "financedAmount", "Financed amount", "special", "principal", None, None, None, None),
        ("down_payment", "downPayment", "Down payment", "obligation", "upfront_payment", "one_time", True, None, None),
        ("monthly_installment", "monthlyInstallment", "Monthly installment", "obligation", "recurring_payment", "monthly", True, None, "loan_term_months"),
        ("balloon_payment", "balloonPayment", "Balloon payment", "obligation", "balloon_payment", "one_time", True, None, None),
        ("interest_rate", "interestRate", "Interest rate (APR)", "rate", "rate", None, None, None, None),
    ),
    "personal_finance": (
        ("loan_amount", "loanAmount", "Loan amount", "special", "principal", None, None, None, None),
        ("monthly_installment", "monthlyInstallment", "Monthly installment", "obligation", "recurring_payment", "monthly", True, None, "loan_term_months"),
        ("interest_rate", "interestRate", "Interest rate (APR)", "rate", "rate", None, None, None, None),
    ),
    "mortgage": (
        ("loan_amount", "loanAmount", "Loan amount", "special", "principal", None, None, None, None),
        ("down_payment", "downPayment", "Down payment", "obligation", "upfront_payment", "one_time", True, None, None),
        ("monthly_installment", "monthlyInstallment", "Monthly installment", "obligation", "recurring_payment", "monthly", True, None, None),
        ("interest_rate", "interestRate", "Interest rate (APR)", "rate", "rate", None, None, None, None),
    ),
    "credit_card": (
        ("credit_limit", "creditLimit", "Credit limit", "special", "creditLimit", None, None, None, None),
        ("annual_fee", "annualFee", "Annual fee", "fee", "other", "annual", True, None, None),
        ("late_fee", "lateFee", "Late payment fee", "penalty", "late_payment", None, None, True, None),
        ("cash_advance_fee", "cashAdvanceFee", "Cash advance fee", "fee", "other", None, False, True, None),
        ("interest_rate_apr", "interestRateApr", "Interest rate (APR)", "rate", "rate", None, None, None, None),
    ),
    "lease": (
        ("monthly_rent", "monthlyRent", "Monthly rent", "obligation", "recurring_payment", "monthly", True, None, "lease_term_months"),
        ("security_deposit", "securityDeposit", "Security deposit", "obligation", "deposit", "one_time", True, None, None),
    ),
    "insurance": (
        ("premium_amount", "premiumAmount", "Insurance premium", "obligation", "insurance", "premium_frequency", True, None, None),
        ("deductible", "deductible", "Insurance deductible", "special", "insuranceDeductible", None, None, None, None),
        ("coverage_amount", "coverageAmount", "Coverage amount", "special", "coverageAmount", None, None, None, None),
    ),
    "employment": (("base_salary", "baseSalary", "Base salary", "special", "salaryComponent", "salary_frequency", None, None, None),),
    "subscription": (("billing_amount", "billingAmount", "Subscription billing amount", "obligation", "recurring_payment", "billing_frequency", True, None, None),),
}
# The role of a special amount and of a type of obligation.
SPECIAL_ROLES = {
    "principal": "principal", "creditLimit": "credit_limit", "outstandingBalance": "reference_value", "monthlyIncome": "income", "statedTotalCost": "reference_value",
    "insuranceDeductible": "conditional_fee", "coverageAmount": "coverage_limit", "rate": "rate", "recurringEquivalent": "reference_value", "statedDueAtSigning": "reference_value",
    "salaryComponent": "reference_value", "statedTotalCompensation": "reference_value",
}
TYPE_ROLES = {
    "principal": "principal", "upfront_payment": "upfront_payment", "one_time_payment": "upfront_payment", "recurring_payment": "scheduled_payment", "balloon_payment": "scheduled_payment",
    "insurance": "scheduled_payment", "deposit": "deposit", "tax": "mandatory_fee", "conditional_payment": "conditional_fee",
}
FINANCIAL_ROLES = {
    "asset_value": "asset_value", "principal": "financing_principal", "upfront_payment": "upfront_liquidity", "conditional_fee": "conditional_cost", "penalty": "conditional_cost",
    "scenario_balance": "informational_total", "scenario_payment": "informational_total", "reference_value": "informational_total", "income": "income", "credit_limit": "credit_limit",
    "coverage_limit": "coverage_limit", "rate": "rate_or_percentage", "conditional_income": "conditional_income", "non_cash_benefit": "benefit",
}
PERCENT_UNITS = ("percent", "percentage", "pct", "بالمئة", "في المئة")
START_WORDS = ("start", "effective", "commence", "begin", "بداية", "تاريخ البداية", "سريان")
END_WORDS = ("end", "expiry", "expiration", "maturity", "termination", "نهاية", "تاريخ الانتهاء", "انتهاء")
CENT = 0.01
#: What sums and notes read of a candidate; nothing else is shuffled or written for them.
_COUNTED = (
    "contract_id", "target_kind", "special_key", "category", "amount", "currency", "frequency", "n_payments", "mandatory", "conditional", "refundable",
    "_label_key", "_says_deposit", "source_field", "role", "context", "contract_currency", "position", "conflict",
)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _candidate(**values: Column) -> Column:
    fields = [f.strip().split(" ") for f in _COLUMNS.split(",")]
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def _sources() -> dict[str, tuple]:
    """By name, what ``_SOURCE`` says of each source of facts, in the order of the sources; a typed field is one."""
    out = {}
    for kind, fields in DETAILS.items():
        for _, name, label, target, what, frequency, mandatory, conditional, _ in fields:
            special = target in ("special", "rate")
            often = None if frequency and frequency.endswith("_frequency") else frequency
            out[f"{kind}.{name}"] = ("typed", "special" if special else target, what if special else None, None if special else what, label, often, mandatory, conditional, "type_details", f"typeDetails.{name}", "high")
    due, loose = ("financial_obligation", "financialObligations", "medium"), ("extracted_number", "extractedNumbers", "low")
    listed = lambda part, target, where, key=None: (part, target, key, None, None, None, None, None, *where)
    out["obligation"] = listed("obligation", "obligation", due)
    out["fee"] = listed("fee", "fee", ("fee_item", "fees", "medium"))
    out["penalty"] = listed("penalty", "penalty", ("penalty_item", "penalties", "medium"))
    out["number"] = listed("number", "obligation", loose)
    for key in TOTALS:
        out[f"{key} of obligations"], out[f"{key} of numbers"] = listed(key, "special", due, key), listed(key, "special", loose, key)
    return out


def _facts(code: dict[str, int]) -> Column:
    """All facts of a contract as written, in the order of the sources; null lists hold none. Totals are looked
    for in obligations and loose numbers, which come up once more for each kind of total."""
    fields = [f.strip().split(" ") for f in _FACT.split(",")]

    def fact(**values: Column) -> Column:
        return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])

    def listed(source: str, **names: str):
        return lambda x, i: fact(code=F.lit(code[source]), place=i, **({n: x[of] for n, of in names.items()} | {"amount": M.finite(x[names["amount"]])}))

    typed = []
    for kind, stated in DETAILS.items():
        for field, name, *_, frequency, _, _, count in stated:
            value = M.finite(F.col(f"details.{field}"))
            often = F.col(f"details.{frequency}") if frequency and frequency.endswith("_frequency") else F.lit(None)
            typed.append(F.when((F.col("contract_type") == kind) & value.isNotNull(), fact(code=F.lit(code[f"{kind}.{name}"]), amount=value, often=often, n_payments=F.col(f"details.{count}") if count else F.lit(None))))
    text = {"label": "description", "amount": "amount", "unit": "currency"}
    number = {"label": "label", "amount": "value", "unit": "unit"}
    parts = [
        F.array(*typed), F.transform("obligations", listed("obligation", often="frequency", start_date="due_date", **text)), F.transform("fees", listed("fee", is_recurring="is_recurring", **text)),
        F.transform("penalties", listed("penalty", trigger="condition", **text)), F.transform("numbers", listed("number", **number)),
    ]
    for key in TOTALS:
        parts += [F.transform("obligations", listed(f"{key} of obligations", **text)), F.transform("numbers", listed(f"{key} of numbers", **number))]
    kind = f"array<struct<{_FACT.replace(' ', ':').replace(',:', ',')}>>"
    return F.array_compact(F.concat(*[F.coalesce(p, F.array().cast(kind)) for p in parts]))


def _read_facts(contracts: DataFrame) -> DataFrame:
    """A row per fact: what its source says of it beside what it says itself; ``ordinal`` is its place."""
    sources, kinds = _sources(), [f.strip().split(" ") for f in _SOURCE.split(",")]
    known = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, kinds, strict=True)]) for row in sources.values()])
    rows = contracts.select("contract_id", "contract_type", F.posexplode(_facts({name: n for n, name in enumerate(sources)})).alias("ordinal", "f"))
    rows = rows.withColumn("s", F.get(known, F.col("f.code")))
    label, rate = F.coalesce("f.label", "s.label"), F.coalesce(F.col("s.special_key") == "rate", F.lit(False))
    return rows.select(
        "contract_id", "contract_type", "ordinal", "s.part", "s.target_kind", "s.special_key", "s.category", label.alias("label"), F.coalesce(label, "f.trigger").alias("evidence"), "f.trigger",
        F.when(~rate, F.col("f.amount")).alias("amount"), F.when(rate, F.col("f.amount")).alias("percentage"), "f.unit", F.coalesce("f.often", "s.often").alias("often"), "f.n_payments", "f.start_date", "f.is_recurring",
        "s.mandatory", "s.conditional", "s.source_kind", F.concat("s.field", F.coalesce(F.concat(F.lit("["), F.col("f.place").cast("string"), F.lit("]")), F.lit(""))).alias("source_field"), "s.confidence",
    )


def _once(frequency: Column, kind: Column) -> Column:
    return F.coalesce(frequency, F.when(kind.isin(*_ONE_TIME_TYPES), "one_time"))


def _statements(rows: DataFrame) -> DataFrame:
    """``rows`` with all that the words of a fact (_STATED) say, whatever fact they are of. Each text is normalised
    once: ``_own`` the label, ``_said`` label and evidence, ``_full`` those and the trigger."""
    label, evidence, trigger, unit = F.col("label"), F.coalesce("label", "trigger"), F.col("trigger"), F.lower(F.trim(F.col("unit")))
    own, said, full, has = F.col("_own"), F.col("_said"), F.col("_full"), has_any
    rows = rows.withColumns({"_own": normalize_label(label), "_said": normalize_label(M.joined(label, evidence)), "_full": normalize_label(M.joined(label, evidence, trigger))})
    return rows.withColumns({
        **{f"_{key}": has(own, words) for key, words in TOTALS.items()},
        "_currency": M.currency_code(F.col("unit")), "_percent": F.coalesce(F.contains(unit, F.lit("%")) | F.contains(unit, F.lit("٪")) | unit.isin(*PERCENT_UNITS), F.lit(False)),
        "_own_frequency": M.frequency_of(own, has), "_often": M.frequency_of(F.col("often")),
        "_type": M.first_match(own, L.OBLIGATION_TYPES, has), "_fee": M.fee_type(own, has=has), "_penalty": M.penalty_type(label, trigger),
        "_conditional": M.conditional_in(own, has=has), "_mandatory": M.mandatory_in(own, has=has), "_refundable": M.refundable_in(own, has=has), "_timing": M.timing_in(own, has=has),
        "_scenario": M.scenario_in(full, has=has), "_asset": has(said, L.SAYS_ASSET_VALUE), "_total": has(said, L.SAYS_TOTAL_COST), "_balance": has(said, L.SAYS_EARLY_SETTLEMENT_BALANCE),
        **{name: has(F.col(text), words) for name, (_, words, text) in _SAID.items()},
        "_label_key": own, "_says_deposit": has(own, L.SAYS_DEPOSIT),
    }).drop("_own", "_said", "_full")


def _understood(facts: DataFrame) -> DataFrame:
    """``facts`` with what ``_statements`` reads. Some fifty lists of words are looked up in a statement, and contracts
    repeat them: as long as there are few, each is read once, else every fact is read for itself."""
    said = written(facts.select(*_STATED).distinct(), "agreement-statements")
    size = said.agg(F.count("*").alias("n"), F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in _STATED)).alias("bytes")).first()
    if size["n"] > STATEMENTS or (size["bytes"] or 0) > STATEMENT_BYTES:
        return _statements(facts)
    read = written(_statements(said), "agreement-statements-read").withColumnsRenamed({c: f"of_{c}" for c in _STATED})
    same = F.lit(True)
    for c in _STATED:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return facts.join(F.broadcast(read), same).drop(*[f"of_{c}" for c in _STATED])


def extract_candidates(contracts: DataFrame) -> DataFrame:
    """One row per fact of each contract, read and classified; ``ordinal`` is its place among the contract's facts.
    What ``assign_roles`` reads of its words stands beside it."""
    rows = _understood(_read_facts(contracts))
    part = F.col("part")
    stated = F.lit(True)
    for key in TOTALS:
        stated &= (part != key) | (F.col(f"_{key}") & F.col("amount").isNotNull())
    rows = rows.filter(stated & ((part != "number") | (F.col("_currency").isNotNull() & F.col("amount").isNotNull())))

    free, listed = part.isin("obligation", "number"), part.isin("obligation", "fee")
    by_text, by_word = F.when(free | (part == "fee"), F.col("_own_frequency")), F.when(part.isin("typed", "obligation"), F.col("_often"))
    typed = F.when(F.col("often") == "one_time", "one_time").otherwise(by_word)
    often = F.when(part == "typed", typed).when(part == "obligation", F.coalesce(by_word, by_text)).when((part == "fee") & ~F.col("is_recurring"), "one_time").when(free | (part == "fee"), by_text)
    rows = rows.withColumn("frequency", often).withColumn("category", F.when(free, M.typed_by(F.col("_type"), F.col("frequency"))).when(part == "fee", F.col("_fee")).when(part == "penalty", F.col("_penalty")).otherwise(F.col("category")))
    rows = rows.withColumns({"_percent": (part == "penalty") & F.col("_percent"), "_conditional": F.when(listed, F.col("_conditional")), "_mandatory": F.when(listed, F.col("_mandatory"))})
    rows = rows.withColumns({
        "frequency": F.when(free, _once(F.col("frequency"), F.col("category"))).otherwise(F.col("frequency")),
        "percentage": F.when(F.col("_percent"), M.percentage(F.col("amount"))).otherwise(F.col("percentage")),
        "currency": F.when(~F.col("_percent"), F.col("_currency")), "amount": F.when(~F.col("_percent"), F.col("amount")),
        "mandatory": F.when(part == "obligation", F.coalesce("_mandatory", ~F.coalesce("_conditional", F.lit(False)))).when(part == "fee", F.col("_mandatory")).otherwise(F.col("mandatory")),
        "conditional": F.when(listed, F.col("_conditional")).when(part == "penalty", True).otherwise(F.col("conditional")),
        "refundable": F.when(listed, F.col("_refundable")), "timing": F.when(listed, F.col("_timing")),
    })
    return rows.select("contract_id", "contract_type", "ordinal", *[f.strip().split(" ")[0] for f in _COLUMNS.split(",")], "_label_key", "_says_deposit", "_scenario", "_asset", "_total", "_balance", *_SAID)


def assign_roles(candidates: DataFrame) -> DataFrame:
    """``role`` (what the amount is) and ``context`` (on which path it falls due)."""
    scenario = F.col("_scenario")
    sure = fin.guaranteed(F.col("mandatory"), F.col("conditional"))
    role = (
        F.when(F.col("special_key").isNotNull(), _lookup(SPECIAL_ROLES, F.col("special_key")))
        .when(F.col("target_kind") == "fee", F.when(sure, "mandatory_fee").otherwise("conditional_fee"))
        .when(F.col("target_kind") == "penalty", "penalty")
        .when(F.col("_asset"), "asset_value")
        .when(F.col("_total"), "reference_value")
        .when(scenario.isNotNull(), F.when(F.col("_balance"), "scenario_balance").otherwise("scenario_payment"))
        .otherwise(F.coalesce(_lookup(TYPE_ROLES, F.col("category")), F.lit("unknown")))
    )
    out = candidates.withColumn("role", role)
    reference = F.col("role").isin("asset_value", "reference_value")
    out = out.withColumn("context", F.coalesce(scenario, F.when(reference, "reference_only"), F.lit("normal_contract_path")))
    # of the texts no more than this is shuffled for the rules that look at a whole contract
    said = {name: (F.col("contract_type") == kind) & F.col(name) for name, (kind, _, _) in _SAID.items()}
    return out.withColumns(said).drop("_scenario", "_asset", "_total", "_balance")


def reclassify_rent(candidates: DataFrame) -> DataFrame:
    """In a lease, an annual amount of twelve monthly rents under a rent label restates the rent."""
    monthly = F.max(F.when(F.col("source_field") == "typeDetails.monthlyRent", F.col("amount"))).over(Window.partitionBy("contract_id"))
    same = (F.col("contract_type") == "lease") & (F.col("target_kind") == "obligation") & (F.col("frequency") == "annual") & (F.abs(F.col("amount") - monthly * 12) <= CENT) & F.col("_rent")
    return _become(candidates, F.coalesce(same, F.lit(False)), "recurringEquivalent")


def _become(rows: DataFrame, when: Column, key: str) -> DataFrame:
    rows = rows.withColumn("_now", when)
    change = {"target_kind": "special", "special_key": key, "role": "reference_value", "context": "reference_only"}
    return rows.withColumns({c: F.when(F.col("_now"), v).otherwise(F.col(c)) for c, v in change.items()}).drop("_now")


def reclassify_employment(candidates: DataFrame) -> DataFrame:
    """In an employment contract: benefits and bonuses aren't costs, allowances are parts of the salary,
    and the guaranteed income is the stated total if the parts add up to it, else their sum."""
    job = F.col("contract_type") == "employment"
    payable = job & F.col("target_kind").isin("obligation", "fee")
    benefit = payable & F.col("_says_benefit")
    bonus = payable & ~F.col("_benefit") & F.col("_says_bonus")
    rows = candidates.withColumn("_benefit", benefit).withColumn("_bonus", bonus).withColumns({"_total": payable & ~F.col("_benefit") & ~F.col("_bonus") & F.col("_says_total")})
    rows = rows.withColumn("_part", payable & ~F.col("_benefit") & ~F.col("_bonus") & ~F.col("_total") & F.col("_says_part"))
    entitled = job & (F.col("target_kind") == "penalty") & F.col("_says_entitled")
    role = F.when(F.col("_benefit"), "non_cash_benefit").when(F.col("_bonus") | entitled, "conditional_income").otherwise(F.col("role"))
    rows = rows.withColumn("role", role).withColumns({"conditional": F.when(F.col("_bonus"), True).otherwise(F.col("conditional")), "mandatory": F.when(F.col("_benefit") | F.col("_bonus"), False).otherwise(F.col("mandatory"))})
    rows = _become(_become(rows, F.col("_total"), "statedTotalCompensation"), F.col("_part"), "salaryComponent").drop("_benefit", "_bonus", "_total", "_part")

    rows = rows.drop(*_SAID)

    known = F.col("amount").isNotNull()
    part, total = known & (F.col("special_key") == "salaryComponent"), known & (F.col("special_key") == "statedTotalCompensation")
    w = Window.partitionBy("contract_id")
    first = lambda value, where: F.min_by(value, F.when(where, F.col("ordinal"))).over(w)
    rows = rows.withColumns({
        "_parts": F.when(job, F.sum(F.when(part, F.col("amount").cast("decimal(38,6)"))).over(w).cast("double")), "_currency": first(F.col("currency"), part & F.col("currency").isNotNull()),
        "_t": F.when(job, first(F.struct("amount", "currency", "label"), total)), "_last": F.max("ordinal").over(w),
    })
    agrees = F.coalesce(F.abs(F.col("_t.amount") - F.col("_parts")) <= CENT, F.lit(False))
    of_total = agrees | F.col("_parts").isNull()
    label = F.lit("Guaranteed monthly employment income")
    income = {
        "ordinal": F.col("ordinal") + 1, "target_kind": F.lit("special"), "special_key": F.lit("monthlyIncome"), "label": label, "_label_key": normalize_label(label), "_says_deposit": F.lit(False), "amount": F.when(of_total, F.col("_t.amount")).otherwise(F.col("_parts")),
        "currency": F.when(agrees, F.coalesce("_t.currency", "_currency")).when(F.col("_parts").isNull(), F.col("_t.currency")).otherwise(F.col("_currency")), "frequency": F.lit("monthly"), "mandatory": F.lit(True), "conditional": F.lit(False),
        "source_kind": F.lit("type_details"), "source_field": F.lit("employment.guaranteedMonthlyIncome"), "evidence": F.when(of_total, F.col("_t.label")).otherwise("sum of guaranteed salary components"), "confidence": F.lit("high"),
        "role": F.lit("income"), "context": F.lit("normal_contract_path"), "contract_id": F.col("contract_id"), "contract_type": F.col("contract_type"),
    }
    columns = [(c, kind) for c, kind in rows.dtypes if c not in ("_parts", "_currency", "_t", "_last")]
    own = F.struct(*[F.col(c) for c, _ in columns])
    canonical = F.struct(*[income.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns])
    # the income is a fact of its own, after the contract's last one
    ends = (F.col("ordinal") == F.col("_last")) & (F.col("_parts").isNotNull() | F.col("_t").isNotNull())
    # the contract stays outside the array, so that Spark still knows by what the rows are dealt
    twice = rows.select("contract_id", F.explode(F.when(ends, F.array(own, canonical)).otherwise(F.array(own))).alias("r"))
    return twice.select("contract_id", *[f"r.{c}" for c, _ in columns if c != "contract_id"])


def ranked_candidates(contracts: DataFrame) -> DataFrame:
    """The candidates without restatements: extracted, classified, with currency, rivals ranked by ``place``;
    ``contract_currency`` where the contract states exactly one; ``financial_role`` for reports."""
    rows = reclassify_employment(reclassify_rent(assign_roles(extract_candidates(contracts))))
    w = Window.partitionBy("contract_id")
    rows = rows.withColumn("contract_currency", F.when(F.min("currency").over(w) == F.max("currency").over(w), F.max("currency").over(w)))
    rows = rows.withColumn("currency", F.coalesce("currency", F.when(F.col("amount").isNotNull(), F.col("contract_currency"))))
    # written, as the clusters are formed of these rows and led back to them: by contract, so that the rows are
    # shuffled once for clusters and slots
    rows = written(rows.withColumn("_chars", F.coalesce(F.length("evidence"), F.lit(0))), "agreement-classified")
    led = rows.unionByName(fin.kept(rows.repartition(fin.BY)), allowMissingColumns=True).repartition(fin.BY)
    merged = F.max("merged").over(Window.partitionBy(fin.BY, "ordinal"))
    rows = fin.ranked_rivals(led.withColumn("merged", merged).filter("target_kind is not null and merged is not null")).drop("_chars")
    scheduled = F.when(F.col("frequency").isin(*M.RECURRING), "recurring_outflow").when(F.col("timing") == "due_now", "upfront_liquidity").otherwise("one_time_outflow")
    role = (
        F.when(F.col("role").isin("scheduled_payment", "mandatory_fee"), scheduled)
        .when(F.col("role") == "deposit", F.when(F.col("refundable"), "refundable").otherwise("upfront_liquidity"))
        .otherwise(F.coalesce(_lookup(FINANCIAL_ROLES, F.col("role")), F.lit("other")))
    )
    return rows.withColumn("financial_role", role)


def resolved_candidates(contracts: DataFrame) -> DataFrame:
    """The final candidates: of ``ranked_candidates``, those that win their slot."""
    return ranked_candidates(contracts).filter("place = 1")


def payment_obligations(candidates: DataFrame) -> DataFrame:
    """Obligations that are due on some path of the contract itself, numbered by source field."""
    rows = candidates.filter((F.col("target_kind") == "obligation") & fin.eligible_role(F.col("role"), F.col("context")))
    order = Window.partitionBy("contract_id").orderBy(F.collate("source_field", "UNICODE"))
    return rows.withColumn("id", F.concat(F.lit("obligation-"), (F.row_number().over(order) - 1).cast("string")))


def _terms(contracts: DataFrame) -> DataFrame:
    """contract_id, contract_type, and what a contract itself says of its term: stated months, years, days between dates."""
    t = F.col("contract_type")
    months = F.when(t.isin("auto_finance", "personal_finance"), F.col("details.loan_term_months")).when(t == "lease", F.col("details.lease_term_months")).when(t == "insurance", F.col("details.policy_term_months"))
    years = F.when(t == "mortgage", F.col("details.loan_term_years"))
    marked = F.transform("dates", lambda x: F.struct(M.iso_date(x["date"]).alias("d"), M.contains_any(x["label"], START_WORDS).alias("s"), M.contains_any(x["label"], END_WORDS).alias("e")))
    start = F.get(F.filter("_marked", lambda x: x["d"].isNotNull() & x["s"]), F.lit(0))["d"]
    end = F.get(F.filter("_marked", lambda x: x["d"].isNotNull() & x["e"] & ~x["s"]), F.lit(0))["d"]
    return contracts.withColumn("_marked", marked).select("contract_id", "contract_type", months.alias("_stated_months"), years.alias("_years"), F.datediff(end, start).alias("_days"))


def durations(rows: DataFrame) -> DataFrame:
    """``rows`` with months, years, days and source of the term, from what ``_terms`` has of it and ``_counted`` instalments:
    stated, between dates, or counted."""
    stated, given, between = F.col("_stated_months"), F.col("_years"), F.col("_days")
    days = F.when(stated.isNull() & given.isNull() & (between >= 0), between)
    rest = F.when(given.isNull() & ~F.coalesce(between >= 0, F.lit(False)), F.col("_counted"))
    source = F.when(stated.isNotNull() | given.isNotNull(), "stated").when(days.isNotNull(), "dates").when(rest.isNotNull(), "instalments")
    told = {"months": F.coalesce(stated, rest), "years": F.when(stated.isNull(), given), "days": days, "duration_source": source}
    return rows.withColumns(told).drop("_stated_months", "_years", "_days", "_counted")


def _flags() -> dict[str, Column]:
    """What the sums of a contract are taken over, as conditions on a final candidate."""
    kind, one = F.col("target_kind"), F.col("frequency") == "one_time"
    due = (kind == "obligation") & fin.eligible_role(F.col("role"), F.col("context"))
    sure, fee = fin.guaranteed(F.col("mandatory"), F.col("conditional")), kind == "fee"
    # of obligations only deposits can be refunded; a fee is a deposit if its label says so
    deposit = F.when(fee, F.col("_says_deposit")).otherwise(F.col("category") == "deposit")
    refund = F.when(fee | deposit, fin.refundability(deposit, F.col("refundable"))).otherwise("include")
    stays, balloon = refund == "include", F.col("category") == "balloon_payment"
    recurring = due & F.col("mandatory") & M.monthly_factor(F.col("frequency")).isNotNull()
    return {
        "due": due, "fee": fee, "penalty": kind == "penalty", "one": one, "balloon": balloon, "recurring": recurring, "once": due & sure & one & stays, "sure_fee": fee & sure & stays,
        "open_deposit": (refund == "exclude_unresolved") & ((fee & sure) | (due & sure & one)), "upfront": due & F.col("mandatory") & one & ~balloon,
        "exposed_fee": fee & fin.normal_path(F.col("mandatory"), F.col("conditional")) & stays, "other_due": due & sure & ~fin._is(one),
    }


def _totals_by_currency(candidates: DataFrame, scheduled: DataFrame) -> DataFrame:
    """contract_id, totals_by_currency (of struct<currency, total>): guaranteed one-time dues, fees of the normal
    path, the scheduled total, and recurring dues in a currency that no schedule covers."""
    f = _flags()
    rows = candidates.join(scheduled.hint("merge"), "contract_id")
    bare = f["other_due"] & ~fin._is(F.col("currency") == F.col("scheduled.currency"))
    counted = rows.filter(f["once"] | f["exposed_fee"] | bare).select("contract_id", "currency", "amount")
    known = scheduled.filter("scheduled.value is not null").select("contract_id", "scheduled.currency", F.col("scheduled.value").alias("amount"))
    totals = fin.totals_by_currency(counted.union(known))
    return totals.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("currency", "total"))).alias("totals_by_currency"))


def metrics_of(contracts: DataFrame, c: DataFrame) -> DataFrame:
    """``financial_metrics`` of ``contracts`` with the final candidates ``c``."""
    a, cur, kind = F.col("amount"), F.col("currency"), F.col("target_kind")
    f = _flags()
    due, fee, penalty, one, once, sure_fee, balloon = (f[x] for x in ("due", "fee", "penalty", "one", "once", "sure_fee", "balloon"))
    factor = M.monthly_factor(F.col("frequency"))
    special = lambda k: F.max_by(F.struct(a.alias("a"), cur.alias("c"), F.col("frequency").alias("f")), F.when((kind == "special") & (F.col("special_key") == k), F.col("position")))
    mixed = lambda where: F.coalesce(F.min(F.when(where & a.isNotNull(), cur)) < F.max(F.when(where & a.isNotNull(), cur)), F.lit(False))
    unknown = a.isNull() | cur.isNull()
    per = c.groupBy("contract_id").agg(
        F.max("contract_currency").alias("currency"),
        fin.known_sum(a * factor, cur, f["recurring"]).alias("monthly_equivalent"),
        fin.known_sum(a * factor * 12, cur, f["recurring"]).alias("annual_equivalent"),
        mixed(f["recurring"]).alias("mixed_recurring"),
        fin.known_sum(a, cur, once & ~balloon).alias("upfront_obligations"),
        fin.known_sum(a, cur, once & balloon).alias("balloon"),
        fin.known_sum(a, cur, fee).alias("fees_total"),
        fin.known_sum(a, cur, sure_fee).alias("mandatory_fees"),
        fin.known_sum(a, cur, fee & one).alias("upfront_fees"),
        fin.known_sum(a, cur, fee & F.col("conditional")).alias("conditional_fees"),
        fin.known_sum(a, cur, penalty).alias("penalties_total"),
        fin.known_max(a, cur, penalty).alias("highest_penalty"),
        F.bool_or(F.when(penalty | (fee & fin._is(F.col("conditional"))), unknown)).alias("unquantified_contingent"),
        fin.known_sum(a, cur, f["upfront"]).alias("_upfront"),
        mixed(f["upfront"]).alias("_mixed_upfront"),
        fin.known_max(a, cur, once | sure_fee).alias("largest_payment"),
        F.min_by(F.struct(a.alias("a"), cur.alias("c")), F.when(due & balloon, F.struct(F.collate("source_field", "UNICODE"), "position"))).alias("_balloon"),
        special("principal").alias("_principal"), special("statedTotalCost").alias("_stated"), special("insuranceDeductible").alias("_deductible"), special("monthlyIncome").alias("_income"), special("statedDueAtSigning").alias("_signing"),
        F.min_by("n_payments", F.when((kind == "obligation") & (F.col("category") == "recurring_payment") & (F.col("frequency") == "monthly") & (F.col("n_payments") > 0), F.col("position"))).alias("_counted"),
        F.count_if("conflict").alias("conflicts"),
        F.coalesce(F.min("currency") < F.max("currency"), F.lit(False)).alias("mixed_currency"),
    )
    money = lambda x: fin.money(F.col(f"{x}.a"), F.col(f"{x}.c"))
    none = fin.money(F.lit(None), F.lit(None))
    monthly_income = fin.money(F.col("_income.a") * M.monthly_factor(F.col("_income.f")), F.col("_income.c"))
    # sides of a row per contract are never broadcast: Spark sizes them by their compressed files
    out = durations(_terms(contracts).join(per.hint("merge"), "contract_id", "left"))
    out = out.withColumns({x: F.coalesce(F.col(x), none) for x in ("monthly_equivalent", "annual_equivalent", "upfront_obligations", "balloon", "fees_total", "mandatory_fees", "upfront_fees", "conditional_fees", "penalties_total", "highest_penalty", "_upfront", "largest_payment")})
    out = out.withColumns({x: F.coalesce(F.col(x), F.lit(False)) for x in ("mixed_recurring", "mixed_currency", "_mixed_upfront")}).withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    out = out.withColumns({"principal": money("_principal"), "stated_total": money("_stated"), "deductible": money("_deductible"), "due_at_signing": money("_signing"), "monthly_income": monthly_income})
    out = fin.total_cost(out)
    core, stated = F.col("core"), F.col("stated_total")
    sure_term = F.col("duration_source").isin("stated", "dates")
    status = F.when((core["status"] == "known") & ~fin._is(sure_term), "estimated").otherwise(core["status"])
    apart = fin._is(stated["currency"] == core["currency"])
    out = out.withColumns({
        "upfront_exposure": F.when(F.col("_mixed_upfront"), none).otherwise(fin.sum_of(F.col("_upfront"), F.col("upfront_fees"))),
        "contingent_exposure": fin.sum_of(F.col("conditional_fees"), F.col("penalties_total"), F.col("deductible")),
        "estimated_cost": F.struct(core["value"].alias("value"), core["currency"].alias("currency"), status.alias("status")),
        "difference_amount": F.when(apart, fin.money(F.abs(stated["value"] - core["value"]), core["currency"])).otherwise(none),
    })
    p = F.col("principal")
    out = out.withColumns({
        "fees_to_base": fin.ratio(F.col("mandatory_fees"), p), "penalties_to_base": fin.ratio(F.col("penalties_total"), p), "upfront_to_base": fin.ratio(F.col("upfront_exposure"), p),
        "balloon_to_base": fin.ratio(money("_balloon"), p), "cost_increase": fin.ratio(F.col("financing_cost"), p), "recurring_to_income": fin.ratio(F.col("monthly_equivalent"), F.col("monthly_income")),
    })
    return out.withColumn("balloon_payment", money("_balloon")).drop("_upfront", "_mixed_upfront", "_balloon", "_principal", "_stated", "_deductible", "_income", "_signing")


def financial_metrics(contracts: DataFrame) -> DataFrame:
    """The metrics of each contract, one row each, money as struct(value, currency, status).

    Unknown is never 0: a figure without amounts, or over several currencies, is unavailable. The final
    candidates are written once, as several of the sums read them.
    """
    candidates = written(resolved_candidates(contracts).select(*_COUNTED), "agreement-candidates")
    metrics = written(metrics_of(contracts, candidates), "agreement-metrics")
    return metrics.join(_totals_by_currency(candidates, metrics.select("contract_id", "scheduled")).hint("merge"), "contract_id", "left")


# The ratios' names, formulas and what they are taken of.
RATIOS = (
    ("fees_to_base", "ratios.feesToBaseCost", "mandatoryFees ÷ principal × 100"),
    ("penalties_to_base", "ratios.penaltiesToBaseCost", "totalKnownPenalties ÷ principal × 100"),
    ("upfront_to_base", "ratios.upfrontPaymentToBaseCost", "upfrontExposure ÷ principal × 100"),
    ("balloon_to_base", "ratios.balloonPaymentToBaseCost", "balloonPayment ÷ principal × 100"),
    ("cost_increase", "ratios.totalCostIncrease", "financingCost ÷ principal × 100"),
    ("recurring_to_income", "ratios.recurringPaymentToIncome", "monthlyCommitment ÷ monthlyIncome × 100"),
)
_FORMULAS = (
    ("monthly_equivalent", "recurringCommitment.monthlyEquivalent", "sum(amount × monthlyEquivalentFactor(frequency)) for each mandatory recurring obligation"),
    ("annual_equivalent", "recurringCommitment.annualEquivalent", "monthlyEquivalent × 12"),
    ("scheduled", "totalScheduledRecurring", "monthlyEquivalent × contractDuration.months"),
)


def _metric_notes(metrics: DataFrame) -> DataFrame:
    """Formulas that were used, calculations that weren't possible, and warnings of mixed currencies."""
    note = lambda kind, name, value, detail: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(None).cast("string").alias("source_field"), F.lit(detail).alias("detail"))
    none = F.lit(None)
    notes = []
    for column, name, formula in _FORMULAS:
        known = F.col(f"{column}.status") == "known"
        notes += [F.when(known, note("formula", name, F.col(f"{column}.value"), formula)), F.when(~known, note("unavailable", name, none, None))]
    for column, name, formula in RATIOS:
        notes += [F.when(F.col(column).isNotNull(), note("formula", name, F.col(column), formula)).otherwise(note("unavailable", name, none, None))]
    for column, name in (("core", "totalCost.calculatedCoreObligations"), ("principal", "totalCost.calculatedBaseCost")):
        notes.append(F.when(F.col(f"{column}.status") != "known", note("unavailable", name, none, None)))
    notes.append(F.when(F.col("mixed_recurring"), note("warning", "recurring_commitment_mixed_currency", none, "MIXED_CURRENCY")))
    notes.append(F.when(F.col("mixed_currency"), note("warning", "contract_currency_ambiguous", none, "MIXED_CURRENCY")))
    return metrics.select("contract_id", F.explode(F.array_compact(F.array(*notes))).alias("n")).select("contract_id", "n.*")


def _candidate_notes(ranked: DataFrame) -> DataFrame:
    """Values that lost to another source, and values that no sum may take, each under every reason once."""
    f = _flags()
    kind, lost = F.col("target_kind"), F.col("place") > 1
    metric = F.when(kind == "special", F.col("special_key")).otherwise(F.concat_ws(":", kind, F.coalesce("category", F.lit("unknown")), F.col("_label_key")))
    shown = f["due"] | f["fee"] | f["penalty"] | (kind == "special") | (F.col("role") == "asset_value")
    note = lambda kind, name, detail: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.col("amount").alias("value"), F.col("source_field"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    notes = [
        F.when(lost & F.col("conflict"), note("conflict", metric, F.col("winner_field"))),
        F.when(~lost & (kind == "obligation") & ~f["due"], note("excluded", F.concat_ws(":", F.lit("not_a_payment_obligation"), "role", "context"), none)),
        F.when(~lost & shown & F.col("amount").isNotNull() & F.col("currency").isNull(), note("excluded", F.lit("currency_unresolved"), none)),
        F.when(~lost & f["open_deposit"], note("excluded", F.lit("deposit_refundability_unresolved"), none)),
    ]
    return ranked.select("contract_id", F.explode(F.array_compact(F.array(*notes))).alias("n")).select("contract_id", "n.*")


def calculation_audit(contracts: DataFrame) -> DataFrame:
    """What stands behind the metrics of each contract, a row each: contract_id, kind, name, value, source_field, detail.

    Kinds: ``formula`` (name of the metric, its value, the formula), ``unavailable`` (name), ``warning``,
    ``conflict`` (a value that another source overruled; detail names that source) and ``excluded`` (a
    value that enters no sum, under its reason). Nothing is gathered: each candidate makes its own rows.
    """
    ranked = written(ranked_candidates(contracts).select(*_COUNTED, "place", "winner_field"), "agreement-ranked")
    metrics = metrics_of(contracts, ranked.filter("place = 1"))
    return _metric_notes(metrics).unionByName(_candidate_notes(ranked))
