"""Golden contracts: the figures that the engine must give."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallystone.operators import contracts, finance


def contract(cid, kind, details=None, obligations=(), fees=(), penalties=(), numbers=(), dates=()):
    return (cid, kind, details or {}, list(obligations), list(fees), list(penalties), list(numbers), list(dates))


def due(description, amount, currency="SAR", frequency=None, due_date=None):
    return (description, float(amount), currency, frequency, due_date)


def fee(description, amount, currency="SAR", recurring=False):
    return (description, float(amount), currency, recurring)


def penalty(description, amount, currency="SAR", condition=None):
    return (description, float(amount), currency, condition)


GOLDEN = [
    contract("auto", "auto_finance", dict(financed_amount=96000.0, down_payment=9600.0, interest_rate=8.75, loan_term_months=48.0, monthly_installment=2400.0, balloon_payment=19200.0), fees=[fee("Administrative fee: 1,200 SAR", 1200)]),
    contract(
        "lease", "lease", dict(monthly_rent=3000.0, security_deposit=2000.0, lease_term_months=12.0),
        [due("Annual rent", 36000, frequency="annual"), due("Total due at signing", 7050)],
        [fee("Brokerage fee", 1800), fee("Administrative fee", 250), fee("Minor maintenance cost, up to 500 SAR per incident, when applicable", 500)],
        [penalty("Late payment fee", 150, condition="per late-payment incident"), penalty("Maximum total late fees during the contract", 450, condition="capped at 450 SAR for the whole contract term"), penalty("Early termination compensation", 6000, condition="if the tenant terminates the lease before the end of the term")],
    ),
    contract("lease2", "lease", dict(monthly_rent=4000.0, security_deposit=8000.0, lease_term_months=12.0), fees=[fee("Registration fee", 200)]),
    contract("insurance", "insurance", dict(premium_amount=1200.0, premium_frequency="annual", deductible=500.0, policy_term_months=12.0), fees=[fee("Issuance fee", 50)]),
    contract(
        "job", "employment", dict(base_salary=9000.0, salary_frequency="monthly"),
        [due("Housing allowance", 2250, frequency="monthly"), due("Transportation allowance", 750, frequency="monthly"), due("Total fixed monthly compensation", 12000, frequency="monthly"), due("Performance bonus", 900), due("Medical insurance", 150)],
    ),
    contract(
        "messy", "auto_finance", dict(financed_amount=80000.0, monthly_installment=1500.0),
        [due("Monthly installment", 1500, frequency="monthly"), due("Monthly installment", 1500, frequency="monthly"), due("Monthly installment", 1750, frequency="monthly")],
        [fee("Refundable deposit", 3000), fee("Wire transfer fee", 25, "USD")], [penalty("Late payment", 200)],
    ),
    contract("bare", "auto_finance", dict(financed_amount=80000.0)),
    contract("percent", "other", penalties=[penalty("Early settlement", 6, "%")]),
    contract("empty", "other"),
]


@pytest.fixture(scope="module")
def frame(spark):
    names = spark.createDataFrame([], contracts.CONTRACT).schema["details"].dataType.names
    rows = [(a, b, tuple(d.get(n) for n in names), *rest) for a, b, d, *rest in GOLDEN]
    return spark.createDataFrame(rows, contracts.CONTRACT)


@pytest.fixture(scope="module")
def metrics(frame):
    return {r["contract_id"]: r for r in contracts.financial_metrics(frame).collect()}


def test_financing(metrics):
    m = metrics["auto"]
    assert [m[k]["value"] for k in ("financing_repayment", "principal", "financing_cost", "core", "fees_total", "mandatory_fees")] == [134400, 96000, 38400, 145200, 1200, 1200]
    assert m["months"] == 48 and m["monthly_equivalent"]["value"] == 2400 and m["cost_increase"] == 40.0
    # no currency is stated for the typed fields but by the fee
    assert m["currency"] == "SAR" and m["upfront_exposure"]["value"] == 10800


def test_lease(metrics, frame):
    m = metrics["lease"]
    assert [m[k]["value"] for k in ("monthly_equivalent", "annual_equivalent", "mandatory_fees", "due_at_signing")] == [3000, 36000, 2050, 7050]
    assert m["months"] == 12 and m["highest_penalty"]["value"] == 6000
    assert metrics["lease2"]["upfront_exposure"]["value"] == 8200
    rows = contracts.payment_obligations(contracts.resolved_candidates(frame)).filter("contract_id = 'lease' and financial_role = 'recurring_outflow'").collect()
    assert [r["amount"] for r in rows] == [3000]


def test_insurance_and_percent(metrics):
    assert metrics["insurance"]["monthly_equivalent"]["value"] == 100 and metrics["insurance"]["contingent_exposure"]["value"] == 500
    assert metrics["percent"]["penalties_total"]["status"] == "unavailable"


def test_employment(metrics, frame):
    assert metrics["job"]["monthly_income"]["value"] == 12000 and metrics["job"]["monthly_equivalent"]["status"] == "unavailable"
    rows = contracts.resolved_candidates(frame).filter("contract_id = 'job'").collect()
    assert sorted(r["amount"] for r in rows if r["special_key"] == "salaryComponent") == [750, 2250, 9000]
    assert {r["label"]: r["financial_role"] for r in rows if r["label"] in ("Performance bonus", "Medical insurance")} == {"Performance bonus": "conditional_income", "Medical insurance": "benefit"}
    assert contracts.payment_obligations(contracts.resolved_candidates(frame)).filter("contract_id = 'job'").count() == 0


def test_unknown_is_not_zero(metrics):
    assert metrics["messy"]["currency"] is None and metrics["messy"]["mixed_currency"] and metrics["messy"]["months"] is None
    assert metrics["messy"]["conflicts"] == 1
    assert metrics["bare"]["principal"] == (None, None, "unavailable")
    assert metrics["empty"]["core"]["status"] == "unavailable" and metrics["empty"]["months"] is None


def test_restatements_merge_with_the_first_of_a_cluster(spark):
    schema = "contract_id string, ordinal int, target_kind string, special_key string, category string, frequency string, currency string, amount double, label string, evidence string, source_kind string, source_field string, confidence string, mandatory boolean, conditional boolean, start_date string"
    row = lambda i, category, label, mandatory, kind="extracted_number": ("c", i, "obligation", None, category, "monthly", "SAR", 10.0, label, label, kind, f"f[{i}]", "low", mandatory, None, None)
    rows = [row(0, "unknown", "car loan", None), row(1, "unknown", "car", True), row(2, "unknown", "car", False), row(3, "unknown", "house", None), row(4, "deposit", "x", None, "type_details"), row(5, "deposit", "y", None)]
    got = {r["ordinal"]: r["merged"] for r in finance.deduplicate(spark.createDataFrame(rows, schema)).collect()}
    # 1 and 2 both agree with 0, whose flag is unstated; 3 shares no word; the typed source wins over 5
    assert sum(got.values()) == 6 and len(got) == 3 and got[4] == 2 and got[3] == 1


def test_many_restatements_under_one_contract(spark):
    """100,000 rows of one placeholder contract: few variants, and rows that merge with nothing."""
    n = F.col("id")
    rows = spark.range(100_000, numPartitions=8).select(
        F.lit("c").alias("contract_id"), n.alias("ordinal"), F.lit("obligation").alias("target_kind"), F.lit(None).cast("string").alias("special_key"),
        F.when(n % 2 == 0, "deposit").otherwise("unknown").alias("category"), F.lit("monthly").alias("frequency"), F.lit("SAR").alias("currency"), (n % 4 * 1.0).alias("amount"),
        F.when(n % 100 == 1, " ").when(n % 2 == 1, F.concat(F.lit("word "), (n % 7).cast("string"))).otherwise("x").alias("label"), F.lit("e").alias("evidence"), F.lit("extracted_number").alias("source_kind"),
        F.concat(F.lit("f"), n).alias("source_field"), F.lit("low").alias("confidence"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("mandatory"), F.lit(None).cast("boolean").alias("conditional"), F.lit(None).cast("string").alias("start_date"),
    )
    got = finance.deduplicate(rows).collect()
    # row by row: 1,000 rows have an unnamed category and no word, all other unnamed ones share a word
    heads, sizes = {}, Counter()
    for i in range(100_000):
        flag = {0: True, 1: False, 2: None}[i % 3]
        clusters = heads.setdefault(i % 4, [])
        at = next((k for k, (other, bare) in enumerate(clusters) if not bare and i % 100 != 1 and (flag is None or other is None or flag == other)), len(clusters))
        if at == len(clusters):
            clusters.append((flag, i % 100 == 1))
        sizes[i % 4, at] += 1
    assert Counter(r["merged"] for r in got) == Counter(sizes.values())


def test_audit_lists_each_excluded_value_once(frame):
    notes = {}
    for r in contracts.calculation_audit(frame).collect():
        notes.setdefault(r["contract_id"], []).append(tuple(r)[1:])
    assert set(notes) == {c[0] for c in GOLDEN}
    messy = notes["messy"]
    assert sorted((v, f, d) for k, _, v, f, d in messy if k == "conflict") == [(1750.0, "financialObligations[2]", "financialObligations[0]")]
    assert ("warning", "contract_currency_ambiguous", None, None, "MIXED_CURRENCY") in messy
    assert ("excluded", "currency_unresolved", 80000.0, "typeDetails.financedAmount", None) in messy
    assert ("formula", "ratios.totalCostIncrease", 40.0, None, "financingCost ÷ principal × 100") in notes["auto"]
    assert ("excluded", "deposit_refundability_unresolved", 2000.0, "typeDetails.securityDeposit", None) in notes["lease"]
    for rows in notes.values():
        excluded = [n for n in rows if n[0] == "excluded"]
        assert len(excluded) == len(set(excluded))
    assert contracts.calculation_audit(frame.limit(0)).count() == 0


def test_totals_and_estimates(metrics):
    assert metrics["auto"]["estimated_cost"] == (145200.0, "SAR", "known") and metrics["auto"]["difference_amount"]["status"] == "unavailable"
    assert metrics["auto"]["totals_by_currency"] == [("SAR", 145200.0)]
    assert [t["currency"] for t in metrics["messy"]["totals_by_currency"]] == ["SAR", "USD"]
    assert metrics["empty"]["totals_by_currency"] is None and metrics["empty"]["unquantified_contingent"] is None
    assert metrics["percent"]["unquantified_contingent"] is True


def test_budgets(spark):
    schema = "monthly_income double, essential_expenses double, existing_debt double, savings double, monthly_commitment double, upfront_costs double"
    rows = spark.createDataFrame([(8000.0, 4000.0, 1000.0, None, 3000.0, None), (10000.0, 3000.0, 500.0, 15000.0, 2000.0, 4050.0), (6000.0, 2000.0, 500.0, 5000.0, None, 1000.0)], schema)
    a, b, c = finance.budget_impact(rows).orderBy(F.desc("existing_debt"), F.desc("monthly_income")).collect()
    assert (a["available_before"], a["available_after"], a["contract_ratio"], a["total_commitment_ratio"], a["remaining_savings"]) == (3000, 0, 37.5, 50, None)
    assert (b["remaining_savings"], b["coverage_months"]) == (10950, 2.0)
    assert (c["available_before"], c["available_after"], c["contract_ratio"]) == (3500, None, None)
