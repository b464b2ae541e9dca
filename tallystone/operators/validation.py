"""Replies checked against a schema: every issue with its path, in the order of the schema.

A schema is a tree of rules. It is compiled into one expression that walks a parsed JSON value
(VARIANT), so a table of replies is checked in one pass without a join or a Python worker.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.text import trimmed
from tallystone.operators.contracts import DETAILS
from tallystone.operators.documents import summary_of, without_fences


@dataclass(frozen=True)
class Rule:
    """``kind``: string, number, boolean, array (of ``item``), object (with ``fields``), choice or literal (of
    ``values``), tagged (an object whose field ``tag`` picks its rule from ``fields``). ``most``: of
    characters or items."""

    kind: str
    nullable: bool = False
    most: int | None = None
    item: Rule | None = None
    fields: Mapping[str, Rule] | None = None
    values: tuple[str, ...] = ()
    tag: str = ""


def _text(most: int | None = None, nullable: bool = False) -> Rule:
    return Rule("string", nullable, most)


def _list(item: Rule, most: int | None = None) -> Rule:
    return Rule("array", most=most, item=item)


_maybe, _number, _flag = _text(None, True), Rule("number", True), Rule("boolean", True)


def _record(**fields: Rule) -> Rule:
    return Rule("object", fields=fields)


# The fields of the typed details by type of agreement, all of which may be null but for the last.
TYPED = {
    "auto_finance": {"vehicleMake": _maybe, "vehicleModel": _maybe, "vehicleYear": _number, "financedAmount": _number, "downPayment": _number, "interestRate": _number, "loanTermMonths": _number, "monthlyInstallment": _number, "balloonPayment": _number},
    "personal_finance": {"loanAmount": _number, "interestRate": _number, "loanTermMonths": _number, "monthlyInstallment": _number, "purpose": _maybe, "earlySettlementTerms": _maybe},
    "mortgage": {"propertyAddress": _maybe, "propertyValue": _number, "loanAmount": _number, "downPayment": _number, "interestRate": _number, "loanTermYears": _number, "monthlyInstallment": _number},
    "credit_card": {"creditLimit": _number, "annualFee": _number, "interestRateApr": _number, "minimumPaymentPercentage": _number, "lateFee": _number, "cashAdvanceFee": _number},
    "lease": {"propertyAddress": _maybe, "monthlyRent": _number, "securityDeposit": _number, "leaseTermMonths": _number, "renewalTerms": _maybe, "utilitiesIncluded": _flag},
    "insurance": {"insuranceType": _maybe, "coverageAmount": _number, "premiumAmount": _number, "premiumFrequency": _maybe, "deductible": _number, "policyTermMonths": _number, "exclusions": _list(_text())},
    "employment": {"jobTitle": _maybe, "employer": _maybe, "employmentType": _maybe, "baseSalary": _number, "salaryFrequency": _maybe, "probationPeriodMonths": _number, "noticePeriodDays": _number, "nonCompeteTerms": _maybe},
    "subscription": {"serviceName": _maybe, "billingAmount": _number, "billingFrequency": _maybe, "autoRenew": _flag, "cancellationTerms": _maybe, "freeTrialDays": _number},
    "other": {"description": _maybe},
}
# What an agreement's understanding states, and the limits of each field.
UNDERSTANDING = _record(
    contractType=Rule("choice", values=(*DETAILS, "other")),
    contractSummary=_text(500),
    contractSummarySimple=_text(350),
    parties=_list(_record(role=_text(100), name=_maybe, identifier=_maybe, notes=_text(300, True)), 6),
    financialObligations=_list(_record(description=_text(250), amount=_number, currency=_maybe, frequency=_text(250, True), dueDate=_maybe), 12),
    dates=_list(_record(label=_text(250), date=_maybe, notes=_text(250, True)), 12),
    penalties=_list(_record(description=_text(250), amount=_number, currency=_maybe, condition=_text(600, True)), 10),
    fees=_list(_record(description=_text(250), amount=_number, currency=_maybe, isRecurring=_flag), 10),
    importantClauses=_list(_record(title=_text(180), summary=_text(500), riskLevel=Rule("choice", True, values=("low", "medium", "high")), evidence=_text(350, True), plainExplanation=_text(350)), 30),
    extractedNumbers=_list(_record(label=_text(250), value=Rule("number"), unit=_maybe), 20),
    missingInformation=_list(_record(field=_text(), reason=_text(300, True)), 15),
    extractionNotes=_text(700, True),
    typeDetails=Rule("tagged", tag="contractType", fields={kind: Rule("object", fields={"contractType": Rule("literal", values=(kind,)), **fields}) for kind, fields in TYPED.items()}),
)
# Fixed value: what is said of a quotation that the text doesn't hold.
LOST_EVIDENCE = "must be an exact verbatim substring of the masked contract text — it was not found (do not translate, paraphrase, or fabricate evidence; use null if no reliable excerpt exists)."


def kind_of(value: Column) -> Column:
    """undefined, null, string, number, boolean, array or object."""
    shape = F.schema_of_variant(value)
    simple = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean"}
    out = F.when(shape.isNull(), "undefined").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")
    for name, kind in simple.items():
        out = out.when(shape == name, kind)
    return out.otherwise("number")


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, F.lit(f"$.{name}"), "variant")


def _string(value: Column) -> Column:
    return F.try_variant_get(value, F.lit("$"), "string")


def schema_issues(value: Column, rule: Rule, path: Column | None = None) -> Column:
    """An array of lines ``- path: message`` for what is wrong with a VARIANT; empty for nothing. SQL null is a missing value."""
    at = F.lit("(root)") if path is None else path
    under = lambda name: F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))
    line = lambda message, where=at: F.array(F.concat(F.lit("- "), where, F.lit(": "), message))
    none = F.array().cast("array<string>")
    kind = kind_of(value)
    absent = (kind == "null") if rule.nullable else F.lit(False)
    if rule.kind in ("choice", "literal"):
        told = "|".join(f'"{v}"' for v in rule.values)
        message = f"Invalid option: expected one of {told}" if rule.kind == "choice" else f"Invalid input: expected {told}"
        fits = F.coalesce((kind == "string") & _string(value).isin(*rule.values), F.lit(False))
        return F.when(absent | fits, none).otherwise(line(F.lit(message)))
    expected = "object" if rule.kind == "tagged" else rule.kind
    wrong = line(F.concat(F.lit(f"Invalid input: expected {expected}, received "), kind))
    big = lambda size, unit: F.when(size > rule.most, line(F.lit(f"Too big: expected {rule.kind} to have <={rule.most} {unit}"))).otherwise(none) if rule.most is not None else none
    if rule.kind == "array":
        items = F.try_variant_get(value, F.lit("$"), "array<variant>")
        each = F.transform(items, lambda x, i: schema_issues(x, rule.item, F.concat(at, F.lit("."), i.cast("string"))))
        found = F.concat(F.flatten(each), big(F.size(items), "items"))
    elif rule.kind == "object":
        found = F.concat(*[schema_issues(_field(value, name), r, under(name)) for name, r in rule.fields.items()])
    elif rule.kind == "tagged":
        tag = _field(value, rule.tag)
        found = line(F.lit("Invalid input"), under(rule.tag))
        for name, r in rule.fields.items():
            found = F.when((kind_of(tag) == "string") & (_string(tag) == name), schema_issues(value, r, path)).otherwise(found)
    else:
        found = big(F.length(_string(value)), "characters") if rule.kind == "string" else none
    return F.when(absent, none).when(kind == expected, found).otherwise(wrong)


def validated_understandings(rows: DataFrame, reply: str = "reply", text: str = "text") -> DataFrame:
    """``rows`` with ``status``, ``n_issues`` and ``issues`` (lines) of each reply.

    A reply is JSON, within code fences or not. Status: ``no_response`` (null or blank), ``unreadable``
    (no JSON, or an object with a key twice), ``invalid`` (against the schema; the first ten issues and
    how many more there are), ``unverified`` (a clause quotes what ``text`` doesn't hold word for word;
    all of them), else ``valid``. Lengths count characters, not units of two bytes.
    """
    body = trimmed(without_fences(trimmed(F.coalesce(F.col(reply), F.lit("")))))
    out = rows.withColumn("_body", body).withColumn("_value", F.try_parse_json("_body"))
    out = out.withColumn("_found", F.when(F.col("_value").isNotNull(), schema_issues(F.col("_value"), UNDERSTANDING)))
    clauses = F.try_variant_get("_value", F.lit("$.importantClauses"), "array<variant>")

    def lost(clause: Column, i: Column) -> Column:
        said = _string(_field(clause, "evidence"))
        return F.when(said.isNotNull() & ~F.coalesce(F.contains(F.col(text), said), F.lit(False)), F.concat(F.lit("- importantClauses."), i.cast("string"), F.lit(f".evidence: {LOST_EVIDENCE}")))

    out = out.withColumn("_lost", F.when(F.size("_found") == 0, F.array_compact(F.transform(clauses, lost))))
    blank = trimmed(F.coalesce(F.col(reply), F.lit(""))) == ""
    status = F.when(blank, "no_response").when(F.col("_value").isNull(), "unreadable").when(F.size("_found") > 0, "invalid").when(F.size("_lost") > 0, "unverified").otherwise("valid")
    lines = F.when(F.col("status") == "invalid", summary_of(F.col("_found"))).when(F.col("status") == "unverified", F.array_join("_lost", "\n"))
    out = out.withColumn("status", status)
    return out.withColumns({"n_issues": F.when(F.col("status") == "unverified", F.size("_lost")).otherwise(F.coalesce(F.size("_found"), F.lit(0))), "issues": lines}).drop("_body", "_value", "_found", "_lost")
