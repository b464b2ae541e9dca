"""Amounts, currencies, percentages, dates, and what a description says of an amount."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions import wordlists as L
from tallystone.functions.text import SPACE, contains_any, normalize_label, trimmed, western_digits

# Payments of a frequency per month.
MONTHLY_FACTORS = {"daily": 365 / 12, "weekly": 52 / 12, "monthly": 1.0, "quarterly": 1 / 3, "semi_annual": 1 / 6, "annual": 1 / 12}
RECURRING = tuple(MONTHLY_FACTORS)
# Relative differences between a stated and a calculated total.
DIFFERENCES = ((0.005, "match"), (0.02, "rounding"), (0.1, "warning"))


Test = Callable[[Column, tuple[str, ...]], Column]


def first_match(text: Column, lists: dict[str, tuple[str, ...]], has: Test = contains_any) -> Column:
    """The first name whose list has a phrase in the text; null if none has. Here and below ``has`` is
    ``has_any`` for texts that are normalised already."""
    return F.coalesce(*[F.when(has(text, words), name) for name, words in lists.items()])


def joined(*texts: Column) -> Column:
    """Texts side by side, nulls left out."""
    return F.concat_ws(" ", *texts)


def frequency_of(raw: Column, has: Test = contains_any) -> Column:
    return first_match(raw, L.FREQUENCIES, has)


def obligation_type(frequency: Column, *texts: Column, has: Test = contains_any) -> Column:
    return typed_by(first_match(joined(*texts), L.OBLIGATION_TYPES, has), frequency)


def typed_by(by_text: Column, frequency: Column) -> Column:
    """The type of an obligation that its text names, else what its frequency makes of it."""
    return F.coalesce(by_text, F.when(frequency.isin(*RECURRING), "recurring_payment"), F.when(frequency == "one_time", "one_time_payment"), F.lit("unknown"))


def fee_type(*texts: Column, has: Test = contains_any) -> Column:
    return F.coalesce(first_match(joined(*texts), L.FEE_TYPES, has), F.lit("other"))


def penalty_type(*texts: Column, has: Test = contains_any) -> Column:
    return F.coalesce(first_match(joined(*texts), L.PENALTY_TYPES, has), F.lit("other"))


def mandatory_in(*texts: Column, has: Test = contains_any) -> Column:
    """True where stated or nothing is said, false where optional, null where it depends on something."""
    t = joined(*texts)
    return F.when(has(t, L.SAYS_MANDATORY), True).when(has(t, L.SAYS_OPTIONAL), False).when(has(t, L.SAYS_CONDITIONAL), None).otherwise(True)


def conditional_in(*texts: Column, has: Test = contains_any) -> Column:
    return F.when(has(joined(*texts), L.SAYS_CONDITIONAL), True)


def timing_in(*texts: Column, has: Test = contains_any) -> Column:
    t = joined(*texts)
    return F.when(has(t, L.SAYS_DUE_LATER), "due_later").when(has(t, L.SAYS_DUE_NOW), "due_now")


def refundable_in(*texts: Column, has: Test = contains_any) -> Column:
    t = joined(*texts)
    return F.when(has(t, L.SAYS_NON_REFUNDABLE), False).when(has(t, L.SAYS_REFUNDABLE), True)


def says(words: tuple[str, ...], *texts: Column, has: Test = contains_any) -> Column:
    return has(joined(*texts), words)


def scenario_in(*texts: Column, has: Test = contains_any) -> Column:
    t = joined(*texts)
    lists = {
        "early_settlement_scenario": L.SAYS_EARLY_SETTLEMENT_BALANCE + L.SAYS_EARLY_SETTLEMENT_PAYMENT,
        "default_scenario": L.SAYS_DEFAULT_SCENARIO,
        "cancellation_scenario": L.SAYS_CANCELLATION_SCENARIO,
        "insurance_claim_scenario": L.SAYS_INSURANCE_CLAIM,
    }
    return first_match(t, lists, has)


def currency_code(raw: Column) -> Column:
    """Three letters in upper case, else the code of a known name, else null."""
    name = trimmed(raw)
    known = F.create_map(*[F.lit(x) for pair in L.CURRENCY_NAMES.items() for x in pair])
    return F.when(name.rlike("^[A-Za-z]{3}$"), F.upper(name)).otherwise(F.try_element_at(known, F.lower(name)))


def parse_money(raw: Column) -> Column:
    """struct(value, currency) of a number with an optional three-letter code on either side; else null."""
    t = trimmed(raw)
    code = rf"^([A-Za-z]{{3}})[{SPACE}]+|[{SPACE}]+([A-Za-z]{{3}})$"
    before, after = F.regexp_extract(t, rf"^([A-Za-z]{{3}})[{SPACE}]+(?=.)", 1), F.regexp_extract(t, rf"[{SPACE}]([A-Za-z]{{3}})$", 1)
    rest = F.when(before != "", F.regexp_replace(t, rf"^[A-Za-z]{{3}}[{SPACE}]+", "")).otherwise(F.regexp_replace(t, code, ""))
    digits = F.replace(F.replace(F.replace(western_digits(rest), F.lit("٬"), F.lit("")), F.lit("٫"), F.lit(".")), F.lit(","), F.lit(""))
    return F.when(digits.rlike(r"^-?\d+(\.\d+)?$"), F.struct(digits.try_cast("double").alias("value"), F.upper(F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))).alias("currency")))


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def percentage(value: Column) -> Column:
    return F.when(finite(value) >= 0, finite(value))


def monthly_factor(frequency: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MONTHLY_FACTORS.items() for x in pair]), frequency)


def difference_class(stated: Column, calculated: Column) -> Column:
    relative = F.abs(F.try_divide(stated - calculated, F.abs(stated)))
    out = F.when(stated.isNull() | calculated.isNull() | (stated == 0), "unavailable")
    for limit, name in DIFFERENCES:
        out = out.when(relative < limit, name)
    return out.otherwise("conflict")


def iso_date(raw: Column) -> Column:
    """A date written YYYY-MM-DD or day first; anything partial or impossible is null."""
    t = western_digits(trimmed(raw))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    day = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    dmy = F.when(t.rlike(day), F.concat_ws("-", F.regexp_extract(t, day, 3), F.lpad(F.regexp_extract(t, day, 2), 2, "0"), F.lpad(F.regexp_extract(t, day, 1), 2, "0")))
    return F.coalesce(iso, dmy).try_cast("date")


def label_key(raw: Column) -> Column:
    return normalize_label(raw)
