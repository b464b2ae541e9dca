"""Masking of personal data in running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, most specific first, and their marks. Word edges are ASCII.
_EDGE_L, _EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
IBAN = rf"(?i){_EDGE_L}SA\d{{2}}[0-9A-Z]{{20}}{_EDGE_R}"
NATIONAL_ID = rf"{_EDGE_L}1\d{{9}}{_EDGE_R}"
IQAMA = rf"{_EDGE_L}2\d{{9}}{_EDGE_R}"
PHONE = rf"(?:\+966|00966|0)[{{S}}-]?5\d[{{S}}-]?\d{{{{3}}}}[{{S}}-]?\d{{{{4}}}}|{_EDGE_L}5\d[{{S}}-]?\d{{{{3}}}}[{{S}}-]?\d{{{{4}}}}{_EDGE_R}".format(S=r"\s ")
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
BANK_ACCOUNT = rf"{_EDGE_L}\d{{10,24}}{_EDGE_R}"
LABEL_COMPANY = rf"(?i)(?:السجل التجاري|سجل تجاري|commercial registration|{_EDGE_L}cr{_EDGE_R})"
LABEL_NATIONAL = rf"(?i)(?:الهوية الوطنية|رقم الهوية|{_EDGE_L}national id{_EDGE_R})"
LABEL_IQAMA = rf"(?i)(?:رقم الإقامة|إقامة|{_EDGE_L}iqama{_EDGE_R})"
BEFORE_CHARS, AFTER_CHARS = 60, 40

CATEGORIES = ("ibans", "commercial_registrations", "national_ids", "iqama_numbers", "phones", "emails", "bank_accounts")


def _last(window: Column, label: str) -> Column:
    """Where the last match begins, or -1."""
    found = window.rlike(label)
    return F.when(found, F.length(F.regexp_extract(window, f"(?s)^(.*)(?:{label})", 1))).otherwise(-1)


def _first(window: Column, label: str) -> Column:
    found = window.rlike(label)
    return F.when(found, F.length(F.regexp_extract(window, f"(?s)^(.*?)(?:{label})", 1))).otherwise(1 << 30)


def _is_company(text: Column, at: Column, end: Column) -> Column:
    """Whether the label nearest to text[at:end] says commercial registration: one before wins over one after."""
    before = F.substring(text, F.greatest(at - BEFORE_CHARS, F.lit(0)) + 1, F.least(at, F.lit(BEFORE_CHARS)))
    after = F.substring(text, end + 1, F.lit(AFTER_CHARS))
    b = [_last(before, p) for p in (LABEL_COMPANY, LABEL_NATIONAL, LABEL_IQAMA)]
    a = [_first(after, p) for p in (LABEL_COMPANY, LABEL_NATIONAL, LABEL_IQAMA)]
    labelled_before = F.greatest(*b) >= 0
    return F.when(labelled_before, b[0] > F.greatest(b[1], b[2])).otherwise((a[0] < (1 << 30)) & (a[0] < F.least(a[1], a[2])))


def _identity_marks(text: Column) -> Column:
    """struct(masked, companies, persons): ten-digit numbers from 1 by the label near them."""
    gaps, ids = F.split(text, NATIONAL_ID, -1), F.regexp_extract_all(text, F.lit(NATIONAL_ID), F.lit(0))
    start = F.struct(F.get(gaps, F.lit(0)).alias("out"), F.length(F.get(gaps, F.lit(0))).alias("at"), F.lit(0).alias("companies"))

    def step(s: Column, i: Column) -> Column:
        end = s["at"] + F.length(F.get(ids, i))
        company = _is_company(text, s["at"], end)
        gap = F.get(gaps, i + 1)
        return F.struct(
            F.concat(s["out"], F.when(company, "[COMMERCIAL_REGISTRATION]").otherwise("[NATIONAL_ID]"), gap).alias("out"),
            (end + F.length(gap)).alias("at"),
            (s["companies"] + company.cast("int")).alias("companies"),
        )

    out = F.aggregate(F.sequence(F.lit(0), F.size(ids) - 1), start, step)
    none = F.struct(text.alias("masked"), F.lit(0).alias("companies"), F.lit(0).alias("persons"))
    return F.when(F.size(ids) > 0, F.struct(out["out"].alias("masked"), out["companies"].alias("companies"), (F.size(ids) - out["companies"]).alias("persons"))).otherwise(none)


# What every match of a rule holds: a text without it is passed on as it is.
_HINTS = {IBAN: r"(?i)SA\d\d", NATIONAL_ID: r"1\d{9}", IQAMA: r"2\d{9}", PHONE: r"5\d[\s\u00A0-]?\d{3}", EMAIL: "@", BANK_ACCOUNT: r"\d{10}"}


def mask_pii(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``masked_text`` and a count per category; each rule sees what those before left.

    Null texts stay null with counts of 0. All in column expressions, so it runs where the text is read;
    a rule counts and replaces only in texts that a cheaper test lets through.
    """
    out = rows.withColumn("masked_text", F.col(text))
    now = F.col("masked_text")
    for name, pattern, mark in (("ibans", IBAN, "[IBAN]"), ("national_ids", NATIONAL_ID, ""), ("iqama_numbers", IQAMA, "[IQAMA]"), ("phones", PHONE, "[PHONE]"), ("emails", EMAIL, "[EMAIL]"), ("bank_accounts", BANK_ACCOUNT, "[BANK_ACCOUNT]")):
        out = out.withColumn("_hint", F.coalesce(now.contains("@") if pattern == EMAIL else now.rlike(_HINTS[pattern]), F.lit(False)))
        if pattern == NATIONAL_ID:
            out = out.withColumn("_id", F.when(F.col("_hint"), _identity_marks(now)))
            out = out.withColumns({"masked_text": F.when(F.col("_hint"), F.col("_id.masked")).otherwise(now), "commercial_registrations": F.coalesce("_id.companies", F.lit(0)), "national_ids": F.coalesce("_id.persons", F.lit(0))}).drop("_id")
        else:
            out = out.withColumns({name: F.when(F.col("_hint"), F.regexp_count(now, F.lit(pattern))).otherwise(0), "masked_text": F.when(F.col("_hint"), F.regexp_replace(now, pattern, mark)).otherwise(now)})
    return out.drop("_hint")
