"""Figures as text, in the reader's language. Digits are Western in both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions.text import trimmed
from tallystone.operators.concepts import plain_number

# Units, titles and file names by language.
UNITS = {"en": {"days": "days", "months": "months", "years": "years"}, "ar": {"days": "يوم", "months": "شهر", "years": "سنة"}}
PERCENT = {"en": "%", "ar": "٪"}
TITLES = {
    "en": {
        "auto_finance": "Auto finance", "personal_finance": "Personal finance", "mortgage": "Mortgage", "credit_card": "Credit card", "lease": "Lease", "insurance": "Insurance", "employment": "Employment",
        "subscription": "Subscription", "other": "Contract",
    },
    "ar": {
        "auto_finance": "تمويل سيارة", "personal_finance": "تمويل شخصي", "mortgage": "تمويل عقاري", "credit_card": "بطاقة ائتمان", "lease": "إيجار", "insurance": "تأمين", "employment": "عمل", "subscription": "اشتراك", "other": "عقد",
    },
}
REPORT_NAMES = {"en": "contract-summary", "ar": "خلاصة-تحليل-العقد"}


def money_text(value: Column, currency: Column) -> Column:
    """The amount and its currency; the bare amount where that is unknown; null for no amount."""
    return F.when(value.isNotNull(), F.concat_ws(" ", plain_number(value), currency))


def exact_money(value: Column, currency: Column, status: Column) -> Column:
    """Two decimals always, as evidence states amounts; estimates say so; null where unavailable."""
    note = F.when(status == "estimated", "(estimated)")
    return F.when((status != "unavailable") & value.isNotNull(), F.concat_ws(" ", F.format_number(value, 2), currency, note))


def percentage_text(value: Column, language: str = "en") -> Column:
    return F.concat(plain_number(value), F.lit(PERCENT[language]))


def duration_text(months: Column, years: Column, days: Column, language: str = "en") -> Column:
    """In the first unit that is known, of months, years and days; null for none."""
    said = [F.when(x.isNotNull(), F.concat_ws(" ", plain_number(x.cast("double")), F.lit(UNITS[language][unit]))) for x, unit in ((months, "months"), (years, "years"), (days, "days"))]
    return F.coalesce(*said)


def coverage_text(months: Column, language: str = "en") -> Column:
    """For how long savings last, in whole months: Arabic has one, two, few and many."""
    n = F.floor(months + 0.5)
    count = n.cast("string")
    if language == "ar":
        many = F.when(n == 1, "حوالي شهر واحد").when(n == 2, "حوالي شهرين").when(n <= 10, F.concat(F.lit("حوالي "), count, F.lit(" أشهر"))).otherwise(F.concat(F.lit("حوالي "), count, F.lit(" شهراً")))
        return F.when(n < 1, "أقل من شهر واحد").when(months.isNotNull(), many)
    return F.when(n < 1, "Less than one month").when(n == 1, "About 1 month").when(months.isNotNull(), F.concat(F.lit("About "), count, F.lit(" months")))


def title_text(contract_type: Column, descriptors: list[Column], language: str = "en") -> Column:
    """The type's name, and what is known of the object after a dash."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in TITLES[language].items() for x in kv]), contract_type)
    shown = F.concat_ws(" ", *[F.nullif(trimmed(d), F.lit("")) for d in descriptors])
    return F.concat_ws(" — ", name, F.nullif(shown, F.lit("")))


def report_name(generated: Column, personal: Column, language: str = "en") -> Column:
    """A file name with the day; it holds no figures."""
    return F.concat(F.lit(REPORT_NAMES[language]), F.when(personal, "-personal").otherwise(""), F.lit("-"), F.date_format(generated, "yyyy-MM-dd"), F.lit(".pdf"))


def whole_days(value: Column) -> Column:
    """Days rounded half up."""
    return F.floor(value + 0.5).cast("long")


def minimum_inputs(*inputs: Column) -> Column:
    """Whether all are finite numbers."""
    fine = F.lit(True)
    for x in inputs:
        fine &= F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    return fine
