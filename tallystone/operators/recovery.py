"""Figures of financing agreements recovered from damaged text.

Digits that a scan has lost are replaced by what the text says elsewhere: amounts in words, an instalment
that a table repeats, a term in years, and sums that must hold. All column expressions, one row per text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import wordlists as L
from tallystone.functions.text import SPACE, western_digits

# Characters after a label, the tolerance of sums, plausible instalments, and penalties.
WINDOW_CHARS = 120
TOLERANCE = 0.02
INSTALLMENTS = (100, 100_000)
GAP, ZERO, BROKEN, ARITHMETIC, DURATION = 60, 8, 8, 10, 10
_NUMBER = r"\d[\d,]*\d|\d"
_YEARS = r"(?i)سن(ة|وات)|year"


def lookup_form(word: Column) -> Column:
    """A word without marks, with one form for each letter, as number words are listed."""
    return F.trim(F.translate(F.regexp_replace(word, "[ً-ْٰ]", ""), "أإآئؤةء", "ااايوه"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` written and computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def number_words(text: Column) -> Column:
    """struct(value, percent) of the amount that ``text`` says in words; null without a number word."""
    pair, thousand = -2.0, -1.0
    codes = {w: float(v) for w, v in L.NUMBER_WORDS.items()} | dict.fromkeys(L.TWO_THOUSAND, pair) | dict.fromkeys(L.THOUSAND, thousand)
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    # one pattern finds the number words, with or without "and" before them; only these few are looked up
    apart = f"[^{SPACE}،,()]"
    pattern = f"(?<!{apart})و?({'|'.join(codes)})(?!{apart})"
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"))

    def step(acc: Column, v: Column) -> Column:
        more = F.when(v == pair, 2000.0).when(v == thousand, F.when(acc["part"] > 0, acc["part"]).otherwise(1.0) * 1000).otherwise(0.0)
        return F.struct((acc["total"] + more).alias("total"), F.when(v < 0, 0.0).otherwise(acc["part"] + v).alias("part"))

    percent = lambda t: F.greatest(*[t.contains(m) for m in L.PERCENT_WORDS])
    value = lambda said: F.aggregate(F.transform(said, lambda w: F.element_at(table, w)), start, step, lambda acc: acc["total"] + acc["part"])
    found = lambda t: _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda said: F.when(F.size(said) > 0, F.struct(value(said).alias("value"), percent(t).alias("percent"))))
    return _let(lookup_form(text), found)


def words_in_parentheses(text: Column) -> Column:
    """The amounts in words that stand in parentheses, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]{2,120})\)"), F.lit(1)), number_words), lambda x: x.isNotNull())


def number_tokens(text: Column) -> Column:
    """Numbers in digits of either script, with their group separators left out."""
    return F.transform(F.regexp_extract_all(western_digits(text), F.lit(_NUMBER), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def about_equal(a: Column, b: Column) -> Column:
    """Within two hundredths of the larger."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * TOLERANCE


def label_window(text: Column, labels: tuple[str, ...]) -> Column:
    """What follows the first place of the first label that occurs, on its line; null without any."""
    after = lambda label: F.substring(text, F.instr(text, label) + len(label), F.lit(WINDOW_CHARS))
    window = F.coalesce(*[F.when(text.contains(label), after(label)) for label in labels])
    return F.substring_index(window, "\n", 1)


def _field(value: Column, status: str, confidence: str, source: str, found: Column | bool = True, zero: bool = False) -> Column:
    found = found if isinstance(found, Column) else F.lit(found)
    return F.struct(value.cast("double").alias("value"), F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), found.alias("found"), F.lit(zero).alias("zero"))


def _in_words(window: Column, unit: str) -> Column:
    """The amount that a window says in words: in parentheses first, else up to its unit."""
    upto = F.regexp_extract(window, f"(?s)^(.*?(?:{L.UNIT_ENDS[unit]}))", 1)
    inline = number_words(F.coalesce(F.nullif(upto, F.lit("")), window))
    if unit != "percent":
        return F.coalesce(F.get(words_in_parentheses(window), F.lit(0))["value"], inline["value"])
    inside = _let(words_in_parentheses(window), lambda w: F.coalesce(F.get(F.filter(w, lambda x: x["percent"]), F.lit(0)), F.get(w, F.lit(0))))
    return F.coalesce(inside["value"], _let(inline, lambda x: F.when(x["percent"], x["value"])))


def recovered_field(window: Column, said: Column, digits: Column) -> Column:
    """A field from its window, the amount in words and the numbers in it: words before digits; a zero and
    several pieces of digits are no value."""
    first, none = F.get(digits, F.lit(0)), F.lit(None)
    return (
        F.when(window.isNull(), _field(none, "missing", "low", "ocr_digits", False))
        .when(said.isNotNull(), _field(said, "recovered", "high", "amount_words"))
        .when(F.size(digits) > 1, _field(none, "ambiguous", "low", "ocr_digits"))
        .when(first == 0, _field(none, "missing", "low", "ocr_digits", True, True))
        .when(first.isNotNull(), _field(first, "direct", "high", "ocr_digits"))
        .otherwise(_field(none, "missing", "low", "ocr_digits"))
    )


def repeated_installment(text: Column) -> Column:
    """struct(value, times) of the plausible number that a text repeats most, dates aside; the first of
    equally frequent ones; null where none is repeated."""
    undated = western_digits(text)
    for date in (r"\b\d{1,2}[\/.-]\d{1,2}[\/.-]\d{4}\b", r"\b\d{4}[\/.-]\d{1,2}[\/.-]\d{1,2}\b"):
        undated = F.regexp_replace(undated, date, " ")
    numbers = F.filter(number_tokens(undated), lambda v: v.between(*INSTALLMENTS))
    counted = _let(numbers, lambda all_: F.transform(F.array_distinct(all_), lambda v: F.struct(v.alias("value"), F.size(F.filter(all_, lambda x: x == v)).alias("times"))))
    best = F.aggregate(counted, F.struct(F.lit(0.0).alias("value"), F.lit(1).alias("times")), lambda a, x: F.when(x["times"] > a["times"], x).otherwise(a))
    return _let(best, lambda b: F.when(b["times"] > 1, b))


def term_by_years(window: Column) -> Column:
    """Months by the years that a window gives in parentheses, in digits or words."""
    inner = F.regexp_extract(window, r"\(([^()]{1,40})\)", 1)
    years = F.coalesce(F.get(number_tokens(inner), F.lit(0)), number_words(inner)["value"])
    return F.when(inner.rlike(_YEARS), years * 12)


_PARTS = ("value", "status", "confidence", "source", "found", "zero")


def _fixed(rows: DataFrame, field: str, when: Column, value: Column, confidence: Column | str, source: str) -> DataFrame:
    """``rows`` with the field's flat columns changed where ``when`` holds. Condition and value are columns
    of their own, so that the chain of corrections stays as long as it is."""
    rows = rows.withColumns({"_when": F.coalesce(when, F.lit(False)), "_value": value, "_sure": confidence if isinstance(confidence, Column) else F.lit(confidence)})
    now = {"value": F.col("_value"), "status": F.lit("recovered"), "confidence": F.col("_sure"), "source": F.lit(source)}
    return rows.withColumns({f"_{field}_{k}": F.when(F.col("_when"), x).otherwise(F.col(f"_{field}_{k}")) for k, x in now.items()})


def recover_values(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with a struct (value, status, confidence, source, found, zero) per field, and ``conflicts``.

    A field is direct, recovered, ambiguous or missing. After the labels come the instalment table, the
    term in years, and the sums, in a fixed order; figures that a sum contradicts are kept and listed in
    ``conflicts``, but for a down payment, which the sum replaces. Null texts have no labels.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = list(L.RECOVERED_FIELDS)
    out = rows.withColumns({f"_w_{n}": label_window(body, labels) for n, (_, *labels) in L.RECOVERED_FIELDS.items()})
    out = out.withColumns({f"_a_{n}": _in_words(F.col(f"_w_{n}"), L.RECOVERED_FIELDS[n][0]) for n in names} | {f"_d_{n}": number_tokens(F.col(f"_w_{n}")) for n in names})
    out = out.withColumns({"_t": repeated_installment(body), "_y": term_by_years(F.col("_w_term_months"))})
    western = western_digits(body)
    last, years = (F.regexp_extract(western, p, 1).try_cast("double") for p in (r"حتى\s*القسط\s*(\d{1,3})", r"(\d{1,2})\s*سن(?:ة|وات)"))
    out = out.withColumns({"_l": last, "_s": years * 12})
    read = {n: recovered_field(F.col(f"_w_{n}"), F.col(f"_a_{n}"), F.col(f"_d_{n}")) for n in names}
    out = out.select(*rows.columns, "_t", "_y", "_l", "_s", *[read[n][k].alias(f"_{n}_{k}") for n in names for k in _PARTS])
    v = {n: F.col(f"_{n}_value") for n in names}
    known = {n: v[n].isNotNull() for n in names}
    note = lambda when, name: F.when(F.coalesce(when, F.lit(False)), name)
    sums = "arithmetic_consistency"

    out = out.withColumn("_n1", note(known["installment"] & (v["installment"] != F.col("_t.value")), "installment_table"))
    out = _fixed(out, "installment", ~known["installment"] & F.col("_t").isNotNull(), F.col("_t.value"), F.when(F.col("_t.times") >= 3, "high").otherwise("medium"), "installment_table")
    out = out.withColumn("_n2", note(known["term_months"] & (v["term_months"] != F.col("_y")), "term"))
    out = _fixed(out, "term_months", F.col("_y").isNotNull() & ~v["term_months"].eqNullSafe(F.col("_y")), F.col("_y"), "high", "duration_equivalence")
    out = _fixed(out, "term_months", ~known["term_months"] & (F.col("_l") > 0), F.col("_l"), "high", "installment_table")
    out = _fixed(out, "term_months", ~known["term_months"] & F.col("_l").isNull() & (F.col("_s") > 0), F.col("_s"), "high", "duration_equivalence")

    rest = v["total_payable"] - v["total_profit"]
    out = _fixed(out, "financed_amount", ~known["financed_amount"] & (rest > 0), rest, "high", sums)
    paid = v["cash_price"] - v["financed_amount"]
    out = out.withColumn("_n3", note((paid > 0) & ~about_equal(v["down_payment"], paid), "down_payment"))
    out = _fixed(out, "down_payment", (paid > 0) & ~F.coalesce(about_equal(v["down_payment"], paid), F.lit(False)), paid, "medium", sums)
    expected = v["cash_price"] - v["down_payment"]
    out = out.withColumn("_n4", note(~about_equal(v["financed_amount"], expected), "financed_amount"))
    out = _fixed(out, "financed_amount", ~known["financed_amount"] & expected.isNotNull(), expected, "medium", sums)
    whole = v["financed_amount"] + v["total_profit"]
    out = out.withColumn("_n5", note(~about_equal(v["total_payable"], whole), "total_payable"))
    out = _fixed(out, "total_payable", ~known["total_payable"] & whole.isNotNull(), whole, "medium", sums)
    profit = v["total_payable"] - v["financed_amount"]
    out = _fixed(out, "total_profit", ~known["total_profit"] & profit.isNotNull(), profit, "medium", sums)
    out = out.withColumn("_n6", note(~about_equal(v["installment"] * v["term_months"], v["total_payable"]), "schedule"))
    fields = [F.struct(*[F.col(f"_{n}_{k}").alias(k) for k in _PARTS]).alias(n) for n in names]
    return out.select(*rows.columns, *fields, F.array_compact(F.array(*[f"_n{i}" for i in range(1, 7)])).alias("conflicts"))


def number_density(text: Column) -> Column:
    """Numbers that occur more than once, as a share of the different ones; 0 without numbers."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))
    share = lambda all_: F.size(F.filter(F.array_distinct(all_), lambda v: F.size(F.filter(all_, lambda x: x == v)) > 1)) / F.size(F.array_distinct(all_))
    return _let(tokens, lambda t: F.when(F.size(t) > 0, share(t)).otherwise(0.0))


def financial_integrity(recovered: DataFrame, text: str = "text") -> DataFrame:
    """``recover_values``' rows with ``n_labels``, ``coverage``, ``density`` and ``financial_score``: 100 less
    penalties for labels without a value, suspicious zeros, broken digits and contradictions; null
    without any label."""
    names = list(L.RECOVERED_FIELDS)
    count = lambda test: sum((F.when(F.col(n)["found"] & test(F.col(n)), 1).otherwise(0) for n in names), F.lit(0))
    labels = count(lambda f: F.lit(True))
    sums = F.size(F.array_intersect("conflicts", F.array(*[F.lit(x) for x in ("financed_amount", "total_payable", "schedule")])))
    out = recovered.withColumns({"n_labels": labels, "coverage": count(lambda f: f["value"].isNotNull()) / F.nullif(labels, F.lit(0)), "density": number_density(F.coalesce(F.col(text), F.lit("")))})
    lost = (1 - F.col("coverage")) * GAP + count(lambda f: f["zero"]) * ZERO + count(lambda f: f["status"] == "ambiguous") * BROKEN + sums * ARITHMETIC + F.when(F.array_contains("conflicts", "term"), DURATION).otherwise(0)
    return out.withColumn("financial_score", F.when(F.col("n_labels") > 0, F.floor(F.greatest(F.lit(0.0), 100 - lost) + 0.5).cast("int")))


def recovery_notes(recovered: DataFrame, parent: str) -> DataFrame:
    """parent, notes: a line per usable figure with how it was found; null for texts without any.
    Write the rows before filtering on a recovered figure: Spark would repeat its whole derivation."""
    line = lambda n, unit: F.when(F.col(n)["value"].isNotNull(), F.concat(F.lit(f"- {n}: "), F.regexp_replace(F.col(n)["value"].cast("decimal(20,2)").cast("string"), r"\.?0+$", ""), F.lit(f" {unit} ("), F.col(n)["confidence"], F.lit(", "), F.col(n)["source"], F.lit(")")))
    lines = F.array_compact(F.array(*[line(n, unit) for n, (unit, *_) in L.RECOVERED_FIELDS.items()]))
    return recovered.select(parent, F.nullif(F.array_join(lines, "\n"), F.lit("")).alias("notes"))
