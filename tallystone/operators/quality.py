"""Text-quality scores of extracted documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.text import SPACE, trimmed

# Character classes, in the order in which they claim a character.
REPLACEMENT = "�"
CONTROL = r"\x00-\x1F\x7F-\x9F"
MOJIBAKE = "ÙØÃÂ"
ARABIC = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
LATIN = "A-Za-z"
DIGIT = "0-9"
SYMBOL = r".,;:!?()\-–—/\\'\"«»%$&@#+*="
# Limits of the score.
LEAST_CHARS = 20
CHARS_PER_PAGE = (40, 200)
READABLE = (0.55, 0.85)
SUSPICIOUS = (0.08, 0.25)
MOJIBAKE_SHARE = (0.004, 0.015)
REPLACEMENT_SHARE = (0.001, 0.01)
ONE_SYMBOL = (0.1, 0.2)
READABLE_TOKENS = (0.35, 0.6)
GOOD, POOR, LEAN_OCR = 75, 40, 60
LEGAL_LEAST_CHARS, LEGAL_MOST_REPLACED, LEGAL_LEAST_PRINTABLE = 40, 0.001, 0.85


def ramp(value: Column, poor_at: float, good_at: float) -> Column:
    """0 at ``poor_at``, 1 at ``good_at``, linear between; either may be the larger."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - poor_at) / (good_at - poor_at)))


def quality_of(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= POOR, "partial").otherwise("poor")


_READABLE = r"a-zA-Z0-9.,%\-/\p{L}\p{N}"
#: White space and all else; what most characters are is tried first.
_GAP, _INK = f"[[^!-~]&&[{SPACE}]]", f"[!-~[^{SPACE}]]"
#: Stands for a token while tokens are counted; it is an unreadable character itself.
_MARK = "\x01"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", "")))


def _most(text: Column) -> Column:
    """How often the commonest character of ``text`` occurs."""
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0).otherwise(F.length(text) - F.length(F.replace(text, c, F.lit("")))))
    return F.when(text == "", 0).otherwise(F.coalesce(F.array_max(each), F.lit(0)))


def score_text_quality(rows: DataFrame, text: str = "text", pages: Column | None = None, financial_score: Column | None = None) -> DataFrame:
    """``rows`` with ratios, ``general_score``, ``score``, ``quality`` and ``should_use_ocr``.

    ``pages`` (default 1) spreads the length; ``financial_score``, where not null, caps the score. Null
    texts count as empty, and texts under LEAST_CHARS characters without white space score 0.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    # characters are counted by what is left without them; all but the ordinary ones are few
    ordinary = f"{LATIN}{DIGIT}{SYMBOL}{ARABIC}"
    first = _let(F.regexp_replace(raw, f"{_GAP}++", ""), lambda bare: F.struct(F.length(bare).alias("n"), F.regexp_replace(bare, f"[{ordinary}]++", "").alias("odd")))
    counted = _let(first, lambda x: F.struct(x["n"].alias("n"), F.length(x["odd"]).alias("odd"), *[_count(x["odd"], chars).alias(name) for name, chars in (("control", CONTROL), ("replaced", REPLACEMENT), ("mojibake", MOJIBAKE))], _most(x["odd"]).alias("most")))
    rows = rows.withColumn("_c", counted)
    n = F.col("_c.n")
    # each token becomes one mark, or each token with an unreadable character
    bad = F.regexp_replace(raw, rf"(?<!{_INK})[{_READABLE}]*+[^{_READABLE}{SPACE}]{_INK}*+", _MARK)
    marks = _let(bad, lambda x: F.struct((F.length(F.regexp_replace(raw, f"{_INK}++", _MARK)) - F.length(raw)).alias("less"), (F.length(x) - F.length(F.replace(x, F.lit(_MARK), F.lit("")))).alias("unreadable")))
    rows = rows.withColumn("_t", marks)
    tokens = F.col("_t.less") + n
    control, replaced, mojibake = (F.col(f"_c.{c}") / n for c in ("control", "replaced", "mojibake"))
    readable = (n - F.col("_c.odd")) / n
    readable_tokens = (tokens - F.col("_t.unreadable")) / F.nullif(tokens, F.lit(0))
    per_page = F.length(raw) / F.greatest(F.lit(1), pages if pages is not None else F.lit(1))
    parts = {
        "chars_per_page": per_page.cast("double"),
        "readable_ratio": readable,
        "suspicious_ratio": F.greatest(F.lit(0.0), 1 - readable - control - replaced),
        "mojibake_ratio": mojibake,
        "replacement_ratio": replaced,
        "symbol_ratio": F.col("_c.most") / n,
        "token_ratio": F.coalesce(readable_tokens, F.lit(0.0)),
    }
    enough = n >= LEAST_CHARS
    out = rows.withColumns({k: F.when(enough, F.round(v, 6)).otherwise(F.lit(0.0)) if k != "chars_per_page" else v for k, v in parts.items()}).withColumn("_enough", enough)
    scores = [
        ramp(F.col("chars_per_page"), *CHARS_PER_PAGE),
        ramp(F.col("readable_ratio"), *READABLE),
        ramp(F.col("suspicious_ratio"), *SUSPICIOUS[::-1]),
        ramp(F.col("mojibake_ratio"), *MOJIBAKE_SHARE[::-1]),
        ramp(F.col("replacement_ratio"), *REPLACEMENT_SHARE[::-1]),
        ramp(F.col("symbol_ratio"), *ONE_SYMBOL[::-1]),
        ramp(F.col("token_ratio"), *READABLE_TOKENS),
    ]
    general = F.when(F.col("_enough"), F.floor(F.round(sum(scores[1:], scores[0]) / len(scores) * 100, 6) + 0.5)).otherwise(0).cast("int")
    broken = (F.col("mojibake_ratio") >= MOJIBAKE_SHARE[1]) | (F.col("replacement_ratio") >= REPLACEMENT_SHARE[1])
    out = out.withColumn("general_score", general).withColumn("general_quality", F.when(broken | ~F.col("_enough"), "poor").otherwise(quality_of(F.col("general_score"))))
    score = F.least(F.col("general_score"), F.when(F.col("_enough"), financial_score)) if financial_score is not None else F.col("general_score")
    out = out.withColumn("score", score).withColumn("quality", F.when(F.col("general_quality") == "poor", "poor").otherwise(quality_of(F.col("score"))))
    return out.withColumn("should_use_ocr", (F.col("quality") == "poor") | ((F.col("quality") == "partial") & (F.col("score") < LEAN_OCR))).drop("_enough", "_c", "_t")


def gate_legal_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``ok`` and ``reason``: long enough, decoded and printable; a null text is too short."""
    body = trimmed(F.coalesce(F.col(text), F.lit("")))
    n = F.length(body)
    replaced = (n - F.length(F.replace(body, F.lit(REPLACEMENT), F.lit("")))) / n
    printable = (n - F.length(F.regexp_replace(body, rf"[\p{{L}}\p{{N}}\p{{P}}{SPACE}]++", ""))) / n
    reason = F.when(n < LEGAL_LEAST_CHARS, "too_short").when(replaced > LEGAL_MOST_REPLACED, "replacement_characters").when(printable < LEGAL_LEAST_PRINTABLE, "low_printable_ratio")
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
