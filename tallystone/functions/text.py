"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the scripts' regular expressions know it (wider than Java's \s).
SPACE = r"\t\n\x0B\f\r    -     　﻿"

# Words too common to rank by.
STOPWORDS = (
    "the", "and", "for", "must", "shall", "any", "all", "with", "from", "this", "that",
    "are", "was", "were", "has", "have", "had", "not", "may", "can", "its", "such",
    "under", "upon", "each", "who", "which", "these", "those", "into", "than",
    "في", "من", "على", "إلى", "أن", "كل", "هذا", "هذه", "التي", "الذي", "أو", "و",
)


_BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{SPACE}]", c))


def trimmed(text: Column) -> Column:
    """Without white space at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(_BLANKS))


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"[{SPACE}]+", " "))


def normalize_label(raw: Column) -> Column:
    """Trimmed, lower-cased, single-spaced, without the Arabic article at the start of a word; null is empty."""
    return F.regexp_replace(F.lower(collapsed(F.coalesce(raw, F.lit("")))), r"(^|\s)ال(?=\S)", "$1")


def plain_keyword(keyword: str) -> str:
    """A keyword as ``normalize_label`` has it."""
    collapsed = re.sub(f"[{SPACE}]+", " ", keyword)
    return re.sub(r"(^|\s)ال(?=\S)", r"\1", re.sub(f"^[{SPACE}]+|[{SPACE}]+$", "", collapsed).lower())


def has_any(label: Column, keywords: list[str] | tuple[str, ...]) -> Column:
    """Whether a normalised label holds any normalised keyword as a substring, word or not; one pattern for
    all keywords, so that a plan over many lists stays small."""
    return label.rlike("|".join(rf"\Q{plain_keyword(k)}\E" for k in keywords))


def contains_any(text: Column, keywords: list[str] | tuple[str, ...]) -> Column:
    """``has_any`` of a text, which is normalised first."""
    return has_any(normalize_label(text), keywords)


# The marks that are dropped, and the letters that become one another.
def fold_arabic(text: Column, tatweel: bool = False) -> Column:
    """Arabic spelling variants under one form; ``tatweel`` also drops the elongation stroke."""
    marks = "[ً-ْٰـ]" if tatweel else "[ً-ٰٟ]"
    return F.translate(F.regexp_replace(text, marks, ""), "إأآىة", "ااايه")


def without_tanween(line: Column) -> Column:
    return F.replace(line, F.lit("ً"), F.lit(""))


def western_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def normalize_question(question: Column) -> Column:
    folded = fold_arabic(F.lower(question), tatweel=True)
    return collapsed(F.regexp_replace(folded, rf"[^\p{{L}}\p{{N}}{SPACE}]", " "))


def _tokens(text: Column) -> Column:
    return F.split(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{SPACE}]", " "), f"[{SPACE}]+")


def content_words(text: Column) -> Column:
    """Lower-cased words of three letters or more that aren't stopwords, in order, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(_tokens(F.lower(text)), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def clause_words(text: Column) -> Column:
    """Lower-cased, folded words of two letters or more."""
    return F.filter(_tokens(fold_arabic(F.lower(text))), lambda t: F.length(t) >= 2)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 when either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def label_similarity(a: Column, b: Column) -> Column:
    """Of two normalised labels, by their words."""
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    return jaccard(words(a), words(b))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def normalize_ocr_text(text: Column) -> Column:
    """Line ends unified, control and invisible characters dropped, runs of blanks and of blank lines cut."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‏‪-‮⁠﻿]", "")
    out = F.regexp_replace(out, r"[ \t ]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine over the shorter length; 1 where either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    s = F.aggregate(pairs, zero, lambda s, p: F.struct((s["d"] + p["x"] * p["y"]).alias("d"), (s["a"] + p["x"] * p["x"]).alias("a"), (s["b"] + p["y"] * p["y"]).alias("b")))
    return F.when((s["a"] == 0) | (s["b"] == 0), F.lit(1.0)).otherwise(1 - s["d"] / (F.sqrt(s["a"]) * F.sqrt(s["b"])))


def hash_bucket(token: Column, dimensions: int) -> Column:
    """A token's coordinate: the first four bytes of its SHA-256 modulo the dimension."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dimensions


def queried_article(text: Column) -> Column:
    """The article that a query names, in English before Arabic; null if none."""
    english, arabic = F.regexp_extract(text, r"(?i)Article\s+([0-9]+[A-Za-z]?)", 1), F.regexp_extract(text, r"المادة\s+(\S+)", 1)
    return F.when(english != "", F.concat(F.lit("Article "), english)).when(arabic != "", F.concat(F.lit("المادة "), arabic))


def queried_section(text: Column) -> Column:
    """The section, clause or article that a query names: the first of five forms that occurs."""
    forms = [(word, rf"(?i){word}\s+([0-9]+[A-Za-z]?)") for word in ("Article", "Section", "Clause")] + [(word, rf"{word}\s+(\S+)") for word in ("المادة", "البند")]
    found = [F.when(F.regexp_extract(text, p, 1) != "", F.concat(F.lit(word + " "), F.regexp_extract(text, p, 1))) for word, p in forms]
    return F.coalesce(*found)


def matched_words(query_words: Column, said: Column) -> Column:
    """How many of the query's words (as ``said`` is folded) stand in the text ``said`` as whole words; a repeated
    query word counts each time. The text is bound once and searched, so no word of it is made a value."""
    bound = F.array(F.concat(F.lit(" "), F.regexp_replace(said, r"[^\p{L}\p{N}]++", " "), F.lit(" ")))
    count = lambda text: F.size(F.filter(query_words, lambda t: F.contains(text, F.concat(F.lit(" "), t, F.lit(" ")))))
    return F.get(F.transform(bound, count), F.lit(0))


def legal_keyword_score(text: Column, article: Column, title: Column, query: Column) -> Column:
    """10 for the very article that the query names, 1 for each content word found."""
    exact = F.coalesce(F.lower(article) == F.lower(queried_article(query)), F.lit(False))
    said = F.lower(F.concat(text, F.lit(" "), F.coalesce(article, F.lit("")), F.lit(" "), title))
    return F.when(exact, 10).otherwise(0) + matched_words(content_words(query), said)


def contract_keyword_score(text: Column, section: Column, query: Column, selected: Column | None = None) -> Column:
    """15 for the selected clause, 10 for the section that the query names, 1 for each word found."""
    fold = lambda c: fold_arabic(F.lower(c))
    named = F.coalesce(fold(section) == fold(queried_section(query)), F.lit(False))
    chosen = F.coalesce(fold(section) == fold(selected), F.lit(False)) if selected is not None else F.lit(False)
    said = fold(F.concat(text, F.lit(" "), F.coalesce(section, F.lit(""))))
    return F.when(chosen, 15).otherwise(0) + F.when(named, 10).otherwise(0) + matched_words(clause_words(query), said)


def contract_score(similarity: Column, keywords: Column) -> Column:
    return similarity * 0.65 + F.least(keywords * 0.05, F.lit(1.0)) * 0.35


def legal_score(similarity: Column, keywords: Column) -> Column:
    return similarity + keywords * 0.05
