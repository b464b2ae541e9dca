"""Documents before and after a model has read them: pages, readings, replies and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.text import trimmed

# Issues that a summary lists, and what a reply must state.
MOST_ISSUES = 10
REQUIRED = ("contractType", "contractSummary", "importantClauses", "missingInformation")
#: An embedding takes texts of 1 to so many characters.
EMBEDDING_CHARS = 6000
_FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"


def best_reading(readings: DataFrame, by: str = "document_id", order: str = "ordinal") -> DataFrame:
    """Of each document the best of its readings (general_score, financial_score, confidence,
    n_recovered, n_arithmetic_conflicts, n_suspicious_zeros): by the lower of the two scores, then
    confidence (unknown is least), more recovered values, fewer conflicts, fewer zeros; the earlier wins."""
    score = F.least("general_score", "financial_score")  # skips nulls
    place = Window.partitionBy(by).orderBy(score.desc(), F.coalesce("confidence", F.lit(-1.0)).desc(), F.desc("n_recovered"), "n_arithmetic_conflicts", "n_suspicious_zeros", order)
    return readings.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")


def merged_pages(pages: DataFrame, by: str = "document_id") -> DataFrame:
    """One text of each document's pages (page, text) without a warning, in order, each under its mark.
    Documents without such a page are left out; a page that is there twice stays twice."""
    mark = F.concat(F.lit("--- PAGE "), F.col("p.page").cast("string"), F.lit(" ---\n"), F.coalesce("p.text", F.lit("")))
    kept = pages.filter("warning IS NULL").select(by, F.struct("page", "text").alias("p"))
    lists = kept.select(by, F.struct(F.col("p.page").alias("page"), mark.alias("t")).alias("p")).groupBy(by).agg(F.array_sort(F.collect_list("p")).alias("all"))
    return lists.select(by, F.array_join(F.transform("all", lambda x: x["t"]), "\n\n").alias("text"))


def chosen_text(native: Column, native_score: Column, scanned: Column, scanned_score: Column) -> Column:
    """struct(text, method): the scanned text when it scores at least as well, else the file's own."""
    scan = F.coalesce(scanned.isNotNull() & (scanned_score >= native_score), F.lit(False))
    return F.struct(F.when(scan, scanned).otherwise(native).alias("text"), F.when(scan, "ocr").otherwise("native").alias("method"))


def without_fences(reply: Column) -> Column:
    """What stands inside the first code fence of a reply, or the reply itself."""
    return F.when(reply.rlike(_FENCE), F.regexp_extract(reply, _FENCE, 1)).otherwise(reply)


def _issues_of_clauses(clauses: Column, text: Column) -> Column:
    lost = F.transform(clauses, lambda c, i: F.when(c["evidence"].isNotNull() & ~F.coalesce(text.contains(c["evidence"]), F.lit(False)), F.concat(F.lit("- importantClauses."), i.cast("string"), F.lit(".evidence: not found in the text"))))
    return F.array_compact(lost)


def summary_of(issues: Column, most: int = MOST_ISSUES) -> Column:
    """The first ``most`` issues, a line each, and how many more there are; null for none."""
    more = F.when(F.size(issues) > most, F.concat(F.lit("\n...and "), (F.size(issues) - most).cast("string"), F.lit(" more issue(s)."))).otherwise("")
    return F.when(F.size(issues) > 0, F.concat(F.array_join(F.slice(issues, 1, most), "\n"), more))


def validated_replies(rows: DataFrame, reply: str = "reply", text: str = "text") -> DataFrame:
    """``rows`` with ``parsed`` (the reply's clauses), ``valid`` and ``issues``.

    A reply must be a JSON object, within code fences or not, that states what is required; only
    then are the quotations of its clauses looked up, word for word, in the text that it was given.
    """
    body = trimmed(without_fences(trimmed(F.coalesce(F.col(reply), F.lit("")))))
    data = F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"})
    readable = body.startswith("{") & F.get_json_object(body, "$").isNotNull()
    out = rows.withColumns({"_data": data, "_ok": F.coalesce(readable, F.lit(False)), "_body": body})
    absent = F.array_compact(F.array(*[F.when(F.try_element_at("_data", F.lit(k)).isNull(), f"- {k}: is missing") for k in REQUIRED]))
    clauses = F.from_json(F.get_json_object("_body", "$.importantClauses"), "array<struct<title:string,evidence:string>>")
    out = out.withColumn("parsed", F.when(F.col("_ok"), clauses))
    lost = F.coalesce(_issues_of_clauses(F.col("parsed"), F.col(text)), F.array().cast("array<string>"))
    issues = F.when(~F.col("_ok"), F.array(F.lit("- (root): is no JSON object"))).when(F.size(absent) > 0, absent).otherwise(lost)
    out = out.withColumn("_issues", issues)
    return out.withColumns({"valid": F.size("_issues") == 0, "issues": summary_of(F.col("_issues"))}).drop("_data", "_ok", "_body", "_issues")


def embeddable(text: Column) -> Column:
    """Whether an embedding takes the text: something but white space, within the limit."""
    return F.coalesce((trimmed(text) != "") & (F.length(text) <= EMBEDDING_CHARS), F.lit(False))


def repaired_name(name: Column) -> Column:
    """A file name whose UTF-8 bytes were read as Latin-1, read again; other names as they are."""
    latin = ~name.rlike("[^\\u0000-\\u00FF]")
    again = F.try_validate_utf8(F.encode(name, "ISO-8859-1").cast("string"))
    return F.when(latin, F.coalesce(again, name)).otherwise(name)


def safe_name(name: Column, fallback: str) -> Column:
    """A trimmed name that can be shown, or ``fallback``: none, blank, or with broken characters."""
    shown = trimmed(name)
    broken = shown.rlike("[\\uFFFD\\u0000-\\u001F\\u007F-\\u009F]")
    return F.when(name.isNull() | (shown == "") | broken, fallback).otherwise(shown)


def extraction_summary(rows: DataFrame, parent: str = "document_id") -> DataFrame:
    """What is told of an extraction: method, pages, score, quality and whether to look again."""
    return rows.select(parent, "method", "pages", F.round("score").cast("int").alias("score"), "quality", (F.col("quality") != "good").alias("review"))
