"""What a report shows: risks, findings, repeated amounts, display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.text import trimmed

# The order of risks, and how many findings a report has.
RISKS = ("high", "medium", "low")
MOST_FINDINGS = 5


def risk_rank(risk: Column) -> Column:
    out = F.lit(len(RISKS))
    for i, name in reversed(list(enumerate(RISKS))):
        out = F.when(risk == name, i).otherwise(out)
    return out


def first_sentence(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)^.*?[.!?؟]", 0)
    return trimmed(F.when(found != "", found).otherwise(text))


def worst_risk(clauses: DataFrame, by: list[str], risk: str = "risk") -> DataFrame:
    """The gravest risk of each group; null only where no clause has one."""
    return clauses.groupBy(*by).agg(F.min_by(risk, risk_rank(F.col(risk))).alias("risk"))


def top_findings(clauses: DataFrame, by: list[str], ordinal: str, risk: str = "risk", most: int = MOST_FINDINGS) -> DataFrame:
    """High risks, then medium ones, in the order of ``ordinal``, the first ``most`` of each group."""
    order = Window.partitionBy(*by).orderBy(risk_rank(F.col(risk)), ordinal)
    return clauses.filter(F.col(risk).isin("high", "medium")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def most_repeated(numbers: DataFrame, by: list[str], least: float, most: float, value: str = "value", place: str = "place") -> DataFrame:
    """The value in [least, most] that occurs most often in its group, twice at least, with ``times``; of
    equally frequent ones the first seen."""
    counts = numbers.filter(F.col(value).between(least, most)).groupBy(*by, value).agg(F.count("*").alias("times"), F.min(place).alias("_first")).filter("times >= 2")
    order = Window.partitionBy(*by).orderBy(F.desc("times"), "_first")
    return counts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_first")


def display_text(value: Column) -> Column:
    """Text without placeholders, empty brackets and dangling separators; null if nothing is left."""
    out = F.regexp_replace(value, r"\[[A-Z_]+\]", "")
    out = F.regexp_replace(out, r"\(\s*\)|\[\s*\]", "")
    out = F.regexp_replace(out, r"\s*([,،;؛:\-–])(?:\s*[,،;؛:\-–])+", "$1")
    out = F.regexp_replace(out, r"^[\s,،;؛:\-–]+|[\s,،;؛:\-–]+$", "")
    return F.nullif(trimmed(F.regexp_replace(out, r"\s+", " ")), F.lit(""))
