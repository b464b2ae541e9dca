"""Queries over pages, readings, replies, names and figures as text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators import display, documents
from tallystone.session import table


def _view(spark: SparkSession, d: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {t}"), t=table(spark, d, name))


_READINGS = """SELECT user_id AS document_id, event_id AS ordinal, CAST(floor(value * 100) AS BIGINT) % 5 * 20 AS general_score, CASE WHEN event_id % 3 > 0 THEN event_id % 4 * 25 END AS financial_score,
  CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 2 AS DOUBLE) END AS confidence, event_id % 2 AS n_recovered, event_id % 3 AS n_arithmetic_conflicts, event_id % 5 AS n_suspicious_zeros FROM events"""


def best_reading(spark: SparkSession, d: str) -> DataFrame:
    return documents.best_reading(_view(spark, d, _READINGS, "events")).select("document_id", "ordinal")


_BEST_SQL = f"""SELECT document_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY least(general_score, coalesce(financial_score, general_score)) DESC, coalesce(confidence, -1) DESC, n_recovered DESC, n_arithmetic_conflicts, n_suspicious_zeros, ordinal) AS n FROM ({_READINGS})) WHERE n = 1"""

_PAGES = "SELECT conv_id AS document_id, turn + 1 AS page, text, CASE WHEN role = 'system' THEN 'blank' END AS warning FROM conversations"


def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    return documents.merged_pages(_view(spark, d, _PAGES, "conversations"))


_MERGED_SQL = f"SELECT document_id, string_agg('--- PAGE ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS text FROM ({_PAGES}) WHERE warning IS NULL GROUP BY 1"


def chosen_text(spark: SparkSession, d: str) -> DataFrame:
    scanned = merged_pages(spark, d).select(F.col("document_id").alias("doc_id"), F.col("text").alias("scanned"))
    rows = table(spark, d, "documents").join(scanned, "doc_id", "left")
    pick = documents.chosen_text(F.col("text"), F.col("doc_id") % 60, F.col("scanned"), F.lit(30))
    out = rows.select("doc_id", pick.alias("c"), F.lit(1).alias("pages"), (F.col("doc_id") % 100).alias("score"), F.when(F.col("doc_id") % 3 == 0, "good").otherwise("partial").alias("quality"))
    told = documents.extraction_summary(out.select("*", F.col("c.method").alias("method")), "doc_id")
    return out.select("doc_id", F.length("c.text").cast("long").alias("n"), documents.embeddable(F.col("c.text")).alias("embeddable")).join(told, "doc_id")


_CHOSEN_SQL = f"""SELECT doc_id, length(t) AS n, coalesce(regexp_replace(t, '\\s', '', 'g') <> '' AND length(t) <= 6000, false) AS embeddable, CASE WHEN scan THEN 'ocr' ELSE 'native' END AS method, 1 AS pages, CAST(doc_id % 100 AS INTEGER) AS score,
  CASE WHEN doc_id % 3 = 0 THEN 'good' ELSE 'partial' END AS quality, doc_id % 3 <> 0 AS review FROM (
  SELECT doc_id, scan, CASE WHEN scan THEN s.text ELSE d.text END AS t FROM (SELECT *, doc_id % 60 <= 30 AS low FROM documents) d LEFT JOIN ({_MERGED_SQL}) s ON s.document_id = d.doc_id, LATERAL (SELECT s.text IS NOT NULL AND low AS scan))"""

_REPLIES = """SELECT conv_id, turn, text, CASE (conv_id + turn) % 7 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN '```' || j || '```' WHEN 2 THEN ' ' || j WHEN 3 THEN 'no answer' WHEN 4 THEN '{"contractType": "lease"}' ELSE j END AS reply FROM (
  SELECT *, '{"contractType": "lease", "contractSummary": "s", "importantClauses": [{"title": "a", "evidence": "' || CASE WHEN turn % 2 = 0 THEN substr(replace(replace(text, chr(10), ' '), '"', ' '), 1, 12) ELSE 'Quoted by nobody' END || '"}, {"title": "b", "evidence": null}'
    || repeat(', {"title": "c", "evidence": "Never said"}', CAST(conv_id % 13 AS INTEGER)) || '], "missingInformation": []}' AS j FROM conversations)"""


def validated_replies(spark: SparkSession, d: str) -> DataFrame:
    return documents.validated_replies(_view(spark, d, _REPLIES, "conversations")).select("conv_id", "turn", "valid", "issues", F.size("parsed").alias("n_clauses"))


_VALID_SQL = rf"""WITH r AS (SELECT conv_id, turn, text, (conv_id + turn) % 7 AS k, CASE WHEN regexp_matches(reply, '(?is)```(?:json)?\s*(.*?)\s*```') THEN regexp_extract(reply, '(?is)```(?:json)?\s*(.*?)\s*```', 1) ELSE trim(reply) END AS b FROM ({_REPLIES})),
c AS (SELECT *, json_valid(b) AS ok, CASE WHEN json_valid(b) THEN from_json(json_extract(b, '$.importantClauses'), '[{{"title": "VARCHAR", "evidence": "VARCHAR"}}]') END AS p FROM r),
i AS (SELECT *, CASE WHEN NOT ok THEN ['- (root): is no JSON object'] WHEN p IS NULL THEN ['- contractSummary: is missing', '- importantClauses: is missing', '- missingInformation: is missing']
  ELSE list_filter(list_transform(p, lambda x, n: CASE WHEN x['evidence'] IS NOT NULL AND NOT contains(text, x['evidence']) THEN '- importantClauses.' || (n - 1) || '.evidence: not found in the text' END), lambda x: x IS NOT NULL) END AS s FROM c)
SELECT conv_id, turn, len(s) = 0 AS valid, CASE WHEN len(s) > 0 THEN array_to_string(s[1:10], chr(10)) || CASE WHEN len(s) > 10 THEN chr(10) || '...and ' || (len(s) - 10) || ' more issue(s).' ELSE '' END END AS issues, CAST(len(p) AS INTEGER) AS n_clauses FROM i"""

_NAMES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Ø¹Ù\u0082Ø¯.pdf' WHEN 1 THEN 'café.pdf' WHEN 2 THEN 'عقد.pdf' WHEN 3 THEN ' ' || p_name || ' ' WHEN 4 THEN '  ' ELSE 'bad' || chr(7) END AS name, p_type FROM part"""


def file_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _view(spark, d, _NAMES, "part").withColumn("repaired", documents.repaired_name(F.col("name")))
    return rows.select("p_partkey", "repaired", documents.safe_name(F.col("repaired"), "Document").alias("shown"))


_NAMES_SQL = f"""SELECT p_partkey, repaired, CASE WHEN trim(repaired) = '' OR contains(repaired, chr(7)) THEN 'Document' ELSE trim(repaired) END AS shown FROM (SELECT *, CASE WHEN p_partkey % 6 = 0 THEN 'عقد.pdf' ELSE name END AS repaired FROM ({_NAMES}))"""

_FIGURES = """SELECT o_orderkey, round(o_totalprice, 2) AS value, CASE WHEN o_orderkey % 4 > 0 THEN 'SAR' END AS currency, CASE o_orderkey % 3 WHEN 0 THEN 'known' WHEN 1 THEN 'estimated' ELSE 'unavailable' END AS status,
  CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 60 END AS months, CASE WHEN o_custkey % 3 = 1 THEN o_custkey % 10 END AS years, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 900 END AS days,
  CASE o_orderkey % 3 WHEN 0 THEN 'lease' WHEN 1 THEN 'auto_finance' ELSE 'other' END AS contract_type, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS descriptor, o_orderdate,
  CAST(o_custkey % 30 AS DOUBLE) / 2 AS cover, CAST(o_orderkey % 16 AS DOUBLE) / 4 AS rate FROM orders"""


def figure_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _view(spark, d, _FIGURES, "orders").select(
        "o_orderkey",
        display.money_text(c("value"), c("currency")).alias("money"),
        display.exact_money(c("value"), c("currency"), c("status")).alias("exact"),
        display.percentage_text(c("rate")).alias("rate"),
        display.duration_text(c("months"), c("years"), c("days"), "ar").alias("term"),
        display.coverage_text(c("cover")).alias("cover_en"),
        display.coverage_text(c("cover"), "ar").alias("cover_ar"),
        display.title_text(c("contract_type"), [c("descriptor")], "ar").alias("title"),
        display.report_name(c("o_orderdate"), c("o_orderkey") % 5 == 0).alias("report"),
        display.whole_days(c("cover")).alias("days"),
        display.minimum_inputs(c("value"), c("cover"), c("months").cast("double")).alias("enough"),
    )


_FLAT = r"regexp_replace(format('{:,.2f}', CAST(%s AS DOUBLE)), '\.?0+$', '')"
_FIGURE_SQL = f"""SELECT o_orderkey, {_FLAT % 'value'} || coalesce(' ' || currency, '') AS money,
  CASE WHEN status <> 'unavailable' THEN format('{{:,.2f}}', value) || coalesce(' ' || currency, '') || CASE WHEN status = 'estimated' THEN ' (estimated)' ELSE '' END END AS exact, {_FLAT % 'rate'} || '%' AS rate,
  coalesce({_FLAT % 'months'} || ' شهر', {_FLAT % 'years'} || ' سنة', {_FLAT % 'days'} || ' يوم') AS term,
  CASE WHEN n < 1 THEN 'Less than one month' WHEN n = 1 THEN 'About 1 month' ELSE 'About ' || n || ' months' END AS cover_en,
  CASE WHEN n < 1 THEN 'أقل من شهر واحد' WHEN n = 1 THEN 'حوالي شهر واحد' WHEN n = 2 THEN 'حوالي شهرين' WHEN n <= 10 THEN 'حوالي ' || n || ' أشهر' ELSE 'حوالي ' || n || ' شهراً' END AS cover_ar,
  CASE contract_type WHEN 'lease' THEN 'إيجار' WHEN 'auto_finance' THEN 'تمويل سيارة' ELSE 'عقد' END || coalesce(' — ' || trim(descriptor), '') AS title,
  'contract-summary' || CASE WHEN o_orderkey % 5 = 0 THEN '-personal' ELSE '' END || '-' || strftime(o_orderdate, '%Y-%m-%d') || '.pdf' AS report, n AS days, months IS NOT NULL AS enough
FROM (SELECT *, CAST(floor(cover + 0.5) AS BIGINT) AS n FROM ({_FIGURES}))"""


def queries() -> dict:
    return {f.__name__: f for f in (best_reading, merged_pages, chosen_text, validated_replies, file_names, figure_texts)}


def oracle_sql() -> dict[str, str]:
    return {"best_reading": _BEST_SQL, "merged_pages": _MERGED_SQL, "chosen_text": _CHOSEN_SQL, "validated_replies": _VALID_SQL, "file_names": _NAMES_SQL, "figure_texts": _FIGURE_SQL}
