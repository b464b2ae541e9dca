"""Queries over figures recovered from damaged text, with their SQL; the texts are composed by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import wordlists as L
from tallystone.operators import recovery
from tallystone.plans.concept_queries import _pick
from tallystone.plans.document_queries import _view

_LINES = (
    ("السعر النقدي: 120,000 ريال", "السعر النقدي: 0 ريال (مائة وعشرون ألف ريال)", "cash price 120000", "السعر الإجمالي: 0", ""),
    ("الدفعة الأولى: ٢٤٬٠٠٠ 24,000", "الدفعة الأولى: 0 (أربعة وعشرون ألفاً ريال)", "down payment 24000", "المقدم 9,000"),
    ("أصل التمويل: 9 6 0", "أصل التمويل: ستة وتسعون ألف ريال سعودي", "principal 96,000", "", "financed amount 50000"),
    ("نسبة الربح: 5%", "نسبة الربح: 0 (خمسة بالمائة)", "هامش التمويل ثلاثة في المئة"),
    ("إجمالي الربح 19,200", "إجمالي الربح: 0", "total profit: 1 9", ""),
    ("إجمالي المبلغ الواجب سداده: 115,200 ريال", "total payable 115200", "", "total payable (ألفان وخمسمائة)"),
    ("مدة التمويل: 4 8 شهر (أربع سنوات) (4 سنوات)", "مدة التمويل 48 شهر", "financing term 40 months (4 years)", "حتى القسط 36", "المدة 3 سنوات", "مدة التمويل: ستون شهراً"),
    ("قيمة القسط: 2,400", "القسط الشهري (ألفان وأربعمائة ريال)", "monthly installment 0", "1/1/2024 2,400 2,400 2,400", "2500 x 2500"),
)
_TEXTS = "SELECT p_partkey, " + " || chr(10) || ".join(_pick(lines, f"p_partkey * {i * 2 + 1} + p_partkey // {7 + i}") for i, lines in enumerate(_LINES)) + " AS text FROM part"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts, dealt to all cores: a file of keys is small, however much its rows make to do."""
    return _view(spark, d, _TEXTS.replace("//", "div"), "part").repartition(spark.sparkContext.defaultParallelism)


def recovered_values(spark: SparkSession, d: str) -> DataFrame:
    out = recovery.financial_integrity(recovery.recover_values(_texts(spark, d)))
    fields = [F.col(n)["value"].alias(n) for n in L.RECOVERED_FIELDS]
    return out.select("p_partkey", *fields, F.concat_ws(",", *[F.col(n)["source"] for n in L.RECOVERED_FIELDS]).alias("sources"), F.array_join("conflicts", ",").alias("conflicts"), "n_labels", "financial_score", F.round("density", 6).alias("density"))


def number_words(spark: SparkSession, d: str) -> DataFrame:
    w = recovery.number_words(F.col("text"))
    rows = _texts(spark, d).select("p_partkey", F.explode(F.split("text", "\n")).alias("text")).select("p_partkey", "text", w.alias("w"))
    return rows.groupBy("text").agg(F.count("*").alias("n"), F.max("w.value").alias("value"), F.max(F.col("w.percent").cast("int")).alias("percent"))


def _lookup_sql(x: str) -> str:
    return f"trim(replace(translate(regexp_replace({x}, '[ً-ْٰ]', '', 'g'), 'أإآئؤة', 'ااايوه'), 'ء', ''))"


def _words_sql(x: str) -> str:
    """{'v': amount or null, 'p': percentage} of an SQL expression of text."""
    known = ", ".join(f"'{w}'" for w in (*L.NUMBER_WORDS, *L.TWO_THOUSAND, *L.THOUSAND))
    values = "CASE t " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in L.NUMBER_WORDS.items()) + " END"
    tokens = rf"list_transform(string_split_regex(regexp_replace({x}, '[،,()]', ' ', 'g'), '\s+'), lambda w: {_lookup_sql('w')})"
    bare = f"list_transform({tokens}, lambda w: CASE WHEN starts_with(w, 'و') AND substr(w, 2) IN ({known}) THEN substr(w, 2) ELSE w END)"
    kind = f"CASE WHEN t IN ('{L.TWO_THOUSAND[0]}', '{L.TWO_THOUSAND[1]}') THEN 2 WHEN t IN ({', '.join(repr(w) for w in L.THOUSAND)}) THEN 1 ELSE 0 END"
    items = f"list_transform({bare}, lambda t: {{'a': 0.0::DOUBLE, 's': coalesce({values}, 0)::DOUBLE, 'h': ({values}) IS NOT NULL OR ({kind}) > 0, 'k': {kind}}})"
    fold = f"""list_reduce(list_concat([{{'a': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'h': false, 'k': 0}}], {items}), lambda c, i: {{
      'a': c['a'] + CASE i['k'] WHEN 2 THEN 2000 WHEN 1 THEN CASE WHEN c['s'] > 0 THEN c['s'] ELSE 1 END * 1000 ELSE 0 END, 's': CASE WHEN i['k'] > 0 THEN 0 ELSE c['s'] + i['s'] END, 'h': c['h'] OR i['h'], 'k': 0}})"""
    percent = " OR ".join(f"contains({_lookup_sql(x)}, '{m}')" for m in L.PERCENT_WORDS)
    return f"(SELECT CASE WHEN z['h'] THEN {{'v': z['a'] + z['s'], 'p': {percent}}} END FROM (SELECT {fold} AS z))"


_WORDS_SQL = f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS text FROM ({_TEXTS}))
SELECT text, n, w['v'] AS value, CAST(w['p'] AS INTEGER) AS percent FROM (SELECT text, n, {_words_sql('text')} AS w FROM (SELECT text, count(*) AS n FROM l GROUP BY 1))"""

_TOKENS = r"list_transform(regexp_extract_all(translate({0}, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\d[\d,]*\d|\d'), lambda t: CAST(replace(t, ',', '') AS DOUBLE))"
_FIELDS = ", ".join(f"('{n}', '{unit}', [{', '.join(repr(x) for x in labels)}])" for n, (unit, *labels) in L.RECOVERED_FIELDS.items())
_CLOSE = "abs({0} - ({1})) <= greatest(abs({0}), abs({1}), 1) * 0.02"


def _recovered_sql() -> str:
    pivot = ", ".join(f"max(v) FILTER (WHERE field = '{n}') AS {n}, max(src) FILTER (WHERE field = '{n}') AS s_{n}, bool_or(f) FILTER (WHERE field = '{n}') AS f_{n}, bool_or(st = 'ambiguous') FILTER (WHERE field = '{n}') AS a_{n}, bool_or(z) FILTER (WHERE field = '{n}') AS z_{n}" for n in L.RECOVERED_FIELDS)
    close = lambda a, b: _CLOSE.format(a, b)
    names = list(L.RECOVERED_FIELDS)
    total = lambda test: " + ".join(f"CASE WHEN f_{n} AND {test.format(n)} THEN 1 ELSE 0 END" for n in names)
    dated = r"regexp_replace(regexp_replace(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\b\d{1,2}[\/.-]\d{1,2}[\/.-]\d{4}\b', ' ', 'g'), '\b\d{4}[\/.-]\d{1,2}[\/.-]\d{1,2}\b', ' ', 'g')"
    most = "(SELECT {'value': v, 'times': n} FROM (SELECT v, count(*) AS n, min(i) AS i FROM (SELECT unnest(u) AS v, generate_subscripts(u, 1) AS i) WHERE v BETWEEN 100 AND 100000 GROUP BY v) WHERE n > 1 ORDER BY n DESC, i LIMIT 1)"
    return rf"""WITH x AS MATERIALIZED ({_TEXTS}), fl(field, unit, labels) AS (VALUES {_FIELDS}),
w AS (SELECT p_partkey, field, unit, split_part(substr(text, instr(text, lab) + length(lab), 120), chr(10), 1) AS win FROM (SELECT x.*, fl.field, fl.unit, list_filter(labels, lambda l: contains(text, l))[1] AS lab FROM x, fl)),
p AS (SELECT *, regexp_extract_all(win, '\(([^()]{{2,120}})\)', 1) AS pars, {_TOKENS.format('win')} AS d,
  CASE unit {' '.join(f"WHEN '{u}' THEN regexp_extract(win, '(?s)^(.*?(?:{e}))', 1)" for u, e in L.UNIT_ENDS.items())} END AS upto FROM w),
pw AS (SELECT p_partkey, field, list(z ORDER BY i) FILTER (WHERE z IS NOT NULL) AS z FROM (SELECT p_partkey, field, i, {_words_sql('par')} AS z FROM (SELECT p_partkey, field, unnest(pars) AS par, generate_subscripts(pars, 1) AS i FROM p)) GROUP BY 1, 2),
iw AS (SELECT p_partkey, field, {_words_sql('body')} AS z FROM (SELECT p_partkey, field, CASE WHEN upto = '' THEN win ELSE upto END AS body FROM p WHERE win IS NOT NULL)),
q AS (SELECT p.*, coalesce(CASE WHEN unit = 'percent' THEN list_filter(pw.z, lambda k: k['p'])[1] END, pw.z[1], CASE WHEN unit <> 'percent' OR iw.z['p'] THEN iw.z END)['v'] AS said FROM p LEFT JOIN pw USING (p_partkey, field) LEFT JOIN iw USING (p_partkey, field)),
r AS (SELECT p_partkey, field, win IS NOT NULL AS f, CASE WHEN said IS NOT NULL THEN said WHEN len(d) = 1 AND d[1] <> 0 THEN d[1] END AS v, CASE WHEN said IS NOT NULL THEN 'amount_words' ELSE 'ocr_digits' END AS src,
  CASE WHEN said IS NULL AND len(d) > 1 THEN 'ambiguous' END AS st, said IS NULL AND len(d) = 1 AND d[1] = 0 AS z FROM q),
a0 AS (SELECT p_partkey, {pivot} FROM r GROUP BY 1),
yy AS (SELECT p_partkey, CASE WHEN regexp_matches(inr, '(?i)سن(ة|وات)|year') THEN 12 * coalesce({_TOKENS.format('inr')}[1], {_words_sql('inr')}['v']) END AS y FROM (SELECT p_partkey, regexp_extract(win, '\(([^()]{{1,40}})\)', 1) AS inr FROM p WHERE field = 'term_months')),
tt AS (SELECT p_partkey, u, text, TRY_CAST(nullif(regexp_extract(wt, 'حتى\s*القسط\s*(\d{{1,3}})', 1), '') AS DOUBLE) AS lastp, 12 * TRY_CAST(nullif(regexp_extract(wt, '(\d{{1,2}})\s*سن(?:ة|وات)', 1), '') AS DOUBLE) AS yrs
  FROM (SELECT *, {_TOKENS.format(dated)} AS u, translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS wt FROM x)),
a1 AS (SELECT * REPLACE (coalesce(installment, m['value']) AS installment, CASE WHEN installment IS NULL AND m IS NOT NULL THEN 'installment_table' ELSE s_installment END AS s_installment,
  coalesce(y, term_months, CASE WHEN lastp > 0 THEN lastp END, CASE WHEN lastp IS NULL AND yrs > 0 THEN yrs END) AS term_months,
  CASE WHEN y IS NOT NULL AND term_months IS DISTINCT FROM y THEN 'duration_equivalence' WHEN y IS NOT NULL OR term_months IS NOT NULL THEN s_term_months WHEN lastp > 0 THEN 'installment_table' WHEN lastp IS NULL AND yrs > 0 THEN 'duration_equivalence' ELSE s_term_months END AS s_term_months),
  CASE WHEN installment <> m['value'] THEN 'installment_table' END AS n1, CASE WHEN term_months <> y THEN 'term' END AS n2
  FROM (SELECT a0.*, yy.y, tt.lastp, tt.yrs, tt.text, {most} AS m FROM a0 JOIN yy USING (p_partkey) JOIN tt USING (p_partkey))),
a2 AS (SELECT * REPLACE (coalesce(financed_amount, CASE WHEN total_payable > total_profit THEN total_payable - total_profit END) AS financed_amount,
  CASE WHEN financed_amount IS NULL AND total_payable > total_profit THEN 'arithmetic_consistency' ELSE s_financed_amount END AS s_financed_amount) FROM a1),
a3 AS (SELECT * REPLACE (CASE WHEN fix THEN cash_price - financed_amount ELSE down_payment END AS down_payment, CASE WHEN fix THEN 'arithmetic_consistency' ELSE s_down_payment END AS s_down_payment), CASE WHEN fix AND down_payment IS NOT NULL THEN 'down_payment' END AS n3
  FROM (SELECT *, coalesce(cash_price > financed_amount, false) AND NOT coalesce({close('down_payment', 'cash_price - financed_amount')}, false) AS fix FROM a2)),
a4 AS (SELECT * REPLACE (coalesce(financed_amount, cash_price - down_payment) AS financed_amount, CASE WHEN financed_amount IS NULL AND cash_price - down_payment IS NOT NULL THEN 'arithmetic_consistency' ELSE s_financed_amount END AS s_financed_amount),
  CASE WHEN NOT {close('financed_amount', 'cash_price - down_payment')} THEN 'financed_amount' END AS n4 FROM a3),
a5 AS (SELECT * REPLACE (coalesce(total_payable, financed_amount + total_profit) AS total_payable, CASE WHEN total_payable IS NULL AND financed_amount + total_profit IS NOT NULL THEN 'arithmetic_consistency' ELSE s_total_payable END AS s_total_payable),
  CASE WHEN NOT {close('total_payable', 'financed_amount + total_profit')} THEN 'total_payable' END AS n5 FROM a4),
a6 AS (SELECT * REPLACE (coalesce(total_profit, total_payable - financed_amount) AS total_profit, CASE WHEN total_profit IS NULL AND total_payable - financed_amount IS NOT NULL THEN 'arithmetic_consistency' ELSE s_total_profit END AS s_total_profit),
  CASE WHEN NOT {close('installment * term_months', 'total_payable')} THEN 'schedule' END AS n6 FROM a5),
g AS (SELECT *, {total('true')} AS n_labels, {total('{0} IS NOT NULL')} AS n_known, {total('z_{0}')} AS n_zero, {total('a_{0} AND {0} IS NULL')} AS n_broken FROM a6),
dn AS (SELECT p_partkey, count(*) FILTER (WHERE n > 1) / count(*) AS density FROM (SELECT p_partkey, t, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(regexp_extract_all(text, '\d[\d,]*\d|\d'), lambda t: replace(t, ',', ''))) AS t FROM x) GROUP BY 1, 2) GROUP BY 1)
SELECT p_partkey, {', '.join(names)}, concat_ws(',', {', '.join(f's_{n}' for n in names)}) AS sources, concat_ws(',', n1, n2, n3, n4, n5, n6) AS conflicts, CAST(n_labels AS INTEGER) AS n_labels,
  CASE WHEN n_labels > 0 THEN CAST(floor(greatest(0, 100 - (1 - n_known / n_labels) * 60 - 8 * n_zero - 8 * n_broken - 10 * ((n4 IS NOT NULL)::INT + (n5 IS NOT NULL)::INT + (n6 IS NOT NULL)::INT) - CASE WHEN n2 IS NOT NULL THEN 10 ELSE 0 END) + 0.5) AS INTEGER) END AS financial_score,
  round(coalesce(density, 0), 6) AS density FROM g LEFT JOIN dn USING (p_partkey)"""


def recovery_notes(spark: SparkSession, d: str) -> DataFrame:
    return recovery.recovery_notes(recovery.recover_values(_texts(spark, d)), "p_partkey").select("p_partkey", F.size(F.split("notes", "\n")).alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (recovered_values, number_words, recovery_notes)}


def oracle_sql() -> dict[str, str]:
    lines = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END" for n in L.RECOVERED_FIELDS)
    return {"recovered_values": _recovered_sql(), "number_words": _WORDS_SQL, "recovery_notes": f"SELECT p_partkey, CAST(CASE WHEN {lines} > 0 THEN {lines} END AS INTEGER) AS n FROM ({_recovered_sql()})"}
