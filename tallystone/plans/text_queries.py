"""Queries over document text: masking, quality, chunks, retrieval, budgets, sessions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions import text as T
from tallystone.operators import chunking, evidence, masking, quality, retrieval, sessions
from tallystone.session import table

QUESTION = "Which of the fees that are due at signing does Article 9 name, and was the estimate for it with them?"
NOW = "2024-01-15 00:00:00"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_WORDS = rf"list_filter(string_split_regex(regexp_replace(lower({{0}}), '[^\p{{{{L}}}}\p{{{{N}}}}\s]', ' ', 'g'), '\s+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def pii_mask_documents(spark: SparkSession, d: str) -> DataFrame:
    return masking.mask_pii(_docs(spark, d)).select("doc_id", "masked_text", *[F.col(c).cast("long").alias(c) for c in masking.CATEGORIES])


def pii_category_counts(spark: SparkSession, d: str) -> DataFrame:
    masked = masking.mask_pii(table(spark, d, "conversations"))
    return masked.groupBy("role").agg(*[F.sum(c).alias(c) for c in masking.CATEGORIES])


_LABELLED = """SELECT conv_id, turn, text || CASE (conv_id + turn) % 6 WHEN 0 THEN ' commercial registration 1010456789' WHEN 1 THEN ' national id: 1098765432' WHEN 2 THEN ' 1098765432 cr.'
  WHEN 3 THEN ' السجل التجاري 1010456789 ثم رقم الهوية 1098765432' WHEN 4 THEN ' iqama 2098765432' ELSE ' cr was asked, then national id 1098765432' END AS text FROM conversations"""


def labelled_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Ten-digit numbers beside labels of companies and persons in both languages, told apart by the nearest."""
    rows = spark.sql(_LABELLED.replace("FROM conversations", "FROM {t}"), t=table(spark, d, "conversations"))
    return masking.mask_pii(rows).select("conv_id", "turn", "commercial_registrations", "national_ids", "iqama_numbers", F.regexp_extract("masked_text", r"(\[COMMERCIAL_REGISTRATION\]|\[NATIONAL_ID\]|\[IQAMA\])[^\[]*$", 1).alias("last"))


_LABELLED_SQL = """SELECT conv_id, turn, CAST(k IN (0, 2, 3) AS INTEGER) AS commercial_registrations, CAST(k IN (1, 3, 5) AS INTEGER) AS national_ids, CAST(k = 4 AS INTEGER) AS iqama_numbers,
  CASE WHEN k IN (0, 2) THEN '[COMMERCIAL_REGISTRATION]' WHEN k = 4 THEN '[IQAMA]' ELSE '[NATIONAL_ID]' END AS last FROM (SELECT conv_id, turn, (conv_id + turn) % 6 AS k FROM conversations)"""

# The patterns of masking, in order.
_STEPS = [
    ("ibans", r"(?i)\bSA\d{2}[0-9A-Z]{20}\b", "[IBAN]"),
    ("national_ids", r"\b1\d{9}\b", "[NATIONAL_ID]"),
    ("iqama_numbers", r"\b2\d{9}\b", "[IQAMA]"),
    ("phones", r"(?:\+966|00966|0)[\s\x{00A0}-]?5\d[\s\x{00A0}-]?\d{3}[\s\x{00A0}-]?\d{4}|\b5\d[\s\x{00A0}-]?\d{3}[\s\x{00A0}-]?\d{4}\b", "[PHONE]"),
    ("emails", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    ("bank_accounts", r"\b\d{10,24}\b", "[BANK_ACCOUNT]"),
]


def _masked_sql(source: str, keep: str) -> str:
    sql, columns = f"SELECT {keep}, text AS x FROM {source}", ""
    for name, pattern, mark in _STEPS:
        sql = f"SELECT {keep}{columns}, CAST(len(regexp_extract_all(x, '{pattern}')) AS BIGINT) AS {name}, regexp_replace(x, '{pattern}', '{mark}', 'g') AS x FROM ({sql})"
        columns += f", {name}"
    return f"SELECT {keep}, x AS masked_text{columns}, CAST(0 AS BIGINT) AS commercial_registrations FROM ({sql})"


def text_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_text_quality(_docs(spark, d)).select("doc_id", "readable_ratio", "suspicious_ratio", "token_ratio", "general_score", "quality", "should_use_ocr")


_QUALITY_SQL = r"""
WITH b AS (SELECT doc_id, text, regexp_replace(text, '\s', '', 'g') AS x FROM documents),
c AS (SELECT doc_id, text, x, length(x) AS n, regexp_replace(x, '[A-Za-z0-9.,;:!?()\-–—/\\''"«»%$&@#+*=؀-ۿ]', '', 'g') AS odd,
        list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS tok FROM b),
r AS (SELECT doc_id, n, length(text) AS per_page, round((n - length(odd)) / n, 6) AS readable, round(length(regexp_replace(odd, '[^ÙØÃÂ]', '', 'g')) / n, 6) AS moji,
        round(greatest(0, length(regexp_replace(odd, '[\x00-\x1F\x7F\x{80}-\x{9F}�]', '', 'g')) / n), 6) AS suspicious,
        round(length(regexp_replace(odd, '[^�]', '', 'g')) / n, 6) AS repl,
        round(coalesce(list_max(list_transform(list_distinct(string_split(odd, '')), lambda ch: CASE WHEN ch = '' THEN 0 ELSE length(odd) - length(replace(odd, ch, '')) END)), 0) / n, 6) AS sym,
        round(len(list_filter(tok, lambda t: regexp_matches(t, '^[\p{L}\p{N}.,%\-/]+$'))) / len(tok), 6) AS toks FROM c),
s AS (SELECT *, CASE WHEN n >= 20 THEN CAST(floor(round((
    least(1, greatest(0, (per_page - 40) / 160)) + least(1, greatest(0, (readable - 0.55) / (0.85 - 0.55))) + least(1, greatest(0, (suspicious - 0.25) / (0.08 - 0.25)))
    + least(1, greatest(0, (moji - 0.015) / (0.004 - 0.015))) + least(1, greatest(0, (repl - 0.01) / (0.001 - 0.01))) + least(1, greatest(0, (sym - 0.2) / (0.1 - 0.2)))
    + least(1, greatest(0, (toks - 0.35) / (0.6 - 0.35)))) / 7 * 100, 6) + 0.5) AS INTEGER) ELSE 0 END AS score FROM r),
q AS (SELECT *, CASE WHEN n < 20 OR moji >= 0.015 OR repl >= 0.01 THEN 'poor' WHEN score >= 75 THEN 'good' WHEN score >= 40 THEN 'partial' ELSE 'poor' END AS quality FROM s)
SELECT doc_id, CASE WHEN n >= 20 THEN readable ELSE 0.0 END AS readable_ratio, CASE WHEN n >= 20 THEN suspicious ELSE 0.0 END AS suspicious_ratio, CASE WHEN n >= 20 THEN toks ELSE 0.0 END AS token_ratio,
  score AS general_score, quality, quality = 'poor' OR (quality = 'partial' AND score < 60) AS should_use_ocr FROM q
"""


def legal_text_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate_legal_text(_docs(spark, d)).select("doc_id", "ok", "reason")


_GATE_SQL = r"""
WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents),
r AS (SELECT doc_id, CASE WHEN length(x) < 40 THEN 'too_short' WHEN len(regexp_extract_all(x, '�')) / length(x) > 0.001 THEN 'replacement_characters'
        WHEN len(regexp_extract_all(x, '[\p{L}\p{N}\p{P}\s]')) / length(x) < 0.85 THEN 'low_printable_ratio' END AS reason FROM b)
SELECT doc_id, reason IS NULL AS ok, reason FROM r
"""


def line_chunks_with_checksum(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(_docs(spark, d), "doc_id").select("doc_id", "chunk_id", F.col("chunk_order").cast("long").alias("chunk_order"), "checksum")


def _line_sql(text: str, source: str) -> str:
    return rf"""SELECT doc_id, doc_id || '::p' || (i - 1) || '::' || (i - 1) AS chunk_id, CAST(i - 1 AS BIGINT) AS chunk_order, sha256(l[i]) AS checksum
      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20) AS l FROM {source}))"""


def incremental_ingest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    changed = docs.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" amended"))).otherwise(F.col("text")))
    return chunking.diff_chunks(chunking.line_chunks(changed, "doc_id"), chunking.line_chunks(docs, "doc_id"))


_DIFF_SQL = f"""
WITH o AS ({_line_sql("text", "documents")}), n AS ({_line_sql("CASE WHEN doc_id % 7 = 0 THEN text || ' amended' ELSE text END", "(SELECT * FROM documents WHERE doc_id % 11 <> 0)")})
SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, CASE WHEN n.chunk_id IS NULL THEN 'drop' WHEN n.checksum = o.checksum THEN 'reuse' ELSE 'embed' END AS action FROM n FULL JOIN o ON n.chunk_id = o.chunk_id
"""


def content_word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("doc_id", T.content_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.legal_keyword_score(F.col("text"), F.when(F.col("doc_id") % 10 == 9, "article 9"), F.col("source"), F.lit(QUESTION)).cast("long").alias("score"))


_Q = QUESTION.replace("'", "''")
_KEYWORD_SQL = f"CASE WHEN doc_id % 10 = 9 THEN 10 ELSE 0 END + len(list_filter({_WORDS.format(repr(_Q))}, lambda t: list_contains({_WORDS.format('h')}, t)))"


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("doc_id", F.explode(T.content_words(F.col("text"))).alias("t"))
    counts = words.groupBy("doc_id", T.hash_bucket(F.col("t"), 64).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return counts.select("doc_id", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


_EMBEDDING_SQL = f"""
WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS t FROM documents),
c AS (SELECT doc_id, CAST(('0x' || substr(sha256(t), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c
"""


def _query_vector(spark: SparkSession, d: str):
    row = table(spark, d, "embeddings").filter("vec_id = 0").first()
    return F.array(*[F.lit(float(x)) for x in row["embedding"]])


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_top(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id").select("vec_id", "label", F.round("distance", 5).alias("distance"))


def scoped_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_top(table(spark, d, "embeddings").filter("label = 3"), _query_vector(spark, d), 10, "vec_id").select("vec_id", "label", F.round("distance", 5).alias("distance"))


_DISTANCE = "1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def hybrid_contract_search(spark: SparkSession, d: str) -> DataFrame:
    chunks = _docs(spark, d).filter("source = 'src0'").join(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    words = T.contract_keyword_score(F.col("text"), F.lit(None).cast("string"), F.lit(QUESTION))
    return retrieval.search_contract(chunks, _query_vector(spark, d), words, ties="doc_id").select("doc_id", F.round("score", 5).alias("score"), "excerpt")


_CLAUSE_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2)"
_CONTRACT_SEARCH_SQL = f"""
WITH c AS (SELECT d.doc_id, d.text, {_DISTANCE} AS dist FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.source = 'src0'),
v AS (SELECT *, row_number() OVER (ORDER BY dist, doc_id) AS n FROM c),
s AS (SELECT doc_id, text, (CASE WHEN n <= 40 AND dist IS NOT NULL THEN 1 - dist ELSE 0 END) * 0.65 + least(len(list_filter({_CLAUSE_WORDS.format(repr(_Q))}, lambda t: list_contains({_CLAUSE_WORDS.format('text')}, t))) * 0.05, 1.0) * 0.35 AS score FROM v),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM s WHERE score >= 0.12),
b AS (SELECT *, 6000 - coalesce(sum(least(length(text), 600)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r WHERE k <= 10)
SELECT doc_id, round(score, 5) AS score, substr(text, 1, CAST(least(600, room) AS BIGINT)) AS excerpt FROM b WHERE room > 0
"""


def hybrid_legal_search(spark: SparkSession, d: str) -> DataFrame:
    chunks = _docs(spark, d).join(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").withColumn("article", F.when(F.col("doc_id") % 10 == 9, "article 9"))
    words = T.legal_keyword_score(F.col("text"), F.col("article"), F.col("source"), F.lit(QUESTION))
    exact = F.lower("article") == F.lower(T.queried_article(F.lit(QUESTION)))
    hits = retrieval.search_legal(chunks, F.col("source").isin("src1", "src2"), F.col("source").isin("src3"), _query_vector(spark, d), words, exact, ties="doc_id")
    return hits.select("doc_id", "score", "excerpt")


_LEGAL_SEARCH_SQL = f"""
WITH c AS (SELECT d.doc_id, d.source, d.text, {_DISTANCE} AS dist, {_KEYWORD_SQL} AS kw FROM (SELECT *, text || ' ' || CASE WHEN doc_id % 10 = 9 THEN 'article 9' ELSE '' END || ' ' || source AS h FROM documents) d
        LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.source IN ('src1', 'src2', 'src3')),
p AS (SELECT *, source <> 'src3' AS pref FROM c),
v AS (SELECT *, row_number() OVER (PARTITION BY pref ORDER BY dist, doc_id) AS vn, row_number() OVER (PARTITION BY pref ORDER BY kw DESC, doc_id) AS kn FROM p),
h AS (SELECT *, (CASE WHEN vn <= 15 AND dist IS NOT NULL THEN 1 - dist ELSE 0 END) + (CASE WHEN kn <= 15 AND kw > 0 THEN kw ELSE 0 END) * 0.05 AS raw FROM v WHERE (vn <= 15 AND dist IS NOT NULL) OR (kn <= 15 AND kw > 0)),
f AS (SELECT *, raw + CASE WHEN pref THEN 0.05 ELSE 0 END AS score FROM h WHERE raw >= 0.12),
u AS (SELECT * FROM f WHERE pref OR NOT (SELECT bool_or(pref) FROM f)),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id % 10 = 9 DESC, score DESC, doc_id) AS k FROM u),
b AS (SELECT *, sum(least(length(text), 600)) OVER (ORDER BY k) AS total FROM r WHERE k <= 5)
SELECT doc_id, round(score, 3) AS score, substr(text, 1, 600) AS excerpt FROM b WHERE k = 1 OR total <= 6000
"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, longest first, without those of lengths that come after the budget is spent."""
    size = F.least(F.length("text"), F.lit(retrieval.EXCERPT_CHARS))
    longer = Window.partitionBy("source").orderBy(F.desc("n_chars")).rowsBetween(Window.unboundedPreceding, -1)
    slices = _docs(spark, d).groupBy("source", "n_chars").agg(F.sum(size).alias("size")).withColumn("before", F.coalesce(F.sum("size").over(longer), F.lit(0)))
    open_ = slices.filter(F.col("before") <= retrieval.CONTEXT_CHARS).select(F.col("source").alias("_source"), F.col("n_chars").alias("_n_chars"))
    # at most a length for each character of the budget and source
    docs = _docs(spark, d).join(F.broadcast(open_), F.col("source").eqNullSafe(F.col("_source")) & F.col("n_chars").eqNullSafe(F.col("_n_chars")), "left_semi")
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))


_RANKED_SQL = "(SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.excerpts(_ranked(spark, d), [F.col("rank")], ["source"]).select("source", "doc_id", "excerpt")


def context_bound(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bounded(_ranked(spark, d), [F.col("rank")], ["source"]).select("source", "doc_id")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    relevance = (F.col("doc_id") * 37 % 101) / 100
    return _docs(spark, d).select("source", F.col("lang").alias("pool"), "doc_id", "text", F.substring("text", 1, 600).alias("excerpt"), F.least(relevance, F.lit(1.0)).alias("relevance"))


def token_budget_trim(spark: SparkSession, d: str) -> DataFrame:
    return evidence.trim_to_budget(_evidence(spark, d).drop("text"), ["source"], ordinal="doc_id").select("source", "doc_id", "tokens")


_TRIM_SQL = """
WITH e AS (SELECT source, doc_id, least((doc_id * 37 % 101) / 100, 1.0) AS rel, CAST(ceil(length(substr(text, 1, 600)) / 4) AS BIGINT) + 20 AS tokens FROM documents),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY source) + 50 AS total, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY rel, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
        row_number() OVER (PARTITION BY source ORDER BY rel, doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM e)
SELECT source, doc_id, tokens FROM w WHERE total - gone <= 4000 OR n = c
"""


def dedupe_and_rank(spark: SparkSession, d: str) -> DataFrame:
    items = _evidence(spark, d).withColumn("key", F.sha2("text", 256))
    return evidence.dedupe_and_rank(items, ["source", "pool"], "key", 6, ordinal="doc_id").select("source", "pool", "key", "doc_id")


_DEDUPE_SQL = """
WITH e AS (SELECT source, lang AS pool, sha256(text) AS key, doc_id, least((doc_id * 37 % 101) / 100, 1.0) AS rel FROM documents),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source, pool, key ORDER BY rel DESC, doc_id) = 1)
SELECT source, pool, key, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY source, pool ORDER BY rel DESC, doc_id) <= 6
"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last")).select("session_id", sessions.expires_at(F.col("last") - F.expr("make_dt_interval(session_id % 20)")).alias("expires_at"), F.when(F.col("session_id") % 9 == 0, "deleted").otherwise("active").alias("status"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", sessions.expires_at(F.col("ts")).alias("expires_at"))


_SESSIONS_SQL = "(SELECT user_id AS session_id, max(ts) - to_days(CAST(user_id % 20 AS INTEGER)) + INTERVAL 120 MINUTE AS expires_at, CASE WHEN user_id % 9 = 0 THEN 'deleted' ELSE 'active' END AS status FROM events GROUP BY user_id)"
def _now():
    return F.lit(NOW).cast("timestamp_ntz")



def ttl_active_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.active_sessions(_sessions(spark, d), _now()).select("session_id")


def session_isolation(spark: SparkSession, d: str) -> DataFrame:
    return sessions.chunks_of_active(_chunks(spark, d), _sessions(spark, d), _now()).groupBy("session_id").agg(F.count("*").alias("n_chunks"))


def ttl_cleanup_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.cleanup_counts(_sessions(spark, d), _chunks(spark, d), _now())


def citation_semijoin(spark: SparkSession, d: str) -> DataFrame:
    """Turns cite items of the benchmark; an answer may cite those that its turns from the second were given."""
    n = table(spark, d, "benchmark").count()
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("answer"), F.col("turn").alias("ordinal"))
    cited = turns.withColumn("item_id", (F.col("answer") * 7 + F.col("ordinal") % 3) % n)
    allowed = turns.filter("ordinal > 0").withColumn("item_id", (F.col("answer") * 7 + F.col("ordinal") % 2) % n)
    return evidence.allowed_citations(cited, allowed, ["item_id"], ["answer"]).select("answer", "item_id", "ordinal")


_SEMI_SQL = """
WITH n AS (SELECT count(*) AS n FROM benchmark),
a AS (SELECT DISTINCT conv_id AS answer, (conv_id * 7 + turn % 2) % n AS item_id FROM conversations, n WHERE turn > 0)
SELECT conv_id AS answer, (conv_id * 7 + turn % 3) % n AS item_id, min(turn) AS ordinal FROM conversations, n WHERE (conv_id, (conv_id * 7 + turn % 3) % n) IN (SELECT answer, item_id FROM a) GROUP BY 1, 2
"""


def citation_anti(spark: SparkSession, d: str) -> DataFrame:
    cited = _docs(spark, d).select("doc_id")
    return evidence.unknown_citations(cited, table(spark, d, "labels").select("doc_id"), ["doc_id"])


def evidence_status_confidence(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"), F.count_if(F.col("role") == "system").alias("s"))
    status = evidence.evidence_status(F.col("a"), F.lit(0), F.lit(0), F.col("s"))
    return per.select("conv_id", status.alias("status"), evidence.answer_confidence(F.lit("contract"), status, F.col("u") - 1, F.lit(0)).alias("confidence"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            pii_mask_documents, pii_category_counts, labelled_numbers, text_quality_score, legal_text_gate, line_chunks_with_checksum, incremental_ingest_diff,
            content_word_counts, keyword_score, hash_embedding, vector_topk, scoped_vector_topk, hybrid_contract_search, hybrid_legal_search,
            excerpt_budget, context_bound, token_budget_trim, dedupe_and_rank, ttl_active_sessions, session_isolation, ttl_cleanup_counts,
            citation_semijoin, citation_anti, evidence_status_confidence,
        )
    }


def oracle_sql() -> dict[str, str]:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in masking.CATEGORIES)
    top = f"SELECT vec_id, label, round({_DISTANCE}, 5) AS distance FROM embeddings {{0}} ORDER BY {_DISTANCE}, vec_id LIMIT 10"
    return {
        "pii_mask_documents": _masked_sql("documents", "doc_id"),
        "pii_category_counts": f"SELECT role, {sums} FROM ({_masked_sql('conversations', 'role')}) GROUP BY role",
        "labelled_numbers": _LABELLED_SQL,
        "text_quality_score": _QUALITY_SQL,
        "legal_text_gate": _GATE_SQL,
        "line_chunks_with_checksum": _line_sql("text", "documents"),
        "incremental_ingest_diff": _DIFF_SQL,
        "content_word_counts": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)",
        "keyword_score": f"SELECT doc_id, CAST({_KEYWORD_SQL} AS BIGINT) AS score FROM (SELECT *, text || ' ' || CASE WHEN doc_id % 10 = 9 THEN 'article 9' ELSE '' END || ' ' || source AS h FROM documents)",
        "hash_embedding": _EMBEDDING_SQL,
        "vector_topk": top.format(""),
        "scoped_vector_topk": top.format("WHERE label = 3"),
        "hybrid_contract_search": _CONTRACT_SEARCH_SQL,
        "hybrid_legal_search": _LEGAL_SEARCH_SQL,
        "excerpt_budget": f"SELECT source, doc_id, substr(text, 1, CAST(least(600, room) AS BIGINT)) AS excerpt FROM (SELECT *, 6000 - coalesce(sum(least(length(text), 600)) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM {_RANKED_SQL}) WHERE room > 0",
        "context_bound": f"SELECT source, doc_id FROM (SELECT *, sum(least(length(text), 600)) OVER (PARTITION BY source ORDER BY rank) AS total FROM {_RANKED_SQL}) WHERE rank = 1 OR total <= 6000",
        "token_budget_trim": _TRIM_SQL,
        "dedupe_and_rank": _DEDUPE_SQL,
        "ttl_active_sessions": f"SELECT session_id FROM {_SESSIONS_SQL} WHERE status = 'active' AND expires_at > TIMESTAMP '{NOW}'",
        "session_isolation": f"SELECT user_id AS session_id, count(*) AS n_chunks FROM events WHERE user_id IN (SELECT session_id FROM {_SESSIONS_SQL} WHERE status = 'active' AND expires_at > TIMESTAMP '{NOW}') GROUP BY 1",
        "ttl_cleanup_counts": f"SELECT (SELECT count(*) FROM {_SESSIONS_SQL} WHERE expires_at <= TIMESTAMP '{NOW}') AS deleted_sessions, (SELECT count(*) FROM events WHERE ts + INTERVAL 120 MINUTE <= TIMESTAMP '{NOW}') AS deleted_chunks",
        "citation_semijoin": _SEMI_SQL,
        "citation_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "evidence_status_confidence": "SELECT conv_id, status, CASE status WHEN 'none' THEN 'low' WHEN 'partial' THEN 'medium' ELSE CASE WHEN u > 1 THEN 'high' ELSE 'medium' END END AS confidence FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS u, CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'none' WHEN count(*) FILTER (WHERE role = 'system') > 0 THEN 'partial' ELSE 'sufficient' END AS status FROM conversations GROUP BY conv_id)",
    }
