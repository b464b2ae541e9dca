"""Queries over collections of texts and indexed agreements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.plans.concept_queries import _TYPES, _pick
from tallystone.session import table, written
from tallystone.sources import texts
from tallystone.sources.settings import Limits

_LIMITS = Limits(max_indexed_chars=3000, max_chunks=3, max_chunk_chars=1500)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a source with three articles; every ninth is too short, every 13th is missing."""
    cut = lambda k: F.concat(F.lit(f"\nArticle {k}: Title {k}\n"), F.substring(F.regexp_replace("text", r"[^A-Za-z]+", " "), 40 * k + 1, 40))
    body = F.concat(F.lit("Chapter One"), cut(1), cut(2), cut(3))
    id_ = F.col("doc_id")
    return table(spark, d, "documents").select(id_.alias("source_id"), F.when(id_ % 9 == 0, "short").when(id_ % 13 != 0, body).alias("text"))


def _stored(sources: DataFrame) -> DataFrame:
    return texts.chunking.chunk_legal_texts(sources.filter("source_id % 4 < 3").withColumn("text", F.when(F.col("source_id") % 4 == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))), "source_id")


def collection_ingest(spark: SparkSession, d: str) -> DataFrame:
    sources = written(_sources(spark, d), "sources")
    return texts.ingest_collection(sources, _stored(sources))[1]


def collection_ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    return texts.collection_totals(collection_ingest(spark, d))


_INGEST_SQL = """WITH s AS (SELECT doc_id, doc_id % 9 = 0 OR doc_id % 13 = 0 AS bad, doc_id % 4 AS k FROM documents)
SELECT doc_id AS source_id, CASE WHEN bad THEN 'failed' ELSE 'done' END AS status, CASE WHEN bad THEN 'too_short' END AS reason, CAST(CASE WHEN bad OR k = 3 THEN 0 WHEN k = 1 THEN 2 ELSE 3 END AS BIGINT) AS reused, CAST(CASE WHEN bad THEN 0 WHEN k = 3 THEN 3 WHEN k = 1 THEN 1 ELSE 0 END AS BIGINT) AS embedded, CAST(0 AS BIGINT) AS dropped FROM s"""


def contract_collections(spark: SparkSession, d: str) -> DataFrame:
    contracts = spark.sql(f"SELECT o_orderkey, {_pick((*_TYPES, 'unheard of'), 'o_orderkey')} AS contract_type FROM {{orders}}", orders=table(spark, d, "orders"))
    return texts.collections_of(contracts).groupBy("contract_type", "collection", "preferred").agg(F.count("*").alias("n"))


_COLLECTIONS = ", ".join(f"('{kind}', '{name}', {str(p).lower()})" for kind, (first, rest) in texts.COLLECTIONS.items() for p, names in ((True, first), (False, rest)) for name in names)
_COLLECTION_SQL = f"""SELECT contract_type, collection, preferred, count(*) AS n FROM (SELECT {_pick((*_TYPES, 'unheard of'), 'o_orderkey')} AS contract_type FROM orders) JOIN (VALUES {_COLLECTIONS}) v(contract_type, collection, preferred) USING (contract_type) GROUP BY 1, 2, 3"""


def indexed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Agreements of plain paragraphs, indexed under small limits so that each of them is met."""
    paragraph = F.concat(F.regexp_replace(F.substring("text", 1, 1600), r"[^A-Za-z]+", ""), F.lit("abcdefghijklmnopqrstuvwxyz"))
    id_ = F.col("doc_id")
    rows = table(spark, d, "documents").select(id_.alias("session_id"), F.lit("lease").alias("contract_type"), F.when(id_ % 10 == 0, "  ").otherwise(F.array_join(F.array_repeat(paragraph, (id_ % 6 + 1).cast("int")), "\n\n")).alias("masked_text"))
    opened, chunks = texts.index_sessions(rows, F.lit("2024-01-01").cast("timestamp_ntz"), _LIMITS)
    sizes = chunks.groupBy("session_id").agg(F.sum(F.length("chunk_text")).alias("n_chars"))
    return opened.join(sizes, "session_id").select("session_id", "n_chunks", "n_chars", "source_fingerprint", F.date_format("expires_at", "yyyy-MM-dd HH:mm").alias("expires_at"))


_INDEXED_SQL = """WITH p AS (SELECT doc_id, regexp_replace(substr(text, 1, 1600), '[^A-Za-z]+', '', 'g') || 'abcdefghijklmnopqrstuvwxyz' AS p, doc_id % 6 + 1 AS k FROM documents WHERE doc_id % 10 <> 0),
t AS (SELECT doc_id, substr(repeat(p || chr(10) || chr(10), CAST(k - 1 AS INTEGER)) || p, 1, 3000) AS t FROM p),
c AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\n{2,}'), lambda x: trim(x)), lambda x: length(x) >= 20) AS c FROM t)
SELECT doc_id AS session_id, CAST(least(len(c), 3) AS BIGINT) AS n_chunks, CAST(list_sum(list_transform(c[1:3], lambda x: least(length(x), 1500))) AS BIGINT) AS n_chars, sha256(t) AS source_fingerprint, '2024-01-01 02:00' AS expires_at FROM c"""


def queries() -> dict:
    return {f.__name__: f for f in (collection_ingest, collection_ingest_totals, contract_collections, indexed_sessions)}


def oracle_sql() -> dict[str, str]:
    totals = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("reused", "embedded", "dropped"))
    return {
        "collection_ingest": _INGEST_SQL,
        "collection_ingest_totals": f"SELECT count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, {totals} FROM ({_INGEST_SQL})",
        "contract_collections": _COLLECTION_SQL,
        "indexed_sessions": _INDEXED_SQL,
    }
