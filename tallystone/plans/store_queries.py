"""Queries over stored tables that are changed and read back, with their SQL.

Each document is a session, and its lines are the session's chunks; sources are the documents' own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators import chunking
from tallystone.plans.text_queries import _line_sql
from tallystone.session import shared_dir, table
from tallystone.sources import store

_START, _NOW = "2024-01-01 00:00:00", "2024-01-01 02:00:00"


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _tables(spark: SparkSession, d: str) -> tuple[str, str]:
    """Chunks and sessions, stored anew: a session ends so many hours after the start, or never."""
    id_ = F.col("doc_id")
    ends = F.when(id_ % 7 < 6, F.lit(_START).cast("timestamp_ntz") + F.make_dt_interval(hours=(id_ % 7).cast("int")))
    docs = table(spark, d, "documents").select(id_.alias("session_id"), "text", ends.alias("expires_at"))
    lines = chunking.line_chunks(docs.withColumn("_s", F.struct("session_id", "expires_at")), "_s").select("_s.session_id", "_s.expires_at", "chunk_order", "chunk_text")
    chunks, sessions = _at(spark, "chunks"), _at(spark, "sessions")
    store.create(chunks, lines, "session_id")
    store.create(sessions, docs.select("session_id", "expires_at", F.lit(0).cast("long").alias("n_chunks")), "session_id")
    return chunks, sessions


def stored_sessions(spark: SparkSession, d: str) -> DataFrame:
    """What is stored after some sessions' chunks were replaced (by their odd ones, by none), some sessions were
    deleted and others had expired: counts as told by the session, and the chunks read back."""
    chunks, sessions = _tables(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), "text")
    replaced = docs.filter("session_id % 5 = 1")
    odd = chunking.line_chunks(replaced.filter("session_id % 10 = 1"), "session_id").filter("chunk_order % 2 = 1")
    fresh = odd.select("session_id", F.lit(None).cast("timestamp_ntz").alias("expires_at"), "chunk_order", F.concat("chunk_text", F.lit(" (amended)")).alias("chunk_text"))
    store.replace_session_chunks(chunks, sessions, fresh, replaced)
    store.delete_sessions(chunks, sessions, docs.filter("session_id % 11 = 3"))
    store.delete_expired(spark, chunks, sessions, F.lit(_NOW).cast("timestamp_ntz"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_text"))), lambda x: x["chunk_text"]), "\n")
    read = store.stored(spark, chunks, "session_id").groupBy("session_id").agg(F.count("*").alias("n_stored"), F.sha2(body, 256).alias("checksum"))
    return store.stored(spark, sessions, "session_id").select("session_id", "n_chunks").join(read, "session_id", "full_outer").na.fill(0, ["n_chunks", "n_stored"])


_LINES = _line_sql("text", "documents").replace("sha256(l[i]) AS checksum", "l[i] AS chunk_text")
_STORED_SQL = f"""WITH l AS (SELECT doc_id, chunk_order, chunk_text, doc_id % 7 < 6 AND doc_id % 7 <= 2 AS over FROM ({_LINES})),
c AS (SELECT doc_id, chunk_order, chunk_text FROM l WHERE doc_id % 5 <> 1 AND NOT over UNION ALL SELECT doc_id, chunk_order, chunk_text || ' (amended)' FROM l WHERE doc_id % 10 = 1 AND chunk_order % 2 = 1),
r AS (SELECT doc_id, count(*) AS n_stored, sha256(string_agg(chunk_text, chr(10) ORDER BY chunk_order)) AS checksum FROM c WHERE doc_id % 11 <> 3 GROUP BY 1),
s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id AND chunk_order % 2 = 1) ELSE 0 END AS n_chunks FROM documents d WHERE doc_id % 11 <> 3 AND doc_id % 7 > 2)
SELECT coalesce(s.doc_id, r.doc_id) AS session_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_stored, 0) AS n_stored, checksum FROM s FULL OUTER JOIN r ON r.doc_id = s.doc_id"""


def stored_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources after two rounds of upserts, the later one with older and newer versions, and some switched off."""
    docs = table(spark, d, "documents")
    row = lambda day, title: docs.select(F.col("doc_id").alias("source_id"), title.alias("title"), F.lit("active").alias("status"), (F.lit(_START).cast("timestamp_ntz") + F.make_dt_interval(days=day)).alias("updated_at"))
    path = _at(spark, "sources")
    store.create(path, row(F.lit(5), F.sha2("text", 256)).filter("source_id % 4 < 3"), "source_id")
    later = row((F.col("doc_id") % 3 + 4).cast("int"), F.sha2(F.upper("source"), 256)).filter("source_id % 4 > 1")
    for _ in range(2):
        store.upsert_rows(path, "source_id", later)
    store.disable_source(path, docs.filter("doc_id % 9 = 0").select(F.col("doc_id").alias("source_id")), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return store.stored(spark, path, "source_id").withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


_SOURCES_SQL = """SELECT doc_id AS source_id, CASE WHEN later THEN sha256(upper(source)) ELSE sha256(text) END AS title, CASE WHEN doc_id % 9 = 0 THEN 'repealed' ELSE 'active' END AS status,
  CASE WHEN doc_id % 9 = 0 THEN '2024-02-01' WHEN later THEN '2024-01-0' || (doc_id % 3 + 5) ELSE '2024-01-06' END AS updated_at
FROM (SELECT *, doc_id % 4 = 3 OR (doc_id % 4 = 2 AND doc_id % 3 >= 1) AS later FROM documents)"""


def queries() -> dict:
    return {f.__name__: f for f in (stored_sessions, stored_sources)}


def oracle_sql() -> dict[str, str]:
    return {"stored_sessions": _STORED_SQL, "stored_sources": _SOURCES_SQL}
