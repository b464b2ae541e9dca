"""Sessions that isolate chunks and expire, and tables of sources that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Minutes to live, and the form of an id.
TTL_MINUTES = 120
SESSION_ID = r"^[A-Za-z0-9_-]{32,64}$"


def expires_at(created: Column, minutes: int = TTL_MINUTES) -> Column:
    return created + F.expr(f"INTERVAL {minutes} MINUTES")


def is_session_id(session_id: Column) -> Column:
    return F.coalesce(session_id.rlike(SESSION_ID), F.lit(False))


def active_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions with status 'active' that end after ``now``; one that ends at ``now`` is over."""
    return sessions.filter((F.col("status") == "active") & (F.col("expires_at") > now))


def chunks_of_active(chunks: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    return chunks.join(active_sessions(sessions, now), "session_id", "left_semi")


def drop_expired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(~F.coalesce(F.col("expires_at") <= now, F.lit(False)))


def cleanup_counts(sessions: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """deleted_sessions, deleted_chunks: rows at or past their end."""
    over = F.col("expires_at") <= now
    s = sessions.agg(F.count_if(over).alias("deleted_sessions"))
    c = chunks.agg(F.count_if(over).alias("deleted_chunks"))
    return s.withColumn("k", F.lit(0)).join(c.withColumn("k", F.lit(0)), "k").drop("k")


def replace_group(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``stored`` with all rows of the groups that ``fresh`` has exchanged for it (write by dynamic partition overwrite)."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert(stored: DataFrame, fresh: DataFrame, key: str, version: str = "updated_at") -> DataFrame:
    """One row per key: the newest; of equally new ones that of ``fresh``."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_n", newest).filter("_n = 1").drop("_n", "_new")


def disable_source(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.withColumn("status", F.when(F.col("source_id") == source_id, "repealed").otherwise(F.col("status")))


def stored_fingerprints(chunks: DataFrame, source_id: str) -> DataFrame:
    """chunk_id, checksum, embedding of a source's embedded chunks; nothing else is read."""
    return chunks.filter((F.col("source_id") == source_id) & F.col("embedding").isNotNull()).select("chunk_id", "checksum", "embedding")


def manifest_violations(manifest: DataFrame, hosts: list[str]) -> DataFrame:
    """source_id, violation: repeated ids, missing titles, and addresses off the official hosts."""
    manifest = manifest.select("source_id", "document_title", "official_source_url", F.count("*").over(Window.partitionBy("source_id")).alias("_n"))
    host = F.lower(F.try_parse_url(F.col("official_source_url"), F.lit("HOST")))
    official = F.lit(False)
    for h in hosts:
        official |= (host == h) | F.endswith(host, F.lit("." + h))
    found = F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate_id"), F.when(F.coalesce(F.trim("document_title"), F.lit("")) == "", "missing_title"), F.when(~F.coalesce(official, F.lit(False)), "unofficial_url")))
    return manifest.select("source_id", F.explode(found).alias("violation")).distinct()
