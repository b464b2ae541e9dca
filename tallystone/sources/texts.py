"""Reading a collection of texts and indexing it, source by source, and agreements, session by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.text import trimmed
from tallystone.operators import chunking, quality, sessions
from tallystone.session import written
from tallystone.sources.settings import Limits

# Which collections a type of contract is answered from, first and otherwise.
COLLECTIONS = {
    "auto_finance": (("SAMA_CONSUMER_FINANCE", "SAMA_APR"), ("CIVIL_TRANSACTIONS",)),
    "personal_finance": (("SAMA_CONSUMER_FINANCE", "SAMA_APR"), ("CIVIL_TRANSACTIONS",)),
    "credit_card": (("SAMA_CREDIT_CARD", "SAMA_APR"), ("CIVIL_TRANSACTIONS",)),
    "mortgage": (("SAMA_MORTGAGE", "SAMA_APR"), ("CIVIL_TRANSACTIONS",)),
    "lease": (("EJAR",), ("CIVIL_TRANSACTIONS",)),
    "insurance": (("INSURANCE_AUTHORITY",), ("CIVIL_TRANSACTIONS",)),
    "employment": (("LABOR_LAW",), ("CIVIL_TRANSACTIONS",)),
    "subscription": (("MOC_ECOMMERCE",), ("CIVIL_TRANSACTIONS",)),
    "other": (("CIVIL_TRANSACTIONS",), ()),
}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file under ``path``, whole, through Spark's own reader."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def source_by_id(manifest: DataFrame, source_id: str) -> DataFrame:
    """The manifest's row of a source, pushed down as a filter."""
    return manifest.filter(F.col("source_id") == source_id)


def collections_of(contracts: DataFrame) -> DataFrame:
    """``contracts`` (contract_type; more columns stay) with a row per collection: ``collection`` and
    ``preferred``. Types without an entry give no row. The lookup table is a handful of literals."""
    rows = [(kind, name, preferred) for kind, (first, rest) in COLLECTIONS.items() for preferred, names in ((True, first), (False, rest)) for name in names]
    table = contracts.sparkSession.createDataFrame(rows, "contract_type string, collection string, preferred boolean")
    return contracts.join(F.broadcast(table), "contract_type")


def ingest_collection(sources: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexes all ``sources`` (source_id, text) against ``stored`` (source_id, chunk_id, checksum).

    Returns what is to be done per chunk (source_id, chunk_id, action) and per source (source_id, status,
    reason, reused, embedded, dropped). A source whose text fails the gate, or is missing, fails alone:
    its stored chunks stay as they are.
    """
    # written, as a filter on the gate or a join would otherwise repeat the whole derivation of the texts and, once
    # their rows are dealt anew, in the few tasks that so few bytes get
    gated = written(quality.gate_legal_text(sources).select("source_id", "text", "reason", "ok"), "gated")
    chunks = chunking.chunk_legal_texts(gated.filter("ok"), "source_id")
    fresh = written(chunks.select("source_id", "chunk_id", "checksum"), "fresh")
    gate = gated.drop("text")
    old = written(stored.select("source_id", "chunk_id", "checksum"), "stored").join(gate.filter("ok").select("source_id"), "source_id", "left_semi")
    both = fresh.withColumnRenamed("checksum", "n").join(old.select("source_id", "chunk_id", F.col("checksum").alias("s")), ["source_id", "chunk_id"], "full_outer")
    actions = both.select("source_id", "chunk_id", F.when(F.col("n").isNull(), "drop").when(F.col("n") == F.col("s"), "reuse").otherwise("embed").alias("action"))
    counts = actions.groupBy("source_id").agg(*[F.count_if(F.col("action") == a).alias(name) for a, name in (("reuse", "reused"), ("embed", "embedded"), ("drop", "dropped"))])
    told = gate.join(counts, "source_id", "left").select("source_id", F.when(F.col("ok"), "done").otherwise("failed").alias("status"), "reason", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reused", "embedded", "dropped")])
    return actions, told


def collection_totals(told: DataFrame) -> DataFrame:
    """One row: sources done and failed, and chunks by what became of them."""
    return told.agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("reused", "embedded", "dropped")])


def index_sessions(agreements: DataFrame, now: Column, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Sessions and chunks of masked agreements (session_id, contract_type, masked_text; null and blank ones
    give neither): the text up to a number of characters, of its chunks the first so many, each up to a
    length. Sessions: session_id, contract_type, status, source_fingerprint, n_chunks, n_review, expires_at.
    """
    bounded = agreements.filter(trimmed(F.coalesce("masked_text", F.lit(""))) != "")
    # written, as sessions and chunks both read it, and the texts are not to be derived again for each
    bounded = written(bounded.select("session_id", "contract_type", F.substring("masked_text", 1, int(limits.max_indexed_chars)).alias("text")), "bounded")
    chunks = chunking.chunk_contracts(bounded, "session_id")
    first = chunks.filter(F.col("chunk_order") < int(limits.max_chunks)).withColumn("chunk_text", F.substring("chunk_text", 1, int(limits.max_chunk_chars)))
    first = first.withColumn("expires_at", sessions.expires_at(now, int(limits.ttl_minutes)))
    counts = first.groupBy("session_id").agg(F.count("*").alias("n_chunks"), F.count_if("needs_manual_review").alias("n_review"))
    # the fingerprint before the join, so that no text is shuffled
    told = bounded.select("session_id", "contract_type", F.sha2("text", 256).alias("source_fingerprint"))
    opened = told.join(counts, "session_id").select("session_id", "contract_type", F.lit("active").alias("status"), "source_fingerprint", "n_chunks", "n_review", sessions.expires_at(now, int(limits.ttl_minutes)).alias("expires_at"))
    return opened, first


def insert_sessions(path: str, opened: DataFrame) -> None:
    """Appends sessions to the table at ``path``; others' rows aren't read."""
    opened.write.mode("append").parquet(path)


def without_sessions(chunks: DataFrame, stored: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and sessions less those of ``gone`` (session_id): chunks are to be written first, so that no
    chunk is ever without its session."""
    ids = gone.select("session_id").distinct()
    return chunks.join(ids, "session_id", "left_anti"), stored.join(ids, "session_id", "left_anti")


def latest_sessions(stored: DataFrame) -> DataFrame:
    """One row per session where appends have left several: the one that ends last."""
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("expires_at")))
    return stored.withColumn("_n", last).filter("_n = 1").drop("_n")
