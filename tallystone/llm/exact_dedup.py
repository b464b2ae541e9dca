"""Exact duplicates by digest, with full content compared and hot groups salted."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.sized import BROADCAST_ROWS
from tallystone.session import table, written

SALTS = 32


def normalised(text: Column) -> Column:
    """Lower case for A to Z only; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def exact_duplicates(docs: DataFrame, salts: int = SALTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The group and the survivor of each row of ``docs`` (doc_id, text; further columns ignored).

    Three combining steps compare full content: rows of a task that are equal become one before
    anything is shuffled (a task has one salt, so this is the partial aggregation), what is left of a
    digest and salt is merged, and the winners of the salts are merged by digest. A group of a third of
    all rows is a row per task after the first step and a row per salt after the second.

    Texts whose digest occurs once need no comparing: a list of the other digests, counted beforehand,
    keeps them out of the shuffle while it has at most ``broadcast_rows`` rows. A longer list is joined
    to the salts' winners, so all texts are shuffled once by digest and salt, and the winners by digest.

    Of equal texts the largest doc_id stays (null ids lose to any other). Contents that share a
    digest stay apart; rows are led back to their group by sha256 and xxhash64 of the content.
    Repeated rows count as members of the group; an empty table gives an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row.
    """
    text = normalised(F.col("text"))
    listed = written(docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("content")), "exact-digests")
    again = written(listed.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "exact-again")
    few = again.limit(broadcast_rows + 1).count() <= broadcast_rows

    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("salt", F.spark_partition_id() % salts)
    if few:
        rows = rows.join(F.broadcast(again), "digest", "left_semi")
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    if not few:
        salted = salted.join(again, "digest", "left_semi")
    groups = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # written, so that the join below has a side of its own and Spark can split a common digest
    winners = written(groups.select("digest", F.xxhash64("text").alias("content"), "keep_id", "group_size"), "exact-winners")

    group_size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return listed.join(winners, ["digest", "content"], "left").select(
        "doc_id", keep_id.alias("keep_id"), group_size.alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, CAST(count(*) OVER (PARTITION BY x) AS BIGINT) AS group_size, sha256(x) AS text_sha256 FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
