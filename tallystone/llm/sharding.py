"""Contiguous shards of equal bytes, from prefix sums over a globally sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.session import table, written

SHARDS = 8
#: A cut moves to the nearest edge of the group of equal texts that it falls into, if that is no further
#: than this share of a shard.
SLACK = 0.01


def _cuts(ranked: DataFrame, total: int, shards: int, slack: float) -> list[int]:
    """Places among all bytes at which the shards after the first begin: edges of rows next to equal
    targets. The driver sees a row and a group per cut."""
    targets = [total * k // shards for k in range(1, shards)]
    if not total or not targets:
        return []
    start = F.col("end") - F.col("size")
    hit = F.filter(F.array(*map(F.lit, targets)), lambda t: (t >= start) & (t < F.col("end")))
    rows = ranked.withColumn("target", F.explode(hit)).select("target", "text_crc32", "digest", start.alias("start"), "end").collect()
    same = F.col("digest").isin(sorted({r["digest"] for r in rows}))
    edges = {(r["text_crc32"], r["digest"]): (r["first"], r["last"]) for r in ranked.filter(same).groupBy("text_crc32", "digest").agg(F.min(start).alias("first"), F.max("end").alias("last")).collect()}
    cuts = []
    for r in sorted(rows, key=lambda r: r["target"]):
        nearest = lambda edges, t=r["target"]: min(edges, key=lambda e: (abs(e - t), e))
        edge = nearest(edges[r["text_crc32"], r["digest"]])
        cuts.append(edge if abs(edge - r["target"]) <= slack * total / shards else nearest((r["start"], r["end"])))
    return cuts


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """Shard number and slot of each row of ``docs`` (doc_id, text; further columns ignored).

    A row weighs its text's UTF-8 bytes plus 1 (null: 1). Rows are range-sorted by the text's
    CRC-32, its MD5 and doc_id, so equal texts are neighbours; the totals of the sorted partitions
    give each its start, and the running sum inside gives each row its place among all bytes. Cuts
    are at equal targets, moved to the nearest edge of a row, or of a group of equal texts where that
    is within ``slack`` of a shard: at most one group a cut is parted. Slots number the rows of a
    shard from 0 in that order. Null and empty texts count as equal. Rows equal in all of this are
    interchangeable. An empty table gives an empty result.

    Returns doc_id, size, text_crc32, shard, slot.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    key = ["text_crc32", "digest", "doc_id"]
    # written before it is numbered: a retried task can't see other range bounds
    placed = written(sized.repartitionByRange(partitions, *key).withColumn("part", F.spark_partition_id()), "shard-order")

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = (
        placed.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    )
    total = placed.agg(F.sum("size")).first()[0] or 0
    inside = Window.partitionBy("part").orderBy(*key, "size").rowsBetween(Window.unboundedPreceding, 0)
    # a row per partition at most, so its size is known
    ranked = (
        placed.withColumn("bytes_in", F.sum("size").over(inside))
        .withColumn("rank_in", F.row_number().over(inside))
        .join(F.broadcast(starts), "part")
        .select("doc_id", "size", "text_crc32", "digest", (F.col("bytes_before") + F.col("bytes_in")).alias("end"), (F.col("rows_before") + F.col("rank_in")).alias("rank"))
    )
    ranked = written(ranked, "shard-rank")
    begin = F.col("end") - F.col("size")
    shard = sum((F.when(begin >= cut, 1).otherwise(0) for cut in _cuts(ranked, total, shards, slack)), F.lit(0)).cast("int")
    dealt = ranked.withColumn("shard", shard)
    first = dealt.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # a row per shard
    return dealt.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
