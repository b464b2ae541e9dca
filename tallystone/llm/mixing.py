"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each document of a source, in a shuffled order that depends on its id alone, gets a virtual finish
time: the words of its source up to and including it, divided by the source's target. A source that
must be read several times goes on in the same order. All copies are range-sorted by that time over
the whole table, which interleaves the sources in proportion to their targets at every point; totals of
the sorted partitions lead to the one in which the budget ends, and the mix is what comes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.session import table, written

#: Words are what stands between these: space, tab, line feed, vertical tab, form feed, return.
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Words of a text (null: 0): each becomes one character, so no list of words is built."""
    marks = F.regexp_replace(text, f"{_GAP}*+{_WORD}++{_GAP}*+", "w")
    return F.when(F.coalesce(F.rlike(text, F.lit(_WORD)), F.lit(False)), F.length(marks)).otherwise(0).cast("long")


def queue_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``source, source_size`` (one row per source) with ``weight`` and ``target``.

    Sources in code-point order (null last) get the weights in turn. The targets share the sum of
    all sizes by weight; none exceeds ``max_epochs`` times its source's size, the excess being
    shared again by weight. With sources sorted by cap over weight, the capped ones come first, so
    one running sum finds the level at which the rest is filled.
    The windows hold one row per source.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table_of_weights = F.array(*[F.lit(int(w)) for w in weights])
    ranked = (
        sources.withColumn("weight", F.element_at(table_of_weights, ((F.row_number().over(in_turn) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("place", F.row_number().over(by_cap))
    )
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "weight", "target")


def _queue(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """doc_id, source, size, queue_key, reached, source_size, target of each row: ``reached`` is the
    words of its source up to and including it. A source, however large, is cut into 4096 runs of the
    shuffled order, whose totals give each run its start; the running sum then needs one run at a time."""
    base = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), queue_key(seed).alias("queue_key")), "mix-sizes").withColumn("run", F.substring("queue_key", 1, 3))
    runs = base.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    targets = source_targets(runs.groupBy("source").agg(F.sum("run_size").alias("source_size")), weights, max_epochs)
    in_source = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("start", F.coalesce(F.sum("run_size").over(in_source), F.lit(0)))
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.run", "s.start", "t.source_size", "t.target")
    in_run = Window.partitionBy("source", "run").orderBy("queue_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = base.withColumn("within", F.sum("size").over(in_run))
    return (
        queued.alias("q")
        .join(starts.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.run") == F.col("s.run")))
        .select("q.doc_id", "q.source", "q.size", "q.queue_key", (F.col("q.within") + F.col("s.start")).alias("reached"), "s.source_size", "s.target")
    )


#: A copy's place in the mix, after its finish time.
_TIES = ("queue_key", "doc_id", "size")


def mix_order(queued: DataFrame, max_epochs: int = 3) -> DataFrame:
    """The copies that the mix takes, from a queue (written): source, epoch, finish (virtual time), part
    and the row's queue_key, doc_id and size. Sorted by part, finish and these three they are in the
    order of the mix; a source without words finishes at 0."""
    spark = queued.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")
    copies = queued.select("source", epochs, *_TIES, "source_size", "reached", "target")
    finish = F.coalesce(F.try_divide(F.col("source_size") * F.col("epoch") + F.col("reached"), F.col("target")), F.lit(0.0))
    copies = copies.select("source", "epoch", finish.alias("finish"), *_TIES)
    # written before it is summed: a retried task can't see other range bounds
    placed = written(copies.repartitionByRange(partitions, "finish", *_TIES).withColumn("part", F.spark_partition_id()), "mix-order")
    budget = queued.agg(F.sum("size")).first()[0] or 0
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = placed.groupBy("part").agg(F.sum("size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = totals.filter(F.col("ahead") + F.col("words") > budget).agg(F.min(F.struct("part", "ahead")).alias("m")).first()["m"]
    if last is None:
        return placed
    upto = Window.orderBy("finish", *_TIES).rowsBetween(Window.unboundedPreceding, 0)  # one partition of the sort
    ending = placed.filter(F.col("part") == last["part"]).withColumn("words", F.sum("size").over(upto)).filter(F.col("words") <= budget - last["ahead"]).drop("words")
    return placed.filter(F.col("part") < last["part"]).unionByName(ending)


def _copies(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` (source, queue_key, doc_id, size, ...) with ``copies``. What a source has in the mix is
    the head of its queue, read again and again: the last of its copies says all, a row per source."""
    last = taken.groupBy("source").agg(F.max(F.struct("epoch", *_TIES)).alias("_last")).withColumnRenamed("source", "_source")
    joined = rows.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("_source")), "left")
    reached = F.struct(*_TIES) <= F.struct(*[F.col("_last")[c].alias(c) for c in _TIES])
    copies = F.coalesce(F.col("_last.epoch") + F.when(reached, 1).otherwise(0), F.lit(0))
    return joined.withColumn("copies", F.when(F.col("size") == 0, F.least(copies, F.lit(1))).otherwise(copies).cast("int")).drop("_source", "_last")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, source, text; further columns ignored).

    Returns doc_id, source, size, source_size, target, taken, copies, one row per input row. A null
    text has size 0; null sources form one source; rows without words are taken once (``copies``)
    when their place in the queue is reached, with ``taken`` 0; equal ids with equal sizes share
    their place, so that the mix takes them alike; an empty table gives an empty result. The driver
    sees two sums and the number of a partition.
    """
    queued = written(_queue(docs, weights, max_epochs, seed), "mix-queue")
    return _copies(queued, mix_order(queued, max_epochs)).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text; all columns stay), each as often as the mix takes it.

    Whole rows aren't shuffled: a row finds its number of copies by its own place in the queue.
    """
    queued = written(_queue(docs, weights, max_epochs, seed), "mix-queue")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), queue_key(seed).alias("queue_key"))
    return _copies(rows, mix_order(queued, max_epochs)).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM src),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size) / weight AS fill FROM w),
l AS (SELECT *, row_number() OVER o AS place,
        (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
        / (CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) AS level
      FROM r WINDOW o AS (ORDER BY fill, source ASC NULLS LAST)),
lev AS (SELECT level FROM l WHERE level <= fill ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), lev.level * weight) AS target FROM l, lev),
q AS (SELECT b.doc_id, b.size, b.k, t.source_size, t.target,
        CAST(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reached
      FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e.e, (e.e * source_size + reached) AS f, (e.e * source_size + reached) / target AS v FROM q, (SELECT unnest([0, 1, 2]) AS e) e),
s AS (SELECT *, CASE WHEN f <= target THEN NULL ELSE CAST(sum(CASE WHEN f <= target THEN 0 ELSE size END) OVER (ORDER BY v, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS late_sum FROM c),
left_over AS (SELECT CAST(sum(CASE WHEN e = 0 THEN size ELSE 0 END) - sum(CASE WHEN f <= target THEN size ELSE 0 END) AS BIGINT) AS n FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(CASE WHEN f <= target OR late_sum <= left_over.n THEN size ELSE 0 END) AS BIGINT) AS taken
FROM s, left_over GROUP BY doc_id
"""
