"""Stored tables whose groups of rows are replaced, upserted and deleted for good.

A table is a folder of Parquet, partitioned by a hash of its key, so that a change rewrites only the buckets of
the keys it touches. A change is first written whole beside the table (``<path>.pending``), and once that is
complete the folders of its buckets are moved in place of the table's, so rows are written once. It states what the rows of
its keys are afterwards, so it can be run again: after a lost executor Spark repeats the tasks; after a lost driver
the next change first finishes one whose pending rows are complete (it moves the buckets that are still there), and
drops one whose aren't, before which the table was not touched. Rows that stay are written by the tasks that read
their buckets; only new rows are shuffled.

A table has one writer at a time. Every touched bucket holds a row without a key, as a bucket without any row would
not be overwritten; ``stored`` leaves these rows out. Rows with a null key can't be addressed and aren't written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.session import written

#: Buckets of a table; the number is part of a table and stays as it was created. A large table takes thousands:
#: a change reads and writes whole buckets. Large buckets are written by several tasks (Spark's rebalancing).
BUCKETS = 64
#: Changed keys up to which they are broadcast to the rows that stay, some 100 MB; beyond, these are shuffled.
BROADCAST_KEYS = 1_000_000
#: Files a bucket has on average, and bytes a file is short of, when a change shuffles the rows that stay too, to join files.
SCATTERED, SHORT_FILE = 8, 16 << 20
_BUCKET = "_bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and its path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)


def _move_buckets(spark: SparkSession, pending: str, path: str) -> bool:
    """Each bucket's folder in ``pending`` put in place of the table's; False if rows lie there outside of buckets.
    A bucket leaves ``pending`` only by its move, so this can be run again wherever it stopped."""
    files, at = _files(spark, pending)
    found = [status.getPath() for status in files.listStatus(at)]
    if any(f.getName().startswith("part-") for f in found):
        return False
    _, table = _files(spark, path)
    files.mkdirs(table)
    for folder in found:
        if folder.getName().startswith(f"{_BUCKET}="):
            target = _files(spark, f"{path}/{folder.getName()}")[1]
            files.delete(target, True)
            if not files.rename(folder, target):
                raise OSError(f"could not move {folder} to {target}; the change stays pending")
    return True


def settle(spark: SparkSession, path: str) -> None:
    """Finishes a change that a driver left pending, or drops it where its rows aren't complete."""
    pending = f"{path}.pending"
    if _exists(spark, f"{pending}/_SUCCESS") and not _move_buckets(spark, pending, path):
        _overwrite(spark.read.parquet(pending), path)
    _remove(spark, pending)


def _apply(new: DataFrame, path: str, touched: list[int], kept: DataFrame | None = None) -> None:
    """Makes ``new`` and ``kept`` (with their bucket) all that the buckets ``touched`` hold. ``new`` rows are shuffled by
    bucket; ``kept`` are in the order in which they were read, bucket by bucket, and make no more files than there were."""
    spark = new.sparkSession
    marks = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in touched])).alias(_BUCKET))
    whole = new.unionByName(marks, allowMissingColumns=True).hint("rebalance", F.col(_BUCKET))
    whole = whole if kept is None else kept.unionByName(whole)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(_BUCKET).parquet(f"{path}.pending")
    settle(spark, path)


def create(path: str, rows: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Writes the table anew from ``rows``; every bucket exists afterwards."""
    placed = rows.filter(F.col(key).isNotNull()).withColumn(_BUCKET, _bucket(F.col(key), buckets))
    _apply(placed, path, list(range(buckets)))


def stored(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of the table, a pending change finished first."""
    settle(spark, path)
    return spark.read.parquet(path).filter(F.col(key).isNotNull()).drop(_BUCKET)


def change(spark: SparkSession, path: str, key: str, keys: DataFrame, rows_of: Callable[[DataFrame], DataFrame], stays: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> None:
    """Rewrites the buckets that the ``keys`` (a column ``key``) fall into: ``rows_of`` makes rows from the stored
    ones, and ``stays`` takes those, if any, that are written again as they are, which must not shuffle them. The
    numbers of the buckets, and nothing else, come to the driver."""
    settle(spark, path)
    touched = sorted(r[0] for r in keys.filter(F.col(key).isNotNull()).select(_bucket(F.col(key), buckets)).distinct().collect())
    if not touched:
        return
    placed = lambda rows: rows.withColumn(_BUCKET, _bucket(F.col(key), buckets))
    now = spark.read.parquet(path).filter(F.col(_BUCKET).isin(touched) & F.col(key).isNotNull()).drop(_BUCKET)
    _apply(placed(rows_of(now)), path, touched, None if stays is None else placed(stays(now)))


def _scattered(spark: SparkSession, path: str, buckets: int) -> bool:
    """Whether the table lies in many short files, as after many small changes."""
    files, at = _files(spark, path)
    held = files.getContentSummary(at)
    return held.getFileCount() > SCATTERED * buckets and held.getLength() < SHORT_FILE * held.getFileCount()


def _change_keys(path: str, key: str, keys: DataFrame, rows_of: Callable[[DataFrame], DataFrame], buckets: int) -> None:
    """Exchanges all rows of the ``keys``, a written table of distinct ones, for what ``rows_of`` makes of the stored ones.
    The others stay, unshuffled where the keys are few enough to be broadcast."""
    others = lambda now, few: now.join(few, key, "left_anti").select(now.columns)
    if keys.count() <= BROADCAST_KEYS and not _scattered(keys.sparkSession, path, buckets):
        change(keys.sparkSession, path, key, keys, rows_of, lambda now: others(now, F.broadcast(keys)), buckets)
    else:
        change(keys.sparkSession, path, key, keys, lambda now: others(now, keys).unionByName(rows_of(now)), None, buckets)


def replace_rows(path: str, key: str, fresh: DataFrame, keys: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """All rows of the ``keys`` (those of ``fresh`` if not given) exchanged for their rows of ``fresh``; a key
    without fresh rows has none afterwards, and rows of ``fresh`` under other keys aren't written."""
    fresh = written(fresh, "fresh")
    keys = written((fresh if keys is None else keys).select(key).distinct(), "keys")
    new = fresh.join(keys, key, "left_semi").select(fresh.columns)
    _change_keys(path, key, keys, lambda now: new.select(now.columns), buckets)


def delete_rows(path: str, key: str, gone: DataFrame, buckets: int = BUCKETS) -> None:
    """All rows of the keys in ``gone`` deleted; unknown ones delete nothing."""
    gone = written(gone.select(key).distinct(), "keys")
    _change_keys(path, key, gone, lambda now: now.filter(F.lit(False)), buckets)


def upsert_rows(path: str, key: str, fresh: DataFrame, version: str = "updated_at", buckets: int = BUCKETS) -> None:
    """One row per key of ``fresh``: the newest by ``version``, of equally new ones the fresh one."""
    fresh = written(fresh, "fresh")
    keys = written(fresh.select(key).distinct(), "keys")

    def newest(now: DataFrame) -> DataFrame:
        both = now.join(keys, key, "left_semi").select(now.columns).withColumn("_new", F.lit(0)).unionByName(fresh.filter(F.col(key).isNotNull()).withColumn("_new", F.lit(1)))
        order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.desc("_new"), F.xxhash64(*now.columns))
        return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")

    _change_keys(path, key, keys, newest, buckets)


def replace_session_chunks(chunks: str, sessions: str, fresh: DataFrame, ids: DataFrame, buckets: int = BUCKETS) -> None:
    """The chunks of the sessions ``ids`` exchanged for ``fresh``, and each one's ``n_chunks`` set to what is then
    stored. Ids that aren't stored as sessions are passed over. The chunks come first and the counts are read from
    them, so running it again after a stop in between gives the same tables."""
    spark = fresh.sparkSession
    known = written(ids.select("session_id").distinct().join(stored(spark, sessions, "session_id").select("session_id"), "session_id", "left_semi"), "keys")
    replace_rows(chunks, "session_id", fresh, known, buckets)
    counts = stored(spark, chunks, "session_id").join(known, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("_stored"))
    told = written(known.join(counts, "session_id", "left").select("session_id", F.coalesce("_stored", F.lit(0)).alias("_stored")), "counts")
    recount = lambda now: now.join(told, "session_id", "left").withColumn("n_chunks", F.coalesce("_stored", "n_chunks")).select(now.columns)
    change(spark, sessions, "session_id", known, recount, buckets=buckets)


def delete_sessions(chunks: str, sessions: str, gone: DataFrame, buckets: int = BUCKETS) -> None:
    """Sessions deleted with their chunks, which go first: no chunk is ever without its session."""
    delete_rows(chunks, "session_id", gone, buckets)
    delete_rows(sessions, "session_id", gone, buckets)


def delete_expired(spark: SparkSession, chunks: str, sessions: str, now: Column, buckets: int = BUCKETS) -> DataFrame:
    """Rows at or past their ``expires_at`` deleted from both tables; returns deleted_sessions, deleted_chunks as
    one row. Each row goes by its own time; one without a time stays."""
    counts = []
    for path, name in ((chunks, "deleted_chunks"), (sessions, "deleted_sessions")):
        over = F.coalesce(F.col("expires_at") <= now, F.lit(False))
        gone = written(stored(spark, path, "session_id").filter(over).groupBy("session_id").agg(F.count("*").alias("n")), "expired")
        change(spark, path, "session_id", gone, lambda rows: rows.filter(F.lit(False)), lambda rows, over=over: rows.filter(~over), buckets)
        counts.append(gone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)).withColumn("_k", F.lit(0)))
    return counts[1].join(counts[0], "_k").drop("_k")


def disable_source(path: str, source_ids: DataFrame, at: Column, buckets: int = BUCKETS) -> None:
    """The sources marked 'repealed' at a time; their rows and chunks stay."""
    ids = written(source_ids.select("source_id").distinct().withColumn("_off", F.lit(True)), "keys")

    def mark(now: DataFrame) -> DataFrame:
        both, off = now.join(ids, "source_id", "left"), F.col("_off").isNotNull()
        return both.withColumns({"status": F.when(off, "repealed").otherwise(F.col("status")), "updated_at": F.when(off, at).otherwise(F.col("updated_at"))}).select(now.columns)

    change(ids.sparkSession, path, "source_id", ids, mark, buckets=buckets)
