"""Stored tables: changes run twice, buckets that become empty, and changes that a driver left behind."""

from pyspark.sql import functions as F

from tallystone.sources import store


def _rows(spark, path, key="session_id"):
    return sorted(tuple(r) for r in store.stored(spark, path, key).collect())


def test_replacing_and_deleting_twice_is_the_same(spark, tmp_path):
    chunks, sessions = f"{tmp_path}/chunks", f"{tmp_path}/sessions"
    ends = "2024-01-01 0{}:00:00"
    store.create(chunks, spark.createDataFrame([("a", 0, "x", ends.format(1)), ("a", 1, "y", ends.format(1)), ("b", 0, "z", ends.format(3)), ("c", 0, "w", None), (None, 0, "lost", None)], "session_id string, chunk_order int, chunk_text string, expires_at string"), "session_id", 4)
    store.create(sessions, spark.createDataFrame([("a", 2, ends.format(1)), ("b", 1, ends.format(3)), ("c", 1, None)], "session_id string, n_chunks long, expires_at string"), "session_id", 4)
    fresh = spark.createDataFrame([("b", 0, "p", ends.format(3)), ("b", 1, "q", ends.format(3)), ("unknown", 0, "r", None)], "session_id string, chunk_order int, chunk_text string, expires_at string")
    ids = spark.createDataFrame([("b",), ("c",), ("unknown",), (None,)], "session_id string")
    for _ in range(2):
        store.replace_session_chunks(chunks, sessions, fresh, ids, 4)
        assert [r[:3] for r in _rows(spark, chunks)] == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "p"), ("b", 1, "q")]
        assert [r[:2] for r in _rows(spark, sessions)] == [("a", 2), ("b", 2), ("c", 0)]
    assert [tuple(store.delete_expired(spark, chunks, sessions, F.lit(ends.format(1)), 4).first()) for _ in range(2)] == [(1, 2), (0, 0)]
    for _ in range(2):
        store.delete_sessions(chunks, sessions, spark.createDataFrame([("b",)], "session_id string"), 4)
        assert _rows(spark, chunks) == [] and [r[0] for r in _rows(spark, sessions)] == ["c"]
    store.delete_rows(chunks, "session_id", ids.limit(0), 4)


def test_upserts_and_sources_switched_off(spark, tmp_path):
    path, schema = f"{tmp_path}/sources", "source_id string, status string, updated_at string"
    store.create(path, spark.createDataFrame([("a", "active", "2"), ("b", "active", "2")], schema), "source_id", 2)
    for _ in range(2):
        store.upsert_rows(path, "source_id", spark.createDataFrame([("a", "old", "1"), ("b", "same", "2"), ("c", "new", "1"), ("c", "newer", "3"), (None, "x", "9")], schema), buckets=2)
        assert _rows(spark, path, "source_id") == [("a", "active", "2"), ("b", "same", "2"), ("c", "newer", "3")]
    for _ in range(2):
        store.disable_source(path, spark.createDataFrame([("b",), ("unknown",)], "source_id string"), F.lit("4"), 2)
        assert _rows(spark, path, "source_id") == [("a", "active", "2"), ("b", "repealed", "4"), ("c", "newer", "3")]


def test_a_change_left_pending(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k string, v int"
    store.create(path, spark.createDataFrame([("a", 1), ("b", 2)], schema), "k", 1)
    pending = spark.createDataFrame([("a", 5), (None, None)], schema).withColumn("_bucket", F.lit(0))
    pending.write.parquet(f"{path}.pending")
    assert _rows(spark, path, "k") == [("a", 5)], "complete: finished"
    pending.write.parquet(f"{path}.pending")
    (tmp_path / "t.pending" / "_SUCCESS").unlink()
    store.replace_rows(path, "k", spark.createDataFrame([("c", 7)], schema), buckets=1)
    assert _rows(spark, path, "k") == [("a", 5), ("c", 7)], "not complete: dropped"
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.pending").exists()


def test_a_move_of_buckets_left_half_done(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k string, v int"
    store.create(path, spark.createDataFrame([(c, 1) for c in "abcdefgh"], schema), "k", 4)
    later = f"{tmp_path}/later"
    store.create(later, spark.createDataFrame([(c, 2) for c in "abcdefgh"], schema), "k", 4)
    (tmp_path / "later").rename(tmp_path / "t.pending")
    (tmp_path / "t.pending" / "_SUCCESS").touch()
    for b, gone in ((0, True), (1, False)):
        (tmp_path / "t" / f"_bucket={b}").rename(tmp_path / f"old{b}")
        if gone:
            (tmp_path / "t.pending" / f"_bucket={b}").rename(tmp_path / "t" / f"_bucket={b}")
    assert _rows(spark, path, "k") == [(c, 2) for c in "abcdefgh"]
    assert not (tmp_path / "t.pending").exists()


def test_rows_are_written_once_and_those_that_stay_are_not_shuffled(spark, tmp_path, monkeypatch):
    path, schema = f"{tmp_path}/t", "k string, v int"
    monkeypatch.setattr(store, "_overwrite", None)
    store.create(path, spark.createDataFrame([(f"k{i}", i) for i in range(50)], schema), "k", 4)
    plans, whole = [], store._apply

    def applied(new, path, touched, kept=None):
        plans.append("" if kept is None else kept._jdf.queryExecution().executedPlan().toString())
        whole(new, path, touched, kept)

    monkeypatch.setattr(store, "_apply", applied)
    files = len(list((tmp_path / "t").glob("*/*.parquet")))
    few = spark.createDataFrame([("k1", -1), ("k50", -2)], schema)
    store.replace_rows(path, "k", few, buckets=4)
    store.delete_rows(path, "k", spark.createDataFrame([("k2",), ("k3",)], "k string"), 4)
    assert _rows(spark, path, "k") == sorted([(f"k{i}", i) for i in range(50) if i not in (1, 2, 3)] + [("k1", -1), ("k50", -2)])
    assert len(plans) == 2 and all("Scan parquet" in p and "Exchange hashpartitioning" not in p for p in plans)
    assert len(list((tmp_path / "t").glob("*/*.parquet"))) <= files + 2 * 4
    monkeypatch.setattr(store, "SCATTERED", 0)
    store.delete_rows(path, "k", spark.range(40).select(F.concat(F.lit("unknown"), "id").alias("k")), 4)
    assert len(list((tmp_path / "t").glob("*/*.parquet"))) == 4, "short files are joined"
    monkeypatch.setattr(store, "BROADCAST_KEYS", 0)
    store.replace_rows(path, "k", few, buckets=4)
    store.delete_rows(path, "k", few, 4)
    assert len(_rows(spark, path, "k")) == 47
