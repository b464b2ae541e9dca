"""What Spark sized too low in the fourth round."""

from pyspark.sql import functions as F

from tallystone.llm import components, near_dedup, sized


def test_near_duplicates_broadcast_only_what_was_counted(spark, monkeypatch):
    said = [F.concat(F.lit("w"), (F.col("doc_id") % 20 * 50 + i).cast("string")) for i in range(30)]
    docs = spark.range(60).select(F.col("id").alias("doc_id")).select("doc_id", F.concat_ws(" ", *said, F.when(F.col("doc_id") < 40, "tail")).alias("text"))
    plans, whole = {}, near_dedup.written

    def planned(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, name)

    monkeypatch.setattr(near_dedup, "written", planned)
    monkeypatch.setattr(components, "written", planned)
    out = near_dedup.near_duplicates(docs)
    plans["result"] = [out._jdf.queryExecution().executedPlan().toString()]
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i % 20 for i in range(60)}
    counted = plans.pop("near-texts")
    assert all("BroadcastHashJoin" in p for p in counted)
    assert [name for name, of in plans.items() if any("BroadcastHashJoin" in p for p in of)] == []
    assert any("SortMergeJoin" in p for p in plans["near-keys"])


def test_rows_with_and_without_a_match(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    for ids, most in (([1], 9), ([1, None], 9), ([1], 0), ([1, 5, None], 1), ([], 9), ([], 0)):
        table = spark.createDataFrame([(i,) for i in ids], "x long")
        for how, within in (("left_semi", True), ("left_anti", False)):
            got = sized.semi_or_anti(rows, table, ["x"], how, most)
            assert {r.x for r in got.collect()} == {x for x in (1, 2, None) if (x in ids) == within}
            assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (len(ids) <= most)
