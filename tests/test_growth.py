"""What grew faster than the input in the third round: work that plans repeated, or left to one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.operators import contracts, recovery
from tallystone.plans import recovery_queries
from tallystone.sources import texts

_SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_read_once_for_all_words_of_a_query(spark):
    rows = spark.createDataFrame([(1, "The deposit, the DEPOSIT! rent-free", None, "src"), (2, "deposits rents", "Article 9", "rent"), (3, None, None, "src")], "id int, text string, article string, title string")
    scored = rows.select("id", T.legal_keyword_score(F.col("text"), F.col("article"), F.col("title"), F.lit("rent deposit rent free Article 9")).alias("n"))
    assert {r.id: r.n for r in scored.collect()} == {1: 4, 2: 13, 3: 0}
    assert "array_contains(filter(" not in _plan(scored)


def test_a_collection_is_gated_before_it_is_joined(spark):
    said = F.repeat(F.concat(F.lit("Article 1: One\nfirst body\nArticle 2: Two\nbody "), F.col("id").cast("string"), F.lit("\n")), 3)
    sources = spark.range(4).select(F.col("id").alias("source_id"), F.when(F.col("id") < 3, said).alias("text"))
    stored = texts.chunking.chunk_legal_texts(sources.filter("source_id < 1"), "source_id")
    actions, told = texts.ingest_collection(sources, stored)
    assert "repeat(" not in _plan(told) and "repeat(" not in _plan(actions)
    assert {r.source_id: (r.status, r.reused, r.embedded) for r in told.collect()} == {0: ("done", 6, 0), 1: ("done", 0, 6), 2: ("done", 0, 6), 3: ("failed", 0, 0)}


def test_sessions_are_opened_without_deriving_or_shuffling_texts(spark):
    rows = spark.range(3).select(F.col("id").alias("session_id"), F.lit("lease").alias("contract_type"), F.repeat(F.lit("a paragraph of some length\n\n"), F.col("id").cast("int")).alias("masked_text"))
    opened, chunks = texts.index_sessions(rows, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert "repeat(" not in _plan(opened) and "repeat(" not in _plan(chunks)
    assert {r.session_id: r.n_chunks for r in opened.collect()} == {1: 1, 2: 2}


def test_white_space_is_trimmed_at_the_ends_alone(spark):
    row = spark.range(1).select(T.trimmed(F.lit("　﻿ \t\na   b \r\n")).alias("t"), T.trimmed(F.lit(" \n")).alias("e")).first()
    assert (row.t, row.e) == ("a   b", "")
    assert "regexp" not in _plan(spark.range(1).select(T.trimmed(F.col("id").cast("string"))))


def test_recovered_texts_are_dealt_to_all_cores(spark):
    for query in (recovery_queries.recovered_values, recovery_queries.recovery_notes):
        assert query(spark, _SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_number_words_are_looked_up_where_they_stand_alone(spark):
    said = ["واحد وعشرون", "(مائة،ألف)", "مائةألف", "xواحد", "", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    found = rows.select("i", recovery.number_words(F.col("s")).alias("w"))
    assert {r.i: r.w and r.w.value for r in found.collect()} == {0: 21.0, 1: 100000.0, 2: None, 3: None, 4: None, 5: None}
    assert "map_contains_key" not in _plan(found)


def test_facts_are_shuffled_once_by_their_contract_and_without_their_texts(spark):
    one = spark.range(2).select(F.col("id"), F.from_json(F.lit('{"contract_type": "employment", "fees": [{"description": "Housing allowance", "amount": 5, "currency": "SAR"}]}'), contracts.CONTRACT).alias("c"))
    frame = one.select(F.col("id").cast("string").alias("contract_id"), *[f"c.{n}" for n in one.schema["c"].dataType.names if n != "contract_id"])
    roles = contracts.assign_roles(contracts.extract_candidates(frame))
    assert not {"_own", "_said", "_full"} & set(roles.columns)
    rows = contracts.reclassify_employment(contracts.reclassify_rent(roles))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("contract_id")))
    assert rows._jdf.queryExecution().sparkPlan().toString().count("Window [") == 2
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    assert {(r.contract_id, r.special_key, r.amount, r.n) for r in rows.collect()} == {(c, k, 5.0, 2) for c in "01" for k in ("salaryComponent", "monthlyIncome")}
