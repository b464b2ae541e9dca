"""Clauses, concepts, recovered figures, replies and answers on small fixtures: nulls, empties and ties."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallystone.operators import clauses, concepts, display, documents, evidence, recovery
from tallystone.sources import settings, texts


def test_clauses_split_and_merge(spark):
    rows = [
        (1, 0, " Late payment : ", "A late payment costs 150. Collection charges come on top. They are due at once.", "About late payment. Collection charges too."),
        (1, 1, "Late payment", "A late payment costs 150.", "About late payment."),
        (1, 2, "Other", None, None),
        (2, 0, "T", "", ""),
    ]
    frame = spark.createDataFrame(rows, "contract_id int, ordinal int, title string, summary string, explanation string")
    split = clauses.split_compound(frame.withColumn("title", clauses.normal_title(F.col("title")))).orderBy("contract_id", "ordinal", "part").collect()
    assert [(r["contract_id"], r["ordinal"], r["part"]) for r in split] == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 2, 0), (2, 0, 0)]
    assert split[1]["summary"] == "Collection charges come on top. They are due at once." and split[1]["explanation"] == "Collection charges too."
    kept = clauses.drop_equivalent(frame.withColumn("part", F.lit(0))).collect()
    assert {(r["contract_id"], r["ordinal"]) for r in kept} == {(1, 0), (1, 1), (1, 2), (2, 0)}
    twice = frame.filter("ordinal < 2").withColumns({"part": F.lit(0), "summary": F.lit("the very same words"), "explanation": F.lit("")})
    assert {(r["contract_id"], r["ordinal"]) for r in clauses.drop_equivalent(twice).collect()} == {(1, 0), (2, 0)}
    placed = clauses.post_process(frame, spark.createDataFrame([(1, "first Other, then costs")], "contract_id int, text string")).collect()
    assert [r["ordinal"] for r in sorted(placed, key=lambda r: (r["contract_id"], r["place"]))][0] == 2
    assert clauses.post_process(frame.limit(0), spark.createDataFrame([], "contract_id int, text string")).count() == 0


def test_number_words_and_recovery(spark):
    lines = ["مائة وعشرون ألف ريال", "أربعة وعشرون ألفاً", "ألفان وأربعمائة", "خمسة بالمائة", "ثمانية وأربعون", "no words", "", None]
    got = [r["w"] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(recovery.number_words(F.col("t")).alias("w")).collect()]
    assert [w and (w["value"], w["percent"]) for w in got] == [(120000.0, False), (24000.0, False), (2400.0, False), (5.0, True), (48.0, False), None, None, None]
    text = "السعر النقدي: 0 (مائة وعشرون ألف ريال)\nالدفعة الأولى: 2 4 0\nأصل التمويل: 96,000\nإجمالي الربح: 0\nإجمالي المبلغ الواجب سداده: 115,200\nمدة التمويل: 4 8 (4 سنوات)\n1/1/2024 2,400 2,400 2,400"
    r, none = recovery.financial_integrity(recovery.recover_values(spark.createDataFrame([(1, text), (2, None)], "i int, text string"))).orderBy("i").collect()
    assert {n: r[n]["value"] for n in ("cash_price", "down_payment", "financed_amount", "total_profit", "total_payable", "term_months", "installment")} == dict(
        cash_price=120000.0, down_payment=24000.0, financed_amount=96000.0, total_profit=19200.0, total_payable=115200.0, term_months=48.0, installment=2400.0
    )
    assert (r["term_months"]["source"], r["installment"]["confidence"], r["conflicts"]) == ("duration_equivalence", "high", [])
    assert none["financial_score"] is None and none["n_labels"] == 0


def test_concepts_of_empty_and_odd_items(spark):
    schema = "contract_id int, contract_type string, ordinal long, source string, label string, amount double, currency string, percentage double, frequency string, n_payments double, mandatory boolean, conditional boolean, refundable boolean, financial_role string, trigger string, kind string"
    item = lambda i, **v: tuple({"contract_id": 1, "contract_type": "lease", "ordinal": i, "source": "obligation", "label": "x", "amount": 10.0, "currency": "SAR", "financial_role": "recurring_outflow", "mandatory": True, **v}.get(f.split(" ")[0]) for f in schema.split(", "))
    rows = [item(0, frequency="monthly"), item(1, frequency="monthly"), item(2, currency=None), item(3, amount=None), item(4, source="informational", kind="stated_due_at_signing", financial_role="informational_total", amount=30.0), item(5, financial_role="upfront_liquidity", amount=20.0), item(6, label=None, financial_role=None, kind=None)]
    got = concepts.financial_concepts(spark.createDataFrame(rows, schema)).cache()
    assert sorted(r["ordinal"] for r in got.collect()) == [0, 2, 4, 5, 6]
    assert concepts.applicable_amounts(got).first()["upfront_liquidity"] == (30.0, "SAR")
    assert concepts.financial_concepts(got.limit(0).drop("concept", "bucket", "is_cap")).count() == 0


def test_replies_names_and_limits(spark):
    text = "the quick fox"
    ok = '{"contractType": "a", "contractSummary": "b", "importantClauses": [{"title": "t", "evidence": "quick"}, {"title": "u", "evidence": null}], "missingInformation": []}'
    rows = spark.createDataFrame([(0, ok, text), (1, f"```json\n{ok}\n```", text), (2, ok.replace("quick", "slow"), text), (3, "{}", text), (4, None, None), (5, ok, None)], "i int, reply string, text string")
    assert [r["valid"] for r in documents.validated_replies(rows).orderBy("i").collect()] == [True, True, False, False, False, False]
    names = spark.createDataFrame([("Ø¹Ù\u0082Ø¯.pdf",), ("café.pdf",), (None,)], "n string").select(documents.repaired_name(F.col("n")).alias("n")).collect()
    assert [r["n"] for r in names] == ["عقد.pdf", "café.pdf", None]
    one = spark.range(1).select(display.coverage_text(F.lit(2.4), "ar").alias("a"), display.money_text(F.lit(1200.5), F.lit(None).cast("string")).alias("m"), evidence.merged_unavailable(F.array(F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("a"))).alias("u")).first()
    assert tuple(one) == ("حوالي شهرين", "1,200.5", ["a", "b"])
    assert settings.limits_from({"TALLYSTONE_TOP_K": "7", "TALLYSTONE_TTL_MINUTES": "-1", "TALLYSTONE_MAX_CHUNKS": "x"}) == settings.Limits(top_k=7)


def test_sources_and_sessions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Article 1: One\nBody of the first article, long enough to pass.\n")
    read = texts.read_texts(spark, str(tmp_path)).collect()
    assert len(read) == 1 and read[0]["text"].startswith("Article 1")
    rows = spark.createDataFrame([("s1", "lease", "A paragraph that is long enough.\n\nAnother one that is long enough."), ("s2", "lease", None)], "session_id string, contract_type string, masked_text string")
    opened, chunks = texts.index_sessions(rows, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [r["n_chunks"] for r in opened.collect()] == [2] and chunks.count() == 2
    texts.insert_sessions(f"{tmp_path}/sessions", opened)
    texts.insert_sessions(f"{tmp_path}/sessions", opened)
    stored = spark.read.parquet(f"{tmp_path}/sessions")
    assert stored.count() == 2 and texts.latest_sessions(stored).count() == 1
    left = texts.without_sessions(chunks, stored, spark.createDataFrame([("s1",)], "session_id string"))
    assert [x.count() for x in left] == [0, 0]
    actions, told = texts.ingest_collection(spark.createDataFrame([("x", read[0]["text"]), ("y", None)], "source_id string, text string"), spark.createDataFrame([("y", "c", "k")], "source_id string, chunk_id string, checksum string"))
    assert {r["source_id"]: r["status"] for r in told.collect()} == {"x": "done", "y": "failed"} and {r["source_id"] for r in actions.collect()} == {"x"}


def test_every_query_of_the_engine_has_sql():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert {n for n in without if not n.startswith("op") and n != "pipeline"} == set()
