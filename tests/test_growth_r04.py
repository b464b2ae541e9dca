"""What took time with every fact in the fourth round, though it is said by few texts."""

import pytest
from pyspark.sql import functions as F

from tallystone.operators import contracts, finance
from tallystone.plans import agreement_queries

_SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def frame(spark):
    return contracts.written(agreement_queries.agreements(spark, _SF), "agreements")


def test_statements_are_read_once_however_many_facts_make_them(frame, monkeypatch):
    def rows():
        read = contracts.assign_roles(contracts.extract_candidates(frame))
        return read, sorted(map(repr, read.collect()))

    once, told = rows()
    assert "RLIKE" not in _plan(once).upper() and "regexp_replace" not in _plan(once)
    for name, most in (("STATEMENTS", 5), ("STATEMENT_BYTES", 100)):
        with monkeypatch.context() as m:
            m.setattr(contracts, name, most)
            each, same = rows()
            assert "RLIKE" in _plan(each).upper() and same == told


def test_sums_look_into_no_text(frame):
    candidates = contracts.written(contracts.resolved_candidates(frame).select(*contracts._COUNTED), "candidates")
    assert "label" not in candidates.columns
    assert "regexp_replace" not in _plan(finance.ranked_rivals(contracts.assign_roles(contracts.extract_candidates(frame))))
    plan = contracts.metrics_of(frame, candidates)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1


def test_labels_of_one_key_are_one_statement(spark):
    rows = [("1", n, label, None, None) for n, label in enumerate(("The  Fee", "the fee", "الالبيت", "البيت", "بيت", " ", None))]
    frame = spark.createDataFrame(rows, "contract_id string, ordinal long, label string, mandatory boolean, conditional boolean")
    same = {"target_kind": "fee", "special_key": None, "category": "other", "frequency": None, "currency": "SAR", "start_date": None, "source_kind": "fee_item", "confidence": "low", "source_field": "fees", "evidence": "x"}
    frame = frame.withColumns({c: F.lit(v).cast("string") for c, v in same.items()}).withColumn("amount", F.lit(5.0))
    assert {r.ordinal: r.merged for r in finance.kept(frame).collect()} == {0: 2, 2: 1, 3: 2, 5: 1, 6: 1}
