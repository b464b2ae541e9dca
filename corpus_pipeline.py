"""From raw documents to balanced shards: five stages, each an operator over all its predecessor kept.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Null and empty texts are clean, duplicate nothing, leak nothing and take no
words; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm.decontamination import drop_leaks
from tallystone.llm.mixing import mixed_documents
from tallystone.llm.near_dedup import drop_near_duplicates
from tallystone.llm.sharding import shard_by_bytes
from tallystone.llm.toxicity import score_toxicity, train
from tallystone.session import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).filter("tox_predicted = 0").drop("tox_score", "tox_predicted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage within an item's edit budget go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return shard_by_bytes(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Classifier and edit distance have no SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
