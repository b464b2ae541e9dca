"""Ranking of chunks by vector and keyword relevance inside a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.functions.text import contract_score, cosine_distance, legal_score

# Limits of both searches.
LEAST_RELEVANCE = 0.12
EXCERPT_CHARS, CONTEXT_CHARS = 600, 6000
CONTRACT_TOP, LEGAL_TOP, LEGAL_MOST = 10, 5, 10
PREFERRED_BOOST = 0.05


def in_scope(collection: Column, collections: list[str], contract_types: Column, contract_type: str, topics: Column, wanted: list[str], status: Column) -> Column:
    """The legal scope: collection, applicable contract type, active source, and topics if any are asked for."""
    out = collection.isin(collections) & F.array_contains(contract_types, contract_type) & (status == "active")
    return out & F.arrays_overlap(topics, F.array(*[F.lit(t) for t in wanted])) if wanted else out


def vector_top(rows: DataFrame, query: Column, limit: int, ties: str, vector: str = "embedding") -> DataFrame:
    """The ``limit`` rows nearest to ``query``, with ``distance``; an exact scan with a top-k per task."""
    return rows.withColumn("distance", cosine_distance(F.col(vector), query)).orderBy("distance", ties).limit(limit)


def keyword_top(rows: DataFrame, score: Column, limit: int, ties: str) -> DataFrame:
    return rows.withColumn("keywords", score).filter("keywords > 0").orderBy(F.desc("keywords"), ties).limit(limit)


def clamp_top(asked: int | None, default: int = LEGAL_TOP, most: int = LEGAL_MOST) -> int:
    return max(1, min(default if asked is None else asked, most))


def excerpts(ranked: DataFrame, order: list[Column], by: list[str] | None = None, text: str = "text", each: int = EXCERPT_CHARS, total: int = CONTEXT_CHARS) -> DataFrame:
    """Excerpts of ranked rows under a shared budget: each takes what is left, up to ``each``."""
    before = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.least(F.length(text), F.lit(each))
    prior = F.coalesce(F.sum(cut).over(before), F.lit(0))
    out = ranked.withColumn("_left", total - prior).filter("_left > 0")
    return out.withColumn("excerpt", F.substring(text, F.lit(1), F.least(F.lit(each), F.col("_left")).cast("int"))).drop("_left")


def bounded(ranked: DataFrame, order: list[Column], by: list[str] | None = None, text: str = "text", each: int = EXCERPT_CHARS, total: int = CONTEXT_CHARS) -> DataFrame:
    """Ranked rows up to the first whose excerpt would overflow ``total``; the first always stays."""
    upto = Window.partitionBy(*(by or [])).orderBy(*order)
    size = F.least(F.length(text), F.lit(each))
    out = ranked.withColumn("_sum", F.sum(size).over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(upto))
    return out.filter((F.col("_sum") <= total) | (F.col("_n") == 1)).drop("_sum", "_n")


def search_contract(chunks: DataFrame, query_vector: Column, keywords: Column, top: int = CONTRACT_TOP, ties: str = "chunk_id") -> DataFrame:
    """Hybrid ranking of one session's ``chunks`` (``ties`` id, text, embedding).

    The nearest max(4k, 20) chunks keep their similarity, the others and those without an embedding
    count 0; blended scores of at
    least 0.12 are ranked, the best ``top`` give excerpts under the budget. One session's chunks are
    few by contract, so the ranked rows meet in one task.
    """
    near = vector_top(chunks.filter("embedding IS NOT NULL"), query_vector, max(4 * top, 20), ties).select(F.col(ties).alias("_id"), (1 - F.col("distance")).alias("similarity"))
    scored = chunks.join(near, chunks[ties] == near["_id"], "left").withColumn("score", contract_score(F.coalesce("similarity", F.lit(0.0)), keywords))
    ranked = scored.filter(F.col("score") >= LEAST_RELEVANCE).orderBy(F.desc("score"), ties).limit(top)
    return excerpts(ranked, [F.desc("score"), F.col(ties)]).drop("_id", "similarity")


def search_legal(chunks: DataFrame, preferred: Column, fallback: Column, query_vector: Column, keywords: Column, exact: Column, top: int | None = None, ties: str = "chunk_id") -> DataFrame:
    """Hybrid ranking over preferred collections, or over fallback ones where no preferred hit reaches 0.12.

    In each scope the nearest 3k and the best 3k by keywords are joined on the id, so that a chunk
    without an embedding can still be a keyword hit; the preferred boost orders but doesn't lift a hit over the threshold; chunks that ``exact`` marks come first.
    """
    k = clamp_top(top)

    def scope(rows: DataFrame, boost: float) -> DataFrame:
        near = vector_top(rows.filter("embedding IS NOT NULL"), query_vector, 3 * k, ties).select(ties, (1 - F.col("distance")).alias("similarity"))
        words = keyword_top(rows, keywords, 3 * k, ties).select(ties, "keywords")
        hits = near.join(words, ties, "full_outer").withColumn("raw", legal_score(F.coalesce("similarity", F.lit(0.0)), F.coalesce("keywords", F.lit(0))))
        return hits.filter(F.col("raw") >= LEAST_RELEVANCE).select(ties, (F.col("raw") + boost).alias("score"), F.lit(boost > 0).alias("is_preferred"))

    hits = scope(chunks.filter(preferred), PREFERRED_BOOST).unionByName(scope(chunks.filter(fallback), 0.0))
    any_preferred = F.max("is_preferred").over(Window.partitionBy(F.lit(0)))  # at most 12k hits
    kept = hits.withColumn("_any", any_preferred).filter(F.col("is_preferred") | ~F.col("_any")).drop("_any")
    full = kept.join(chunks, ties).withColumn("_exact", F.coalesce(exact, F.lit(False)))
    order = [F.desc("_exact"), F.desc("score"), F.col(ties)]
    return bounded(full.orderBy(*order).limit(k), order).withColumn("score", F.round("score", 3)).withColumn("excerpt", F.left("text", F.lit(EXCERPT_CHARS))).drop("_exact")
