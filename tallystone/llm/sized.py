"""Joins whose smaller side is broadcast only once its size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers each that every executor can hold.
BROADCAST_ROWS = 1_000_000


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` of a join by equality that is never broadcast, however small Spark takes it to be: it sizes a table by
    its compressed files and arrays by one item, and leaves out the rows that an explode adds."""
    return side.hint("merge")


def semi_or_anti(rows: DataFrame, ids: DataFrame, on: list[str], how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with (``left_semi``) or without (``left_anti``) a match in ``ids``, nulls equal to nulls.

    ``ids`` has the columns ``on`` and should be cheap to count, such as a written table. Up to
    ``most`` rows it is broadcast, so that wide rows need no shuffle; beyond, both sides are shuffled.
    Without nulls it is matched by plain equality, which takes two thirds of the memory.
    """
    ids = ids.select([F.col(c).alias(f"_{c}") for c in on])
    counted = ids.limit(most + 1).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in ids.columns]).first()
    same = F.lit(True)
    for c in on:
        # beyond ``most`` the nulls weren't all counted
        same &= rows[c].eqNullSafe(F.col(f"_{c}")) if counted[f"_{c}"] or counted["n"] > most else rows[c] == F.col(f"_{c}")
    return rows.join(F.broadcast(ids) if counted["n"] <= most else shuffled(ids), same, how)
