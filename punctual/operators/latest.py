"""Collapse the many side of a join to one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The last row of each key by ``newest``, descending; a NULL counts as the latest.

    Ranking with a limit of one lets Spark drop the other rows before the shuffle, so a
    key with very many rows sends one per task. Ranking is also kept in place of an
    aggregate because an aggregate proves the key unique, after which the optimizer
    removes an unused left join, and with it the proof that the join adds no rows.
    """
    order = [F.col(column).desc_nulls_first() for column in newest]
    ranked = df.withColumn("latest_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("latest_rank") == 1).drop("latest_rank")


def review_per_order(reviews: DataFrame) -> DataFrame:
    """One review per order: the latest created, then the greatest id."""
    return latest_per_key(
        reviews.select("order_id", "review_id", "review_score", "review_creation_date"),
        ["order_id"],
        ["review_creation_date", "review_id"],
    )
