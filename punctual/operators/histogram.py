"""Bucket histograms and running shares.

Raw rows are counted per bucket first; windows only ever see those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from punctual.functions import Buckets, share

def all_rows() -> WindowSpec:
    """The whole frame; for frames that are aggregated already."""
    return Window.partitionBy()


def running(column: str, *order: str) -> Column:
    """Sum of ``column`` up to the current row, over an aggregated frame."""
    return F.sum(column).over(
        Window.orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ).cast("bigint")


def bucket_counts(df: DataFrame, value: str, buckets: Buckets, *by: str) -> DataFrame:
    """Rows per bucket number, and per further columns."""
    return df.groupBy(*by, buckets.number(F.col(value)).alias("bucket_no")).agg(F.count("*").alias("orders"))


def histogram(df: DataFrame, value: str, buckets: Buckets) -> DataFrame:
    """Buckets in order, with count, share and cumulative share."""
    counts = bucket_counts(df, value, buckets).withColumn("cum_orders", running("orders", "bucket_no"))
    total = F.sum("orders").over(all_rows())
    return counts.select(
        "bucket_no",
        buckets.label(F.col("bucket_no")).alias("bucket"),
        "orders",
        share(F.col("orders"), total).alias("pct"),
        "cum_orders",
        share(F.col("cum_orders"), total).alias("cum_pct"),
    )


def histogram_of_part(df: DataFrame, value: str, buckets: Buckets, part: str) -> DataFrame:
    """Histogram of the rows where ``part`` is true, with each bucket's share of all rows.

    The outer base comes from the same counts, so the rows are read once.
    """
    counts = bucket_counts(df, value, buckets, part).withColumn("base", F.sum("orders").over(all_rows()))
    kept = counts.filter(part).withColumn("cum_orders", running("orders", "bucket_no"))
    total = F.sum("orders").over(all_rows())
    return kept.select(
        "bucket_no",
        buckets.label(F.col("bucket_no")).alias("bucket"),
        "orders",
        share(F.col("orders"), total).alias("pct"),
        "cum_orders",
        share(F.col("cum_orders"), total).alias("cum_pct"),
        share(F.col("orders"), F.col("base")).alias("pct_of_all"),
    )
