"""Compare the totals of several summaries of the same orders."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import share
from punctual.operators.histogram import all_rows


def totals(sheet: DataFrame) -> DataFrame:
    """Orders and late orders of a summary that has a row per group; zero of an empty one."""
    return sheet.agg(
        *(
            F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias(column)
            for column in ("orders_count", "late_orders_count")
        )
    )


def order_totals(orders: DataFrame) -> DataFrame:
    """The same of a sheet that has a row per order."""
    return orders.agg(
        F.count("*").alias("orders_count"), F.count_if(F.col("is_late")).alias("late_orders_count")
    )


def reconcile(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named total, its late share, and whether all rows agree."""
    stacked = reduce(
        DataFrame.unionByName, (total.withColumn("check_name", F.lit(name)) for name, total in checks.items())
    )
    return compare(stacked)


def compare(stacked: DataFrame) -> DataFrame:
    """``agree`` is true where every row has the same two totals, none of them NULL."""
    same = [
        (F.min(column).over(all_rows()) == F.max(column).over(all_rows()))
        & (F.count(column).over(all_rows()) == F.count("*").over(all_rows()))
        for column in ("orders_count", "late_orders_count")
    ]
    return stacked.select(
        "check_name",
        "orders_count",
        "late_orders_count",
        share(F.col("late_orders_count"), F.col("orders_count")).alias("late_orders_pct"),
        F.coalesce(same[0] & same[1], F.lit(False)).alias("agree"),
    )


def reconcile_sheets(joined: DataFrame, sample: DataFrame, month: str = "purchase_month",
                     state: str = "customer_state") -> DataFrame:
    """Totals of the order sheet, of its month and state summaries, and of the sample.

    ``joined`` is the sample left-joined with one review per order. The first three rows
    come from one pass over it: its counts by month and state, of which the grouping sets
    are made. The last row counts the sample without the join, so equal totals prove that the
    join multiplied nothing.
    """
    which = F.grouping_id().alias("level")
    counts = joined.groupBy(month, state).agg(
        F.count("*").alias("orders_count"), F.count_if(F.col("is_late")).alias("late_orders_count")
    )
    groups = counts.groupingSets([[], [F.col(month)], [F.col(state)]], F.col(month), F.col(state)).agg(
        which, F.sum("orders_count").alias("orders_count"), F.sum("late_orders_count").alias("late_orders_count")
    )
    # grouping_id has a bit per column left out: 3 = neither column, 1 = by month, 2 = by state.
    levels = {"flat table of orders": 3, "total by month": 1, "total by state": 2}

    def total(column: str, level: int):
        counted = F.sum(F.when(F.col("level") == level, F.col(column)))
        return F.coalesce(counted, F.lit(0)).cast("bigint").alias(column)

    summed = groups.agg(F.array(*(
        F.struct(
            F.lit(name).alias("check_name"), total("orders_count", level), total("late_orders_count", level)
        )
        for name, level in levels.items()
    )).alias("checks")).select(F.inline("checks"))
    source = order_totals(sample).withColumn("check_name", F.lit("delivered_orders"))
    return compare(summed.unionByName(source))
