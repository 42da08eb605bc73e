"""Profiles of raw tables: sizes, spans, shares, missing values, chronology, repeats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.fixed_values import SAME_ORDER, SEVERAL_ORDERS
from punctual.functions import share


def row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Rows of each table beside the expected number."""
    return reduce(
        DataFrame.unionByName,
        (
            table.agg(
                F.lit(name).alias("table_name"),
                F.count("*").alias("rows"),
                F.lit(expected.get(name)).cast("bigint").alias("expected"),
            )
            for name, table in tables.items()
        ),
    ).withColumn("ok", F.col("rows") == F.col("expected"))


def date_span(df: DataFrame, moment: str, first: str, last: str) -> DataFrame:
    """Earliest and latest date."""
    return df.agg(F.to_date(F.min(moment)).alias(first), F.to_date(F.max(moment)).alias(last))


def value_shares(df: DataFrame, column: str, count: str = "orders_count", pct: str = "pct") -> DataFrame:
    """Rows per value and their share of all rows; the window runs over the grouped rows."""
    everything = Window.partitionBy()
    return (
        df.groupBy(column)
        .agg(F.count("*").alias(count))
        .withColumn(pct, share(F.col(count), F.sum(count).over(everything)))
    )


def null_profile(df: DataFrame, by: str, columns: Mapping[str, str], count: str = "orders_count") -> DataFrame:
    """Missing values per group; ``columns`` maps an output name to the column it counts."""
    counted = df.groupBy(by).agg(
        F.count("*").alias(count),
        *(F.count_if(F.col(column).isNull()).alias(name) for name, column in columns.items()),
    )
    shares = [
        part
        for name in columns
        for part in (F.col(name), share(F.col(name), F.col(count)).alias(f"{name}_pct"))
    ]
    return counted.select(by, count, *shares)


@dataclass(frozen=True)
class Order:
    """A rule ``earlier <= later``, with the names of its violation and base counts."""

    name: str
    earlier: str
    later: str
    base: str

    def broken(self) -> Column:
        return F.count_if(F.col(self.later) < F.col(self.earlier)).alias(self.name)

    def eligible(self, untested: Sequence[str] = ()) -> Column:
        """Rows that have both moments; a column listed in ``untested`` may be NULL."""
        tested = [F.col(c).isNotNull() for c in (self.earlier, self.later) if c not in untested]
        return F.count_if(reduce(Column.__and__, tested)).alias(self.base)


def chronology(df: DataFrame, rules: Sequence[Order], digits: int = 3,
               untested: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row: violations, eligible rows and percentage of each rule, in one pass.

    ``untested`` maps a base name to columns that may be NULL in it.
    """
    loose = untested or {}
    counted = df.agg(*(e for rule in rules for e in (rule.broken(), rule.eligible(loose.get(rule.base, ())))))
    return counted.select(*(
        part
        for rule in rules
        for part in (
            F.col(rule.name),
            F.col(rule.base),
            share(F.col(rule.name), F.col(rule.base), digits).alias(f"{rule.name}_pct"),
        )
    ))


def multiplicity(df: DataFrame, *keys: str) -> DataFrame:
    """One row: all rows, keys that occur once, keys that repeat."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
            F.count_if(F.col("n") == 1).alias("once"),
            F.count_if(F.col("n") > 1).alias("repeated"),
        )
    )


def repeat_pattern(df: DataFrame, key: str, within: str, several: str = SEVERAL_ORDERS,
                   same: str = SAME_ORDER) -> DataFrame:
    """Repeated keys, by whether their rows have several different values of ``within``.

    Only "more than one value" matters, and that is min < max: two values kept per key,
    and one shuffle, where counting distinct values takes two.
    """
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"), F.min(within).alias("least"), F.max(within).alias("most"))
        .filter(F.col("n") > 1)
        .groupBy(F.when(F.col("least") < F.col("most"), several).otherwise(same).alias("pattern"))
        .agg(F.count("*").alias("review_ids"))
    )


def distinct_counts(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], count: str = "rows") -> DataFrame:
    """Rows of each group and number of distinct values of each column; NULL is no value.

    ``columns`` maps an output name to the column it counts. In the first step rows are reduced
    to one for each group, column and value, in the tasks and then by these three, so that even a
    group with most of the rows is spread over all tasks. The second step adds up counts. All
    columns go through the same two shuffles; values are compared as text, which tells apart all that
    numbers, dates, moments, booleans and texts can hold. A NULL key is a group of its own.
    """
    items = [F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))]
    items += [
        F.struct(F.lit(name).alias("name"), F.col(column).cast("string").alias("value")) for name, column in columns.items()
    ]
    single = (
        df.select(*by, F.explode(F.array(*items)).alias("item"))
        .filter(F.col("item.name").isNull() | F.col("item.value").isNotNull())
        .groupBy(*by, "item.name", "item.value")
        .agg(F.count("*").alias("n"))
    )
    return single.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("name").isNull(), F.col("n"))), F.lit(0)).alias(count),
        *(F.count_if(F.col("name") == name).alias(name) for name in columns),
    )
