"""Key, reference and NOT NULL checks, run as jobs because Spark does not enforce them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.sources.model import Model
from punctual.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, REQUIRED


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their number of rows.

    A key with a NULL part is always a violation. Rows are counted map-side, so a key
    held by very many rows is no burden.
    """
    incomplete = reduce(lambda a, b: a | b, (F.col(key).isNull() for key in keys))
    return (
        df.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter((F.col("occurrences") > 1) | incomplete)
    )


def missing_parents(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values without a parent row, with the number of child rows; NULL refers to nothing.

    Child values are collapsed before the join, so that a frequent value is one row there.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("occurrences"))
    known = parent.select(F.col(parent_column).alias(column))
    return values.join(known, column, "left_anti")


#: Bits of the filter for each key, bits it has at most (8 MB), and bits that a key sets.
BITS_PER_KEY, MOST_BITS, PROBES = 12, 1 << 26, 4


def key_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """A Bloom filter of the keys as one row: ``words``, an array of ``bits / 64`` numbers.

    ``bits`` is a power of two. The words are gathered on the driver, so their number is bounded by it.
    """
    set_bits = keys.filter(F.col(column).isNotNull()).select(F.explode(F.array(*_probes(column, bits))).alias("bit"))
    words = set_bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")
    )
    filled = [0] * (bits // 64)
    for row in words.toLocalIterator():
        filled[row.word] = row.bits
    return keys.sparkSession.createDataFrame([(filled,)], "words array<bigint>")


def _probes(column: str, bits: int) -> list[Column]:
    return [F.xxhash64(F.col(column), F.lit(probe)).bitwiseAND(F.lit(bits - 1)) for probe in range(PROBES)]


def maybe_named(parent: DataFrame, column: str, words: DataFrame, bits: int) -> DataFrame:
    """Rows whose key the filter may hold: all that it does hold, and few others.

    The one row of words is a scalar subquery, so rows are tested where they are read, without a join.
    """
    held = words.select("words").scalar()

    def is_set(bit: Column) -> Column:
        word = F.element_at(held, (F.shiftright(bit, 6) + 1).cast("int"))
        return F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return parent.filter(reduce(lambda a, b: a & b, map(is_set, _probes(column, bits))))


def missing_parents_of_batch(batch: DataFrame, column: str, parent: DataFrame, parent_column: str,
                             most_bits: int = MOST_BITS) -> DataFrame:
    """As ``missing_parents``, for a batch that is small beside its parents.

    Parent rows that the batch cannot name are dropped where they are read, by a Bloom filter of the batch's
    values, so only the others are shuffled. A filter may pass a key in vain but never
    drops one that it holds, and the anti join decides: the result is exact. The filter has ``BITS_PER_KEY``
    bits for each distinct value up to ``most_bits``; a batch with more passes more parents.
    """
    values = batch.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("occurrences"))
    known = batch_parents(batch, column, parent, parent_column, most_bits).select(F.col(parent_column).alias(column))
    return values.join(known, column, "left_anti")


def batch_parents(batch: DataFrame, column: str, parent: DataFrame, parent_column: str,
                  most_bits: int = MOST_BITS) -> DataFrame:
    """Parent keys that the batch may name. Both columns are of one type."""
    kinds = {dict(batch.dtypes)[column], dict(parent.dtypes)[parent_column]}
    if len(kinds) > 1:
        raise ValueError(f"{column} and {parent_column} differ in type: {sorted(kinds)}")
    keys = batch.select(column).distinct()
    count = keys.count()
    bits = min(most_bits, max(64, 1 << (BITS_PER_KEY * max(1, count) - 1).bit_length()))
    return maybe_named(parent.select(parent_column), parent_column, key_filter(keys, column, bits), bits)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of NULLs in each column."""
    return df.agg(*(F.count_if(F.col(column).isNull()).alias(column) for column in columns))


def _verdict(kind: str, table: str, columns: str, violations: DataFrame) -> DataFrame:
    """One row per constraint: violating keys and the rows they cover."""
    return violations.agg(
        F.lit(kind).alias("kind"),
        F.lit(table).alias("table_name"),
        F.lit(columns).alias("columns"),
        F.count("*").alias("violating_keys"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).cast("bigint").alias("violating_rows"),
    ).withColumn("holds", F.col("violating_keys") == 0)


def newest(model: Model) -> dict[str, DataFrame]:
    """What the model's calendar calls its tail, as the batch of each table that has a date."""
    start = F.lit(model.calendar.tail).cast("timestamp_ntz")
    dates = {"orders": "order_purchase_timestamp", "order_items": "shipping_limit_date", "order_reviews": "review_creation_date"}
    return {table: model[table].filter(F.col(moment) >= start) for table, moment in dates.items()}


def newest_report(model: Model) -> DataFrame:
    """The references of the newest rows."""
    return batch_report(model, newest(model))


def batch_report(model: Model, batches: dict[str, DataFrame]) -> DataFrame:
    """One row for each foreign key of the tables that have a new batch, checked against the whole model."""
    return reduce(
        DataFrame.unionByName,
        (
            _verdict(
                "foreign key of a batch", table, column, missing_parents_of_batch(batches[table], column, model[parent], key)
            )
            for (table, column), (parent, key) in FOREIGN_KEYS.items()
            if table in batches
        ),
    )


def primary_key_report(model: Model) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        (
            _verdict("primary key", table, ",".join(keys), repeated_keys(model[table], keys))
            for table, keys in PRIMARY_KEYS.items()
        ),
    )


def foreign_key_report(model: Model) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        (
            _verdict("foreign key", table, column, missing_parents(model[table], column, model[parent], key))
            for (table, column), (parent, key) in FOREIGN_KEYS.items()
        ),
    )


def not_null_report(model: Model) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        (
            model[table].agg(
                F.lit("not null").alias("kind"),
                F.lit(table).alias("table_name"),
                F.lit(column).alias("columns"),
                F.count_if(F.col(column).isNull()).alias("violating_rows"),
            ).withColumn("holds", F.col("violating_rows") == 0)
            for table, columns in REQUIRED.items()
            for column in columns
        ),
    )
