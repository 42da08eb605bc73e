"""Exact percentiles with linear interpolation.

``percentile`` keeps a count per distinct value, which suits whole days and scores: a
few hundred values, combined map-side. A duration in microseconds has about as many
values as rows, and ``group_percentile`` finds its rank by narrowing instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.times import DAY, SECOND


def percentile(column: Column, *points: float) -> Column:
    """Aggregate giving one value per point, as an array; for values of a bounded range."""
    return F.percentile(column, F.array(*map(F.lit, points)))


def group_percentile(
    df: DataFrame,
    key: str,
    measures: Mapping[str, Column],
    point: float,
    widths: Sequence[int] = (DAY, SECOND),
) -> DataFrame:
    """One percentile of several whole-number measures per group; NULLs are skipped."""
    return group_percentiles(df, [key], measures, [point], widths).drop("point")


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    points: Sequence[float],
    widths: Sequence[int] = (DAY, SECOND),
) -> DataFrame:
    """``keys``, ``measure``, ``point``, ``value``: several percentiles of several whole-number
    measures per group; NULLs are skipped, and a NULL key is a group of its own.

    The range is split into cells of ``widths[0]``; rows per cell tell which cells hold the
    ranks of all points. Only rows of those cells are split again, and so on down to single
    values. A cell that several points look for is split once. A task ranks at most the
    cells of one parent cell, so no group, however many rows and values it has, is gathered
    in one place, and only counts are shuffled.

    The cells sought are at most two per group, measure and point; Spark picks the join by
    their size. The passes read the same columns, so they share the shuffles of ``df``.
    """
    rows = (
        df.select(
            *keys,
            F.explode(F.array(*(
                F.struct(F.lit(name).alias("measure"), column.cast("bigint").alias("value"))
                for name, column in measures.items()
            ))).alias("item"),
        )
        .select(*keys, "item.measure", "item.value")
        .filter(F.col("value").isNotNull())
    )
    group = [*keys, "measure"]

    def cell(width: int) -> Column:
        return F.col("value") - F.pmod(F.col("value"), F.lit(width))

    counts = rows.groupBy(*group, cell(widths[0]).alias("start")).agg(F.count("*").alias("n"))
    sums = Window.partitionBy(*group)
    ranked = counts.withColumn("size", F.sum("n").over(sums)).withColumn("upto", F.sum("n").over(sums.orderBy("start")))
    places = F.array(*(
        F.struct(F.lit(float(point)).alias("point"), ((F.col("size") - 1) * F.lit(float(point))).alias("place"))
        for point in points
    ))
    sought = _holding_rank(ranked.withColumn("places", places))

    for outer, inner in zip(widths, (*widths[1:], 1)):
        targets = sought.select(
            *(F.col(name).alias(f"sought_{name}") for name in group),
            F.col("start").alias("parent"),
            (F.col("upto") - F.col("n")).alias("before"),
            "places",
        )
        same = [F.col(name).eqNullSafe(F.col(f"sought_{name}")) for name in group]
        narrowed = rows.join(targets.drop("places"), reduce(Column.__and__, [*same, cell(outer) == F.col("parent")]))
        counts = narrowed.groupBy(*group, "parent", "before", cell(inner).alias("start")).agg(F.count("*").alias("n"))
        within = Window.partitionBy(*group, "parent").orderBy("start")
        ranked = counts.withColumn("upto", F.col("before") + F.sum("n").over(within)).drop("before")
        wanted = targets.drop("before").withColumnRenamed("parent", "sought_parent")
        found = reduce(Column.__and__, [*same, F.col("parent") == F.col("sought_parent")])
        sought = _holding_rank(ranked.join(wanted, found).drop("parent", *wanted.drop("places").columns))

    each = sought.select(*group, "start", "upto", "n", F.inline("places"))
    low = F.max(F.when(_covers(F.floor("place")), F.col("start")))
    high = F.max(F.when(_covers(F.ceil("place")), F.col("start")))
    return each.groupBy(*group, "point", "place").agg(low.alias("low"), high.alias("high")).select(
        *group, "point",
        (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("value"),
    )


def _covers(rank: Column) -> Column:
    """Whether a 0-based rank falls in the row's cell."""
    return (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))


def _holding_rank(ranked: DataFrame) -> DataFrame:
    """Cells holding a neighbour of a place sought, with the places that they hold one of."""
    held = F.filter("places", lambda one: _covers(F.floor(one["place"])) | _covers(F.ceil(one["place"])))
    return ranked.withColumn("places", held).filter(F.size("places") > 0)
