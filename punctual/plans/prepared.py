"""Write the working sample once, for a run over many queries, and keep it up to date.

Every SLA query reads the sample, and building it joins orders with customers and with
reviews. Written out, it takes those two joins once; a query then reads the few columns
it uses, skips the months it does not need, and shuffles nothing but its counts.
"""

from __future__ import annotations

from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from punctual.operators.latest import review_per_order
from punctual.plans.sla import sample
from punctual.session import remove, scratch_folder
from punctual.sources.model import Model


MONTH = "purchase_month"


def facts(model: Model) -> DataFrame:
    """The sample with the score of one review per order."""
    scores = review_per_order(model["order_reviews"]).select(
        "order_id", "review_score", F.lit(True).alias("has_review")
    )
    return sample(replace(model, prepared=None)).join(scores, "order_id", "left").withColumn(
        "has_review", F.coalesce("has_review", F.lit(False))
    )


def _by_month(rows: DataFrame) -> DataFrameWriter:
    """The rebalance lets Spark split a month that holds a large part of the rows over several
    tasks, and merge small ones."""
    return rows.hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH)


def prepare(model: Model, path: str | None = None) -> Model:
    """Write the sample, with the score of one review per order, and return a model reading it.

    Without a path it goes to a new folder under ``spark.checkpoint.dir``.
    Files are laid out by month.
    """
    spark = model["orders"].sparkSession
    path = path or f"{scratch_folder(spark)}/sample-{uuid4().hex}"
    rows = facts(model)
    _by_month(rows).parquet(path)
    return _reading(model, path, rows.schema)


def _reading(model: Model, path: str, schema: StructType) -> Model:
    spark = model["orders"].sparkSession
    return replace(model, prepared=lambda: spark.read.schema(schema).parquet(path))


def _only(model: Model, ids: DataFrame) -> Model:
    """The model with no other orders and reviews than those of the ids."""

    def kept(rows: DataFrame) -> DataFrame:
        return rows.join(ids, "order_id", "left_semi")

    near = model.orders_opener
    return replace(
        model,
        opener=lambda table: kept(model[table]) if table in ("orders", "order_reviews") else model[table],
        orders_opener=None if near is None else lambda start, end: kept(near(start, end)),
        placed=None if model.placed is None else lambda: kept(model.placed()),
    )


def refresh(model: Model, path: str, changed: DataFrame) -> Model:
    """Bring the sample at ``path`` up to date with a model in which some orders are new, changed or gone.

    ``changed`` names them in a column ``order_id``; an order counts as changed with its dates, state, customer
    or reviews, and may move to another month, enter the sample or leave it. The result is that of
    ``prepare`` over the model. Only these orders are joined anew, and only the months that
    hold one, before or after, are written; files of other months stay as they are.

    New rows are staged first, so the tables are read while nothing is being replaced. Months are
    replaced one after the other: a run that ends midway leaves some months new and some old,
    and another run with the same ``changed`` ends in the same sample.
    """
    spark = model["orders"].sparkSession
    stage = f"{scratch_folder(spark)}/refresh-{uuid4().hex}"
    changed.select("order_id").filter(F.col("order_id").isNotNull()).distinct().write.parquet(f"{stage}/ids")
    ids = spark.read.parquet(f"{stage}/ids")
    fresh = facts(_only(model, ids))
    schema = fresh.schema
    fresh.write.parquet(f"{stage}/fresh")
    fresh = spark.read.schema(schema).parquet(f"{stage}/fresh")
    held = spark.read.schema(schema).parquet(path)
    before = held.join(ids, "order_id", "left_semi").select(MONTH)
    # At most as many rows as the period has months.
    touched = [row[0] for row in before.unionByName(fresh.select(MONTH)).distinct().collect()]
    if not touched:
        return _reading(model, path, schema)
    rest = held.filter(F.col(MONTH).isin(touched)).join(ids, "order_id", "left_anti")
    _by_month(rest.unionByName(fresh)).parquet(f"{stage}/months")
    staged = spark.read.schema(schema).parquet(f"{stage}/months")
    _by_month(staged).option("partitionOverwriteMode", "dynamic").parquet(path)
    left = {row[0] for row in staged.select(MONTH).distinct().collect()}
    for month in set(touched) - left:
        # No row of this month is left, so nothing has replaced its files.
        remove(spark, f"{path}/{MONTH}={month}")
    remove(spark, stage)
    return _reading(model, path, schema)
