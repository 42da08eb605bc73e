"""Queries over tables that are laid out, brought up to date or published first.

Each writes what it needs into a new folder under ``spark.checkpoint.dir`` and then asks it.
"""

from __future__ import annotations

from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import month_of
from punctual.operators.sample import PURCHASE, bought_in
from punctual.plans import lines, publish, sheets
from punctual.plans.prepared import prepare, refresh
from punctual.session import scratch_folder
from punctual.sources.bucketed import bucket_tables, bucketed_model
from punctual.sources.clustered import ORDER_OF, read_clustered, write_clustered
from punctual.sources.files import CSV_DIALECT, load_csv
from punctual.sources.model import Model
from punctual.sources.rejects import bad_rows
from punctual.sources.schemas import SCHEMAS

#: Months whose orders come after the sample was written.
LATE_MONTHS = 2


def _folder(model: Model, name: str) -> str:
    return f"{scratch_folder(model['orders'].sparkSession)}/{name}-{uuid4().hex}"


def refreshed_months(model: Model) -> DataFrame:
    """The month sheet over a sample that was written before the period's last orders came, and then refreshed."""
    spark, path = model["orders"].sparkSession, _folder(model, "refreshed")
    last = F.add_months(F.lit(model.calendar.period.end), -LATE_MONTHS).cast("timestamp_ntz")
    late = F.col(PURCHASE) >= last

    def early(rows: DataFrame) -> DataFrame:
        return rows.filter(~late)

    near, placed = model.orders_opener, model.placed
    before = replace(
        model,
        opener=lambda table: early(model[table]) if table == "orders" else model[table],
        orders_opener=None if near is None else lambda start, end: early(near(start, end)),
        placed=None if placed is None else lambda: early(placed()),
        prepared=None,
    )
    prepare(before, path)
    model["orders"].filter(late).select("order_id").write.parquet(f"{path}-batch")
    return sheets.month_sheet(refresh(model, path, spark.read.parquet(f"{path}-batch")))


def clustered_months(model: Model) -> DataFrame:
    """Orders of the stage period by month and status, from the files of a clustered table that can hold them."""
    spark, path, orders = model["orders"].sparkSession, _folder(model, "clustered"), model["orders"]
    write_clustered(orders, path, ORDER_OF["orders"])
    months = model.calendar.stages
    held = read_clustered(spark, path, orders.schema, PURCHASE, months.start, months.end).filter(bought_in(months.start, months.end))
    return held.groupBy(month_of(F.col(PURCHASE)).alias("purchase_month"), "order_status").agg(F.count("*").alias("orders_count"))


def _bucketed(model: Model, *tables: str) -> Model:
    """The tables in buckets, as many as the session has shuffle partitions."""
    spark, path = model["orders"].sparkSession, _folder(model, "bucketed")
    bucket_tables(replace(model, tables=tables), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return bucketed_model(spark, path, model.calendar, {table: model[table].schema for table in tables})


def bucketed_handover(model: Model) -> DataFrame:
    """Late handovers by seller over tables that are bucketed by order: the join shuffles nothing."""
    return lines.seller_handover(_bucketed(model, "orders", "order_items"))


def bucketed_months(model: Model) -> DataFrame:
    """The month sheet over bucketed orders and reviews."""
    bucketed = _bucketed(model, "orders", "order_reviews")
    return sheets.month_sheet(replace(bucketed, opener=lambda table: model[table] if table == "customers" else bucketed[table]))


def _payments_csv(model: Model, name: str, *columns) -> str:
    """The payments written as CSV files, with some columns put in place of their own."""
    path = _folder(model, name)
    payments = model["order_payments"].select(*SCHEMAS["order_payments"].names).withColumns(dict(columns))
    payments.write.option("header", True).options(**{k: v for k, v in CSV_DIALECT.items() if k in ("quote", "escape")}).csv(path)
    return path


def loaded_payments(model: Model) -> DataFrame:
    """Payments by type, from CSV files that the typed load reads back."""
    path = _payments_csv(model, "payments")
    loaded = load_csv(model["order_payments"].sparkSession, path, "order_payments")
    return loaded.groupBy("payment_type").agg(
        F.count("*").alias("payments"), F.max("payment_installments").alias("installments"),
        F.sum("payment_value").cast("decimal(18,2)").alias("paid"),
    )


def rejected_payments(model: Model) -> DataFrame:
    """Faults found in CSV files in which payments of some numbers of installments have a number or an amount spoilt."""
    installments = F.col("payment_installments")
    path = _payments_csv(
        model, "spoilt",
        ("payment_sequential", F.when(installments == 5, F.lit("first")).otherwise(F.col("payment_sequential").cast("string"))),
        ("payment_value", F.when(installments == 7, F.lit("1.2.3")).otherwise(F.col("payment_value").cast("string"))),
    )
    found = bad_rows(model["order_payments"].sparkSession, path, "order_payments")
    return found.groupBy("column_name", "value", "reason").agg(F.count("*").alias("faults"))


def published_states(model: Model) -> DataFrame:
    """The state sheet as a reader of the published sheets gets it."""
    path = _folder(model, "published")
    publish.publish(model, path, "parquet")
    return publish.published(model, path)["states"]
