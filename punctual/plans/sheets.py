"""The three dashboard sheets and their reconciliation."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.fixed_values import SHEET_SUFFIX
from punctual.functions import Buckets
from punctual.operators import metrics, reconcile
from punctual.plans.prepared import prepare
from punctual.plans.reviews import with_review
from punctual.plans.sla import sample
from punctual.sources.files import check_format, read_sheet, write_sheet
from punctual.sources.model import Model

SHEET_BUCKETS = Buckets(suffix=SHEET_SUFFIX)


def order_sheet(model: Model) -> DataFrame:
    """One row per delivered order, with or without a review."""
    number = SHEET_BUCKETS.number(F.col("delivery_days"))
    return with_review(model, "left").select(
        "order_id",
        "purchase_month",
        "customer_state",
        "delivery_days",
        "days_vs_estimate",
        "is_late",
        "promise_days",
        "review_score",
        SHEET_BUCKETS.label(number).alias("bucket"),
        number.alias("bucket_no"),
    )


def month_sheet(model: Model, partial_from: date | None = None) -> DataFrame:
    """Summary per month; ``partial_from`` marks the months from there on as incomplete."""
    summary = metrics.sla_summary(with_review(model, "left"), "purchase_month", cushion=True, scored=True)
    if partial_from is not None:
        summary = summary.withColumn("is_partial_month", F.col("purchase_month") >= F.lit(partial_from))
    return summary.orderBy(F.asc_nulls_last("purchase_month"))


def state_sheet(model: Model) -> DataFrame:
    """Summary per state, largest first."""
    summary = metrics.sla_summary(with_review(model, "left"), "customer_state", scored=True)
    return summary.orderBy(F.desc("orders_count"), F.asc_nulls_last("customer_state"))


def reconciliation(model: Model) -> DataFrame:
    """Totals computed four ways; the first three share one join.

    The last counts the orders themselves, also where the sample is prepared, as a prepared
    sample would only be compared with itself.
    """
    return reconcile.reconcile_sheets(with_review(model, "left"), sample(replace(model, prepared=None)))


def export(model: Model, path: str, fmt: str = "csv") -> DataFrame:
    """Write the sheets, then reconcile what was written with the sample.

    The sample is written first, unless it is prepared already, so that the three sheets
    share its joins. Totals are read back from the sheets' files, and the sample is
    counted from the orders again.
    """
    check_format(fmt)
    spark = model["orders"].sparkSession
    ready = model if model.prepared is not None else prepare(model, f"{path}/sample")
    sheets = {"orders": order_sheet(ready), "months": month_sheet(ready), "states": state_sheet(ready)}
    for name, sheet in sheets.items():
        write_sheet(sheet, f"{path}/{name}", fmt, one_file=name != "orders")
    written = {name: read_sheet(spark, sheet.schema, f"{path}/{name}", fmt) for name, sheet in sheets.items()}
    return reconcile.reconcile({
        "flat table of orders": reconcile.order_totals(written["orders"]),
        "total by month": reconcile.totals(written["months"]),
        "total by state": reconcile.totals(written["states"]),
        "delivered_orders": reconcile.order_totals(sample(replace(model, prepared=None))),
    })
