"""Queries over items, products, sellers, payments and people.

Where the result has a row per order, the many side is collapsed before it meets the orders, so a
join never multiplies them. Results over items (sellers, products, lanes) join the items as rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions import Buckets, rounded, share
from punctual.functions.times import DAY, micros
from punctual.operators import metrics
from punctual.operators.percentiles import percentile
from punctual.operators.sample import APPROVED, CARRIER
from punctual.plans.sla import sample
from punctual.sources.model import Model

# Grams and cubic centimetres of all items of an order.
WEIGHT_BUCKETS = Buckets(edges=(1000, 2500, 5000, 10000, 20000))
VOLUME_BUCKETS = Buckets(edges=(20000, 50000, 100000, 150000, 250000))


def order_freight(model: Model) -> DataFrame:
    """Freight is charged per line; an order's freight is the sum."""
    return model["order_items"].groupBy("order_id").agg(
        F.count("*").alias("items"), F.sum("freight_value").cast("decimal(18,2)").alias("freight")
    )


def seller_handover(model: Model) -> DataFrame:
    """Items a seller handed to the carrier after the shipping limit."""
    handed = model["orders"].select("order_id", CARRIER).filter(F.col(CARRIER).isNotNull())
    late = F.count_if(F.col(CARRIER) > F.col("shipping_limit_date"))
    return (
        model["order_items"]
        .select("order_id", "seller_id", "shipping_limit_date")
        .join(handed, "order_id")
        .groupBy("seller_id")
        .agg(
            F.count("*").alias("items"), late.alias("late_items"), share(late, F.count("*")).alias("late_items_pct")
        )
    )


def translated_categories(model: Model) -> DataFrame:
    """Products per category, with the English name where there is one."""
    counts = model["products"].groupBy("product_category_name").agg(F.count("*").alias("products"))
    return counts.join(model["category_translation"], "product_category_name", "left").select(
        "product_category_name", "product_category_name_english", "products"
    )


def people(model: Model) -> DataFrame:
    """Orders, customer ids and people; a person may have several ids.

    Orders are counted per customer id before the join, so a busy customer is one row.
    """
    orders = model["orders"].groupBy("customer_id").agg(F.count("*").alias("n"))
    persons = model["customers"].select("customer_id", "customer_unique_id")
    per_person = (
        orders.join(persons, "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.sum("n").alias("n"), F.count("*").alias("ids"))
    )
    return per_person.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orders"),
        F.coalesce(F.sum("ids"), F.lit(0)).cast("bigint").alias("customer_ids"),
        F.count("*").alias("people"),
        F.count_if(F.col("n") > 1).alias("repeat_buyers"),
        share(F.count_if(F.col("n") > 1), F.count("*")).alias("repeat_buyers_pct"),
    )


def delivery_by_weight(model: Model) -> DataFrame:
    """Delivery time by the total weight of the order's items."""
    return _delivery_by(model, "grams", F.col("product_weight_g"), WEIGHT_BUCKETS)


def delivery_by_volume(model: Model) -> DataFrame:
    """Delivery time by the total volume of the order's items, as length by height by width.

    A product that lacks a measure adds nothing; an order of such products alone is in the last bucket.
    """
    sides = (F.col(f"product_{side}_cm").cast("bigint") for side in ("length", "height", "width"))
    return _delivery_by(model, "cubic_cm", reduce(Column.__mul__, sides), VOLUME_BUCKETS)


def _delivery_by(model: Model, name: str, size: Column, buckets: Buckets) -> DataFrame:
    """Delivery time by the sum of a product measure over the order's items."""
    sizes = model["products"].select("product_id", size.alias("size"))
    per_order = (
        model["order_items"]
        .select("order_id", "product_id")
        .join(sizes, "product_id")
        .groupBy("order_id")
        .agg(F.sum("size").alias("size"))
    )
    number = buckets.number(F.col("size")).alias("bucket_no")
    return (
        sample(model).join(per_order, "order_id")
        .groupBy(number)
        .agg(*metrics.delivery_measures())
        .withColumn(name, buckets.label(F.col("bucket_no")))
        .orderBy("bucket_no")
        .drop("bucket_no")
    )


def lanes(model: Model) -> DataFrame:
    """SLA by seller state and customer state; an order counts once per seller state."""
    origins = model["sellers"].select("seller_id", "seller_state")
    shipped_from = (
        model["order_items"]
        .select("order_id", "seller_id")
        .join(origins, "seller_id")
        .select("order_id", "seller_state")
        .distinct()
    )
    return metrics.sla_summary(sample(model).join(shipped_from, "order_id"), "seller_state", "customer_state")


def order_payments(model: Model) -> DataFrame:
    """Payments of an order as one row."""
    return model["order_payments"].groupBy("order_id").agg(
        F.count("*").alias("payments"),
        F.max("payment_installments").alias("installments"),
        F.sum("payment_value").cast("decimal(18,2)").alias("paid"),
    )


def handover_by_payment(model: Model) -> DataFrame:
    """Handovers recorded before approval, by the order's first payment type, and their gap."""
    first_type = (
        model["order_payments"]
        .groupBy("order_id")
        .agg(F.min_by("payment_type", "payment_sequential").alias("payment_type"))
    )
    approved, carrier = F.col(APPROVED), F.col(CARRIER)
    dated = model["orders"].filter(approved.isNotNull() & carrier.isNotNull())
    broken = carrier < approved
    gap = F.when(broken, F.floor(micros(carrier, approved) / F.lit(float(DAY))).cast("int"))
    return (
        dated.select("order_id", APPROVED, CARRIER)
        .join(first_type, "order_id", "left")
        .groupBy("payment_type")
        .agg(
            F.count("*").alias("orders_count"),
            F.count_if(broken).alias("handover_bad"),
            share(F.count_if(broken), F.count("*"), 3).alias("handover_bad_pct"),
            rounded(percentile(gap, 0.5)[0], 2).alias("median_gap_days"),
            F.max(gap).alias("max_gap_days"),
        )
    )


def late_by_handover(model: Model) -> DataFrame:
    """Late orders by whether a seller handed an item over late: the seller's part against transport's."""
    limits = model["order_items"].groupBy("order_id").agg(F.min("shipping_limit_date").alias("shipping_limit"))
    handed = sample(model).select("order_id", "is_late", CARRIER).filter(F.col(CARRIER).isNotNull())
    late = F.count_if("is_late")
    return (
        handed.join(limits, "order_id")
        .groupBy((F.col(CARRIER) > F.col("shipping_limit")).alias("handed_late"))
        .agg(F.count("*").alias("orders"), late.alias("late_orders"), share(late, F.count("*")).alias("late_pct"))
    )
