"""The marketplace model derived from a TPC-H-like star schema.

The star tables hold no approval, handover or delivery moments and no scores, so these
are computed from order key, customer key and price by integer arithmetic. All of it is
row-local: no derived table needs a shuffle, except that customers and sellers look up
their nation.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.fixed_values import DELIVERED, SHIPPED, Period
from punctual.sources.model import Calendar, Model

# Declared so that opening a table needs no job to read file footers.
STAR_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
        " l_shipdate timestamp_ntz"
    ),
}

# The star data's own calendar: orders exist on both sides of the period.
STAR_CALENDAR = Calendar(
    period=Period(date(1995, 3, 1), date(2001, 8, 1)),
    stages=Period(date(1997, 12, 1), date(1998, 5, 1)),
    tail=date(2001, 8, 1),
    baseline=date(1998, 10, 1),
)

_SECOND = "INTERVAL '1' SECOND"


def _open(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _cents(money: str) -> str:
    """Whole cents of an amount stored as a double with two decimals."""
    return f"CAST(rint({money} * 100) AS BIGINT)"


def _money(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(12,0)) / 100 AS DECIMAL(10,2))"


def orders(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Orders with their five dates.

    A purchase falls within a day of the stored order date, so bounds on the purchase
    become (wider) bounds on the stored column, which reach the Parquet scan.
    """
    raw = _open(spark, sf_dir, "orders")
    if start is not None:
        raw = raw.filter(F.col("o_orderdate") > F.lit(start - timedelta(days=1)).cast("timestamp_ntz"))
    if end is not None:
        raw = raw.filter(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    return raw.selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        f"IF(o_orderstatus = 'P', '{SHIPPED}', '{DELIVERED}') AS order_status",
        f"{_cents('o_totalprice')} AS p",
        f"o_orderdate + {_SECOND} * (p % 86400) AS order_purchase_timestamp",
        f"IF(order_id % 97 <> 0, order_purchase_timestamp + {_SECOND} * ((p * 7 + order_id) % 172800), NULL)"
        " AS order_approved_at",
        "IF(order_id % 101 <> 0, (p * 13 + order_id * 31) % 1036800 - 3600, NULL) AS handover",
        f"order_purchase_timestamp + {_SECOND} * handover AS order_delivered_carrier_date",
        "CASE WHEN order_id % 100 = 0 THEN 5184000 WHEN order_id % 50 = 0 THEN 2592000"
        " WHEN order_id % 20 = 0 THEN 1296000 ELSE 0 END AS delay",
        f"""IF(order_status = '{DELIVERED}' AND order_id % 89 <> 0,
               order_purchase_timestamp + {_SECOND} * (
                   coalesce(handover, 259200) + (p * 17 + customer_id * 101) % 1382400 - 7200 + delay),
               NULL) AS order_delivered_customer_date""",
        "o_orderdate + INTERVAL '1' DAY * (10 + p % 35) AS order_estimated_delivery_date",
    ).drop("p", "handover", "delay")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customer records to a person, as one person's orders carry different ids."""
    people = _open(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return people.join(F.broadcast(_nations(spark, sf_dir)), "n_nationkey").selectExpr(
        "c_custkey AS customer_id",
        "c_custkey DIV 2 AS customer_unique_id",
        "c_mktsegment AS customer_city",
        "n_name AS customer_state",
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = _open(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return shops.join(F.broadcast(_nations(spark, sf_dir)), "n_nationkey").selectExpr(
        "s_suppkey AS seller_id", "n_name AS seller_state"
    )


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rows at every scale of the star schema, hence safe to broadcast."""
    return _open(spark, sf_dir, "nation").select("n_nationkey", "n_name")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id", "p_type AS product_category_name", "p_size * 100 AS product_weight_g",
        "CAST(IF(p_partkey % 53 = 0, NULL, 10 + p_partkey % 61) AS INT) AS product_length_cm",
        "CAST(2 + p_partkey * 7 % 47 AS INT) AS product_height_cm", "CAST(5 + p_partkey * 13 % 41 AS INT) AS product_width_cm",
    )


def category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category that occurs, but one: its products have no translation."""
    named = _open(spark, sf_dir, "part").filter("p_type <> 'ECONOMY'").select("p_type").distinct()
    return named.selectExpr("p_type AS product_category_name", "lower(p_type) AS product_category_name_english")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line; (order, line) repeats here, a positive case for the key check."""
    return _open(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS order_item_id",
        "l_partkey AS product_id",
        "l_suppkey AS seller_id",
        "l_shipdate AS shipping_limit_date",
        f"{_money(_cents('l_extendedprice'))} AS price",
        f"{_money(_cents('l_extendedprice') + ' % 5000')} AS freight_value",
    )


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment per order; every third order adds a second one."""
    return (
        _open(spark, sf_dir, "orders")
        .selectExpr("*", "IF(o_orderkey % 3 = 0, 2, 1) AS parts")
        .selectExpr("*", "explode(sequence(1, parts)) AS payment_sequential")
        .selectExpr(
            "o_orderkey AS order_id",
            "payment_sequential",
            "element_at(array('credit_card', 'boleto', 'voucher', 'debit_card'),"
            " CAST(1 + (o_orderkey + payment_sequential) % 4 AS INT)) AS payment_type",
            "CAST(1 + o_orderkey % 12 AS INT) AS payment_installments",
            f"{_money(_cents('o_totalprice') + ' DIV parts')} AS payment_value",
        )
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS review_id",
        "l_orderkey AS order_id",
        "CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS INT) AS review_score",
        "l_shipdate AS review_creation_date",
    )


_BUILDERS = {
    "customers": customers,
    "sellers": sellers,
    "products": products,
    "category_translation": category_translation,
    "orders": orders,
    "order_items": order_items,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
}


def star_model(spark: SparkSession, sf_dir: str, calendar: Calendar = STAR_CALENDAR) -> Model:
    """The model over the Parquet files ``sf_dir/<table>.parquet``."""
    return Model(
        opener=lambda table: _BUILDERS[table](spark, sf_dir),
        orders_opener=lambda start, end: orders(spark, sf_dir, start, end),
        calendar=calendar,
    )
