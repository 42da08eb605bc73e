"""Tables bucketed by order, so that joins and windows on the order need no shuffle.

Orders, items, payments and reviews all meet on the order id. Written once into the same number of
buckets of that id, they are joined bucket by bucket as they are read. Orders take their
customer's state and city along, as that join, on another key, would shuffle them again.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from punctual.operators.sample import CUSTOMER_FOUND
from punctual.sources.files import parquet_model
from punctual.sources.model import Calendar, Model
from punctual.sources.schemas import SCHEMAS

KEY = "order_id"
#: Tables that are bucketed; the others are written as they are.
BY_ORDER = ("orders", "order_items", "order_payments", "order_reviews")
PLACES = ("customer_state", "customer_city")


def with_places(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer's state and city, and whether there is one."""
    places = customers.select("customer_id", *PLACES).withColumn(CUSTOMER_FOUND, F.lit(True))
    placed = orders.join(places, "customer_id", "left").withColumn(CUSTOMER_FOUND, F.coalesce(CUSTOMER_FOUND, F.lit(False)))
    return placed.select(*orders.columns, *PLACES, CUSTOMER_FOUND)


def _name(path: str, table: str) -> str:
    """Name in the catalog; another path is another table."""
    return f"by_order_{zlib.crc32(path.encode()):08x}_{table}"


def bucket_tables(model: Model, path: str, buckets: int) -> None:
    """Replace the tables under ``path`` by those of the model, with ``buckets`` buckets of the order id.

    Rows of a bucket go to one file, sorted by order. All rows of one order are in one bucket, and a join that
    needs no shuffle cannot split them, so this suits tables in which an order has few rows;
    ``constraints.repeated_keys`` tells. Choose the number so that a bucket fits a task.
    """
    spark = model["orders"].sparkSession
    for table in model.tables:
        rows = with_places(model["orders"], model["customers"]) if table == "orders" else model[table]
        place = f"{path}/{table}"
        if table in BY_ORDER:
            rows.repartition(buckets, KEY).write.mode("overwrite").format("parquet").option("path", place).bucketBy(
                buckets, KEY
            ).sortBy(KEY).saveAsTable(_name(path, table))
        else:
            rows.write.mode("overwrite").parquet(place)
    layout = [(table, buckets if table in BY_ORDER else 0) for table in model.tables]
    spark.createDataFrame(layout, "table_name string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")


def _open(spark: SparkSession, path: str, table: str, buckets: int) -> DataFrame:
    """A bucketed table, entered in this session's catalog if another session wrote it."""
    name, place = _name(path, table), f"{path}/{table}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in spark.read.parquet(place).schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY})"
            f" INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)


def bucketed_model(spark: SparkSession, path: str, calendar: Calendar = Calendar(),
                   schemas: Mapping[str, StructType] = SCHEMAS) -> Model:
    """Tables written by ``bucket_tables``, in this session or another."""
    layout = {row.table_name: row.buckets for row in spark.read.parquet(f"{path}/_layout").collect()}
    plain = parquet_model(spark, path, calendar, schemas)

    def opener(table: str) -> DataFrame:
        if not layout[table]:
            return plain[table]
        return _open(spark, path, table, layout[table]).drop(*(PLACES + (CUSTOMER_FOUND,) if table == "orders" else ()))

    return replace(
        plain, tables=tuple(layout), opener=opener, placed=lambda: _open(spark, path, "orders", layout["orders"])
    )
