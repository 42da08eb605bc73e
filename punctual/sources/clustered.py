"""Tables sorted across files by the column that queries filter on, with the range each file holds.

A table written as it comes has every value range in every file, so that Parquet's statistics
rule nothing out. Sorted by range, a month of purchases lies in a few files and, inside them, in a few
row groups. The range of each file is kept beside the table, so that a query opens no
other file at all; the filter on the stored column then skips row groups within these.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from punctual.operators.sample import PURCHASE
from punctual.sources.files import parquet_model
from punctual.sources.model import Calendar, Model
from punctual.sources.schemas import SCHEMAS

#: Folder of the file ranges; Spark leaves names with an underscore out when it reads the table.
RANGES = "_ranges"

#: What each table is sorted by: what its queries filter or join by first.
ORDER_OF: Mapping[str, Sequence[str]] = {
    "orders": (PURCHASE, "order_id"),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("order_id", "review_creation_date"),
    "customers": ("customer_id",),
    "sellers": ("seller_id",),
    "products": ("product_id",),
    "category_translation": ("product_category_name",),
}


def write_clustered(df: DataFrame, path: str, by: Sequence[str], files: int | None = None) -> None:
    """Replace the table at ``path`` by the rows sorted by ``by`` over files and within them.

    ``files`` is about the number of files; without it Spark's shuffle partitions decide. The ranges are
    those of the first column of ``by``. A value that very many rows share fills one
    file, unless a later column of ``by`` tells its rows apart: name one that does.
    """
    spread = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    ranges = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(by[0]).alias("least"), F.max(by[0]).alias("most"), F.count("*").alias("rows"),
        F.count_if(F.col(by[0]).isNull()).alias("nulls"),
    )
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/{RANGES}")


def file_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``least``, ``most``, ``rows``, ``nulls`` of each file of a clustered table."""
    return spark.read.parquet(f"{path}/{RANGES}")


def read_clustered(spark: SparkSession, path: str, schema: StructType, column: str, start=None, end=None) -> DataFrame:
    """Rows with ``column`` in ``[start, end)``, either of which may be None, from the files that can hold one.

    ``column`` is the first that the table was sorted by. Rows without a value are read only if there is no
    bound. Only the names of these files come to the driver, which lists every file of a
    table it reads anyway.
    """
    if start is None and end is None:
        return spark.read.schema(schema).parquet(path)
    kind = schema[column].dataType
    bounds = []
    if start is not None:
        bounds.append((F.col("most") >= F.lit(start).cast(kind), F.col(column) >= F.lit(start).cast(kind)))
    if end is not None:
        bounds.append((F.col("least") < F.lit(end).cast(kind), F.col(column) < F.lit(end).cast(kind)))
    held = file_ranges(spark, path)
    for on_file, _ in bounds:
        held = held.filter(on_file)
    files = [f"{path}/{row.file}" for row in held.select("file").collect()]
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    for _, on_row in bounds:
        rows = rows.filter(on_row)
    return rows


def cluster_tables(model: Model, path: str, files: int | None = None, order: Mapping[str, Sequence[str]] = ORDER_OF) -> None:
    """Replace the tables under ``path`` by those of the model, each sorted by its columns of ``order``."""
    for table in model.tables:
        write_clustered(model[table], f"{path}/{table}", order[table], files)


def clustered_model(spark: SparkSession, path: str, calendar: Calendar = Calendar(),
                    schemas: Mapping[str, StructType] = SCHEMAS) -> Model:
    """Tables written by ``cluster_tables``; queries open only the orders' files of their months."""

    def orders_opener(start: date | None, end: date | None) -> DataFrame:
        return read_clustered(spark, f"{path}/orders", schemas["orders"], PURCHASE, start, end)

    return replace(parquet_model(spark, path, calendar, schemas), orders_opener=orders_opener)
