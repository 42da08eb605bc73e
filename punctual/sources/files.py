"""CSV in, Parquet at rest, sheets out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from punctual.sources.model import Calendar, Model
from punctual.sources.schemas import SCHEMAS

# File name of each table; pass another mapping for files named differently.
CSV_FILES = {table: f"{table}.csv" for table in SCHEMAS}

# Only review comments may hold line breaks; every other table stays splittable.
MULTILINE_TABLES = frozenset({"order_reviews"})

# How fields are quoted, and how an empty field differs from a quoted empty one.
CSV_DIALECT = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000"}


def parsed_whole(rows: DataFrame) -> DataFrame:
    """The same rows of a CSV, with every field of every row converted whatever a query asks for.

    Spark converts only the columns in use, so a bad field may pass unseen: the hash, which is
    always at least the least long, uses them all. It also leaves a row that a pushed filter
    rules out half read. A filter on a column that is coalesced with itself cannot be pushed
    into the parser, so no setting of the session is needed.
    """
    whole = rows.filter(F.xxhash64(*(F.col(name) for name in rows.columns)) >= F.lit(-(1 << 63)))
    return whole.select(*(F.coalesce(F.col(name), F.col(name)).alias(name) for name in rows.columns))


def load_csv(spark: SparkSession, path: str, table: str, multiline: bool | None = None) -> DataFrame:
    """Read a headed CSV by column position with the declared types.

    A malformed row fails whatever reads the table, a count included. An empty field is NULL, a
    quoted empty field is ''. A file read with ``multiline`` cannot be split, so convert it to Parquet once;
    ``path`` may be a folder of files, which are then read side by side.
    """
    return parsed_whole(
        spark.read.schema(SCHEMAS[table])
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", table in MULTILINE_TABLES if multiline is None else multiline)
        .options(**CSV_DIALECT)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def csv_to_parquet(spark: SparkSession, csv_dir: str, parquet_dir: str,
                   files: Mapping[str, str] = CSV_FILES, multiline: Mapping[str, bool] | None = None) -> None:
    """Replace the Parquet copy of every table with the content of its CSV.

    ``multiline`` says for a table whether its quoted fields may hold line breaks.
    """
    for table, name in files.items():
        load_csv(spark, f"{csv_dir}/{name}", table, (multiline or {}).get(table)).write.mode("overwrite").parquet(f"{parquet_dir}/{table}")


def parquet_model(spark: SparkSession, parquet_dir: str, calendar: Calendar = Calendar(),
                  schemas: Mapping[str, StructType] = SCHEMAS) -> Model:
    """Tables written by ``csv_to_parquet``, or others in folders of their names with their own ``schemas``."""
    return Model(
        lambda table: spark.read.schema(schemas[table]).parquet(f"{parquet_dir}/{table}"),
        calendar=calendar,
    )


def csv_model(spark: SparkSession, csv_dir: str, files: Mapping[str, str] = CSV_FILES,
              calendar: Calendar = Calendar(), multiline: Mapping[str, bool] | None = None) -> Model:
    """Tables read straight from CSV; ``multiline`` as in ``csv_to_parquet``."""
    lines = multiline or {}
    return Model(lambda table: load_csv(spark, f"{csv_dir}/{files[table]}", table, lines.get(table)), calendar=calendar)


def check_format(fmt: str) -> None:
    """Refuse a sheet format that can't be written."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown sheet format: {fmt}")


def read_sheet(spark: SparkSession, schema: StructType, path: str, fmt: str = "csv") -> DataFrame:
    """A sheet as ``write_sheet`` left it; a malformed row fails the read."""
    check_format(fmt)
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
    return parsed_whole(reader.option("mode", "FAILFAST").csv(path))


def write_sheet(sheet: DataFrame, path: str, fmt: str = "csv", one_file: bool = False) -> None:
    """Write a dashboard sheet.

    ``one_file`` is for summaries (one row per month or region); a sheet with a row per
    order is written by all its tasks.
    """
    check_format(fmt)
    writer = (sheet.coalesce(1) if one_file else sheet).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.parquet(path)
