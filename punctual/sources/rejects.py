"""Which rows of a CSV cannot be loaded, and why: file, line, column and value of each.

A load stops at the first bad row. This report finds all of them in one run and leaves the rest loadable.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from punctual.sources.files import CSV_DIALECT, CSV_FILES, MULTILINE_TABLES
from punctual.sources.schemas import SCHEMAS

#: Name of the column in which Spark leaves a row that it can't convert.
BROKEN = "_broken"
#: Lines that are numbered together within a file.
RUN = 4096


def bad_rows(spark: SparkSession, path: str, table: str, multiline: bool | None = None,
             schemas: Mapping[str, StructType] = SCHEMAS) -> DataFrame:
    """``file``, ``line``, ``column_name``, ``value``, ``reason`` of whatever ``load_csv`` would stop at.

    One row for each field that does not have its column's type, and one, without a column and with the whole
    line, for a line with another number of fields. Lines are counted from 1, the header, which is not
    checked, included. ``path`` may be a folder; lines are counted in each file.

    Where quoted fields may hold line breaks (``multiline``), a file is read by one task, and ``line`` is the one
    that the record starts at; blank lines outside of records are not counted there. Otherwise files
    are read in splits, side by side.
    """
    schema = schemas[table]
    many = table in MULTILINE_TABLES if multiline is None else multiline
    return _bad_records(spark, path, schema) if many else _bad_lines(spark, path, schema)


def bad_rows_of_all(spark: SparkSession, csv_dir: str, files: Mapping[str, str] = CSV_FILES,
                    multiline: Mapping[str, bool] | None = None) -> DataFrame:
    """The bad rows of every table, with ``table_name``."""
    found = None
    for table, name in files.items():
        own = bad_rows(spark, f"{csv_dir}/{name}", table, (multiline or {}).get(table))
        own = own.select(F.lit(table).alias("table_name"), "*")
        found = own if found is None else found.unionByName(own)
    return found


def _as_text(schema: StructType) -> StructType:
    return StructType([StructField(field.name, StringType()) for field in schema])


def _faults(schema: StructType, typed: str, text: str, line: Column) -> Column:
    """The faults of a row, given as a struct of its values, one of its fields as text, and its line."""
    faults = [
        F.when(
            F.col(f"{text}.{field.name}").isNotNull() & F.col(f"{typed}.{field.name}").isNull(),
            F.struct(F.lit(field.name).alias("column_name"), F.col(f"{text}.{field.name}").alias("value"),
                     F.lit(f"not {field.dataType.simpleString()}").alias("reason")),
        )
        for field in schema if field.dataType != StringType()
    ]
    found = F.filter(F.array(*faults), lambda fault: fault.isNotNull()) if faults else F.array()
    # A broken row all of whose fields have their types has too many or too few.
    shape = F.array(F.struct(F.lit(None).cast("string").alias("column_name"), line.alias("value"),
                             F.lit(f"not {len(schema)} fields").alias("reason")))
    return F.when(F.col(f"{typed}.{BROKEN}").isNull(), F.filter(shape, lambda _: F.lit(False))).when(
        F.col(f"{text}.{BROKEN}").isNotNull(), shape
    ).otherwise(found)


def _options() -> dict[str, str]:
    return {**CSV_DIALECT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}


def _with_broken(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(BROKEN, StringType())])


def _bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    # A split is read in order by one task, so its ids rise by one from line to line.
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def parsed(kind: StructType) -> Column:
        return F.from_csv("value", F.lit(_with_broken(kind).simpleString()[len("struct<"):-1].replace(":", " ")), _options())

    checked = lines.filter("length(value) > 0").withColumn("typed", parsed(schema)).filter(f"typed.{BROKEN} IS NOT NULL")
    checked = checked.withColumn("text", parsed(_as_text(schema)))
    faults = checked.select("file", "block", "id", F.inline(_faults(schema, "typed", "text", F.col("value"))))
    return (
        faults.join(splits, ["file", "block"])
        .withColumn("line", F.col("id") - F.col("first") + F.col("before") + 1)
        .filter("line > 1")
        .select("file", "line", "column_name", "value", "reason")
    )


def _bad_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    def read(kind: StructType) -> DataFrame:
        return spark.read.schema(_with_broken(kind)).option("header", True).option("enforceSchema", True).option(
            "multiLine", True
        ).options(**_options()).csv(path)

    numbered = [F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id")]
    typed = read(schema)
    typed = typed.select(*numbered, F.struct(*typed.columns).alias("typed")).filter(f"typed.{BROKEN} IS NOT NULL")
    text = read(_as_text(schema))
    text = text.select(*numbered, F.struct(*text.columns).alias("text"))
    records = text.select("file", "id", _breaks(schema).alias("breaks")).withColumn("run", F.floor(F.col("id") / RUN))
    runs = records.groupBy("file", "run").agg(F.sum(F.col("breaks") + 1).alias("lines"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "run").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    bad = typed.select("file", "id", F.floor(F.col("id") / RUN).alias("run"))
    lines = (
        records.join(bad.select("file", "run").distinct(), ["file", "run"], "left_semi")
        .withColumn("inside", F.coalesce(F.sum(F.col("breaks") + 1).over(inside), F.lit(0)))
        .join(runs, ["file", "run"])
        # The header is line 1.
        .select("file", "id", (F.col("inside") + F.col("before") + 2).alias("line"))
    )
    checked = typed.join(text, ["file", "id"]).select(
        "file", "id", F.inline(_faults(schema, "typed", "text", F.col(f"typed.{BROKEN}")))
    )
    return checked.join(lines, ["file", "id"]).select("file", "line", "column_name", "value", "reason")


def _breaks(schema: StructType) -> Column:
    """Line breaks inside the fields of a record."""
    total = F.lit(0)
    for field in schema:
        value = F.coalesce(F.col(f"text.{field.name}"), F.lit(""))
        total = total + F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))
    return total
