"""Publish the three sheets as one: readers see all of a new version, or all of the former one.

Sheets are written into a folder of their own, read back and reconciled with the orders. Only if all totals agree
is one row added to the list of versions, which is what readers go by. A job that fails, at
whatever point, or does not reconcile leaves the list and every earlier folder as they were.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.plans import sheets
from punctual.session import remove
from punctual.sources.files import check_format, read_sheet
from punctual.sources.model import Model

#: The sheets of a version, and the list of versions.
SHEETS = {"orders": sheets.order_sheet, "months": sheets.month_sheet, "states": sheets.state_sheet}
VERSIONS = "versions"

_VERSION = "number bigint, folder string, format string, orders_count bigint, published_at timestamp"


class NotReconciled(RuntimeError):
    """The sheets of a version disagree with the orders; the former version stays."""


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The published versions: ``number``, ``folder``, ``format``, ``orders_count``, ``published_at``."""
    try:
        return spark.read.schema(_VERSION).parquet(f"{path}/{VERSIONS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _VERSION)


def _current(spark: SparkSession, path: str):
    return versions(spark, path).orderBy(F.desc("number"), F.desc("folder")).first()


def publish(model: Model, path: str, fmt: str = "csv") -> DataFrame:
    """Write, reconcile and publish the sheets; returns the reconciliation.

    Raises ``NotReconciled`` if totals differ. A version that isn't published is deleted if it can be; what a
    killed job leaves behind is in no list. The list grows by one file, which appears
    whole or not at all.
    """
    check_format(fmt)
    spark = model["orders"].sparkSession
    folder = uuid4().hex
    try:
        checks = sheets.export(model, f"{path}/{folder}", fmt).collect()
        if not all(row.agree for row in checks):
            raise NotReconciled(", ".join(f"{row.check_name}: {row.orders_count} orders, {row.late_orders_count} late" for row in checks))
    except BaseException:
        remove(spark, f"{path}/{folder}")
        raise
    last = _current(spark, path)
    entry = spark.createDataFrame(
        [((last.number if last else 0) + 1, folder, fmt, checks[0].orders_count)], "number bigint, folder string, format string, orders_count bigint"
    )
    entry.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/{VERSIONS}")
    return spark.createDataFrame(checks)


def published(model: Model, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """The sheets of the newest version, or of the one with this number.

    ``model`` tells the sheets' columns. All sheets are of one version, whatever is published meanwhile.
    """
    spark = model["orders"].sparkSession
    version = _current(spark, path) if number is None else versions(spark, path).filter(F.col("number") == number).first()
    if version is None:
        raise ValueError(f"no published sheets at {path}" if number is None else f"no version {number} at {path}")
    return {
        name: read_sheet(spark, sheet(model).schema, f"{path}/{version.folder}/{name}", version.format)
        for name, sheet in SHEETS.items()
    }


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the files of all but the newest ``keep`` versions; returns their folders.

    Their rows stay in the list, as a record; reading such a version fails.
    """
    old = versions(spark, path).orderBy(F.desc("number"), F.desc("folder")).offset(max(1, keep)).select("folder").collect()
    for row in old:
        remove(spark, f"{path}/{row.folder}")
    return [row.folder for row in old]
