"""Run the whole analysis over a folder of CSV files.

    spark-submit --py-files punctual.zip -m punctual CSV_DIR OUT_DIR

Tables are copied to Parquet, every result is written whole to ``OUT_DIR/results/<query>``, the
first rows of each are printed, and the sheets are written.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from punctual.catalog import QUERIES
from punctual.plans.prepared import prepare
from punctual.plans.sheets import export
from punctual.session import SETTINGS
from punctual.sources.files import csv_to_parquet, parquet_model


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="punctual", description=__doc__)
    parser.add_argument("csv_dir", help="folder with <table>.csv for each table")
    parser.add_argument("out_dir", help="folder for the Parquet tables, the sample and the sheets")
    parser.add_argument("--rows", type=int, default=30, help="rows of each result to print; all are written")
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv", help="format of the sheets")
    given = parser.parse_args(arguments)

    builder = SparkSession.builder.appName("punctual")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()

    csv_to_parquet(spark, given.csv_dir, f"{given.out_dir}/tables")
    model = prepare(parquet_model(spark, f"{given.out_dir}/tables"), f"{given.out_dir}/sample")
    for name, query in QUERIES.items():
        print(name)
        path = f"{given.out_dir}/results/{name}"
        query(model).write.mode("overwrite").parquet(path)
        spark.read.parquet(path).show(given.rows, truncate=False)
    print("sheets")
    export(model, f"{given.out_dir}/sheets", given.format).show(truncate=False)


if __name__ == "__main__":
    main()
