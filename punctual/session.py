"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names for intermediate tables, ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own (its driver and tasks are one
    process on one disk); a cluster without the setting is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="punctual-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that its path names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("punctual")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the call site of every column expression slows short queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PUNCTUAL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
