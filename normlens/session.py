"""Session settings used by the tests, the benchmark and the query check."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once for each session; functions in Arrow maps refer to its modules."""
    context = spark.sparkContext
    if getattr(context, "_normlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "normlens_pkg"), "zip", root, "normlens"))
    context._normlens_shipped = True


def local_session(cpus: int = 8, name: str = "normlens") -> SparkSession:
    spark = (
        SparkSession.builder
        .master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # Small local tables still deserve all cores after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="normlens-checkpoint-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
