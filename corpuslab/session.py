"""Session factory for tests, the bench and local use."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession


def get_spark(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings every query here relies on (UTC, AQE)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpuslab")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", os.environ.get("CORPUSLAB_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one set on the context.

    A local session that names none gets one under its warehouse; on a cluster that is an error,
    since a folder of one machine would not be seen by the others.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpuslab-scratch"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def share_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, whatever folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (found, root) if x)
    return spark
