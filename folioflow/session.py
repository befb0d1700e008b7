"""A session with the settings the jobs are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime re-planning splits skewed join partitions and merges small ones; UTC makes
# calendar periods of quotas the same everywhere; lost files must not pass silently;
# a translator must not be called twice for the same rows by a speculative task.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.ignoreCorruptFiles": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.speculation": "false",
    # plans here have many small expressions; do not record a call site for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(name: str, cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster pass the settings at submit."""
    cpus = cpus or os.cpu_count() or 8
    builder = (
        SparkSession.builder.appName(name).master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
