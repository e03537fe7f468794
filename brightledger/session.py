"""Spark session with the settings the jobs are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution coalesces small shuffle partitions and splits skewed ones, so the initial number can be
# generous on a cluster. Nothing here overrides what spark-submit already set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", memory: str = "8g", name: str = "brightledger", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(os.cpu_count() or 8),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        **extra,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
