"""Spark session helpers.

The library never creates its own cluster topology: on a cluster the
session comes from the platform and we only *read* its settings.  The
helpers here fill in sensible defaults where a setting is unset (local
tests, the bench) and never override one the cluster already supplies.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings applied only when the session does not already carry a value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # rows of texts are large: 10,000 of them take tens of MB in a task and again in its Python worker
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "flowmetrics") -> SparkSession:
    """Session for tests and the bench: local mode, no UI, AQE on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FLOWMETRICS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Fill unset SQL settings with the library defaults (never overrides)."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
