"""Sinks: dashboard JSON export (S9), partitioned BI extracts and date shards.

Writes go to a caller-supplied folder (on a cluster, a shared location).
``rebalance`` is the AQE-aware repartition hint: it splits skewed output
partitions and merges small ones, so one hot partition value neither
becomes one giant task nor leaves thousands of tiny files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: the checkpoint folder, or the warehouse if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Newline-delimited JSON for the dashboard (one file per task)."""
    df.write.mode(mode).json(path)


def write_extract(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet extract partitioned by its filter dimensions."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_sharded(df: DataFrame, path: str, column: str = "event_date", mode: str = "overwrite") -> None:
    """One folder per day (``column=YYYYMMDD``), the Spark form of date-sharded tables."""
    write_extract(df, path, [column], mode)
