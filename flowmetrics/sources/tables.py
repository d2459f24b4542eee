"""Base table access.

Tables are single parquet datasets named after the driver's test tables.
Reads are lazy: Catalyst prunes columns and pushes filters into the scan,
so callers select only what they need downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


_HANDLES: dict[tuple[str, str], DataFrame] = {}


def session_key(spark: SparkSession) -> str:
    """Identity of the running application (falls back to the session object
    where no SparkContext is exposed, e.g. a Spark Connect client)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return f"session-{id(spark)}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one table.

    The resolved scan (file listing + footer schema) is memoised per
    application and path, so building many queries over the same tables
    does not list and infer the files again.  Nothing is cached in memory:
    each query still plans its own pruned, filtered scan.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (session_key(spark), path)
    df = _HANDLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _HANDLES[key] = df
    return df
