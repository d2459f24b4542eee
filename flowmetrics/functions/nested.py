"""Nested-field and JSON extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .core import col

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")
AVAILABILITY_SCHEMA = "map<string, struct<am: boolean, pm: boolean>>"


def event_param(key: str, kind: str = "string_value", params: str = "event_params") -> Column:
    """``(SELECT value.<kind> FROM UNNEST(params) WHERE key = k)``.

    A higher-order ``filter`` on the row's own array (no explode, no join);
    ``get(.., 0)`` is NULL when the key is absent (ANSI ``[0]`` would raise).
    """
    hit = F.get(F.filter(F.col(params), lambda p: p["key"] == F.lit(key)), 0)
    return hit["value"][kind]


def session_key(user: str = "user_pseudo_id", session_param: str = "ga_session_id") -> Column:
    """``CONCAT(user, session id)``; NULL when either part is NULL."""
    return F.concat(F.col(user), event_param(session_param, "int_value").cast("string"))


def availability(c: str | Column) -> Column:
    """Parse availability JSON once into ``map<day, struct<am, pm>>``."""
    return F.from_json(col(c), AVAILABILITY_SCHEMA)


def availability_features(df: DataFrame, c: str = "customer_availability") -> DataFrame:
    """Slot count (weekdays x AM/PM), AM/PM preference and flexibility tier.

    ``has_preferences`` follows the *intent* (non-empty object => Yes); the
    warehouse's root ``JSON_VALUE`` is NULL for objects, which would make it
    'No' for everyone (G10).
    """
    parsed = df.withColumn("_av", availability(c))

    def slot(day: str, part: str) -> Column:
        return F.col("_av")[day][part] == F.lit(True)

    count = sum((F.when(slot(d, p), 1).otherwise(0) for d in WEEKDAYS for p in ("am", "pm")), F.lit(0))
    am = None
    pm = None
    for d in WEEKDAYS:
        am = slot(d, "am") if am is None else am | slot(d, "am")
        pm = slot(d, "pm") if pm is None else pm | slot(d, "pm")
    raw = F.col(c)
    has = raw.isNotNull() & (raw != "{}") & (raw != "null")
    return parsed.select(
        "*",
        F.when(has, "Yes").otherwise("No").alias("has_preferences"),
        count.alias("available_slots_count"),
        F.when(count >= 8, "Fully Flexible (8-10 slots)")
        .when(count >= 5, "Mostly Flexible (5-7 slots)")
        .when(count >= 2, "Limited (2-4 slots)")
        .when(count >= 1, "Very Limited (1 slot)")
        .otherwise("No Preferences Set")
        .alias("flexibility_level"),
        F.when(am & pm, "AM & PM").when(am, "AM Only").when(pm, "PM Only").otherwise("Not Set").alias("time_preference"),
    ).drop("_av")


def explode_ids(df: DataFrame, c: str, name: str = "account_number", sep: str = ",") -> DataFrame:
    """One row per id of a comma-separated multi-value string (trimmed, non-empty)."""
    return (
        df.withColumn(name, F.explode(F.split(F.col(c), sep)))
        .withColumn(name, F.trim(F.col(name)))
        .where(F.col(name) != "")
    )


def load_sharded(spark: SparkSession, path: str, first: str | Column | None = None, last: str | Column | None = None, column: str = "event_date") -> DataFrame:
    """Read a table partitioned by ``column=YYYYMMDD`` for a suffix range.

    The schema is given with the partition column as a string (inference
    would make it an integer), so the session's settings stay as they are
    and the range prunes folders.  A bound may be a scalar subquery, for
    example over the shards themselves: folders are then pruned when the
    query runs.  Bounds are inclusive; None leaves a side open.
    """
    found = spark.read.option("basePath", path).parquet(path).schema
    fields = [StructField(column, StringType()) if f.name == column else f for f in found.fields]
    df = spark.read.schema(StructType(fields)).option("basePath", path).parquet(path)
    suffix = F.col(column)
    for bound, test in ((first, suffix.__ge__), (last, suffix.__le__)):
        if bound is not None:
            df = df.where(test(bound))
    return df


def latest_shard(spark: SparkSession, path: str, column: str = "event_date") -> Column:
    """Scalar subquery for the last suffix of a sharded table; reads folder names and counts only."""
    return load_sharded(spark, path, column=column).select(F.max(column)).scalar()
