"""Feed health, anomaly, error-correlation and timeline operators.

All are partial+final hash aggregations over the log, plus joins between
*aggregated* frames (one row per flow or per account), so no join sees raw
log rows on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import count_if, pct


def feed_health(files: DataFrame, day: str, by: Sequence[str], status: str = "status", ok: str = "SUCCESS") -> DataFrame:
    """Total / successful / failed files and failure rate per day x group."""
    agg = files.groupBy(F.to_date(day).alias("date"), *by).agg(
        F.count(F.lit(1)).alias("total_files"),
        count_if(F.col(status) == ok).alias("successful"),
        count_if(F.col(status) != ok).alias("failed"),
    )
    return agg.withColumn("failure_rate_pct", pct("failed", "total_files", 2)).orderBy(F.col("date").desc(), *by)


def missing_keys(df: DataFrame, key: str, day: str, today: dt.date, lookback: int = 1) -> DataFrame:
    """Keys seen on ``today - lookback`` .. ``today - 1`` but not on ``today``.

    ``left_anti`` on distinct keys (G29: ``lookback`` generalises yesterday).
    """
    d = F.to_date(day)
    past = df.where((d >= F.lit(today - dt.timedelta(days=lookback))) & (d < F.lit(today))).select(key).distinct()
    now = df.where(d == F.lit(today)).select(key).distinct()
    return past.join(now, key, "left_anti").withColumnRenamed(key, f"missing_{key}")


def volume_anomalies(
    df: DataFrame, key: str, day: str, today: dt.date, threshold: float = 2.0, exclude_current: bool = False
) -> DataFrame:
    """Per-key daily counts; flag ``today`` when ``|z| > threshold``.

    The baseline (mean, sample stddev over days with data) includes today
    unless ``exclude_current`` (G28).  Daily counts are one row per
    (key, day); the stats and today's counts are both one row per key, so
    the final join is between two key-sized frames.
    """
    daily = df.groupBy(key, F.to_date(day).alias("date")).agg(F.count(F.lit(1)).alias("file_count"))
    return z_score_anomalies(daily, key, today, threshold, exclude_current)


def z_score_anomalies(
    daily: DataFrame, key: str, today: dt.date, threshold: float = 2.0, exclude_current: bool = False
) -> DataFrame:
    """Z-score of ``today``'s ``file_count`` against each key's daily counts
    (``daily``: key, date, file_count), e.g. counts published by a stream."""
    base = daily.where(F.col("date") != F.lit(today)) if exclude_current else daily
    stats = base.groupBy(key).agg(F.avg("file_count").alias("avg_count"), F.stddev_samp("file_count").alias("stddev_count"))
    cur = daily.where(F.col("date") == F.lit(today)).select(key, F.col("file_count").alias("today_count"))
    z = (F.col("today_count") - F.col("avg_count")) / F.nullif(F.col("stddev_count"), F.lit(0.0))
    j = cur.join(stats, key).withColumn("_z", z)
    return (
        j.where(F.abs("_z") > threshold)
        .select(key, "today_count", F.round("avg_count", 1).alias("avg_count"), F.round("_z", 2).alias("z_score"))
        .orderBy(F.abs(F.col("z_score")).desc(), key)
    )


def first_event_lag(a: DataFrame, a_key: str, a_ts: str, b: DataFrame, b_key: str, b_ts: str) -> DataFrame:
    """Per key, first A event, A count, first B event after it, whole hours between.

    Both sides are reduced to one row per key before the join; the hour
    difference truncates like the warehouse's ``TIMESTAMP_DIFF(.., HOUR)`` (G23).
    """
    first_a = a.groupBy(F.col(a_key).alias("_k")).agg(F.min(a_ts).alias("first_error_time"), F.count(F.lit(1)).alias("error_count"))
    first_b = b.groupBy(F.col(b_key).alias("_k")).agg(F.min(b_ts).alias("first_contact_time"))
    j = first_a.join(first_b, "_k").where(F.col("first_contact_time") > F.col("first_error_time"))
    return j.select(
        F.col("_k").alias(a_key),
        "error_count",
        "first_error_time",
        "first_contact_time",
        F.expr("timestampdiff(HOUR, first_error_time, first_contact_time)").cast("long").alias("hours_to_contact"),
    )


def followon_rate(a: DataFrame, a_key: str, kind: str, b: DataFrame, b_key: str, digits: int = 2) -> DataFrame:
    """Per A type, distinct keys and the share that also appear in B.

    Distinct (key, type) on one side, distinct keys on the other, flagged by
    a left join on the key; counts are distinct so no fan-out is possible.
    """
    ea = a.where(F.col(a_key).isNotNull()).select(F.col(a_key).alias("_k"), F.col(kind).alias(kind)).distinct()
    cb = b.select(F.col(b_key).alias("_k")).distinct().withColumn("_c", F.lit(True))
    j = ea.join(cb, "_k", "left")
    # (key, kind) is distinct and the right side is one row per key, so each
    # row is one account of its kind: counts replace COUNT(DISTINCT).
    agg = j.groupBy(kind).agg(
        F.count(F.lit(1)).alias("accounts_with_error"),
        count_if(F.col("_c").isNotNull()).alias("accounts_that_contacted"),
    )
    return agg.withColumn("contact_rate_pct", pct("accounts_that_contacted", "accounts_with_error", digits)).orderBy(
        F.col("accounts_with_error").desc(), kind
    )


def keyword_filter(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows where any ``lower(column) LIKE pattern`` holds."""
    cond: Column | None = None
    for column, pattern in rules:
        c = F.lower(F.col(column)).like(pattern)
        cond = c if cond is None else cond | c
    return df.where(cond)


def timeline(
    sources: Sequence[tuple[str, DataFrame]], key: str, ts: str, columns: Sequence[str], row_key: str | None = None,
    value=None, limit: int | None = None,
) -> DataFrame:
    """Union of per-source event rows tagged with their source, in one total order.

    With ``value`` the timeline is that of one entity: the test on ``key``
    goes into each source before the union, so it reaches every scan.  With
    ``row_key`` (a row's key within its source) the order is newest first,
    then source as listed, then row key: total over unlike sources, also
    among rows of one instant.  ``limit`` keeps the first rows of that order;
    a source can give no more than that many of them, so each is cut to its
    own first rows before the union.
    """
    out = None
    for rank, (name, df) in enumerate(sources):
        part = df if value is None else df.where(F.col(key) == F.lit(value))
        if limit is not None:
            part = part.orderBy(F.col(ts).desc_nulls_last(), row_key).limit(limit)
        ordered = [] if row_key is None else [F.lit(rank).alias("_rank"), F.col(row_key).alias("_row")]
        part = part.select(F.lit(name).alias("source"), F.col(key).alias(key), F.col(ts).alias(ts), *[F.col(c) for c in columns], *ordered)
        out = part if out is None else out.unionByName(part)
    if row_key is None:
        return out
    out = out.orderBy(F.col(ts).desc_nulls_last(), "_rank", "_row")
    if limit is not None:
        out = out.limit(limit)
    return out.drop("_rank", "_row")
