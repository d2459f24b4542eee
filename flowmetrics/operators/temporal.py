"""Temporal selection and time-bucketed operators.

SCD2 rows carry an ``effective_to`` that equals the open sentinel for the
current version; business-valid rows carry ``[from, to)`` with an open NULL
end.  All operators are filters or hash aggregations: they scale with the
input and introduce no shuffle beyond the group-by keys they state.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col, month_start, pct, ts_literal, week_label, week_start

SENTINEL = dt.datetime(9999, 1, 1)


def next_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, name: str
) -> DataFrame:
    """``LEAD(value) OVER (PARTITION BY keys ORDER BY order)`` without one task per key.

    A plain window puts every row of a key in one task, so a key holding a
    third of the table becomes one giant task.  Here rows are windowed per
    (key, bucket) - ``bucket`` must be monotone in ``order`` (e.g. the year
    of the date) - and the last row of each bucket takes the first value of
    the key's next non-empty bucket, found by a second ``lead`` over the
    per-(key, bucket) minima (bounded by the number of buckets, not rows).
    """
    b = df.withColumn("_nb", bucket)
    b = b.withColumn("_lead", F.lead(value).over(Window.partitionBy(*keys, "_nb").orderBy(*order)))
    firsts = b.groupBy(*keys, "_nb").agg(F.min_by(F.col(value), F.struct(*order)).alias("_first"))
    nxt = firsts.withColumn("_next_first", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_nb"))).drop("_first")
    out = b.join(nxt, [*keys, "_nb"], "left")
    return out.withColumn(name, F.coalesce("_lead", "_next_first")).drop("_nb", "_lead", "_next_first")


def current_state(df: DataFrame, end_col: str = "effective_to", sentinel: dt.datetime = SENTINEL) -> DataFrame:
    """A1: current SCD2 rows (``end_col = 9999-01-01``).

    A plain equality on a literal, so parquet statistics prune row groups.
    """
    return df.where(F.col(end_col) == ts_literal(sentinel, df, end_col))


def as_of(df: DataFrame, at, from_col: str = "from_date", to_col: str = "to_date") -> DataFrame:
    """A2: rows valid at ``at`` for ``[from, to)`` intervals, NULL end = open."""
    t_from = ts_literal(at, df, from_col)
    t_to = ts_literal(at, df, to_col)
    return df.where((F.col(from_col) <= t_from) & (F.col(to_col).isNull() | (F.col(to_col) > t_to)))


def latest_snapshot(df: DataFrame, date_col: str) -> DataFrame:
    """A3: rows of the latest snapshot date.

    Expressed as a scalar subquery so the max is computed once by an
    aggregate job and, on a table partitioned by ``date_col``, becomes a
    runtime partition filter; no join, no shuffle of the rows.
    """
    latest = df.select(F.max(date_col)).scalar()
    return df.where(F.col(date_col) == latest)


def state_transitions(
    df: DataFrame,
    t0,
    t1,
    key: str,
    group: str,
    state: str,
    from_col: str = "from_date",
    to_col: str = "to_date",
    missing: str = "NO_CONSENT",
) -> DataFrame:
    """A4: transition counts between the states at ``t0`` and ``t1``.

    Both snapshots are ``as_of`` filters of the same scan; the full outer
    join on (key, group) is a sort-merge join partitioned on those keys.
    A missing side becomes ``missing``; labels carry ``(before)``/``(after)``.
    """
    cur = current_state(df)
    s = as_of(cur, t0, from_col, to_col).select(
        F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(state).alias("state_from")
    )
    e = as_of(cur, t1, from_col, to_col).select(
        F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(state).alias("state_to")
    )
    j = s.join(e, ["_k", "_g"], "full")
    src = F.concat(F.coalesce(F.col("state_from"), F.lit(missing)), F.lit(" (before)"))
    tgt = F.concat(F.coalesce(F.col("state_to"), F.lit(missing)), F.lit(" (after)"))
    return (
        j.groupBy(F.col("_g").alias(group), src.alias("source"), tgt.alias("target"))
        .agg(F.count(F.lit(1)).alias("meter_point_count"))
        .orderBy(group, F.col("meter_point_count").desc(), "source", "target")
    )


def link_current(left: DataFrame, dim: DataFrame, on: Column | str | list[str], how: str = "left", end_col: str = "effective_to") -> DataFrame:
    """A5: join a dimension's *current* rows, keeping unmatched left rows (G1).

    The SCD2 predicate is applied to the dimension before the join (the ON
    clause semantics), never after it.
    """
    return left.join(current_state(dim, end_col), on, how)


def bucket(ts: str | Column, grain: str) -> Column:
    if grain == "day":
        return F.to_date(col(ts))
    if grain == "week":
        return week_start(ts)
    if grain == "month":
        return month_start(ts)
    raise ValueError(f"unknown grain {grain}")


def trend(df: DataFrame, ts: str, grain: str, metrics: Sequence[Column], by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Metrics per time bucket (day / ISO week from Monday / month)."""
    b = bucket(ts, grain).alias(name or grain)
    return df.groupBy(b, *by).agg(*metrics)


def with_week_label(df: DataFrame, date_col: str, name: str = "week_label") -> DataFrame:
    return df.withColumn(name, week_label(date_col))


def wow_change(df: DataFrame, period: str, by: Sequence[str], value: str, rate: str | None = None) -> DataFrame:
    """Period-over-period change per series.

    ``lag`` runs over the aggregated series (one row per period and key),
    never over raw events, so each window partition is bounded by the
    number of periods.
    """
    w = Window.partitionBy(*by).orderBy(period)
    prev = F.lag(value).over(w)
    out = df.withColumn(f"prev_{value}", prev).withColumn(
        f"{value}_change_pct", pct(F.col(value) - F.col(f"prev_{value}"), F.col(f"prev_{value}"), 1)
    )
    if rate:
        out = out.withColumn(f"{rate}_change_pp", F.round(F.col(rate) - F.lag(rate).over(w), 1))
    return out


def month_end_snapshot(df: DataFrame, date_col: str, as_of_date) -> DataFrame:
    """Rows of the month end of ``as_of_date``'s month."""
    d = as_of_date if isinstance(as_of_date, dt.date) else dt.date.fromisoformat(str(as_of_date))
    nxt = dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)
    return df.where(F.col(date_col) == F.lit(nxt - dt.timedelta(days=1)))


def success_rate(df: DataFrame, period: str, ok: str, failed: str) -> DataFrame:
    """``SAFE_DIVIDE(sum(ok), sum(ok) + sum(failed))`` per period."""
    agg = df.groupBy(period).agg(F.sum(ok).cast("long").alias("successful"), F.sum(failed).cast("long").alias("failed"))
    return agg.withColumn(
        "success_rate", F.round(F.try_divide(F.col("successful").cast("double"), (F.col("successful") + F.col("failed")).cast("double")), 4)
    ).orderBy(F.col(period).desc())
