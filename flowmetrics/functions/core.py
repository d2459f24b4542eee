"""Column builders shared by every operator.

All builders return JVM-side ``Column`` expressions (no Python UDFs) so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

Rule = tuple[Column, str]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify(rules: Sequence[Rule], default: str | None = None) -> Column:
    """Ordered-rule classifier (A6): the first matching rule wins.

    A rule whose predicate evaluates to NULL does not match, so rows fall
    through to later rules exactly like a SQL searched CASE.
    """
    if not rules:
        raise ValueError("classify needs at least one rule")
    expr = None
    for cond, label in rules:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def rank_of(c: str | Column, order: Sequence[str]) -> Column:
    """Business sort order: position of ``c`` in ``order`` (unknown last)."""
    expr = None
    for i, label in enumerate(order, start=1):
        cond = col(c) == F.lit(label)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(order) + 1))


def pct(num: str | Column, den: str | Column, digits: int = 1) -> Column:
    """Safe percentage (A14): ``round(num * 100.0 / den, digits)``, NULL on 0."""
    return F.round(F.try_divide(col(num).cast("double") * F.lit(100.0), col(den).cast("double")), digits)


def count_if(cond: Column) -> Column:
    """``COUNTIF``: rows where ``cond`` is TRUE (NULL counts as not true)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def any_flag(cond: Column) -> Column:
    """``MAX(CASE WHEN cond THEN 1 ELSE 0 END)``."""
    return F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def is_null_or_empty(c: str | Column) -> Column:
    return col(c).isNull() | (col(c) == F.lit(""))


def in_list(c: str | Column, values: Iterable[str]) -> Column:
    """``c IN (...)``; NULL ``c`` yields NULL (three-valued, G3)."""
    return col(c).isin(list(values))


def not_in_list(c: str | Column, values: Iterable[str]) -> Column:
    """``c NOT IN (...)``; NULL ``c`` yields NULL, so CASE falls through."""
    return ~col(c).isin(list(values))


def _as_datetime(value: dt.date | dt.datetime | str) -> dt.datetime:
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.datetime):
        return value
    return dt.datetime(value.year, value.month, value.day)


def ntz(value: dt.date | dt.datetime | str) -> Column:
    """Wall-clock ``timestamp_ntz`` literal, built from text so it does not
    depend on the Python process or session time zone."""
    return F.lit(_as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def ts_literal(value: dt.date | dt.datetime | str, like: DataFrame | None = None, column: str | None = None) -> Column:
    """Timestamp literal typed like ``like[column]`` so the comparison is pushed to the scan.

    ``timestamp_ntz`` columns get a wall-clock literal; ``timestamp``
    columns get the same wall-clock time read in the session time zone.
    """
    text = F.lit(_as_datetime(value).isoformat(sep=" "))
    if like is not None and column is not None:
        field = like.schema[column] if column in like.columns else None
        if field is not None and isinstance(field.dataType, TimestampNTZType):
            return text.cast("timestamp_ntz")
    return text.cast("timestamp")


def between_ts(df: DataFrame, column: str, start, end, end_inclusive: bool = False) -> Column:
    """``start <= column < end`` (or ``<= end``) with scan-pushable literals."""
    lo = ts_literal(start, df, column)
    hi = ts_literal(end, df, column)
    upper = F.col(column) <= hi if end_inclusive else F.col(column) < hi
    return (F.col(column) >= lo) & upper


def day_window(as_of: dt.date | str, lo_days: int, hi_days: int = 0) -> tuple[dt.datetime, dt.datetime]:
    """Half-open timestamp range covering the calendar days
    ``[as_of - lo_days, as_of - hi_days]`` inclusive.

    ``DATE(ts) BETWEEN as_of - lo AND as_of - hi`` is rewritten as
    ``ts >= as_of - lo AND ts < as_of - hi + 1 day`` so it reaches the scan.
    """
    base = _as_datetime(as_of)
    return base - dt.timedelta(days=lo_days), base - dt.timedelta(days=hi_days - 1)


def week_label(c: str | Column) -> Column:
    """``'%Y-W%V'``: *calendar* year with ISO week number.

    2024-12-30 is labelled ``2024-W01`` exactly as the warehouse format does.
    """
    d = F.to_date(col(c))
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def iso_week_label(c: str | Column) -> Column:
    """ISO year + ISO week (``2025-W01`` for 2024-12-30).

    The ISO year is the calendar year of the week's Thursday.
    """
    d = F.to_date(col(c))
    thursday = F.date_add(d, F.lit(3) - ((F.dayofweek(d) + F.lit(5)) % F.lit(7)))
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_start(c: str | Column) -> Column:
    """Monday of the ISO week as a DATE."""
    return F.to_date(F.date_trunc("week", col(c)))


def month_start(c: str | Column) -> Column:
    return F.to_date(F.date_trunc("month", col(c)))


def safe_first(arr: Column) -> Column:
    """First element of an array or NULL when empty (ANSI ``[0]`` raises)."""
    return F.get(arr, 0)


def literal_table(spark, rows, names: Sequence[str]):
    """A small fixed table built JVM-side (``inline`` of an array of structs).

    Used for rule tables whose size is fixed by code (eligibility matrix,
    thresholds), so broadcasting them is provably bounded and no Python
    worker is needed to materialise them.
    """
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
