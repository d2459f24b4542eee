"""Shared parameters and oracle-SQL helpers for the query catalogue."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.standins import oracle_views

# Anchors for the test tables (no query reads the clock).
EVENTS_AS_OF = dt.date(2024, 1, 31)
ORDERS_AS_OF = dt.date(2001, 8, 2)
# Look-back that spans the whole events table from EVENTS_AS_OF.
EVENTS_DAYS = 30


@dataclass(frozen=True)
class LookBack:
    """The last ``days`` calendar days of a table, counted from its own latest row.

    One declaration for both engines: the anchor is a scalar subquery over
    the table's time column, so a table of another span needs no change.
    """

    days: int

    def rows(self, df: DataFrame, column: str) -> DataFrame:
        last = df.select(F.max(column).cast("date")).scalar()
        return df.where(F.col(column) >= F.date_sub(last, self.days - 1).cast(df.schema[column].dataType))

    def sql(self, view: str, column: str) -> str:
        return f"{column} >= (select cast(max({column}) as date) - {self.days - 1} from {view})"


#: Every day of the event tables given; the documented queries take 7 to 30 days.
EVENT_DAYS = LookBack(EVENTS_DAYS)
#: Ten years: every day of the order and line-item history given.
HISTORY = LookBack(3653)


def with_views(names: list[str], body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the stand-in views it uses (DuckDB dialect)."""
    views = oracle_views()
    parts = [f"{n} as ({views[n]})" for n in names]
    if extra_ctes:
        parts.append(extra_ctes.strip().rstrip(","))
    return "with " + ",\n".join(parts) + "\n" + body if parts else body


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
