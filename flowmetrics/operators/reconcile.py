"""Reconciliation of a master table against the tables it was built from.

One row per account carries what the master says and what the other tables
say, from full outer joins of sides that are reduced to one row per account
first; so an account that one side lacks is seen, and a table with many
rows per account adds none.  Every check is a pair of flags over that row
(expected, found), and one aggregate gives for all checks the totals, the
differences in both directions and an example key of each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import count_if

COLUMNS = ("check_name", "expected", "actual", "missing", "unexpected", "example_missing", "example_unexpected", "passed")


def account_audit(master: DataFrame, sides: Sequence[DataFrame], key: str = "account_number") -> DataFrame:
    """One row per account: master rows, the master's flags (any row), and a flag per side.

    ``master`` (key, boolean flags); each side (key, one boolean flag).
    Rows without a key are left out of every side, and counted by ``master_rows`` under a NULL key.
    """
    flags = [c for c in master.columns if c != key]
    out = master.groupBy(key).agg(F.count(F.lit(1)).alias("master_rows"), *[F.bool_or(f).alias(f) for f in flags])
    for side in sides:
        (flag,) = (c for c in side.columns if c != key)
        reduced = side.where(F.col(key).isNotNull()).groupBy(key).agg(F.bool_or(flag).alias(flag))
        out = out.join(reduced, key, "full")
    return out.select(key, F.coalesce("master_rows", F.lit(0)).alias("master_rows"), *[F.coalesce(c, F.lit(False)).alias(c) for c in out.columns if c not in (key, "master_rows")])


def flag_checks(audit: DataFrame, checks: Sequence[tuple[str, Column, Column]], key: str = "account_number", grain: str | None = None) -> DataFrame:
    """Result rows (COLUMNS) of checks (name, expected flag, found flag) over ``account_audit``, in one aggregate.

    ``grain`` names a check that every account is one master row: expected
    are the master's rows, actual its accounts.
    """
    k = F.col(key).cast("string")
    aggs, structs = [], []
    if grain is not None:
        rows = F.col("master_rows")
        aggs += [F.sum(rows).alias("g_e"), count_if(rows > 0).alias("g_a"), F.sum(F.greatest(rows - 1, F.lit(0))).alias("g_m"), F.min(F.when(rows > 1, k)).alias("g_x")]
        structs.append(F.struct(F.lit(grain).alias("check_name"), *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in ((F.col("g_e"), "expected"), (F.col("g_a"), "actual"), (F.col("g_m"), "missing"), (F.lit(0), "unexpected"))], F.col("g_x").alias("example_missing"), F.lit(None).cast("string").alias("example_unexpected")))
    for i, (name, expected, found) in enumerate(checks):
        parts = {"expected": expected, "actual": found, "missing": expected & ~found, "unexpected": ~expected & found}
        aggs += [F.coalesce(count_if(c), F.lit(0)).alias(f"{n}{i}") for n, c in parts.items()]
        aggs += [F.min(F.when(parts[n], k)).alias(f"example_{n}{i}") for n in ("missing", "unexpected")]
        fields = [*parts, "example_missing", "example_unexpected"]
        structs.append(F.struct(F.lit(name).alias("check_name"), *[F.col(f"{f}{i}").alias(f) for f in fields]))
    out = audit.agg(*aggs).select(F.inline(F.array(*structs)))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("unexpected") == 0)).select(*COLUMNS)


def trend_check(series: DataFrame, period: str, value: str, name: str, most: float = 0.5) -> DataFrame:
    """Result row (COLUMNS): periods whose value stays within a share of ``most`` of the period before.

    ``series`` has one row per period; expected are the periods that have one before.
    """
    w = Window.orderBy(period)
    steps = series.select(period, F.lag(value).over(w).alias("before"), F.col(value).alias("now")).where(F.col("before").isNotNull())
    calm = F.abs(F.col("now") - F.col("before")) <= F.lit(most) * F.abs(F.col("before"))
    out = steps.agg(F.count(F.lit(1)).alias("expected"), F.coalesce(count_if(calm), F.lit(0)).alias("actual"), F.min(F.when(~calm, F.col(period).cast("string"))).alias("example_missing"))
    return out.select(
        F.lit(name).alias("check_name"), "expected", "actual", (F.col("expected") - F.col("actual")).alias("missing"), F.lit(0).cast("long").alias("unexpected"),
        "example_missing", F.lit(None).cast("string").alias("example_unexpected"), (F.col("expected") == F.col("actual")).alias("passed"),
    )
