"""Reconciliation: one planted fault per check, in both directions."""

import datetime as dt

from pyspark.sql import functions as F

from flowmetrics.operators.reconcile import account_audit, flag_checks, trend_check

SHAPE = "account_number string, in_master boolean, renewed boolean"


def _checks(spark, master, linked, followed):
    m = spark.createDataFrame(master, SHAPE)
    sides = [spark.createDataFrame([(a, True) for a in rows], f"account_number string, {name} boolean") for name, rows in (("linked", linked), ("followed", followed))]
    audit = account_audit(m, sides)
    found = flag_checks(audit, [("linked", F.col("in_master"), F.col("in_master") & F.col("linked")), ("renewal", F.col("renewed"), F.col("followed"))], grain="grain")
    return {r.check_name: tuple(r)[1:] for r in found.collect()}


def test_clean_tables_pass(spark):
    got = _checks(spark, [("a", True, True), ("b", True, False)], ["a", "b", "z"], ["a", "a", None])
    assert got == {"grain": (2, 2, 0, 0, None, None, True), "linked": (2, 2, 0, 0, None, None, True), "renewal": (1, 1, 0, 0, None, None, True)}


def test_each_planted_fault_fails_its_check_only(spark):
    rows = [("a", True, True), ("b", True, False), ("c", True, False)]
    good = dict(master=rows, linked=["a", "b", "c"], followed=["a"])
    faults = {
        "grain": (dict(good, master=rows + [("b", True, False)]), (4, 3, 1, 0, "b", None, False)),
        "linked": (dict(good, linked=["a", "c"]), (3, 2, 1, 0, "b", None, False)),
        "renewal": (dict(good, followed=["c", "q"]), (1, 2, 1, 2, "a", "c", False)),
    }
    for name, (tables, want) in faults.items():
        got = _checks(spark, **tables)
        assert got[name] == want
        assert all(row[-1] for other, row in got.items() if other != name)


def test_empty_tables(spark):
    got = _checks(spark, [], [], [])
    assert all(row[:4] == (0, 0, 0, 0) and row[-1] for row in got.values())


def test_trend_steps(spark):
    weeks = [(dt.date(2024, 1, 1) + dt.timedelta(weeks=i), v) for i, v in enumerate([10, 12, 9, 30, 28])]
    df = spark.createDataFrame(weeks, "week date, n long")
    (row,) = trend_check(df, "week", "n", "trend").collect()
    assert tuple(row)[1:] == (4, 3, 1, 0, "2024-01-22", None, False)
    (row,) = trend_check(df.where("n < 13"), "week", "n", "trend").collect()
    assert row.passed and row.expected == 2
    (row,) = trend_check(df.limit(0), "week", "n", "trend").collect()
    assert row.passed and row.expected == 0
