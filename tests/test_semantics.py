"""NULL logic, date labels, rates and golden values."""

import datetime as dt

from pyspark.sql import functions as F

from flowmetrics.functions.contact_rules import VOICE_FLOW_DEFLECTABLE_INTENTS
from flowmetrics.functions.core import classify, iso_week_label, not_in_list, pct, week_label
from flowmetrics.operators.flows import flow_node_totals
from flowmetrics.operators.funnel import first_touch, normalise_status, stage_counts
from flowmetrics.operators.temporal import as_of, current_state, latest_snapshot


def test_not_equal_drops_nulls(spark):
    # Col != 'Y' is NULL for NULL col, so the row is filtered out.
    df = spark.createDataFrame([("Y",), ("N",), (None,)], "flag string")
    assert df.where(F.col("flag") != "Y").count() == 1


def test_not_in_with_null_falls_through(spark):
    # NULL NOT IN (...) is NULL, so the CASE takes a later branch.
    df = spark.createDataFrame([(None,), ("RenewalIntent",), ("Other",)], "intent string")
    stage3 = classify([(not_in_list("intent", VOICE_FLOW_DEFLECTABLE_INTENTS), "N/A")], "deflection label")
    got = {r.intent: r.s for r in df.select("intent", stage3.alias("s")).collect()}
    assert got == {None: "deflection label", "RenewalIntent": "deflection label", "Other": "N/A"}


def test_week_label_calendar_year_iso_week(spark):
    # G11: '%Y-W%V' gives 2024-W01 for 2024-12-30; ISO-year variant gives 2025-W01.
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2024, 1, 1),), (dt.date(2021, 1, 3),)], "d date")
    rows = df.select(week_label("d").alias("w"), iso_week_label("d").alias("iw")).collect()
    assert [r.w for r in rows] == ["2024-W01", "2024-W01", "2021-W53"]
    assert [r.iw for r in rows] == ["2025-W01", "2024-W01", "2020-W53"]


def test_pct_is_null_on_zero_denominator(spark):
    # ANSI division by zero raises; pct uses try_divide.
    df = spark.createDataFrame([(1, 0), (1, 3), (2, 8)], "n long, d long")
    assert [r.p for r in df.select(pct("n", "d").alias("p")).collect()] == [None, 33.3, 25.0]


def test_first_touch_ignores_missing_sources(spark):
    # Sentinel-based least; all missing -> NULL.
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 5), None), (None, None), (dt.date(2024, 2, 1), dt.date(2024, 1, 9))], "a date, b date"
    )
    assert [r.f for r in df.select(first_touch("a", "b").alias("f")).collect()] == [
        dt.date(2024, 1, 5),
        None,
        dt.date(2024, 1, 9),
    ]


def test_status_normalisation_uses_fallback(spark):
    df = spark.createDataFrame(
        [("COMPLETED", None), (None, "Completed - Install & Leave"), (None, "cancelled"), (None, None), ("ON_ROUTE", "X"), ("NOPE", None)],
        "p string, f string",
    )
    got = [r.o for r in df.select(normalise_status("p", "f").alias("o")).collect()]
    assert got == ["Completed", "Completed", "Cancelled", "Pending", "Pending", "Other"]


def test_scd2_current_and_as_of(spark):
    rows = [
        (1, "a", dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)),
        (1, "b", dt.datetime(2021, 1, 1), dt.datetime(9999, 1, 1)),
        (2, "c", dt.datetime(2020, 6, 1), None),
    ]
    df = spark.createDataFrame(rows, "id int, v string, from_date timestamp, to_date timestamp")
    cur = current_state(df, end_col="to_date")
    assert [r.v for r in cur.collect()] == ["b"]
    snap = as_of(df, dt.datetime(2020, 7, 1))
    assert sorted(r.v for r in snap.collect()) == ["a", "c"]


def test_latest_snapshot(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2), (dt.date(2024, 1, 2), 3)], "d date, x int")
    assert sorted(r.x for r in latest_snapshot(df, "d").collect()) == [2, 3]


# Published voice-flow sample (18 link rows) and its documented node totals.
VOICE_SAMPLE = [
    ("New contact", "Routed to ID&V", 973, 1),
    ("Return contact", "Routed to ID&V", 326, 1),
    ("New contact", "Routed to auto-resolution", 259, 1),
    ("Return contact", "Routed to auto-resolution", 58, 1),
    ("Routed to ID&V", "ID&V completed", 557, 2),
    ("Routed to ID&V", "Queued (no ID&V)", 453, 2),
    ("Routed to ID&V", "Abandoned pre-queue", 288, 2),
    ("Routed to auto-resolution", "Proceeded to ID&V", 112, 2),
    ("Routed to auto-resolution", "Disconnected pre-queue", 88, 2),
    ("Routed to auto-resolution", "Proceeded to queue", 78, 2),
    ("Routed to auto-resolution", "Other deflection outcome", 39, 2),
    ("Proceeded to queue", "Queued (no ID&V)", 215, 3),
    ("Proceeded to ID&V", "ID&V completed", 111, 3),
    ("ID&V completed", "Answered by agent", 465, 4),
    ("Queued (no ID&V)", "Answered by agent", 395, 4),
    ("ID&V completed", "Abandoned from queue", 142, 4),
    ("Queued (no ID&V)", "Abandoned from queue", 136, 4),
    ("ID&V completed", "Other outcome", 61, 4),
]


def test_voice_flow_golden_node_totals(spark):
    links = spark.createDataFrame(VOICE_SAMPLE, "source string, target string, value long, stage int")
    nodes = {r.node: r for r in flow_node_totals(links).collect()}
    assert nodes["New contact"].node_value == 1232
    assert nodes["Return contact"].node_value == 384
    assert nodes["Answered by agent"].node_value == 860
    assert nodes["Abandoned from queue"].node_value == 278
    assert nodes["Abandoned pre-queue"].node_value == 288
    assert nodes["Disconnected pre-queue"].node_value == 88
    assert nodes["Other deflection outcome"].node_value == 39
    assert nodes["Other outcome"].node_value == 61
    # Flow is not conserved at 'Proceeded to queue' (in 78, out 215).
    assert (nodes["Proceeded to queue"].inflow, nodes["Proceeded to queue"].outflow) == (78, 215)
    # KPI: answered by agent 53% of 1616.
    assert round(860 * 100 / 1616) == 53 and nodes["Answered by agent"].pct == 53.2


def test_funnel_golden_percentages(spark):
    # Published funnel: 1483 -> 804 -> 376 -> 138.
    flags = spark.createDataFrame([(i < 804, i < 376, i < 138) for i in range(1483)], "o boolean, b boolean, c boolean")
    out = stage_counts(flags, [("1", F.lit(True)), ("2", F.col("o")), ("3", F.col("b")), ("4", F.col("c"))]).collect()
    assert [r.customers for r in out] == [1483, 804, 376, 138]
    assert [r.pct_of_start for r in out] == [100.0, 54.2, 25.4, 9.3]
    assert [r.conversion_from_prev for r in out] == [None, 54.2, 46.8, 36.7]


def test_hour_difference_truncates(spark):
    # Whole hours between two timestamps (59 minutes -> 0, 2h59 -> 2).
    from flowmetrics.operators.health import first_event_lag

    a = spark.createDataFrame(
        [("x", dt.datetime(2024, 1, 1, 10, 0)), ("y", dt.datetime(2024, 1, 1, 10, 0))], "k string, t timestamp"
    )
    b = spark.createDataFrame(
        [("x", dt.datetime(2024, 1, 1, 10, 59)), ("y", dt.datetime(2024, 1, 1, 12, 59))], "k string, t timestamp"
    )
    got = {r.k: r.hours_to_contact for r in first_event_lag(a, "k", "t", b, "k", "t").collect()}
    assert got == {"x": 0, "y": 2}


def test_session_key_is_null_when_a_part_is_null(spark):
    # CONCAT propagates NULL, so events without a session id are not counted.
    from flowmetrics.functions.nested import session_key

    params = "array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>"
    df = spark.createDataFrame(
        [("u1", [("ga_session_id", (None, 7))]), ("u2", [("other", ("a", None))]), ("u3", [])],
        f"user_pseudo_id string, event_params {params}",
    )
    assert [r.s for r in df.select(session_key().alias("s")).collect()] == ["u17", None, None]
    assert df.agg(F.count_distinct(session_key()).alias("n")).first().n == 1


def test_entity_timeline_is_totally_ordered_and_cut_per_source(spark):
    from flowmetrics.operators.health import timeline

    a = spark.createDataFrame([(1, 5, 2, "a2"), (1, 5, 1, "a1"), (1, 9, 3, "a3"), (2, 9, 4, "x"), (1, None, 7, "late")], "k int, t int, id int, v string")
    b = spark.createDataFrame([(1, 5, 1, "b1"), (1, 7, 2, "b2"), (None, 7, 3, "x")], "k int, t int, id int, v string")
    whole = timeline([("A", a), ("B", b)], "k", "t", ["v"], "id", 1)
    want = ["a3", "b2", "a1", "a2", "b1", "late"]
    assert [r.v for r in whole.collect()] == want and whole.columns == ["source", "k", "t", "v"]
    for n in range(7):
        assert [r.v for r in timeline([("A", a), ("B", b)], "k", "t", ["v"], "id", 1, n).collect()] == want[:n]
    assert timeline([("A", a), ("B", b)], "k", "t", ["v"]).count() == 8


def test_keyed_lookups_push_the_key_into_every_scan(spark):
    from flowmetrics.plans.dataflows import gas_point_returns, meter_point_timeline
    from flowmetrics.plans.operations import account_errors

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for query, column, scans in ((account_errors, "user_id", 1), (meter_point_timeline, "key", 2), (gas_point_returns, "o_custkey", 1)):
        plan = query(spark, "/root/testdata/sf0.001", 3)._jdf.queryExecution().executedPlan().toString()
        pushed = [line for line in plan.split("PushedFilters")[1:] if f"{column},3)" in line.split("ReadSchema")[0]]
        assert len(pushed) == scans, plan
