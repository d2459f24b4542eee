"""Catalogue: meter-reading and billing operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.core import count_if
from ..operators.temporal import current_state, latest_snapshot, trend
from ..sources.standins import bill_periods, bills, journeys, meter_reading, referrals
from .common import EVENTS_AS_OF, EVENTS_DAYS, HISTORY, with_views


def _readings(spark, sf_dir):
    return HISTORY.rows(current_state(meter_reading(spark, sf_dir)), "created_at")


def readings_by_source(spark, sf_dir):
    """OP7: readings per source."""
    return _readings(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("readings")).orderBy(F.col("readings").desc())


def reading_status_workflow(spark, sf_dir):
    """OP8: readings per status x workflow status."""
    return (
        current_state(meter_reading(spark, sf_dir))
        .groupBy("status", "workflow_status")
        .agg(F.count(F.lit(1)).alias("readings"))
        .orderBy(F.col("readings").desc(), "status", "workflow_status")
    )


def reads_consumption_by_source(spark, sf_dir):
    """OP9 (AG7): reads and exact decimal consumption per source."""
    r = HISTORY.rows(meter_reading(spark, sf_dir), "read_date")
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("reads"), F.sum("consumption").cast("decimal(38,2)").alias("total_consumption")).orderBy(
        F.col("reads").desc()
    )


def daily_submissions(spark, sf_dir):
    """OP10 (A16): submissions per day and source."""
    return trend(_readings(spark, sf_dir), "created_at", "day", [F.count(F.lit(1)).alias("submissions")], by=["source"], name="date").orderBy(
        F.col("date").desc(), F.col("submissions").desc()
    )


def _bills(spark, sf_dir):
    return HISTORY.rows(current_state(bills(spark, sf_dir)), "created_dttm")


def bills_per_day(spark, sf_dir):
    """OP11 (AG7): accepted bills and total billed per day."""
    b = _bills(spark, sf_dir).where(F.col("status") == "ACCEPTED")
    return trend(
        b, "created_dttm", "day", [F.count(F.lit(1)).alias("bills_generated"), F.sum("gross_amount").cast("decimal(38,2)").alias("total_billed")], name="bill_date"
    ).orderBy(F.col("bill_date").desc())


def bills_by_status(spark, sf_dir):
    """OP12: bills and amount per status."""
    return (
        _bills(spark, sf_dir)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("gross_amount").cast("decimal(38,2)").alias("total_amount"))
        .orderBy(F.col("count").desc())
    )


def delivery_method_latest(spark, sf_dir):
    """OP13 (A3): accounts by bill delivery method in the latest report period."""
    b = latest_snapshot(bills(spark, sf_dir), "period_end")
    return b.groupBy(F.col("delivery").alias("bill_delivery")).agg(F.count_distinct("account_fk").alias("accounts")).orderBy(
        F.col("accounts").desc()
    )


def journeys_by_source(spark, sf_dir):
    """OP17 (AG6): journeys and successes per source system x KPI."""
    j = journeys(spark, sf_dir).where(F.col("created_date") >= F.lit(EVENTS_AS_OF - dt.timedelta(days=EVENTS_DAYS)))
    return (
        j.groupBy("db_source", "kpi_name")
        .agg(F.count(F.lit(1)).alias("total"), count_if(F.col("success_status") == "Y").alias("successful"))
        .orderBy("db_source", F.col("total").desc(), "kpi_name")
    )


def daily_journey_kpis(spark, sf_dir):
    """OP16 (A16): attempts and successes per day, KPI and channel."""
    j = journeys(spark, sf_dir).where(F.col("created_date") >= F.lit(EVENTS_AS_OF - dt.timedelta(days=EVENTS_DAYS)))
    return (
        j.groupBy("created_date", "kpi_name", "channel")
        .agg(F.count(F.lit(1)).alias("attempts"), count_if(F.col("success_status") == "Y").alias("successes"))
        .orderBy(F.col("created_date").desc(), "kpi_name", "channel")
    )


def bill_period_status(spark, sf_dir):
    """OP14: current bill periods by status code."""
    return (
        current_state(bill_periods(spark, sf_dir))
        .groupBy("status_code")
        .agg(F.count(F.lit(1)).alias("periods"))
        .orderBy(F.col("periods").desc())
    )


def referrals_per_month(spark, sf_dir):
    """C18 (A16): current referrals per month."""
    r = current_state(referrals(spark, sf_dir))
    return trend(r, "created_at", "month", [F.count(F.lit(1)).alias("referrals")]).orderBy(F.col("month").desc())


def referrals_per_day(spark, sf_dir):
    """E20 (A16): current referrals per day."""
    r = current_state(referrals(spark, sf_dir))
    return trend(r, "created_at", "day", [F.count(F.lit(1)).alias("referrals")], name="date").orderBy(F.col("date").desc())


QUERIES = {
    "referrals_per_day": referrals_per_day,
    "bill_period_status": bill_period_status,
    "referrals_per_month": referrals_per_month,
    "daily_journey_kpis": daily_journey_kpis,
    "readings_by_source": readings_by_source,
    "reading_status_workflow": reading_status_workflow,
    "reads_consumption_by_source": reads_consumption_by_source,
    "daily_submissions": daily_submissions,
    "bills_per_day": bills_per_day,
    "bills_by_status": bills_by_status,
    "delivery_method_latest": delivery_method_latest,
    "journeys_by_source": journeys_by_source,
}

CUR = "effective_to = timestamp '9999-01-01'"
RS = HISTORY.sql("meter_reading", "created_at")
BS = HISTORY.sql("bills", "created_dttm")
ORACLE = {
    "readings_by_source": with_views(
        ["meter_reading"], f"select source, count(*) as readings from meter_reading where {CUR} and {RS} group by 1"
    ),
    "reading_status_workflow": with_views(
        ["meter_reading"], f"select status, workflow_status, count(*) as readings from meter_reading where {CUR} group by 1, 2"
    ),
    "reads_consumption_by_source": with_views(
        ["meter_reading"],
        "select source, count(*) as reads, sum(consumption) as total_consumption from meter_reading "
        f"where {HISTORY.sql('meter_reading', 'read_date')} group by 1",
    ),
    "daily_submissions": with_views(
        ["meter_reading"],
        f"select cast(created_at as date) as date, source, count(*) as submissions from meter_reading where {CUR} and {RS} group by 1, 2",
    ),
    "bills_per_day": with_views(
        ["bills"],
        f"""select cast(created_dttm as date) as bill_date, count(*) as bills_generated, sum(gross_amount) as total_billed
from bills where {CUR} and {BS} and status = 'ACCEPTED' group by 1""",
    ),
    "bills_by_status": with_views(
        ["bills"],
        f"select status, count(*) as count, sum(gross_amount) as total_amount from bills where {CUR} and {BS} group by 1",
    ),
    "delivery_method_latest": with_views(
        ["bills"],
        """select delivery as bill_delivery, count(distinct account_fk) as accounts from bills
where period_end = (select max(period_end) from bills) group by 1""",
    ),
    "journeys_by_source": with_views(
        ["journeys"],
        """select db_source, kpi_name, count(*) as total, count(*) filter (where success_status = 'Y') as successful
from journeys where created_date >= date '2024-01-01' group by 1, 2""",
    ),
}

ORACLE["daily_journey_kpis"] = with_views(
    ["journeys"],
    """select created_date, kpi_name, channel, count(*) as attempts, count(*) filter (where success_status = 'Y') as successes
from journeys where created_date >= date '2024-01-01' group by 1, 2, 3""",
)

ORACLE["bill_period_status"] = with_views(
    ["bill_periods"], f"select status_code, count(*) as periods from bill_periods where {CUR} group by 1"
)
ORACLE["referrals_per_month"] = with_views(
    ["referrals"],
    f"select cast(date_trunc('month', created_at) as date) as month, count(*) as referrals from referrals where {CUR} group by 1",
)

ORACLE["referrals_per_day"] = with_views(
    ["referrals"], f"select cast(created_at as date) as date, count(*) as referrals from referrals where {CUR} group by 1"
)
