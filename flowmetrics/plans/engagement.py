"""Catalogue: digital engagement snapshots and journey performance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.core import count_if, pct
from ..operators.temporal import latest_snapshot
from ..sources.standins import _PAGES, engagement, journeys
from .common import EVENTS_AS_OF, EVENTS_DAYS, with_views

SINCE = EVENTS_AS_OF - dt.timedelta(days=EVENTS_DAYS)


def _latest(spark, sf_dir):
    return latest_snapshot(engagement(spark, sf_dir), "event_date")


def engaged_by_platform(spark, sf_dir):
    """E1 (A3): distinct engaged accounts per platform on the latest snapshot."""
    return (
        _latest(spark, sf_dir)
        .groupBy("platform")
        .agg(F.count_distinct("account_number").alias("engaged_accounts"))
        .orderBy(F.col("engaged_accounts").desc())
    )


def page_visit_counters(spark, sf_dir):
    """E3 (AG6): nine page-visit counters on the latest snapshot, one global aggregate."""
    return _latest(spark, sf_dir).agg(*[count_if(F.col(f"visited_{p}") == "Y").alias(f"{p}_page") for p in _PAGES])


def engagement_by_segment(spark, sf_dir):
    """Accounts and engaged rows by status x tariff type."""
    return (
        _latest(spark, sf_dir)
        .groupBy("account_status", F.col("fixed_svt").alias("tariff_type"))
        .agg(F.count_distinct("account_number").alias("accounts"), count_if(F.col("engaged_3m") == "Y").alias("engaged_3m"))
        .orderBy(F.col("accounts").desc(), "account_status", "tariff_type")
    )


def smart_engagement_rate(spark, sf_dir):
    """E5: engaged rows over distinct accounts (rows / accounts, so it may exceed 100)."""
    agg = _latest(spark, sf_dir).groupBy("smart_meter_fl").agg(
        F.count_distinct("account_number").alias("accounts"), count_if(F.col("engaged_3m") == "Y").alias("engaged")
    )
    return agg.withColumn("engagement_rate", pct("engaged", "accounts", 2))


def _recent_journeys(spark, sf_dir):
    return journeys(spark, sf_dir).where(F.col("created_date") >= F.lit(SINCE))


def journey_success_by_channel(spark, sf_dir):
    """E8 (A14): attempts, successes and rate per KPI x channel."""
    agg = _recent_journeys(spark, sf_dir).groupBy("kpi_name", "channel").agg(
        F.count(F.lit(1)).alias("total_attempts"), count_if(F.col("success_status") == "Y").alias("successful")
    )
    return agg.withColumn("success_rate_pct", pct("successful", "total_attempts", 2)).orderBy("kpi_name", "channel")


def app_vs_web(spark, sf_dir):
    """E9 (AG13 pivot): per KPI, App vs Web successes, totals and rates side by side."""
    p = (
        _recent_journeys(spark, sf_dir)
        .groupBy("kpi_name")
        .pivot("channel", ["App", "Web"])
        .agg(count_if(F.col("success_status") == "Y").alias("success"), F.count(F.lit(1)).alias("total"))
    )
    return p.select(
        "kpi_name",
        F.coalesce("App_success", F.lit(0)).alias("app_success"),
        F.coalesce("App_total", F.lit(0)).alias("app_total"),
        pct("App_success", "App_total", 2).alias("app_rate"),
        F.coalesce("Web_success", F.lit(0)).alias("web_success"),
        F.coalesce("Web_total", F.lit(0)).alias("web_total"),
        pct("Web_success", "Web_total", 2).alias("web_rate"),
    ).orderBy("kpi_name")


def engaged_last_3_months(spark, sf_dir):
    """E2 (A3): accounts by the engaged-in-3-months flag on the latest snapshot."""
    return _latest(spark, sf_dir).groupBy(F.col("engaged_3m").alias("digitally_engaged_in_last_three_month")).agg(
        F.count_distinct("account_number").alias("accounts")
    )


def daily_journeys(spark, sf_dir):
    """E10 (A16): journeys and successes per day and KPI."""
    from ..operators.temporal import trend

    return trend(
        _recent_journeys(spark, sf_dir),
        "created_date",
        "day",
        [F.count(F.lit(1)).alias("journeys"), count_if(F.col("success_status") == "Y").alias("successful")],
        by=["kpi_name"],
        name="date",
    ).orderBy(F.col("date").desc(), "kpi_name")


def engagement_by_tenure(spark, sf_dir):
    """Accounts and engaged rows per tenure year."""
    return (
        _latest(spark, sf_dir)
        .groupBy(F.col("tenure_years").alias("tenure_in_year"))
        .agg(F.count_distinct("account_number").alias("accounts"), count_if(F.col("engaged_3m") == "Y").alias("engaged"))
        .orderBy("tenure_in_year")
    )


def contact_after_engagement(spark, sf_dir):
    """E21 (A3, AG6): accounts and support contacts by platform x engagement."""
    return (
        _latest(spark, sf_dir)
        .groupBy("platform", F.col("engaged_3m").alias("digitally_engaged_in_last_three_month"))
        .agg(F.count_distinct("account_number").alias("accounts"), count_if(F.col("post_ticket_id").isNotNull()).alias("contacted_support"))
        .orderBy("platform", "digitally_engaged_in_last_three_month")
    )


def engagement_by_balance(spark, sf_dir):
    """E22 (A14): engagement rate by balance status (rows over distinct accounts)."""
    agg = _latest(spark, sf_dir).groupBy(F.col("balance_status").alias("account_balance_status")).agg(
        F.count_distinct("account_number").alias("accounts"), count_if(F.col("engaged_3m") == "Y").alias("engaged")
    )
    return agg.withColumn("engagement_rate", pct("engaged", "accounts", 2)).orderBy(F.col("accounts").desc())


def usage_graph_visibility(spark, sf_dir):
    """Usage-page visitors by usage-graph visibility flags."""
    return (
        _latest(spark, sf_dir)
        .where(F.col("visited_usage") == "Y")
        .groupBy("usage_graph_visible", "usage_graph_not_visible")
        .agg(F.count_distinct("account_number").alias("accounts"))
    )


QUERIES = {
    "usage_graph_visibility": usage_graph_visibility,
    "engagement_by_tenure": engagement_by_tenure,
    "contact_after_engagement": contact_after_engagement,
    "engagement_by_balance": engagement_by_balance,
    "engaged_last_3_months": engaged_last_3_months,
    "daily_journeys": daily_journeys,
    "engaged_by_platform": engaged_by_platform,
    "page_visit_counters": page_visit_counters,
    "engagement_by_segment": engagement_by_segment,
    "smart_engagement_rate": smart_engagement_rate,
    "journey_success_by_channel": journey_success_by_channel,
    "app_vs_web": app_vs_web,
}

_L = "event_date = (select max(event_date) from engagement)"


def _p(n, d, k):
    return f"round(cast({n} as double) * 100.0 / nullif(cast({d} as double), 0), {k})"


ORACLE = {
    "engaged_by_platform": with_views(
        ["engagement"],
        f"select platform, count(distinct account_number) as engaged_accounts from engagement where {_L} group by 1",
    ),
    "page_visit_counters": with_views(
        ["engagement"],
        "select "
        + ", ".join(f"count(*) filter (where visited_{p} = 'Y') as {p}_page" for p in _PAGES)
        + f" from engagement where {_L}",
    ),
    "engagement_by_segment": with_views(
        ["engagement"],
        f"""select account_status, fixed_svt as tariff_type, count(distinct account_number) as accounts,
       count(*) filter (where engaged_3m = 'Y') as engaged_3m
from engagement where {_L} group by 1, 2""",
    ),
    "smart_engagement_rate": with_views(
        ["engagement"],
        f"""select smart_meter_fl, count(distinct account_number) as accounts,
       count(*) filter (where engaged_3m = 'Y') as engaged,
       {_p("count(*) filter (where engaged_3m = 'Y')", 'count(distinct account_number)', 2)} as engagement_rate
from engagement where {_L} group by 1""",
    ),
    "journey_success_by_channel": with_views(
        ["journeys"],
        f"""select kpi_name, channel, count(*) as total_attempts, count(*) filter (where success_status = 'Y') as successful,
       {_p("count(*) filter (where success_status = 'Y')", 'count(*)', 2)} as success_rate_pct
from journeys where created_date >= date '2024-01-01' group by 1, 2""",
    ),
    "app_vs_web": with_views(
        ["journeys"],
        f"""select kpi_name,
  count(*) filter (where channel = 'App' and success_status = 'Y') as app_success,
  count(*) filter (where channel = 'App') as app_total,
  {_p("count(*) filter (where channel = 'App' and success_status = 'Y')", "count(*) filter (where channel = 'App')", 2)} as app_rate,
  count(*) filter (where channel = 'Web' and success_status = 'Y') as web_success,
  count(*) filter (where channel = 'Web') as web_total,
  {_p("count(*) filter (where channel = 'Web' and success_status = 'Y')", "count(*) filter (where channel = 'Web')", 2)} as web_rate
from journeys where created_date >= date '2024-01-01' group by 1""",
    ),
}

ORACLE["engaged_last_3_months"] = with_views(
    ["engagement"],
    f"""select engaged_3m as digitally_engaged_in_last_three_month, count(distinct account_number) as accounts
from engagement where {_L} group by 1""",
)
ORACLE["daily_journeys"] = with_views(
    ["journeys"],
    """select created_date as date, kpi_name, count(*) as journeys, count(*) filter (where success_status = 'Y') as successful
from journeys where created_date >= date '2024-01-01' group by 1, 2""",
)

ORACLE["engagement_by_tenure"] = with_views(
    ["engagement"],
    f"""select tenure_years as tenure_in_year, count(distinct account_number) as accounts,
       count(*) filter (where engaged_3m = 'Y') as engaged from engagement where {_L} group by 1""",
)
ORACLE["contact_after_engagement"] = with_views(
    ["engagement"],
    f"""select platform, engaged_3m as digitally_engaged_in_last_three_month, count(distinct account_number) as accounts,
       count(*) filter (where post_ticket_id is not null) as contacted_support from engagement where {_L} group by 1, 2""",
)
ORACLE["engagement_by_balance"] = with_views(
    ["engagement"],
    f"""select balance_status as account_balance_status, count(distinct account_number) as accounts,
       count(*) filter (where engaged_3m = 'Y') as engaged,
       {_p("count(*) filter (where engaged_3m = 'Y')", 'count(distinct account_number)', 2)} as engagement_rate
from engagement where {_L} group by 1""",
)

ORACLE["usage_graph_visibility"] = with_views(
    ["engagement"],
    f"""select usage_graph_visible, usage_graph_not_visible, count(distinct account_number) as accounts
from engagement where {_L} and visited_usage = 'Y' group by 1, 2""",
)
