"""Catalogue of record-keeping questions: SCD2 state, snapshots, trends, rates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.contact_rules import EMAIL_DEFLECTABLE_INTENTS, SELF_SERVICE_LIST_B, base_filter, deflected_any_channel, deflection_taken
from ..functions.core import count_if, pct, week_label
from ..operators import temporal as T
from ..operators.deflection import in_days
from ..sources import standins as S
from ..sources.tables import table
from .common import EVENTS_AS_OF, EVENTS_DAYS, ORDERS_AS_OF, sql_list, with_views

T0 = dt.datetime(1998, 1, 1)
T1 = dt.datetime(2001, 1, 1)
WINDOW_SQL = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"


def current_accounts(spark, sf_dir):
    """Current account versions."""
    v = T.current_state(S.account_versions(spark, sf_dir))
    return v.select("account_id", "version_id", "status", "priority", "effective_from")


def active_account_count(spark, sf_dir):
    """Current, not cancelled (NULL cancel flag is dropped, G2)."""
    v = T.current_state(S.account_versions(spark, sf_dir))
    return v.where(F.col("cancel_fl") != "Y").agg(F.count_distinct("account_id").alias("active_accounts"))


def consents_as_of(spark, sf_dir):
    """A2: consent settings valid at T0 per definition."""
    c = T.as_of(T.current_state(S.consent_intervals(spark, sf_dir)), T0)
    return c.groupBy("consent_definition", "setting").agg(F.count(F.lit(1)).alias("meter_points"))


def consent_transitions(spark, sf_dir):
    """Transition matrix between T0 and T1."""
    return T.state_transitions(
        S.consent_intervals(spark, sf_dir), T0, T1, "meter_point_id", "consent_definition", "setting"
    )


def open_backlog_latest(spark, sf_dir):
    """Open cases at the latest landed date, by category."""
    c = T.latest_snapshot(S.cases(spark, sf_dir), "created_date")
    return (
        c.where(~F.col("status").isin("Closed", "Resolved"))
        .groupBy(F.col("level_1").alias("category"))
        .agg(F.count_distinct("case_id").alias("open_cases"))
    )


def customer_link(spark, sf_dir):
    """Customer -> current account -> nation, left-preserving."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    acct = S.account_versions(spark, sf_dir).select(
        F.col("account_id").alias("c_custkey"), "version_id", "status", "priority", "effective_to"
    )
    j = T.link_current(cust, acct, "c_custkey").join(nation, "c_nationkey", "left")
    return j.select("c_custkey", "c_name", "n_name", "version_id", "status", "priority")


def daily_contacts_trend(spark, sf_dir):
    """Contacts, parties and deflections per day and channel."""
    c = in_days(S.contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS)
    return T.trend(
        c,
        "ts",
        "day",
        [
            F.count(F.lit(1)).alias("contacts"),
            F.count_distinct("party").alias("parties"),
            count_if(deflected_any_channel()).alias("deflected"),
        ],
        by=["channel"],
        name="date",
    ).orderBy(F.col("date").desc(), "channel")


def weekly_deflection_trend(spark, sf_dir):
    """Weekly contacts, detected intents and deflections taken per channel, ISO week labels."""
    c = S.contacts(spark, sf_dir)
    scope = base_filter("VOICE") | base_filter("EMAIL") | base_filter("CHAT")
    c = in_days(c.where(scope), EVENTS_AS_OF, EVENTS_DAYS)
    agg = T.trend(
        c,
        "ts",
        "week",
        [
            F.count(F.lit(1)).alias("total_contacts"),
            count_if(F.col("intent").isNotNull()).alias("intent_detected"),
            count_if(deflection_taken()).alias("deflection_taken"),
        ],
        by=["channel"],
        name="week_start",
    )
    return (
        agg.withColumn("week_label", week_label("week_start"))
        .withColumn("take_rate_pct", pct("deflection_taken", "total_contacts"))
        .orderBy(F.col("week_start").desc(), "channel")
    )


def weekly_change(spark, sf_dir):
    """Week-over-week change of contacts, deflection volume and take rate per channel."""
    w = weekly_deflection_trend(spark, sf_dir).drop("week_label", "intent_detected")
    w = T.wow_change(w, "week_start", ["channel"], "total_contacts", rate="take_rate_pct")
    return T.wow_change(w, "week_start", ["channel"], "deflection_taken").orderBy("channel", "week_start")


def new_customers_per_month(spark, sf_dir):
    """New customers per month of creation."""
    return T.trend(S.marketing_master(spark, sf_dir), "acc_created_dt", "month", [F.count(F.lit(1)).alias("new_customers")]).orderBy("month")


def monthly_orders_trend(spark, sf_dir):
    """Orders and distinct customers per month."""
    o = table(spark, sf_dir, "orders")
    return T.trend(
        o,
        "o_orderdate",
        "month",
        [F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers")],
    ).orderBy("month")


def month_end_status(spark, sf_dir):
    """Accounts by payment status at the last complete month end."""
    pm = T.month_end_snapshot(S.payment_months(spark, sf_dir), "month_end", dt.date(2001, 7, 15))
    return pm.groupBy("dd_status").agg(F.count_distinct("account_id").alias("customers")).orderBy(
        F.col("customers").desc(), "dd_status"
    )


def payment_success_rate(spark, sf_dir):
    """Payment success rate per month end over the whole history."""
    pm = S.payment_months(spark, sf_dir).where(F.col("month_end") >= F.lit(dt.date(1994, 1, 1)))
    return T.success_rate(pm, "month_end", "successful_payments", "failed_payments")


def contacts_by_channel(spark, sf_dir):
    """Contacts per channel."""
    c = in_days(S.contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS)
    return c.groupBy("channel").agg(F.count(F.lit(1)).alias("contacts")).orderBy(F.col("contacts").desc())


def avg_queue_wait(spark, sf_dir):
    """Average queue wait per queue."""
    c = in_days(S.contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS).where(F.col("queue_seconds").isNotNull())
    return (
        c.groupBy("queue_name")
        .agg(F.round(F.avg("queue_seconds"), 4).alias("avg_wait_seconds"))
        .orderBy(F.col("avg_wait_seconds").desc())
    )


def handle_time_by_agent(spark, sf_dir):
    """C14: average handle time and contacts per agent."""
    c = in_days(S.contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS).where(F.col("agent_username").isNotNull())
    return (
        c.groupBy("agent_username")
        .agg(F.round(F.avg("handle_seconds"), 4).alias("avg_handle_seconds"), F.count(F.lit(1)).alias("contacts_handled"))
        .orderBy(F.col("contacts_handled").desc(), "agent_username")
    )


def cases_by_category(spark, sf_dir):
    """Distinct cases per category."""
    c = in_days(S.cases(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS, column="created_at")
    return c.groupBy(F.col("level_1").alias("category")).agg(F.count_distinct("case_id").alias("cases")).orderBy(
        F.col("cases").desc()
    )


def complaints_by_subject(spark, sf_dir):
    """Distinct complaint cases per subject (``= TRUE`` on a boolean)."""
    c = in_days(S.cases(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS, column="created_at")
    return (
        c.where(F.col("is_complaint") == F.lit(True))
        .groupBy(F.col("complaint_subject").alias("subject"))
        .agg(F.count_distinct("case_id").alias("complaints"))
        .orderBy(F.col("complaints").desc())
    )


def complaints_per_day(spark, sf_dir):
    """Distinct complaint cases per day."""
    c = in_days(S.cases(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS, column="created_at")
    return T.trend(
        c.where(F.col("is_complaint") == F.lit(True)), "created_at", "day", [F.count_distinct("case_id").alias("complaints")], name="date"
    ).orderBy(F.col("date").desc())


def overdue_open_cases(spark, sf_dir):
    """C11 (A3, P16): open overdue cases at the latest landed date (``= TRUE`` drops NULL)."""
    c = T.latest_snapshot(S.cases(spark, sf_dir), "created_date")
    return c.where((F.col("is_overdue") == F.lit(True)) & ~F.col("status").isin("Closed", "Resolved")).agg(
        F.count_distinct("case_id").alias("overdue_cases")
    )


def cases_today(spark, sf_dir):
    """C5 (AG18): distinct cases created on the last day of the window."""
    c = in_days(S.cases(spark, sf_dir), EVENTS_AS_OF, 1, column="created_at")
    return c.agg(F.count_distinct("case_id").alias("cases_today"))


def cases_last_7_days(spark, sf_dir):
    """C6 (A16): distinct cases per day over the last 7 days."""
    c = in_days(S.cases(spark, sf_dir), EVENTS_AS_OF, 7, column="created_at")
    return T.trend(c, "created_at", "day", [F.count_distinct("case_id").alias("cases")], name="date").orderBy(F.col("date").desc())


def open_backlog_count(spark, sf_dir):
    """D3 (A3, P12, AG2): distinct open cases at the latest landed date."""
    c = T.latest_snapshot(S.cases(spark, sf_dir), "created_date")
    return c.where(~F.col("status").isin("Closed", "Resolved")).agg(F.count_distinct("case_id").alias("open_cases"))


QUERIES = {
    "open_backlog_count": open_backlog_count,
    "cases_today": cases_today,
    "cases_last_7_days": cases_last_7_days,
    "overdue_open_cases": overdue_open_cases,
    "current_accounts": current_accounts,
    "active_account_count": active_account_count,
    "consents_as_of": consents_as_of,
    "consent_transitions": consent_transitions,
    "open_backlog_latest": open_backlog_latest,
    "customer_link": customer_link,
    "daily_contacts_trend": daily_contacts_trend,
    "weekly_deflection_trend": weekly_deflection_trend,
    "weekly_change": weekly_change,
    "monthly_orders_trend": monthly_orders_trend,
    "new_customers_per_month": new_customers_per_month,
    "month_end_status": month_end_status,
    "payment_success_rate": payment_success_rate,
    "contacts_by_channel": contacts_by_channel,
    "avg_queue_wait": avg_queue_wait,
    "handle_time_by_agent": handle_time_by_agent,
    "cases_by_category": cases_by_category,
    "complaints_by_subject": complaints_by_subject,
    "complaints_per_day": complaints_per_day,
}

_DEFLECTED_SQL = f"""case
  when channel = 'VOICE' then coalesce(selfservice in ({", ".join(repr(x) for x in (
    "renewalOnline", "moveInOnline", "moveOutOnline", "submitMeterReadingOnline",
    "makeACardPaymentOnline", "directDebitOnline"))}), false)
  when channel = 'EMAIL' then coalesce(disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
    and intent in ('MovingInIntent', 'RenewalIntent', 'MakeACardPaymentIntent', 'DirectDebitIntent',
                   'FinalBillIntent', 'PaymentIntent') and queue_name is null, false)
  when channel = 'CHAT' then coalesce(agent_ts is null and queue_name is null
    and disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and intent is not null, false)
  else false end"""

_ROUTES = sql_list(SELF_SERVICE_LIST_B)
_WEEKLY_SQL = f"""
select week_start, channel, total_contacts, intent_detected, deflection_taken,
       cast(year(week_start) as varchar) || '-W' || lpad(cast(weekofyear(week_start) as varchar), 2, '0') as week_label,
       round(cast(deflection_taken as double) * 100.0 / total_contacts, 1) as take_rate_pct
from (
  select cast(date_trunc('week', ts) as date) as week_start, channel, count(*) as total_contacts,
         count(intent) as intent_detected,
         count(*) filter (where case when channel in ('VOICE', 'CHAT') then selfservice in ({_ROUTES})
           else intent in ({sql_list(EMAIL_DEFLECTABLE_INTENTS)}) and disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
                and queue_name is null end) as deflection_taken
  from contacts
  where {WINDOW_SQL} and (channel, initiation) in (('VOICE', 'INBOUND'), ('EMAIL', 'INBOUND'), ('CHAT', 'API'))
  group by 1, 2
) w"""

ORACLE = {
    "open_backlog_count": with_views(
        ["cases"],
        """select count(distinct case_id) as open_cases from cases
where status not in ('Closed', 'Resolved') and created_date = (select max(created_date) from cases)""",
    ),
    "cases_today": with_views(
        ["cases"],
        "select count(distinct case_id) as cases_today from cases "
        "where created_at >= timestamp '2024-01-30' and created_at < timestamp '2024-01-31'",
    ),
    "cases_last_7_days": with_views(
        ["cases"],
        """select cast(created_at as date) as date, count(distinct case_id) as cases from cases
where created_at >= timestamp '2024-01-24' and created_at < timestamp '2024-01-31' group by 1""",
    ),
    "overdue_open_cases": with_views(
        ["cases"],
        """
select count(distinct case_id) as overdue_cases from cases
where is_overdue = true and status not in ('Closed', 'Resolved') and created_date = (select max(created_date) from cases)""",
    ),
    "current_accounts": with_views(
        ["account_versions"],
        """
select account_id, version_id, status, priority, effective_from
from account_versions where effective_to = timestamp '9999-01-01'""",
    ),
    "active_account_count": with_views(
        ["account_versions"],
        """
select count(distinct account_id) as active_accounts
from account_versions where effective_to = timestamp '9999-01-01' and cancel_fl != 'Y'""",
    ),
    "consents_as_of": with_views(
        ["consent_intervals"],
        """
select consent_definition, setting, count(*) as meter_points
from consent_intervals
where effective_to = timestamp '9999-01-01' and from_date <= timestamp '1998-01-01'
  and (to_date is null or to_date > timestamp '1998-01-01')
group by 1, 2""",
    ),
    "consent_transitions": with_views(
        ["consent_intervals"],
        """
select consent_definition, source, target, count(*) as meter_point_count
from (
  select coalesce(s.consent_definition, e.consent_definition) as consent_definition,
         coalesce(s.setting, 'NO_CONSENT') || ' (before)' as source,
         coalesce(e.setting, 'NO_CONSENT') || ' (after)' as target
  from (select * from consent_intervals where effective_to = timestamp '9999-01-01'
          and from_date <= timestamp '1998-01-01' and (to_date is null or to_date > timestamp '1998-01-01')) s
  full outer join
       (select * from consent_intervals where effective_to = timestamp '9999-01-01'
          and from_date <= timestamp '2001-01-01' and (to_date is null or to_date > timestamp '2001-01-01')) e
    on s.meter_point_id = e.meter_point_id and s.consent_definition = e.consent_definition
) t
group by 1, 2, 3""",
    ),
    "open_backlog_latest": with_views(
        ["cases"],
        """
select level_1 as category, count(distinct case_id) as open_cases
from cases
where status not in ('Closed', 'Resolved') and created_date = (select max(created_date) from cases)
group by 1""",
    ),
    "customer_link": with_views(
        ["account_versions"],
        """
select c.c_custkey, c.c_name, n.n_name, a.version_id, a.status, a.priority
from customer c
left join account_versions a on a.account_id = c.c_custkey and a.effective_to = timestamp '9999-01-01'
left join nation n on n.n_nationkey = c.c_nationkey""",
    ),
    "daily_contacts_trend": with_views(
        ["contacts"],
        f"""
select cast(ts as date) as date, channel, count(*) as contacts, count(distinct party) as parties,
       count(*) filter (where {_DEFLECTED_SQL}) as deflected
from contacts where {WINDOW_SQL}
group by 1, 2""",
    ),
    "weekly_deflection_trend": with_views(["contacts"], _WEEKLY_SQL),
    "weekly_change": with_views(
        ["contacts"],
        f"""
select week_start, channel, total_contacts, deflection_taken, take_rate_pct,
       lag(total_contacts) over w as prev_total_contacts,
       round(cast(total_contacts - lag(total_contacts) over w as double) * 100.0 / cast(lag(total_contacts) over w as double), 1) as total_contacts_change_pct,
       round(take_rate_pct - lag(take_rate_pct) over w, 1) as take_rate_pct_change_pp,
       lag(deflection_taken) over w as prev_deflection_taken,
       round(cast(deflection_taken - lag(deflection_taken) over w as double) * 100.0 / nullif(cast(lag(deflection_taken) over w as double), 0), 1) as deflection_taken_change_pct
from ({_WEEKLY_SQL}) x
window w as (partition by channel order by week_start)""",
    ),
    "monthly_orders_trend": """
select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as orders,
       count(distinct o_custkey) as customers
from orders group by 1""",
    "month_end_status": with_views(
        ["payment_months"],
        """
select dd_status, count(distinct account_id) as customers
from payment_months where month_end = date '2001-07-31'
group by 1""",
    ),
    "payment_success_rate": with_views(
        ["payment_months"],
        """
select month_end, cast(sum(successful_payments) as bigint) as successful,
       cast(sum(failed_payments) as bigint) as failed,
       round(cast(sum(successful_payments) as double)
             / nullif(cast(sum(successful_payments) + sum(failed_payments) as double), 0), 4) as success_rate
from payment_months where month_end >= date '1994-01-01'
group by 1""",
    ),
    "contacts_by_channel": with_views(
        ["contacts"],
        f"select channel, count(*) as contacts from contacts where {WINDOW_SQL} group by 1",
    ),
    "avg_queue_wait": with_views(
        ["contacts"],
        f"""
select queue_name, round(avg(queue_seconds), 4) as avg_wait_seconds
from contacts where queue_seconds is not null and {WINDOW_SQL} group by 1""",
    ),
    "handle_time_by_agent": with_views(
        ["contacts"],
        f"""
select agent_username, round(avg(handle_seconds), 4) as avg_handle_seconds, count(*) as contacts_handled
from contacts where agent_username is not null and {WINDOW_SQL} group by 1""",
    ),
    "cases_by_category": with_views(
        ["cases"],
        """
select level_1 as category, count(distinct case_id) as cases
from cases where created_at >= timestamp '2024-01-01' and created_at < timestamp '2024-01-31' group by 1""",
    ),
    "complaints_by_subject": with_views(
        ["cases"],
        """
select complaint_subject as subject, count(distinct case_id) as complaints
from cases where is_complaint = true
  and created_at >= timestamp '2024-01-01' and created_at < timestamp '2024-01-31' group by 1""",
    ),
    "complaints_per_day": with_views(
        ["cases"],
        """
select cast(created_at as date) as date, count(distinct case_id) as complaints
from cases where is_complaint = true
  and created_at >= timestamp '2024-01-01' and created_at < timestamp '2024-01-31' group by 1""",
    ),
}

_ = ORDERS_AS_OF

ORACLE["new_customers_per_month"] = with_views(
    ["master"],
    "select cast(date_trunc('month', acc_created_dt) as date) as month, count(*) as new_customers from master group by 1",
)
