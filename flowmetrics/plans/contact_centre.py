"""Contact-centre catalogue: funnels, outcome breakdowns, take-up, summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import contact_rules as R
from ..functions.core import count_if, pct
from ..operators import deflection as D
from ..sources.standins import contacts, journeys
from .common import EVENTS_AS_OF, EVENTS_DAYS, sql_list, with_views

# Window used by the registered queries: every day of the events table.
WINDOW_SQL = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"
LIST_A = sql_list(R.SELF_SERVICE_LIST_A)
LIST_B = sql_list(R.SELF_SERVICE_LIST_B)
EMAIL_INTENTS = sql_list(R.EMAIL_DEFLECTABLE_INTENTS)
OFFERED = sql_list(R.OFFERED_INTENTS)


def voice_contact_funnel(spark, sf_dir):
    """K22 (A19): voice daily contact funnel (flagship)."""
    return D.contact_funnel(contacts(spark, sf_dir), "VOICE", EVENTS_AS_OF, EVENTS_DAYS)


def email_contact_funnel(spark, sf_dir):
    """K24 (A19): e-mail daily contact funnel."""
    return D.contact_funnel(contacts(spark, sf_dir), "EMAIL", EVENTS_AS_OF, EVENTS_DAYS)


def chat_contact_funnel(spark, sf_dir):
    """K26 (A19): chat daily contact funnel (API initiation)."""
    return D.contact_funnel(contacts(spark, sf_dir), "CHAT", EVENTS_AS_OF, EVENTS_DAYS)


def voice_outcome_breakdown(spark, sf_dir):
    """K5: seven-way voice outcome with share and distinct accounts."""
    return D.voice_outcome_breakdown(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS)


def voice_deflection_rates(spark, sf_dir):
    """K6: voice deflection, agent and abandonment rates."""
    return D.voice_deflection_rates(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS)


def voice_take_up_by_intent(spark, sf_dir):
    """K23 (A20): voice offered vs taken by intent."""
    return D.take_up_by_intent(contacts(spark, sf_dir), "VOICE", EVENTS_AS_OF, EVENTS_DAYS)


def chat_take_up_by_intent(spark, sf_dir):
    """K27 (A20): chat deflection and bot resolution by intent."""
    return D.take_up_by_intent(contacts(spark, sf_dir), "CHAT", EVENTS_AS_OF, EVENTS_DAYS)


def channel_summary(spark, sf_dir):
    """K28 (A21): handled / deflected / dropped per channel."""
    return D.channel_summary(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS)


def safeguard_breakdown(spark, sf_dir):
    """K25 (A22): e-mail deflection decisions and safeguards by intent."""
    return D.safeguard_breakdown(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS, case_days=EVENTS_DAYS)


def _later_success(spark, sf_dir, subjects, day_col):
    """J7 as a max-aggregate: a success on or after ``day`` exists iff the
    account's latest success date is >= ``day`` (one row per account, equi-join)."""
    j = journeys(spark, sf_dir).where(
        (F.col("success_status") == "Y") & (F.col("created_date") >= F.lit(EVENTS_AS_OF - dt.timedelta(days=EVENTS_DAYS)))
    )
    last = j.groupBy(F.col("account_number").alias("account")).agg(F.max("created_date").alias("_last"))
    return subjects.join(last, "account", "left").withColumn("_done", F.coalesce(F.col("_last") >= F.col(day_col), F.lit(False)))


def deflected_completion(spark, sf_dir):
    """Deflected accounts that completed a self-service journey on or after the call."""
    c = D.in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS).where(
        (F.col("channel") == "VOICE") & R.voice_deflected(R.SELF_SERVICE_LIST_A) & F.col("account").isNotNull()
    )
    d = c.select(
        "account", F.to_date("ts").alias("deflection_date"), F.col("selfservice").alias("deflection_type"),
        F.coalesce("intent", "initial_intent").alias("intent"),
    ).distinct()
    f = _later_success(spark, sf_dir, d, "deflection_date")
    agg = f.groupBy("deflection_type").agg(
        F.count_distinct("account").alias("deflected_accounts"),
        F.count_distinct(F.when(F.col("_done"), F.col("account"))).alias("completed_online"),
    )
    return agg.withColumn("completion_rate_pct", pct("completed_online", "deflected_accounts")).orderBy(
        F.col("deflected_accounts").desc(), "deflection_type"
    )


def abandoned_later_self_served(spark, sf_dir):
    """Abandoned (not deflected) callers who later self-served, intents with >= 10 accounts."""
    c = D.in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS).where(
        R.base_filter("VOICE")
        & F.col("agent_ts").isNull()
        & (F.col("selfservice").isNull() | F.col("selfservice").isin("rejected", "error"))
        & F.col("account").isNotNull()
    )
    a = c.select("account", F.to_date("ts").alias("contact_date"), F.coalesce("intent", "initial_intent").alias("intent")).distinct()
    f = _later_success(spark, sf_dir, a, "contact_date")
    agg = f.groupBy("intent").agg(
        F.count_distinct("account").alias("abandoned_accounts"),
        F.count_distinct(F.when(F.col("_done"), F.col("account"))).alias("later_self_served"),
    )
    return (
        agg.where(F.col("abandoned_accounts") >= 10)
        .withColumn("self_serve_rate_pct", pct("later_self_served", "abandoned_accounts"))
        .orderBy(F.col("abandoned_accounts").desc(), "intent")
    )


def self_service_failures(spark, sf_dir):
    """Rejected / error self-service attempts by intent."""
    c = D.in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS).where(
        R.base_filter("VOICE") & F.col("selfservice").isin("rejected", "error")
    )
    return (
        c.groupBy(F.col("selfservice").alias("failure_type"), F.coalesce("intent", "initial_intent").alias("intent"))
        .agg(F.count(F.lit(1)).alias("contacts"), F.count_distinct("account").alias("unique_accounts"))
        .orderBy(F.col("contacts").desc(), "failure_type", "intent")
    )


def queue_abandonment(spark, sf_dir):
    """Queue abandonment with average and maximum wait."""
    c = D.in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS).where(
        R.base_filter("VOICE") & F.col("agent_ts").isNull() & F.col("queue_name").isNotNull()
    )
    return (
        c.groupBy("queue_name", F.coalesce("intent", "initial_intent").alias("intent"))
        .agg(
            F.count(F.lit(1)).alias("abandoned"),
            F.round(F.avg("queue_seconds"), 0).alias("avg_queue_wait_sec"),
            F.max("queue_seconds").alias("max_queue_wait_sec"),
        )
        .orderBy(F.col("abandoned").desc(), "queue_name", "intent")
    )


def _scope(c):
    return c.where(R.base_filter("VOICE") | R.base_filter("EMAIL") | R.base_filter("CHAT"))


def channel_take_rates(spark, sf_dir):
    """R1 (A21): intent, eligibility, take rate per channel in ONE conditional aggregate.

    Eligibility and "taken" are channel-specific expressions, so the three
    per-channel scans + UNION of the documented query become one scan.
    """
    c = _scope(D.in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS))
    ch = F.col("channel")
    eligible = F.when(ch == "EMAIL", R.in_list("intent", R.EMAIL_DEFLECTABLE_INTENTS)).otherwise(
        R.in_list("intent", R.OFFERED_INTENTS)
    )
    taken = F.when(
        ch == "EMAIL",
        R.in_list("intent", R.EMAIL_DEFLECTABLE_INTENTS) & (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT") & F.col("queue_name").isNull(),
    ).otherwise(R.voice_deflected(R.SELF_SERVICE_LIST_B))
    agg = c.groupBy("channel").agg(
        F.count(F.lit(1)).alias("total_contacts"),
        count_if(F.col("intent").isNotNull()).alias("intent_detected"),
        count_if(eligible).alias("deflection_eligible"),
        count_if(taken).alias("deflection_taken"),
        count_if((ch == "VOICE") & (F.col("selfservice") == "rejected")).alias("deflection_rejected"),
        count_if(R.agent_handled()).alias("spoke_to_agent"),
    )
    return agg.select(
        "channel", "total_contacts", "intent_detected", pct("intent_detected", "total_contacts").alias("intent_rate_pct"),
        "deflection_eligible", "deflection_taken", pct("deflection_taken", "deflection_eligible").alias("take_rate_pct"),
        "deflection_rejected", "spoke_to_agent",
    ).orderBy(F.col("total_contacts").desc())


def channel_intent_breakdown(spark, sf_dir):
    """R2 (A20, A66): taken / rejected / agent by channel x intent, plus the 'offered' stage."""
    intents = R.OFFERED_INTENTS + ("FinalBillIntent", "PaymentIntent")
    c = _scope(D.in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS)).where(R.in_list("intent", intents))
    ch = F.col("channel")
    taken = (
        F.when(ch == "EMAIL", (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT") & F.col("queue_name").isNull())
        .otherwise(R.voice_deflected(R.SELF_SERVICE_LIST_B))
    )
    return (
        c.groupBy("channel", "intent")
        .agg(
            F.count(F.lit(1)).alias("total_with_intent"),
            count_if(taken).alias("deflection_taken"),
            count_if((ch == "VOICE") & (F.col("selfservice") == "rejected")).alias("deflection_rejected"),
            count_if(R.agent_handled()).alias("spoke_to_agent"),
            count_if(R.offered()).alias("offered"),
        )
        .orderBy("channel", F.col("total_with_intent").desc(), "intent")
    )


def email_outcome_breakdown(spark, sf_dir):
    """Seven-way e-mail outcome; empty strings count as missing."""
    from ..functions.core import classify, is_null_or_empty

    c = D.in_days(contacts(spark, sf_dir).where(R.base_filter("EMAIL")), EVENTS_AS_OF, EVENTS_DAYS)
    reason, queue = F.col("disconnect_reason"), F.col("queue_name")
    outcome = classify(
        [
            (queue == "Dropped Emails", "1. Spam/OOO (Dropped Emails queue)"),
            (R.agent_handled(), "2. Agent Handled"),
            ((reason == "CONTACT_FLOW_DISCONNECT") & ~is_null_or_empty("intent"), "3. Auto-Response with Intent (TRUE DEFLECTION)"),
            (
                (reason == "CONTACT_FLOW_DISCONNECT") & is_null_or_empty("intent") & is_null_or_empty("queue_name"),
                "4. System Notifications Dropped (NOT deflection)",
            ),
            ((queue == "Agent Holding Queue") & (reason == "API"), "5. In Queue (Waiting)"),
            (reason == "TRANSFERRED", "6. Transferred"),
        ],
        "7. Other",
    )
    agg = c.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("count"))
    return D.share_of_total(agg, "count").orderBy("outcome")


def self_service_by_type(spark, sf_dir):
    """K7: self-service values with their status class and distinct accounts."""
    from ..functions.core import classify

    c = D.in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS).where(
        R.base_filter("VOICE") & F.col("selfservice").isNotNull()
    )
    status = classify(
        [
            (R.in_list("selfservice", R.SELF_SERVICE_LIST_A), "SUCCESS"),
            (F.col("selfservice") == "rejected", "REJECTED"),
            (F.col("selfservice") == "error", "ERROR"),
        ],
        "OTHER",
    )
    return (
        c.groupBy("selfservice", status.alias("status"))
        .agg(F.count(F.lit(1)).alias("contacts"), F.count_distinct("account").alias("unique_accounts"))
        .orderBy(F.col("contacts").desc(), "selfservice")
    )


def daily_email_trend(spark, sf_dir):
    """Inbound e-mail per day: total, filtered, agent handled, auto-responded (closed by the flow, not filtered) and its rate."""
    from ..operators.temporal import trend

    c = D.in_days(contacts(spark, sf_dir).where(R.base_filter("EMAIL")), EVENTS_AS_OF, EVENTS_DAYS)
    filtered = F.coalesce(F.col("queue_name") == "Dropped Emails", F.lit(False))
    per_day = trend(
        c,
        "ts",
        "day",
        [
            F.count(F.lit(1)).alias("total_emails"),
            count_if(filtered).alias("spam_ooo_filtered"),
            count_if(R.agent_handled()).alias("agent_handled"),
            count_if((F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT") & ~filtered).alias("auto_responded"),
        ],
        name="date",
    )
    return per_day.withColumn("deflection_rate_pct", pct("auto_responded", "total_emails", 1)).orderBy(F.col("date").desc())


def voice_daily_deflection(spark, sf_dir):
    """K8: inbound voice per day: contacts, reached agent, true deflections, abandonments and both rates."""
    from ..operators.temporal import trend

    c = D.in_days(contacts(spark, sf_dir).where(R.base_filter("VOICE")), EVENTS_AS_OF, EVENTS_DAYS)
    lost = F.col("agent_ts").isNull() & (F.col("selfservice").isNull() | F.col("selfservice").isin("rejected", "error"))
    per_day = trend(
        c,
        "ts",
        "day",
        [
            F.count(F.lit(1)).alias("total_contacts"),
            count_if(F.col("agent_ts").isNotNull()).alias("reached_agent"),
            count_if(F.col("selfservice").isin(*R.SELF_SERVICE_LIST_A)).alias("true_deflections"),
            count_if(lost).alias("abandonments"),
        ],
        name="date",
    )
    rates = {"deflection_rate_pct": pct("true_deflections", "total_contacts", 1), "abandonment_rate_pct": pct("abandonments", "total_contacts", 1)}
    return per_day.withColumns(rates).orderBy(F.col("date").desc())


def auto_response_by_intent(spark, sf_dir):
    """E-mail auto-response and agent handling by intent."""
    c = D.in_days(contacts(spark, sf_dir).where(R.base_filter("EMAIL")), EVENTS_AS_OF, EVENTS_DAYS)
    auto = (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT") & (
        F.col("queue_name").isNull() | (F.col("queue_name") != "Dropped Emails")
    )
    agg = c.groupBy(F.coalesce("intent", F.lit("No Intent")).alias("intent")).agg(
        F.count(F.lit(1)).alias("total"), count_if(R.agent_handled()).alias("agent_handled"), count_if(auto).alias("auto_responded")
    )
    return agg.withColumn("auto_response_rate_pct", pct("auto_responded", "total")).orderBy(F.col("total").desc(), "intent")


def deflected_contacts(spark, sf_dir):
    """K19-K21 (A18): the deflected contacts of each channel, tagged by channel."""
    c = D.in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS)
    parts = [D.deflected_rows(c, ch).select("contact_id", "channel", "ts", "intent", "selfservice") for ch in ("VOICE", "CHAT", "EMAIL")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    "deflected_contacts": deflected_contacts,
    "auto_response_by_intent": auto_response_by_intent,
    "email_outcome_breakdown": email_outcome_breakdown,
    "self_service_by_type": self_service_by_type,
    "daily_email_trend": daily_email_trend,
    "voice_daily_deflection": voice_daily_deflection,
    "channel_take_rates": channel_take_rates,
    "channel_intent_breakdown": channel_intent_breakdown,
    "deflected_completion": deflected_completion,
    "abandoned_later_self_served": abandoned_later_self_served,
    "self_service_failures": self_service_failures,
    "queue_abandonment": queue_abandonment,
    "voice_contact_funnel": voice_contact_funnel,
    "email_contact_funnel": email_contact_funnel,
    "chat_contact_funnel": chat_contact_funnel,
    "voice_outcome_breakdown": voice_outcome_breakdown,
    "voice_deflection_rates": voice_deflection_rates,
    "voice_take_up_by_intent": voice_take_up_by_intent,
    "chat_take_up_by_intent": chat_take_up_by_intent,
    "channel_summary": channel_summary,
    "safeguard_breakdown": safeguard_breakdown,
}

_SHARE = "round(cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double), 1) as pct"

ORACLE = {
    "voice_contact_funnel": with_views(
        ["contacts"],
        f"""
select category, count(*) as contacts, {_SHARE}
from (
  select case
    when agent_ts is not null then 'Agent Handled'
    when selfservice in ({LIST_B}) then 'Deflection Taken'
    when selfservice = 'rejected' then 'Deflection Rejected'
    when queue_name is not null and agent_ts is null then 'Dropped in Queue'
    when intent is null then 'Dropped Pre-Intent/IDNV'
    else 'Other/In-Flow Drop' end as category
  from contacts
  where channel = 'VOICE' and initiation = 'INBOUND' and {WINDOW_SQL}
) c
group by category""",
    ),
    "email_contact_funnel": with_views(
        ["contacts"],
        f"""
select category, count(*) as contacts, {_SHARE}
from (
  select case
    when agent_ts is not null then 'Agent Handled'
    when disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and intent in ({EMAIL_INTENTS})
         and queue_name is null then 'Deflection (Auto-Response)'
    when queue_name = 'Dropped Emails' then 'Spam/OOO Filtered'
    when queue_name is not null and agent_ts is null then 'In Queue / Waiting'
    when queue_name is null and intent is null and disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
         then 'System Notifications Dropped'
    else 'Other' end as category
  from contacts
  where channel = 'EMAIL' and initiation = 'INBOUND' and {WINDOW_SQL}
) c
group by category""",
    ),
    "chat_contact_funnel": with_views(
        ["contacts"],
        f"""
select category, count(*) as contacts, {_SHARE}
from (
  select case
    when agent_ts is not null then 'Agent Handled'
    when selfservice in ({LIST_B}) then 'Deflection Taken'
    when intent is not null and queue_name is null and disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
         then 'Bot Resolved (KB Answer)'
    when disconnect_reason = 'CUSTOMER_CONNECTION_NOT_ESTABLISHED' then 'Connection Failed'
    when queue_name is not null and agent_ts is null then 'Dropped in Queue'
    when intent is not null and disconnect_reason = 'CUSTOMER_DISCONNECT' and queue_name is null
         then 'Left During Bot Chat'
    when intent is null and disconnect_reason = 'CUSTOMER_DISCONNECT' then 'Left Pre-Intent'
    when intent is null and disconnect_reason = 'CONTACT_FLOW_DISCONNECT' then 'Bot Ended (Timeout/No Input)'
    else 'Other' end as category
  from contacts
  where channel = 'CHAT' and initiation = 'API' and {WINDOW_SQL}
) c
group by category""",
    ),
    "voice_outcome_breakdown": with_views(
        ["contacts"],
        f"""
select outcome, count(*) as contacts, {_SHARE}, count(distinct account) as unique_accounts
from (
  select account, case
    when agent_ts is not null then '1. Reached Agent'
    when selfservice in ({LIST_A}) then '2. TRUE DEFLECTION (to self-service)'
    when selfservice = 'rejected' then '3. Self-Service Rejected'
    when selfservice = 'error' then '4. Self-Service Error'
    when coalesce(intent, initial_intent) is null then '5. Early Abandonment (no intent)'
    when queue_name is not null then '6. Queue Abandonment'
    else '7. IVR Abandonment' end as outcome
  from contacts
  where channel = 'VOICE' and initiation = 'INBOUND' and {WINDOW_SQL}
) c
group by outcome""",
    ),
    "voice_deflection_rates": with_views(
        ["contacts"],
        f"""
select total_voice_contacts, true_deflections,
       round(cast(true_deflections as double) * 100.0 / total_voice_contacts, 1) as true_deflection_rate_pct,
       reached_agent, round(cast(reached_agent as double) * 100.0 / total_voice_contacts, 1) as agent_rate_pct,
       abandonments, round(cast(abandonments as double) * 100.0 / total_voice_contacts, 1) as abandonment_rate_pct
from (
  select count(*) as total_voice_contacts,
         count(*) filter (where selfservice in ({LIST_A})) as true_deflections,
         count(*) filter (where agent_ts is not null) as reached_agent,
         count(*) filter (where agent_ts is null and (selfservice is null or selfservice in ('rejected', 'error'))) as abandonments
  from contacts
  where channel = 'VOICE' and initiation = 'INBOUND' and {WINDOW_SQL}
) a""",
    ),
    "voice_take_up_by_intent": with_views(
        ["contacts"],
        f"""
select intent, count(*) as offered,
       count(*) filter (where selfservice in ({LIST_B})) as taken,
       count(*) filter (where selfservice = 'rejected') as rejected,
       count(*) filter (where agent_ts is not null) as spoke_to_agent,
       round(cast(count(*) filter (where selfservice in ({LIST_B})) as double) * 100.0 / count(*), 0) as take_up_rate_pct
from contacts
where channel = 'VOICE' and initiation = 'INBOUND' and {WINDOW_SQL} and intent in ({OFFERED})
group by intent""",
    ),
    "chat_take_up_by_intent": with_views(
        ["contacts"],
        f"""
select intent, count(*) as total_with_intent,
       count(*) filter (where selfservice in ({LIST_B})) as deflection_taken,
       count(*) filter (where queue_name is null and agent_ts is null
                        and disconnect_reason = 'CONTACT_FLOW_DISCONNECT') as bot_resolved,
       count(*) filter (where agent_ts is not null) as spoke_to_agent
from contacts
where channel = 'CHAT' and initiation = 'API' and {WINDOW_SQL} and intent in ({OFFERED})
group by intent""",
    ),
    "channel_summary": with_views(
        ["contacts"],
        f"""
select channel, count(*) as total_contacts,
       count(*) filter (where agent_ts is not null) as agent_handled,
       round(cast(count(*) filter (where agent_ts is not null) as double) * 100.0 / count(*), 1) as agent_handled_pct,
       cast(sum(case
         when channel = 'VOICE' and selfservice in ({LIST_B}) then 1
         when channel = 'EMAIL' and disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
              and intent in ({EMAIL_INTENTS}) and queue_name is null then 1
         when channel = 'CHAT' and agent_ts is null and queue_name is null
              and disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and intent is not null then 1
         else 0 end) as bigint) as deflected,
       count(*) filter (where queue_name is not null and agent_ts is null and channel != 'EMAIL') as dropped_in_queue
from contacts
where {WINDOW_SQL}
  and ((channel = 'VOICE' and initiation = 'INBOUND') or (channel = 'EMAIL' and initiation = 'INBOUND')
       or (channel = 'CHAT' and initiation = 'API'))
group by channel""",
    ),
    "safeguard_breakdown": with_views(
        ["contacts"],
        f"""
select e.intent, count(*) as total,
       count(*) filter (where e.outcome = 'DEFLECTED') as deflected,
       count(*) filter (where e.outcome = 'NOT_DEFLECTED' and c.n >= 3) as blocked_by_threshold,
       count(*) filter (where e.outcome = 'NOT_DEFLECTED' and c.n < 3) as blocked_by_other_safeguard,
       round(cast(count(*) filter (where e.outcome = 'DEFLECTED') as double) * 100.0 / count(*), 0) as deflection_rate_pct
from (
  select intent, case_id,
         case when disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is null
              then 'DEFLECTED' else 'NOT_DEFLECTED' end as outcome
  from contacts
  where channel = 'EMAIL' and initiation = 'INBOUND' and {WINDOW_SQL} and intent in ({EMAIL_INTENTS})
) e
left join (
  select case_id, count(*) as n from contacts
  where channel = 'EMAIL' and initiation = 'INBOUND' and case_id is not null
    and ts >= timestamp '2024-01-01'
  group by case_id
) c on e.case_id = c.case_id
group by e.intent""",
    ),
}


ORACLE["deflected_completion"] = with_views(
    ["contacts", "journeys"],
    f"""
select d.deflection_type, count(distinct d.account) as deflected_accounts,
       count(distinct case when ss.account_number is not null then d.account end) as completed_online,
       round(cast(count(distinct case when ss.account_number is not null then d.account end) as double) * 100.0
             / nullif(cast(count(distinct d.account) as double), 0), 1) as completion_rate_pct
from (select distinct account, cast(ts as date) as deflection_date, selfservice as deflection_type,
             coalesce(intent, initial_intent) as intent
      from contacts where {WINDOW_SQL} and channel = 'VOICE' and selfservice in ({LIST_A}) and account is not null) d
left join (select * from journeys where created_date >= date '2024-01-01') ss
  on d.account = ss.account_number and ss.created_date >= d.deflection_date and ss.success_status = 'Y'
group by d.deflection_type""",
)
ORACLE["abandoned_later_self_served"] = with_views(
    ["contacts", "journeys"],
    f"""
select a.intent, count(distinct a.account) as abandoned_accounts,
       count(distinct case when ss.account_number is not null then a.account end) as later_self_served,
       round(cast(count(distinct case when ss.account_number is not null then a.account end) as double) * 100.0
             / nullif(cast(count(distinct a.account) as double), 0), 1) as self_serve_rate_pct
from (select distinct account, cast(ts as date) as contact_date, coalesce(intent, initial_intent) as intent
      from contacts where {WINDOW_SQL} and channel = 'VOICE' and initiation = 'INBOUND' and agent_ts is null
        and (selfservice is null or selfservice in ('rejected', 'error')) and account is not null) a
left join (select distinct account_number, created_date from journeys
           where created_date >= date '2024-01-01' and success_status = 'Y') ss
  on a.account = ss.account_number and ss.created_date >= a.contact_date
group by a.intent
having count(distinct a.account) >= 10""",
)
ORACLE["self_service_failures"] = with_views(
    ["contacts"],
    f"""
select selfservice as failure_type, coalesce(intent, initial_intent) as intent, count(*) as contacts,
       count(distinct account) as unique_accounts
from contacts where {WINDOW_SQL} and channel = 'VOICE' and initiation = 'INBOUND' and selfservice in ('rejected', 'error')
group by 1, 2""",
)
ORACLE["queue_abandonment"] = with_views(
    ["contacts"],
    f"""
select queue_name, coalesce(intent, initial_intent) as intent, count(*) as abandoned,
       round(avg(queue_seconds), 0) as avg_queue_wait_sec, max(queue_seconds) as max_queue_wait_sec
from contacts where {WINDOW_SQL} and channel = 'VOICE' and initiation = 'INBOUND' and agent_ts is null
  and queue_name is not null
group by 1, 2""",
)

_SCOPE_SQL = """((channel = 'VOICE' and initiation = 'INBOUND') or (channel = 'EMAIL' and initiation = 'INBOUND')
       or (channel = 'CHAT' and initiation = 'API'))"""
ORACLE["channel_take_rates"] = with_views(
    ["contacts"],
    f"""
select channel, total_contacts, intent_detected,
       round(cast(intent_detected as double) * 100.0 / nullif(cast(total_contacts as double), 0), 1) as intent_rate_pct,
       deflection_eligible, deflection_taken,
       round(cast(deflection_taken as double) * 100.0 / nullif(cast(deflection_eligible as double), 0), 1) as take_rate_pct,
       deflection_rejected, spoke_to_agent
from (
  select channel, count(*) as total_contacts,
    count(*) filter (where intent is not null) as intent_detected,
    count(*) filter (where (channel = 'EMAIL' and intent in ({EMAIL_INTENTS}))
                        or (channel != 'EMAIL' and intent in ({OFFERED}))) as deflection_eligible,
    count(*) filter (where (channel = 'EMAIL' and intent in ({EMAIL_INTENTS})
                            and disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is null)
                        or (channel != 'EMAIL' and selfservice in ({LIST_B}))) as deflection_taken,
    count(*) filter (where channel = 'VOICE' and selfservice = 'rejected') as deflection_rejected,
    count(*) filter (where agent_ts is not null) as spoke_to_agent
  from contacts where {WINDOW_SQL} and {_SCOPE_SQL}
  group by channel
) s""",
)
ORACLE["channel_intent_breakdown"] = with_views(
    ["contacts"],
    f"""
select channel, intent, count(*) as total_with_intent,
  count(*) filter (where (channel = 'EMAIL' and disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is null)
                      or (channel != 'EMAIL' and selfservice in ({LIST_B}))) as deflection_taken,
  count(*) filter (where channel = 'VOICE' and selfservice = 'rejected') as deflection_rejected,
  count(*) filter (where agent_ts is not null) as spoke_to_agent,
  count(*) filter (where intent in ({OFFERED}) and (selfservice is not null or agent_ts is not null
                                                    or queue_name is not null)) as offered
from contacts where {WINDOW_SQL} and {_SCOPE_SQL}
  and intent in ({OFFERED}, 'FinalBillIntent', 'PaymentIntent')
group by channel, intent""",
)

ORACLE["email_outcome_breakdown"] = with_views(
    ["contacts"],
    f"""
select outcome, count(*) as count, {_SHARE}
from (
  select case
    when queue_name = 'Dropped Emails' then '1. Spam/OOO (Dropped Emails queue)'
    when agent_ts is not null then '2. Agent Handled'
    when disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and intent is not null and intent != ''
      then '3. Auto-Response with Intent (TRUE DEFLECTION)'
    when disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and (intent is null or intent = '')
      and (queue_name is null or queue_name = '') then '4. System Notifications Dropped (NOT deflection)'
    when queue_name = 'Agent Holding Queue' and disconnect_reason = 'API' then '5. In Queue (Waiting)'
    when disconnect_reason = 'TRANSFERRED' then '6. Transferred'
    else '7. Other' end as outcome
  from contacts where channel = 'EMAIL' and initiation = 'INBOUND' and {WINDOW_SQL}
) x group by outcome""",
)
ORACLE["self_service_by_type"] = with_views(
    ["contacts"],
    f"""
select selfservice, case when selfservice in ({LIST_A}) then 'SUCCESS' when selfservice = 'rejected' then 'REJECTED'
                         when selfservice = 'error' then 'ERROR' else 'OTHER' end as status,
       count(*) as contacts, count(distinct account) as unique_accounts
from contacts where {WINDOW_SQL} and channel = 'VOICE' and initiation = 'INBOUND' and selfservice is not null
group by 1, 2""",
)
ORACLE["daily_email_trend"] = with_views(
    ["contacts"],
    f"""
select date, total_emails, spam_ooo_filtered, agent_handled, auto_responded,
       round(cast(auto_responded as double) * 100.0 / cast(total_emails as double), 1) as deflection_rate_pct
from (
  select cast(ts as date) as date, count(*) as total_emails,
    count(*) filter (where queue_name = 'Dropped Emails') as spam_ooo_filtered,
    count(*) filter (where agent_ts is not null) as agent_handled,
    count(*) filter (where disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is distinct from 'Dropped Emails') as auto_responded
  from contacts where channel = 'EMAIL' and initiation = 'INBOUND' and {WINDOW_SQL}
  group by 1)""",
)

ORACLE["voice_daily_deflection"] = with_views(
    ["contacts"],
    f"""
select *, round(cast(true_deflections as double) * 100.0 / cast(total_contacts as double), 1) as deflection_rate_pct,
       round(cast(abandonments as double) * 100.0 / cast(total_contacts as double), 1) as abandonment_rate_pct
from (
  select cast(ts as date) as date, count(*) as total_contacts, count(agent_ts) as reached_agent,
    count(*) filter (where selfservice in ({LIST_A})) as true_deflections,
    count(*) filter (where agent_ts is null and coalesce(selfservice, 'error') in ('rejected', 'error')) as abandonments
  from contacts where channel = 'VOICE' and initiation = 'INBOUND' and {WINDOW_SQL}
  group by 1)""",
)

ORACLE["auto_response_by_intent"] = with_views(
    ["contacts"],
    f"""
select coalesce(intent, 'No Intent') as intent, count(*) as total,
       count(*) filter (where agent_ts is not null) as agent_handled,
       count(*) filter (where disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
                        and (queue_name is null or queue_name != 'Dropped Emails')) as auto_responded,
       round(cast(count(*) filter (where disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
                        and (queue_name is null or queue_name != 'Dropped Emails')) as double) * 100.0 / count(*), 1)
         as auto_response_rate_pct
from contacts where channel = 'EMAIL' and initiation = 'INBOUND' and {WINDOW_SQL}
group by 1""",
)

ORACLE["deflected_contacts"] = with_views(
    ["contacts"],
    f"""
select contact_id, channel, ts, intent, selfservice from contacts
where {WINDOW_SQL} and initiation = 'INBOUND' and (
  (channel = 'VOICE' and selfservice in ({LIST_B}))
  or (channel = 'CHAT' and agent_ts is null and intent is not null)
  or (channel = 'EMAIL' and disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and intent in ({EMAIL_INTENTS})
      and queue_name is null))""",
)
