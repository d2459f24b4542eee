"""Catalogue: containment, identity resolution, attribution, repeat contacts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.core import ntz

from ..functions import contact_rules as R
from ..functions.core import classify, pct
from ..operators import behaviour as B
from ..operators.deflection import in_days
from ..sources.standins import contacts, journeys, web_events
from .common import EVENTS_AS_OF, sql_list, with_views

DAY = 86_400
AS_OF_TS = dt.datetime(2024, 1, 31)
SINCE_30D = AS_OF_TS - dt.timedelta(days=30)
SINCE_365D = AS_OF_TS - dt.timedelta(days=365)
# Subjects: every day of the table except the last follow-up buffer.
SUBJECT_LO, SUBJECT_HI = 30, 4
LIST_B = sql_list(R.SELF_SERVICE_LIST_B)


def _since(df, column, when):
    return df.where(F.col(column) >= ntz(when))


def _containment_agg(flagged, by, count_name, cb_name):
    agg = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias(count_name), F.sum(F.col("called_back").cast("long")).alias(cb_name)
    )
    return agg.select(
        *by,
        count_name,
        cb_name,
        pct(cb_name, count_name).alias("callback_rate_pct"),
        pct(F.col(count_name) - F.col(cb_name), count_name).alias("containment_rate_pct"),
    )


def containment_by_outcome(spark, sf_dir):
    """Voice callback within 3 days, deflected vs agent-handled."""
    voice = contacts(spark, sf_dir).where(R.base_filter("VOICE"))
    outcome = classify([(R.agent_handled(), "Agent Handled"), (R.voice_deflected(), "Deflected")])
    subjects = in_days(voice, EVENTS_AS_OF, SUBJECT_LO, SUBJECT_HI).withColumn("outcome", outcome).where(
        F.col("outcome").isNotNull()
    )
    flagged = B.exists_within_ts(subjects, _since(voice, "ts", SINCE_30D), "endpoint", "ts", "called_back", 3 * DAY)
    return _containment_agg(flagged, ["outcome"], "contacts", "called_back_within_3_days").orderBy("outcome")


def containment_by_deflection_type(spark, sf_dir):
    """Voice containment per deflection type (6-hour window discriminates on the test data)."""
    voice = contacts(spark, sf_dir).where(R.base_filter("VOICE"))
    subjects = in_days(voice.where(R.voice_deflected()), EVENTS_AS_OF, SUBJECT_LO, SUBJECT_HI).withColumn(
        "deflection_type", R.deflection_type()
    )
    flagged = B.exists_within_ts(subjects, _since(voice, "ts", SINCE_30D), "endpoint", "ts", "called_back", 6 * 3600)
    return _containment_agg(flagged, ["deflection_type"], "deflected", "called_back").orderBy(
        F.col("deflected").desc(), "deflection_type"
    )


def chat_bot_containment(spark, sf_dir):
    """Bot-resolved chats followed by a contact on any channel within 3 days."""
    c = contacts(spark, sf_dir)
    subjects = in_days(c.where(R.base_filter("CHAT") & R.chat_deflected()), EVENTS_AS_OF, SUBJECT_LO, SUBJECT_HI)
    cands = _since(c.where(F.col("initiation").isin("INBOUND", "API")), "ts", SINCE_30D)
    flagged = B.exists_within_ts(subjects, cands, "endpoint", "ts", "called_back", 3 * DAY).withColumn(
        "outcome", F.lit("Chat Bot Resolved")
    )
    return _containment_agg(flagged, ["outcome"], "contacts", "called_back_within_3_days")


def _phone_to_account(c):
    known = _since(c.where(F.col("account").isNotNull() & (F.col("account") != "")), "ts", SINCE_365D)
    return B.latest_by(known, "endpoint", "ts", "account", tiebreak="contact_id", name="acct_num").withColumnRenamed(
        "endpoint", "phone"
    )


def latest_account_per_party(spark, sf_dir):
    """Phone -> latest identified account number."""
    return _phone_to_account(contacts(spark, sf_dir))


def renewal_deflection_funnel(spark, sf_dir):
    """Deflected renewals -> renewed self-serve / via agent within 7 days, callbacks."""
    c = contacts(spark, sf_dir)
    voice = c.where(R.base_filter("VOICE"))
    subjects = (
        in_days(voice.where(F.col("selfservice") == "renewalOnline"), EVENTS_AS_OF, SUBJECT_LO, SUBJECT_HI)
        .select("contact_id", F.col("endpoint").alias("phone"), F.to_date("ts").alias("deflection_date"), F.col("ts").alias("deflection_ts"))
        .join(_phone_to_account(c), "phone")
    )
    j = journeys(spark, sf_dir).where(
        (F.col("kpi_name") == "Renewals") & (F.col("created_date") >= F.lit(SINCE_30D.date())) & (F.col("success_status") == "Y")
    )
    callbacks = _since(voice.where(R.agent_handled()), "ts", SINCE_30D)
    f = B.exists_within_days_many(
        subjects,
        "acct_num",
        "deflection_date",
        7,
        [
            ("renewed_self_serve", j.where(F.col("channel") == "Self Serve"), "account_number", "created_date"),
            ("renewed_via_agent", j.where(F.col("channel") == "Agent"), "account_number", "created_date"),
        ],
    )
    f = B.exists_within_ts(f, callbacks, "phone", "deflection_ts", "called_back", 7 * DAY, cand_key="endpoint", cand_ts="ts")
    agg = f.agg(
        F.count(F.lit(1)).alias("trackable_deflected"),
        F.sum(F.col("called_back").cast("long")).alias("called_back"),
        F.sum(F.col("renewed_self_serve").cast("long")).alias("renewed_self_serve"),
        F.sum(F.col("renewed_via_agent").cast("long")).alias("renewed_via_agent"),
        F.sum((F.col("renewed_self_serve") | F.col("renewed_via_agent")).cast("long")).alias("total_renewed"),
    )
    n = F.col("trackable_deflected")
    return agg.select(
        "trackable_deflected",
        "called_back",
        pct("called_back", n).alias("callback_rate_pct"),
        "renewed_self_serve",
        pct("renewed_self_serve", n).alias("self_serve_rate_pct"),
        "renewed_via_agent",
        pct("renewed_via_agent", n).alias("agent_rate_pct"),
        "total_renewed",
        pct("total_renewed", n).alias("total_renewal_rate_pct"),
    )


def _visits(spark, sf_dir, patterns):
    w = web_events(spark, sf_dir)
    cond = None
    for p in patterns:
        cond = F.col("event_name").like(p) if cond is None else cond | F.col("event_name").like(p)
    return w.where((F.col("event_date") >= SINCE_30D.strftime("%Y%m%d")) & cond & F.col("user_id").isNotNull()).select(
        F.col("user_id").alias("account_number"), F.to_date("event_date", "yyyyMMdd").alias("visit_date")
    )


def visit_success(spark, sf_dir):
    """Renewal page visits / same-day visits / completions, VOICE and EMAIL."""
    c = contacts(spark, sf_dir)
    voice = (
        in_days(c.where(R.base_filter("VOICE") & (F.col("selfservice") == "renewalOnline")), EVENTS_AS_OF, SUBJECT_LO, SUBJECT_HI)
        .select("contact_id", F.col("endpoint").alias("phone"), F.to_date("ts").alias("deflection_date"))
        .join(_phone_to_account(c), "phone")
        .select("contact_id", "acct_num", "deflection_date", F.lit("VOICE").alias("channel"))
    )
    email = in_days(
        c.where(
            R.base_filter("EMAIL")
            & (F.col("intent") == "RenewalIntent")
            & (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT")
            & F.col("queue_name").isNull()
            & F.col("account").isNotNull()
            & (F.col("account") != "")
        ),
        EVENTS_AS_OF,
        SUBJECT_LO,
        SUBJECT_HI,
    ).select("contact_id", F.col("account").alias("acct_num"), F.to_date("ts").alias("deflection_date"), F.lit("EMAIL").alias("channel"))
    subjects = voice.unionByName(email)
    visits = _visits(spark, sf_dir, ["Renewal%"])
    done = journeys(spark, sf_dir).where(
        (F.col("kpi_name") == "Renewals") & (F.col("channel") == "Self Serve") & (F.col("success_status") == "Y")
        & (F.col("created_date") >= F.lit(SINCE_30D.date()))
    )
    # flags depend on account and day alone: one row for all contacts of an account's day
    days = subjects.groupBy("channel", "acct_num", "deflection_date").agg(F.count(F.lit(1)).alias("n"))
    f = B.visit_attribution(
        days, "acct_num", "deflection_date", (visits, "account_number", "visit_date"),
        {"completed_flag": (done, "account_number", "created_date")}, part_rows=None,
    )
    # Subjects are one row per contact, so the documented COUNT(DISTINCT contactid)
    # columns are sums of n: no Expand of the rows per distinct.
    times = lambda cond: F.sum(F.when(F.col(cond), F.col("n")).otherwise(F.lit(0)))
    agg = f.groupBy("channel").agg(
        F.sum("n").alias("trackable"),
        times("visited").alias("visited_page"),
        times("visited_same_day").alias("visited_same_day"),
        times("completed_flag").alias("completed"),
    )
    return agg.select(
        "channel", "trackable", "visited_page", pct("visited_page", "trackable").alias("visited_pct"), "visited_same_day", "completed"
    )


POST_DEFLECTION_HI = 8
_TYPE_OF = (
    ("renewalOnline", "Renewal"),
    ("submitMeterReadingOnline", "MeterReading"),
    ("makeACardPaymentOnline", "CardPayment"),
    ("directDebitOnline", "DirectDebit"),
    ("moveInOnline", "MovingIn"),
    ("moveOutOnline", "MovingOut"),
)


def _deflected_with_repeats(spark, sf_dir):
    """Deflected voice contacts (contact_id, deflection_type, acct_num, contact_date) and their repeat-contact flags."""
    c = contacts(spark, sf_dir)
    dtype = classify([(F.col("selfservice") == route, name) for route, name in _TYPE_OF])
    deflected = in_days(c.where(R.base_filter("VOICE") & R.voice_deflected()), EVENTS_AS_OF, SUBJECT_LO, POST_DEFLECTION_HI).select(
        "contact_id", F.col("endpoint").alias("phone"), F.to_date("ts").alias("contact_date"), "ts", dtype.alias("deflection_type")
    )
    mails = (
        _since(c.where((F.col("channel") == "EMAIL") & F.col("account").isNotNull() & F.col("endpoint").isNotNull()), "ts", SINCE_365D)
        .select(F.col("account").alias("acct_num"), F.col("endpoint").alias("email_addr"))
        .distinct()
    )
    known = deflected.join(_phone_to_account(c), "phone", "left").join(mails, "acct_num", "left")
    # no subject is looked up beyond its window, so older candidates are not read
    scope = R.base_filter("VOICE") | R.base_filter("EMAIL") | R.base_filter("CHAT")
    cands = _since(c.where(scope), "ts", SINCE_30D).select("endpoint", "ts", "channel")
    channel = lambda name: F.col("channel") == name
    return B.repeat_contacts(
        known,
        {"phone": "phone", "email": "email_addr"},
        cands,
        {"repeat_voice": ("phone", channel("VOICE")), "repeat_email": ("email", channel("EMAIL")), "repeat_chat": ("phone", channel("CHAT"))},
        keep=["deflection_type", "acct_num", "contact_date"],
    )


def repeat_contacts(spark, sf_dir):
    """Deflected voice contacts that came back within 3 days (30 minutes at least), by any identifier and per channel."""
    flags = ["repeat_any", "repeat_voice", "repeat_email", "repeat_chat"]
    found = _deflected_with_repeats(spark, sf_dir)
    return found.select("contact_id", "deflection_type", *[F.col(f).cast("int").alias(f) for f in flags])


def deflection_totals(spark, sf_dir):
    """Counts of R3 per deflection type: deflected, trackable, visits, completions and repeat contacts."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    repeats = {"repeat_contact": "repeat_any", "repeat_via_voice": "repeat_voice", "repeat_via_email": "repeat_email", "repeat_via_chat": "repeat_chat"}
    # later steps depend on account and day alone: one row for all contacts of an account's day
    days = _deflected_with_repeats(spark, sf_dir).groupBy("deflection_type", "acct_num", "contact_date").agg(
        F.count(F.lit(1)).alias("n"), *[count(flag).alias(name) for name, flag in repeats.items()]
    )
    visits = _visits(spark, sf_dir, ["Renewal%", "Submit Read%", "Payment%", "Direct Debit%"])
    jn = journeys(spark, sf_dir).where((F.col("success_status") == "Y") & (F.col("created_date") >= F.lit(SINCE_30D.date())))
    done = {"self_serve": F.col("channel") == "Self Serve", "via_agent": F.col("channel") == "Agent"}
    o = B.exists_after_many(
        days, "acct_num", B.day_number("contact_date"), -1, 7,
        [("visited", visits, "account_number", B.day_number("visit_date")), (done, jn, "account_number", B.day_number("created_date"))],
        part_rows=None,  # a row per account, day and type
    )
    times = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return o.groupBy("deflection_type").agg(
        F.sum("n").alias("total_deflected"),
        times(F.col("acct_num").isNotNull()).alias("trackable"),
        times(F.col("visited")).alias("visited_page"),
        times(F.col("self_serve")).alias("completed_self_serve"),
        *[F.sum(name).alias(name) for name in repeats],
        times(F.col("via_agent")).alias("completed_via_agent"),
        times(F.col("self_serve") | F.col("via_agent")).alias("total_completed"),
    )


def post_deflection_funnel(spark, sf_dir):
    """R3 (A29): weekly voice post-deflection funnel per deflection type.

    The OR-join on phone/e-mail (A28) is one sweep over (contact,
    identifier); visits and completions are one sweep over account days.
    """
    agg = deflection_totals(spark, sf_dir)
    t, n = F.col("trackable"), F.col("total_deflected")
    return agg.select(
        "deflection_type",
        "total_deflected",
        "trackable",
        "visited_page",
        pct("visited_page", t).alias("visited_page_pct"),
        "completed_self_serve",
        pct("completed_self_serve", t).alias("self_serve_pct"),
        "repeat_contact",
        pct("repeat_contact", n).alias("repeat_rate_pct"),
        "repeat_via_voice",
        "repeat_via_email",
        "repeat_via_chat",
        pct(n - F.col("repeat_contact"), n).alias("containment_pct"),
        "completed_via_agent",
        pct("completed_via_agent", t).alias("agent_completion_pct"),
        "total_completed",
        pct("total_completed", t).alias("total_completion_pct"),
    ).orderBy(F.col("total_deflected").desc(), "deflection_type")


QUERIES = {
    "containment_by_outcome": containment_by_outcome,
    "containment_by_deflection_type": containment_by_deflection_type,
    "chat_bot_containment": chat_bot_containment,
    "latest_account_per_party": latest_account_per_party,
    "renewal_deflection_funnel": renewal_deflection_funnel,
    "visit_success": visit_success,
    "repeat_contacts": repeat_contacts,
    "post_deflection_funnel": post_deflection_funnel,
}

SUBJ = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-28'"
SINCE = "timestamp '2024-01-01'"
_P2A = f"""
p2a as (
  select endpoint as phone, account as acct_num from (
    select endpoint, account, row_number() over (partition by endpoint order by ts desc, contact_id desc) as rn
    from contacts where account is not null and account != '' and ts >= timestamp '2023-01-31'
  ) x where rn = 1
)"""


def _pct(n, d):
    return f"round(cast({n} as double) * 100.0 / nullif(cast({d} as double), 0), 1)"


_ROUTE_CASE = " ".join(f"when '{route}' then '{name}'" for route, name in _TYPE_OF)
# one row per deflected voice contact, and one existence test per contact and window
REPEAT_CTES = (
    _P2A
    + f""",
subject as (
  select v.contact_id, v.endpoint as phone, p.acct_num, v.ts, cast(v.ts as date) as day,
         case v.selfservice {_ROUTE_CASE} end as deflection_type
  from contacts v left join p2a p on p.phone = v.endpoint
  where v.channel = 'VOICE' and v.initiation = 'INBOUND' and v.selfservice in ({LIST_B})
    and v.ts >= timestamp '2024-01-01' and v.ts < timestamp '2024-01-24'
),
reach as (
  select contact_id, endpoint, ts, channel from contacts
  where (channel, initiation) in (('VOICE', 'INBOUND'), ('EMAIL', 'INBOUND'), ('CHAT', 'API'))
),
address as (
  select distinct account, endpoint from contacts
  where channel = 'EMAIL' and account is not null and endpoint is not null and ts >= timestamp '2023-01-31'
)"""
)
_LATER = "r.contact_id <> s.contact_id and r.ts > s.ts + interval 30 minute and r.ts <= s.ts + interval 3 day"


def _by_phone(cond="true"):
    return f"exists (select 1 from reach r where r.endpoint = s.phone and {_LATER} and {cond})"


def _by_mail(cond="true"):
    return f"exists (select 1 from reach r join address a on a.endpoint = r.endpoint where a.account = s.acct_num and {_LATER} and {cond})"


_REPEATS = f"""cast({_by_phone()} or {_by_mail()} as integer) as repeat_any,
  cast({_by_phone("r.channel = 'VOICE'")} as integer) as repeat_voice,
  cast({_by_mail("r.channel = 'EMAIL'")} as integer) as repeat_email,
  cast({_by_phone("r.channel = 'CHAT'")} as integer) as repeat_chat"""


def _journey(channel):
    return f"""exists (select 1 from journeys j where j.account_number = s.acct_num and j.channel = '{channel}'
    and j.success_status = 'Y' and j.created_date between s.day and s.day + 7)"""


TOTAL_CTES = (
    REPEAT_CTES
    + f""",
told as (
  select s.deflection_type, s.acct_num, {_REPEATS},
    exists (select 1 from web_events w where w.user_id = s.acct_num
      and (w.event_name like 'Renewal%' or w.event_name like 'Submit Read%' or w.event_name like 'Payment%' or w.event_name like 'Direct Debit%')
      and strptime(w.event_date, '%Y%m%d')::date between s.day and s.day + 7) as visited,
    {_journey('Self Serve')} as by_self, {_journey('Agent')} as by_agent
  from subject s
),
totals as (
  select deflection_type, count(*) as total_deflected, count(acct_num) as trackable,
    count(*) filter (where visited) as visited_page, count(*) filter (where by_self) as completed_self_serve,
    cast(sum(repeat_any) as bigint) as repeat_contact, cast(sum(repeat_voice) as bigint) as repeat_via_voice,
    cast(sum(repeat_email) as bigint) as repeat_via_email, cast(sum(repeat_chat) as bigint) as repeat_via_chat,
    count(*) filter (where by_agent) as completed_via_agent, count(*) filter (where by_self or by_agent) as total_completed
  from told group by deflection_type
)"""
)


ORACLE = {
    "containment_by_outcome": with_views(
        ["contacts"],
        f"""
select outcome, count(*) as contacts, cast(sum(cb) as bigint) as called_back_within_3_days,
       {_pct('sum(cb)', 'count(*)')} as callback_rate_pct,
       {_pct('count(*) - sum(cb)', 'count(*)')} as containment_rate_pct
from (
  select vc.outcome, case when exists (
      select 1 from voice av where av.endpoint = vc.endpoint and av.ts > vc.ts
        and av.ts <= vc.ts + interval 3 day and av.ts >= {SINCE}) then 1 else 0 end as cb
  from (select *, case when agent_ts is not null then 'Agent Handled'
                       when selfservice in ({LIST_B}) then 'Deflected' end as outcome
        from voice where {SUBJ}) vc
  where vc.outcome is not null
) x group by outcome""",
        "voice as (select * from contacts where channel = 'VOICE' and initiation = 'INBOUND')",
    ),
    "containment_by_deflection_type": with_views(
        ["contacts"],
        f"""
select deflection_type, count(*) as deflected, cast(sum(cb) as bigint) as called_back,
       {_pct('sum(cb)', 'count(*)')} as callback_rate_pct,
       {_pct('count(*) - sum(cb)', 'count(*)')} as containment_rate_pct
from (
  select case selfservice when 'renewalOnline' then 'Renewal' when 'moveInOnline' then 'MovingIn'
           when 'moveOutOnline' then 'MovingOut' when 'submitMeterReadingOnline' then 'SubmitMeterReading'
           when 'makeACardPaymentOnline' then 'MakeACardPayment' when 'directDebitOnline' then 'DirectDebit' end
           as deflection_type,
         case when exists (select 1 from voice av where av.endpoint = dc.endpoint and av.ts > dc.ts
             and av.ts <= dc.ts + interval 6 hour and av.ts >= {SINCE}) then 1 else 0 end as cb
  from voice dc where selfservice in ({LIST_B}) and {SUBJ}
) x group by deflection_type""",
        "voice as (select * from contacts where channel = 'VOICE' and initiation = 'INBOUND')",
    ),
    "chat_bot_containment": with_views(
        ["contacts"],
        f"""
select 'Chat Bot Resolved' as outcome, count(*) as contacts, cast(sum(cb) as bigint) as called_back_within_3_days,
       {_pct('sum(cb)', 'count(*)')} as callback_rate_pct,
       {_pct('count(*) - sum(cb)', 'count(*)')} as containment_rate_pct
from (
  select case when exists (select 1 from contacts ac where ac.initiation in ('INBOUND', 'API')
             and ac.endpoint = cb.endpoint and ac.ts > cb.ts and ac.ts <= cb.ts + interval 3 day
             and ac.ts >= {SINCE}) then 1 else 0 end as cb
  from contacts cb
  where channel = 'CHAT' and initiation = 'API' and agent_ts is null and queue_name is null
    and disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and intent is not null and {SUBJ}
) x""",
    ),
    "latest_account_per_party": with_views(["contacts"], "select phone, acct_num from p2a", _P2A),
    "renewal_deflection_funnel": with_views(
        ["contacts", "journeys"],
        f"""
select trackable_deflected, called_back, {_pct('called_back', 'trackable_deflected')} as callback_rate_pct,
       renewed_self_serve, {_pct('renewed_self_serve', 'trackable_deflected')} as self_serve_rate_pct,
       renewed_via_agent, {_pct('renewed_via_agent', 'trackable_deflected')} as agent_rate_pct,
       total_renewed, {_pct('total_renewed', 'trackable_deflected')} as total_renewal_rate_pct
from (
  select count(*) as trackable_deflected, cast(sum(called_back) as bigint) as called_back,
         cast(sum(rs) as bigint) as renewed_self_serve, cast(sum(ra) as bigint) as renewed_via_agent,
         cast(sum(case when rs = 1 or ra = 1 then 1 else 0 end) as bigint) as total_renewed
  from (
    select d.contact_id,
      max(case when rj.channel = 'Self Serve' and rj.success_status = 'Y'
               and rj.created_date between d.dd and d.dd + 7 then 1 else 0 end) as rs,
      max(case when rj.channel = 'Agent' and rj.success_status = 'Y'
               and rj.created_date between d.dd and d.dd + 7 then 1 else 0 end) as ra,
      max(case when cb.ts > d.dts and cb.ts <= d.dts + interval 7 day then 1 else 0 end) as called_back
    from (select v.contact_id, v.endpoint as phone, cast(v.ts as date) as dd, v.ts as dts, p.acct_num
          from contacts v join p2a p on v.endpoint = p.phone
          where v.channel = 'VOICE' and v.initiation = 'INBOUND' and v.selfservice = 'renewalOnline'
            and v.{SUBJ}) d
    left join (select * from journeys where kpi_name = 'Renewals' and created_date >= date '2024-01-01') rj
      on d.acct_num = rj.account_number
    left join (select endpoint, ts from contacts where channel = 'VOICE' and initiation = 'INBOUND'
               and agent_ts is not null and ts >= {SINCE}) cb on d.phone = cb.endpoint
    group by d.contact_id
  ) o
) a""",
        _P2A,
    ),
    "visit_success": with_views(
        ["contacts", "journeys", "web_events"],
        f"""
select channel, trackable, visited_page, {_pct('visited_page', 'trackable')} as visited_pct, visited_same_day, completed
from (
  select s.channel, count(distinct s.contact_id) as trackable,
    count(distinct case when rv.visit_date between s.dd and s.dd + 7 then s.contact_id end) as visited_page,
    count(distinct case when rv.visit_date = s.dd then s.contact_id end) as visited_same_day,
    count(distinct case when rc.created_date between s.dd and s.dd + 7 then s.contact_id end) as completed
  from (
    select 'VOICE' as channel, v.contact_id, p.acct_num, cast(v.ts as date) as dd
    from contacts v join p2a p on v.endpoint = p.phone
    where v.channel = 'VOICE' and v.initiation = 'INBOUND' and v.selfservice = 'renewalOnline' and v.{SUBJ}
    union all
    select 'EMAIL', contact_id, account, cast(ts as date)
    from contacts where channel = 'EMAIL' and initiation = 'INBOUND' and intent = 'RenewalIntent'
      and disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is null and {SUBJ}
      and account is not null and account != ''
  ) s
  left join (select user_id as account_number, strptime(event_date, '%Y%m%d')::date as visit_date
             from web_events where event_date >= '20240101' and event_name like 'Renewal%'
               and user_id is not null) rv on s.acct_num = rv.account_number
  left join (select account_number, created_date from journeys where kpi_name = 'Renewals'
             and channel = 'Self Serve' and success_status = 'Y' and created_date >= date '2024-01-01') rc
    on s.acct_num = rc.account_number
  group by s.channel
) a""",
        _P2A,
    ),
    "repeat_contacts": with_views(["contacts"], f"select contact_id, deflection_type, {_REPEATS} from subject s", REPEAT_CTES),
    "post_deflection_funnel": with_views(
        ["contacts", "journeys", "web_events"],
        f"""
select deflection_type, total_deflected, trackable, visited_page, {_pct('visited_page', 'trackable')} as visited_page_pct,
       completed_self_serve, {_pct('completed_self_serve', 'trackable')} as self_serve_pct,
       repeat_contact, {_pct('repeat_contact', 'total_deflected')} as repeat_rate_pct,
       repeat_via_voice, repeat_via_email, repeat_via_chat,
       {_pct('total_deflected - repeat_contact', 'total_deflected')} as containment_pct,
       completed_via_agent, {_pct('completed_via_agent', 'trackable')} as agent_completion_pct,
       total_completed, {_pct('total_completed', 'trackable')} as total_completion_pct
from totals""",
        TOTAL_CTES,
    ),
}
