"""Catalogue: noise filter, routing gaps, eligibility matrix, RAG status, id explode, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contact_rules as R
from ..functions.core import count_if, is_null_or_empty, literal_table, pct
from ..functions.nested import explode_ids
from ..operators.deflection import in_days
from ..operators.reconcile import account_audit, flag_checks, trend_check
from ..sources.standins import billing_account, cancellations, contacts, customer_setting, marketing_master, product_bundle
from ..operators.temporal import current_state
from .behaviour import TOTAL_CTES, deflection_totals
from .common import EVENTS_AS_OF, EVENTS_DAYS, sql_list, with_views
from .dashboard import TREND_CTE, dashboard_weekly_trend

# --- fixed values that must equal the documented definitions -------------
# (intent, VOICE, CHAT, EMAIL) deflection eligibility.
ELIGIBILITY = (
    ("RenewalIntent", True, True, True),
    ("MovingInIntent", True, True, True),
    ("MovingOutIntent", True, True, False),
    ("SubmitMeterReadingIntent", True, True, False),
    ("MakeACardPaymentIntent", True, True, True),
    ("DirectDebitIntent", True, True, True),
    ("FinalBillIntent", False, False, True),
    ("PaymentIntent", False, False, True),
)
# Monitoring thresholds: (metric, green bound, amber bound, higher_is_better).
RAG_THRESHOLDS = (
    ("Intent Detection Rate", 75.0, 60.0, True),
    ("Voice Take Rate", 25.0, 15.0, True),
    ("Email Take Rate", 40.0, 25.0, True),
    ("Page Visit Rate", 40.0, 25.0, True),
    ("Containment Rate", 75.0, 60.0, True),
    ("Repeat Contact Rate", 25.0, 40.0, False),
    ("Total Completion", 50.0, 35.0, True),
)
# -------------------------------------------------------------------------
WINDOW_SQL = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"


def _window(spark, sf_dir):
    return in_days(contacts(spark, sf_dir), EVENTS_AS_OF, EVENTS_DAYS)


def noise_filtered_volume(spark, sf_dir):
    """Contacts per channel before and after the optional noise filters."""
    c = _window(spark, sf_dir)
    return c.groupBy("channel").agg(
        F.count(F.lit(1)).alias("contacts"),
        count_if(R.noise_filter()).alias("after_noise_filter"),
        count_if(~R.noise_filter(include_telecom=False)).alias("spam"),
    ).orderBy("channel")


def abandonment_by_intent(spark, sf_dir):
    """K9: voice abandonment by intent, groups with at least 10 contacts (HAVING)."""
    c = _window(spark, sf_dir).where(R.base_filter("VOICE"))
    abandoned = F.col("agent_ts").isNull() & (F.col("selfservice").isNull() | F.col("selfservice").isin("rejected", "error"))
    agg = c.groupBy(F.coalesce("intent", "initial_intent", F.lit("No Intent")).alias("intent")).agg(
        F.count(F.lit(1)).alias("total_contacts"),
        count_if(R.agent_handled()).alias("reached_agent"),
        count_if(R.voice_deflected(R.SELF_SERVICE_LIST_A)).alias("deflected"),
        count_if(abandoned).alias("abandoned"),
    )
    return (
        agg.where(F.col("total_contacts") >= 10)
        .withColumn("abandonment_rate_pct", pct("abandoned", "total_contacts"))
        .orderBy(F.col("abandoned").desc(), "intent")
    )


def unclassified_mail(spark, sf_dir):
    """Inbound e-mail with no intent and no queue, by sender and recipient."""
    c = _window(spark, sf_dir).where(R.base_filter("EMAIL") & is_null_or_empty("intent") & is_null_or_empty("queue_name"))
    return (
        c.groupBy(F.col("endpoint").alias("sender"), F.col("recipient"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "sender", "recipient")
    )


def auto_response_by_validity(spark, sf_dir):
    """Auto-response by intent x account validity, groups of at least 5 (HAVING on alias)."""
    c = _window(spark, sf_dir).where(R.base_filter("EMAIL"))
    auto = (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT") & (
        F.col("queue_name").isNull() | (F.col("queue_name") != "Dropped Emails")
    )
    agg = c.groupBy(
        F.coalesce("intent", F.lit("No Intent")).alias("intent"), F.coalesce("account_valid", F.lit("Unknown")).alias("account_valid")
    ).agg(F.count(F.lit(1)).alias("total"), count_if(auto).alias("auto_responded"))
    return agg.where(F.col("total") >= 5).orderBy("intent", "account_valid")


def _eligibility_frame(spark) -> DataFrame:
    rows = []
    for intent, voice, chat, email in ELIGIBILITY:
        rows += [("VOICE", intent, voice), ("CHAT", intent, chat), ("EMAIL", intent, email)]
    return literal_table(spark, rows, ["channel", "intent", "eligible"])


def eligibility_by_channel(spark, sf_dir):
    """Contacts per channel x intent with the documented deflection eligibility.

    The matrix is a fixed 24-row literal, so broadcasting it is bounded.
    """
    c = _window(spark, sf_dir).where(
        (R.base_filter("VOICE") | R.base_filter("EMAIL") | R.base_filter("CHAT")) & F.col("intent").isNotNull()
    )
    j = c.join(F.broadcast(_eligibility_frame(spark)), ["channel", "intent"], "left")
    eligible = F.coalesce(F.col("eligible"), F.lit(False))
    return j.groupBy("channel", "intent").agg(
        F.count(F.lit(1)).alias("contacts"),
        F.max(eligible).alias("eligible"),
        count_if(eligible & R.deflected_any_channel()).alias("deflected_eligible"),
    ).orderBy("channel", "intent")


def rag_status(spark, sf_dir):
    """The seven monitoring metrics with Green / Amber / Red bands (repeat-contact band inverted); Unknown without a value."""
    c = _window(spark, sf_dir)
    voice, email = R.base_filter("VOICE"), R.base_filter("EMAIL")
    offered, mailable = voice & R.in_list("intent", R.OFFERED_INTENTS), email & R.in_list("intent", R.EMAIL_DEFLECTABLE_INTENTS)
    taken = c.agg(
        pct(count_if(voice & F.col("intent").isNotNull()), count_if(voice)).alias("Intent Detection Rate"),
        pct(count_if(offered & R.voice_deflected()), count_if(offered)).alias("Voice Take Rate"),
        pct(count_if(email & R.email_deflected()), count_if(mailable)).alias("Email Take Rate"),
    )
    total = deflection_totals(spark, sf_dir)
    total = total.agg(*[F.sum(n).alias(n) for n in ("total_deflected", "trackable", "visited_page", "repeat_contact", "total_completed")])
    after = total.select(
        pct("visited_page", "trackable").alias("Page Visit Rate"),
        pct(F.col("total_deflected") - F.col("repeat_contact"), "total_deflected").alias("Containment Rate"),
        pct("repeat_contact", "total_deflected").alias("Repeat Contact Rate"),
        pct("total_completed", "trackable").alias("Total Completion"),
    )
    metrics = taken.unpivot([], taken.columns, "metric", "value").unionByName(after.unpivot([], after.columns, "metric", "value"))
    th = literal_table(spark, RAG_THRESHOLDS, ["metric", "green", "amber", "higher_is_better"])
    # seven rows of metrics: every threshold keeps its row
    j = th.join(F.broadcast(metrics), "metric", "left")
    hib = F.col("higher_is_better")
    status = (
        F.when(F.col("value").isNull(), "Unknown")
        .when(hib & (F.col("value") > F.col("green")), "Green")
        .when(hib & (F.col("value") >= F.col("amber")), "Amber")
        .when(hib, "Red")
        .when(F.col("value") < F.col("green"), "Green")
        .when(F.col("value") <= F.col("amber"), "Amber")
        .otherwise("Red")
    )
    return j.select("metric", "value", status.alias("status")).orderBy("metric")


def account_number_explode(spark, sf_dir):
    """Contacts per account after splitting multi-account strings."""
    c = _window(spark, sf_dir).where(F.col("account_numbers").isNotNull())
    e = explode_ids(c, "account_numbers", "account_number")
    return e.groupBy("account_number").agg(
        F.count(F.lit(1)).alias("contacts"), F.count_distinct("contact_id").alias("distinct_contacts")
    )


def reconcile_master(spark, sf_dir):
    """The five checks of the marketing master, with differences both ways and an example of each."""
    setting = current_state(customer_setting(spark, sf_dir)).where(F.col("deleted").isNull()).select("id").distinct()
    linked = (
        current_state(billing_account(spark, sf_dir)).select(F.col("number").alias("account_number"), F.col("settings_id").alias("id"))
        .join(setting, "id").select("account_number", F.lit(True).alias("linked"))
    )
    text = F.col("account_number").cast("string").alias("account_number")
    follow_on = current_state(product_bundle(spark, sf_dir)).where((F.col("cancel_fl") != "Y") & (F.col("follow_on_fl") == "Y"))
    follow_on = follow_on.withColumn("account_number", F.col("account_fk")).select(text, F.lit(True).alias("follow_on"))
    cancelled = current_state(cancellations(spark, sf_dir)).where(F.col("deleted_at").isNull() & (F.col("type") == "Full"))
    cancelled = cancelled.withColumn("account_number", F.col("billing_account_id")).select(text, F.lit(True).alias("cancelled"))
    renewed = F.coalesce((F.col("ele_rnwl_status") == "Renewed"), F.lit(False)) | F.coalesce(F.col("gas_rnwl_status") == "Renewed", F.lit(False))
    m = marketing_master(spark, sf_dir).select(
        "account_number", F.lit(True).alias("in_master"), renewed.alias("renewed"),
        (F.col("acc_status").isin("Closing", "Final") & ~renewed).alias("churned"),
    )
    audit = account_audit(m, [linked, follow_on, cancelled])
    checks = flag_checks(
        audit,
        [
            ("join completeness: linked to a customer setting", F.col("in_master"), F.col("in_master") & F.col("linked")),
            ("renewal logic: renewed against follow-on bundles", F.col("renewed"), F.col("follow_on")),
            ("churn: churned against full cancellations", F.col("churned"), F.col("cancelled")),
        ],
        grain="total counts: one row per account",
    )
    weeks = dashboard_weekly_trend(spark, sf_dir).groupBy("week_start").agg(F.sum("contracts_ended").alias("ended"))
    return checks.unionByName(trend_check(weeks, "week_start", "ended", "trend: week over week within half"))


QUERIES = {
    "noise_filtered_volume": noise_filtered_volume,
    "abandonment_by_intent": abandonment_by_intent,
    "unclassified_mail": unclassified_mail,
    "auto_response_by_validity": auto_response_by_validity,
    "eligibility_by_channel": eligibility_by_channel,
    "rag_status": rag_status,
    "account_number_explode": account_number_explode,
    "reconcile_master": reconcile_master,
}

_NOISE = sql_list(R.NOISE_DISCONNECT_REASONS)
_ELIG = ", ".join(
    f"('{ch}', '{i}', {str(flag).lower()})"
    for i, v, c, e in ELIGIBILITY
    for ch, flag in (("VOICE", v), ("CHAT", c), ("EMAIL", e))
)
_RAG = ", ".join(f"('{m}', {g}, {a}, {str(h).lower()})" for m, g, a, h in RAG_THRESHOLDS)
_DEFL = f"""case when channel = 'VOICE' then coalesce(selfservice in ({sql_list(R.SELF_SERVICE_LIST_B)}), false)
  when channel = 'EMAIL' then coalesce(disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and intent in ({sql_list(R.EMAIL_DEFLECTABLE_INTENTS)})
    and queue_name is null, false)
  when channel = 'CHAT' then coalesce(agent_ts is null and queue_name is null and disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
    and intent is not null, false) else false end"""


def _p(n, d):
    return f"round(cast({n} as double) * 100.0 / nullif(cast({d} as double), 0), 1)"


ORACLE = {
    "noise_filtered_volume": with_views(
        ["contacts"],
        f"""
select channel, count(*) as contacts,
       count(*) filter (where (spam_verdict is null or spam_verdict != 'FAIL') and disconnect_reason not in ({_NOISE})) as after_noise_filter,
       count(*) filter (where not (spam_verdict is null or spam_verdict != 'FAIL')) as spam
from contacts where {WINDOW_SQL} group by 1""",
    ),
    "abandonment_by_intent": with_views(
        ["contacts"],
        f"""
select intent, total_contacts, reached_agent, deflected, abandoned, {_p('abandoned', 'total_contacts')} as abandonment_rate_pct
from (select coalesce(intent, initial_intent, 'No Intent') as intent, count(*) as total_contacts,
             count(*) filter (where agent_ts is not null) as reached_agent,
             count(*) filter (where selfservice in ({sql_list(R.SELF_SERVICE_LIST_A)})) as deflected,
             count(*) filter (where agent_ts is null and (selfservice is null or selfservice in ('rejected', 'error'))) as abandoned
      from contacts where {WINDOW_SQL} and channel = 'VOICE' and initiation = 'INBOUND'
      group by 1 having count(*) >= 10) x""",
    ),
    "unclassified_mail": with_views(
        ["contacts"],
        f"""
select endpoint as sender, recipient, count(*) as count from contacts
where channel = 'EMAIL' and initiation = 'INBOUND' and {WINDOW_SQL}
  and (intent is null or intent = '') and (queue_name is null or queue_name = '')
group by 1, 2""",
    ),
    "auto_response_by_validity": with_views(
        ["contacts"],
        f"""
select coalesce(intent, 'No Intent') as intent, coalesce(account_valid, 'Unknown') as account_valid, count(*) as total,
       count(*) filter (where disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
                        and (queue_name is null or queue_name != 'Dropped Emails')) as auto_responded
from contacts where channel = 'EMAIL' and initiation = 'INBOUND' and {WINDOW_SQL}
group by 1, 2 having count(*) >= 5""",
    ),
    "eligibility_by_channel": with_views(
        ["contacts"],
        f"""
select c.channel, c.intent, count(*) as contacts, max(coalesce(e.eligible, false)) as eligible,
       count(*) filter (where coalesce(e.eligible, false) and ({_DEFL.replace('channel', 'c.channel').replace('intent', 'c.intent')})) as deflected_eligible
from contacts c left join (values {_ELIG}) e(channel, intent, eligible) on c.channel = e.channel and c.intent = e.intent
where {WINDOW_SQL} and c.intent is not null
  and ((c.channel = 'VOICE' and initiation = 'INBOUND') or (c.channel = 'EMAIL' and initiation = 'INBOUND')
       or (c.channel = 'CHAT' and initiation = 'API'))
group by 1, 2""",
    ),
    "rag_status": with_views(
        ["contacts", "journeys", "web_events"],
        f"""
select t.metric, m.value,
  case when m.value is null then 'Unknown'
       when t.hib and m.value > t.green then 'Green' when t.hib and m.value >= t.amber then 'Amber' when t.hib then 'Red'
       when m.value < t.green then 'Green' when m.value <= t.amber then 'Amber' else 'Red' end as status
from (values {_RAG}) t(metric, green, amber, hib)
left join (
  select 'Intent Detection Rate' as metric, {_p("count(intent)", "count(*)")} as value from voice
  union all
  select 'Voice Take Rate', {_p(f"count(*) filter (where selfservice in ({sql_list(R.SELF_SERVICE_LIST_B)}))", "count(*)")}
  from voice where intent in ({sql_list(R.OFFERED_INTENTS)})
  union all
  select 'Email Take Rate', {_p("count(*) filter (where disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is null)", "count(*)")}
  from contacts where channel = 'EMAIL' and initiation = 'INBOUND' and {WINDOW_SQL} and intent in ({sql_list(R.EMAIL_DEFLECTABLE_INTENTS)})
  union all
  select 'Page Visit Rate', {_p("sum(visited_page)", "sum(trackable)")} from totals
  union all
  select 'Containment Rate', {_p("sum(total_deflected) - sum(repeat_contact)", "sum(total_deflected)")} from totals
  union all
  select 'Repeat Contact Rate', {_p("sum(repeat_contact)", "sum(total_deflected)")} from totals
  union all
  select 'Total Completion', {_p("sum(total_completed)", "sum(trackable)")} from totals
) m on m.metric = t.metric""",
        f"voice as (select * from contacts where channel = 'VOICE' and initiation = 'INBOUND' and {WINDOW_SQL})," + TOTAL_CTES,
    ),
    "account_number_explode": with_views(
        ["contacts"],
        f"""
select account_number, count(*) as contacts, count(distinct contact_id) as distinct_contacts
from (select contact_id, trim(unnest(string_split(account_numbers, ','))) as account_number
      from contacts where {WINDOW_SQL} and account_numbers is not null) x
where account_number != '' group by 1""",
    ),
    "reconcile_master": with_views(
        ["master", "billing_account", "customer_setting", "product_bundle", "cancellations", "account_versions"],
        """
select 'total counts: one row per account' as check_name, count(*) as expected, count(distinct coalesce(account_number, '')) as actual,
  count(*) - count(distinct coalesce(account_number, '')) as missing, 0 as unexpected,
  (select min(account_number) from (select account_number from master group by 1 having count(*) > 1) d) as example_missing,
  cast(null as varchar) as example_unexpected, count(*) = count(distinct coalesce(account_number, '')) as passed
from master
union all
select name, count(*) filter (where e), count(*) filter (where f), count(*) filter (where e and not f), count(*) filter (where f and not e),
  min(acct) filter (where e and not f), min(acct) filter (where f and not e), bool_and(e = f)
from (
  select 'join completeness: linked to a customer setting' as name, acct, acct in (select acct from said) as e,
    acct in (select acct from said) and acct in (select acct from linked) as f from everyone
  union all
  select 'renewal logic: renewed against follow-on bundles', acct, acct in (select acct from said where renewed), acct in (select acct from followed) from everyone
  union all
  select 'churn: churned against full cancellations', acct, acct in (select acct from said where churned), acct in (select acct from left_us) from everyone
) t group by name
union all
select 'trend: week over week within half', count(*), count(*) filter (where calm), count(*) filter (where not calm), 0,
  min(cast(week_start as varchar)) filter (where not calm), null, bool_and(calm)
from (select week_start, abs(ended - before) <= 0.5 * before as calm
      from (select week_start, sum(contracts_ended) as ended, lag(sum(contracts_ended)) over (order by week_start) as before from wt group by 1) x
      where before is not null) y""",
        TREND_CTE + """,
said as (
  select account_number as acct, ele_rnwl_status is not distinct from 'Renewed' or gas_rnwl_status is not distinct from 'Renewed' as renewed,
    acc_status in ('Closing', 'Final') and not renewed as churned
  from master
),
linked as (
  select number as acct from billing_account b join customer_setting s on s.id = b.settings_id
  where b.effective_to = timestamp '9999-01-01' and s.effective_to = timestamp '9999-01-01' and s.deleted is null
),
followed as (select cast(account_fk as varchar) as acct from product_bundle
             where effective_to = timestamp '9999-01-01' and cancel_fl != 'Y' and follow_on_fl = 'Y' and account_fk is not null),
left_us as (select cast(billing_account_id as varchar) as acct from cancellations
            where effective_to = timestamp '9999-01-01' and deleted_at is null and type = 'Full' and billing_account_id is not null),
everyone as (select acct from said union select acct from linked union select acct from followed union select acct from left_us)""",
    ),
}
