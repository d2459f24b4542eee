"""Catalogue: contact flow (Sankey) links and node totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flow_rules as FR
from ..functions.contact_rules import VOICE_FLOW_DEFLECTABLE_INTENTS, base_filter
from ..operators.deflection import in_days
from ..operators.flows import flow_links, flow_node_totals, seen_in_previous_days
from ..sources.standins import contacts
from .common import EVENTS_AS_OF, EVENTS_DAYS, sql_list, with_views

WINDOW_SQL = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"


def _voice_classified(spark, sf_dir):
    c = contacts(spark, sf_dir).where(base_filter("VOICE")).withColumn("day", F.to_date("ts"))
    report = in_days(c, EVENTS_AS_OF, EVENTS_DAYS)
    # only days that a reported contact can look back to: the scan is pruned on both ends
    history = in_days(c, EVENTS_AS_OF, EVENTS_DAYS + 5, 2)
    flagged = seen_in_previous_days(report, "endpoint", "day", lo=5, hi=1, history=history)
    return flagged.select("*", *[v.alias(k) for k, v in FR.voice_stages().items()])


def voice_flow_links(spark, sf_dir):
    """Voice flow links; each contact's day is its report date."""
    return flow_links(_voice_classified(spark, sf_dir), FR.voice_edges()).orderBy("stage", F.col("value").desc(), "source", "target")


def voice_flow_node_totals(spark, sf_dir):
    """Node totals and share of all contacts for the voice flow."""
    return flow_node_totals(flow_links(_voice_classified(spark, sf_dir), FR.voice_edges()))


def _chained(spark, sf_dir, channel, stages):
    c = in_days(contacts(spark, sf_dir).where(F.col("channel") == channel), EVENTS_AS_OF, EVENTS_DAYS)
    classified = c.select(*[v.alias(k) for k, v in stages.items()])
    return flow_links(classified, FR.chain_edges(len(stages)))


def email_flow_links(spark, sf_dir):
    """E-mail flow links (origin -> intent -> queue -> outcome)."""
    return _chained(spark, sf_dir, "EMAIL", FR.email_stages()).orderBy("stage", F.col("value").desc(), "source", "target")


def chat_flow_links(spark, sf_dir):
    """Chat flow links (entry -> intent -> routing -> outcome)."""
    return _chained(spark, sf_dir, "CHAT", FR.chat_stages()).orderBy("stage", F.col("value").desc(), "source", "target")


def chat_flow_node_totals(spark, sf_dir):
    """Chat node totals; 'Connection failed' is one node across stages."""
    return flow_node_totals(_chained(spark, sf_dir, "CHAT", FR.chat_stages()))


def email_flow_node_totals(spark, sf_dir):
    """E-mail node totals."""
    return flow_node_totals(_chained(spark, sf_dir, "EMAIL", FR.email_stages()))


QUERIES = {
    "email_flow_node_totals": email_flow_node_totals,
    "voice_flow_links": voice_flow_links,
    "voice_flow_node_totals": voice_flow_node_totals,
    "email_flow_links": email_flow_links,
    "chat_flow_links": chat_flow_links,
    "chat_flow_node_totals": chat_flow_node_totals,
}

DEFLECTABLE = sql_list(VOICE_FLOW_DEFLECTABLE_INTENTS)

_VOICE_CLASSIFIED = f"""
voice as (select * from contacts where channel = 'VOICE' and initiation = 'INBOUND'),
prev as (select distinct endpoint, cast(ts as date) as d from voice),
classified as (
  select
    case when exists (select 1 from prev p where p.endpoint = v.endpoint
                      and p.d between cast(v.ts as date) - 5 and cast(v.ts as date) - 1)
         then 'Return contact' else 'New contact' end as stage1,
    case when intent in ({DEFLECTABLE}) then 'Routed to auto-resolution' else 'Routed to ID&V' end as stage2,
    case when intent not in ({DEFLECTABLE}) then 'N/A'
         when queue_name is null and agent_ts is null and disconnect_reason = 'CONTACT_FLOW_DISCONNECT'
           then 'Disconnected pre-queue'
         when account_valid is not null then 'Proceeded to ID&V'
         when queue_name is not null then 'Proceeded to queue'
         else 'Other deflection outcome' end as stage3,
    case when account_valid in ('true', 'false') then 'ID&V completed'
         when queue_name is not null and account_valid is null then 'Queued (no ID&V)'
         when queue_name is null and agent_ts is null then 'Abandoned pre-queue'
         else 'Other' end as stage4,
    case when agent_ts is not null then 'Answered by agent'
         when queue_name is not null and agent_ts is null then 'Abandoned from queue'
         when disconnect_reason = 'CONTACT_FLOW_DISCONNECT' then 'Disconnected in IVR'
         else 'Other outcome' end as stage5
  from voice v where {WINDOW_SQL}
),
links as (
  select * from (
    select stage1 as source, stage2 as target, count(*) as value, 1 as stage from classified group by 1, 2
    union all
    select stage2, stage4, count(*), 2 from classified where stage2 = 'Routed to ID&V' group by 1, 2
    union all
    select stage2, stage3, count(*), 2 from classified
      where stage2 = 'Routed to auto-resolution' and stage3 != 'N/A' group by 1, 2
    union all
    select stage3, stage4, count(*), 3 from classified
      where stage3 in ('Proceeded to ID&V', 'Proceeded to queue') group by 1, 2
    union all
    select stage4, stage5, count(*), 4 from classified
      where stage4 in ('ID&V completed', 'Queued (no ID&V)') group by 1, 2
  ) u where value > 0
)"""

_EMAIL_LINKS = f"""
classified as (
  select
    case when initiation = 'INBOUND' then 'Inbound email' when initiation = 'OUTBOUND' then 'Outbound email'
         when initiation = 'AGENT_REPLY' then 'Agent reply' when initiation = 'TRANSFER' then 'Transfer'
         else 'System/Flow' end as stage1,
    case when intent is null then 'Unclassified'
         when intent = 'FallbackIntent' then 'Fallback intent'
         when intent in ({sql_list(FR.EMAIL_BILLING_INTENTS)}) then 'Billing related'
         when intent in ({sql_list(FR.EMAIL_METERING_INTENTS)}) then 'Metering related'
         when intent in ({sql_list(FR.EMAIL_MOVING_INTENTS)}) then 'Moving home'
         when intent in ({sql_list(FR.EMAIL_PAYMENT_INTENTS)}) then 'Payments related'
         when intent = 'SolarIntent' then 'Solar'
         when intent = 'ComplaintIntent' then 'Complaints'
         else 'Other intent' end as stage2,
    case when queue_name is null then 'No queue'
         when queue_name = 'Dropped Emails' then 'Dropped Emails queue'
         when queue_name = 'Customer Care - Email' then 'Customer Care queue'
         when queue_name = 'Agent Holding Queue' then 'Agent Holding queue'
         when queue_name like '%Solar%' then 'Solar queue'
         when queue_name like '%Collection%' then 'Collections queue'
         else 'Specialist queue' end as stage3,
    case when agent_ts is not null and disconnect_reason in ('AGENT_DISCONNECT', 'OTHER') then 'Agent handled'
         when queue_name = 'Dropped Emails' then 'Dropped'
         when disconnect_reason = 'DISCARDED' then 'Discarded'
         when disconnect_reason = 'TRANSFERRED' then 'Transferred'
         when disconnect_reason = 'API' then 'API processed'
         when disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is null then 'Flow terminated'
         else 'Other outcome' end as stage4
  from contacts where channel = 'EMAIL' and {WINDOW_SQL}
)"""

_CHAT_LINKS = f"""
classified as (
  select
    case when initiation = 'API' then 'Web/App chat' when initiation = 'DISCONNECT' then 'Reconnection attempt'
         else 'Other' end as stage1,
    case when intent is null then 'No intent captured'
         when intent = 'FallbackIntent' then 'Fallback intent'
         when intent = 'SpeakToAnAdvisorIntent' then 'Agent requested'
         when intent in ({sql_list(FR.CHAT_BOT_RESOLVABLE_INTENTS)}) then 'Bot-resolvable intent'
         when intent in ({sql_list(FR.CHAT_BILLING_INTENTS)}) then 'Billing query'
         when intent in ({sql_list(FR.CHAT_COMPLEX_INTENTS)}) then 'Complex issue'
         when intent in ({sql_list(FR.CHAT_SALES_INTENTS)}) then 'Sales/Switching'
         else 'Other intent' end as stage2,
    case when disconnect_reason = 'CUSTOMER_CONNECTION_NOT_ESTABLISHED' then 'Connection failed'
         when queue_name is not null then 'Escalated to agent queue'
         when disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is null then 'Bot conversation ended'
         when disconnect_reason = 'CUSTOMER_DISCONNECT' and queue_name is null then 'Customer left chatbot'
         else 'Other routing' end as stage3,
    case when disconnect_reason = 'CUSTOMER_CONNECTION_NOT_ESTABLISHED' then 'Connection failed'
         when agent_ts is not null and disconnect_reason = 'AGENT_DISCONNECT' then 'Agent resolved'
         when agent_ts is not null and disconnect_reason = 'CUSTOMER_DISCONNECT' then 'Customer ended with agent'
         when queue_name is not null and agent_ts is null then 'Abandoned in queue'
         when disconnect_reason = 'CONTACT_FLOW_DISCONNECT' and queue_name is null then 'Bot completed'
         when disconnect_reason = 'CUSTOMER_DISCONNECT' and queue_name is null then 'Customer abandoned bot'
         else 'Other outcome' end as stage4
  from contacts where channel = 'CHAT' and {WINDOW_SQL}
)"""

_CHAIN = """
links as (
  select * from (
    select stage1 as source, stage2 as target, count(*) as value, 1 as stage from classified group by 1, 2
    union all select stage2, stage3, count(*), 2 from classified group by 1, 2
    union all select stage3, stage4, count(*), 3 from classified group by 1, 2
  ) u where value > 0
)"""

_NODE_TOTALS = """
select node, inflow, outflow, node_value,
       round(cast(node_value as double) * 100.0 / (select cast(sum(value) as double) from links where stage = 1), 1) as pct
from (
  select node, inflow, outflow, case when outflow > 0 then outflow else inflow end as node_value
  from (
    select coalesce(o.node, i.node) as node, coalesce(i.inflow, 0) as inflow, coalesce(o.outflow, 0) as outflow
    from (select source as node, cast(sum(value) as bigint) as outflow from links group by 1) o
    full outer join (select target as node, cast(sum(value) as bigint) as inflow from links group by 1) i
      on o.node = i.node
  ) n
) v"""

ORACLE = {
    "voice_flow_links": with_views(["contacts"], "select source, target, value, stage from links", _VOICE_CLASSIFIED),
    "voice_flow_node_totals": with_views(["contacts"], _NODE_TOTALS, _VOICE_CLASSIFIED),
    "email_flow_links": with_views(["contacts"], "select source, target, value, stage from links", _EMAIL_LINKS + "," + _CHAIN),
    "chat_flow_links": with_views(["contacts"], "select source, target, value, stage from links", _CHAT_LINKS + "," + _CHAIN),
    "email_flow_node_totals": with_views(["contacts"], _NODE_TOTALS, _EMAIL_LINKS + "," + _CHAIN),
    "chat_flow_node_totals": with_views(["contacts"], _NODE_TOTALS, _CHAT_LINKS + "," + _CHAIN),
}
