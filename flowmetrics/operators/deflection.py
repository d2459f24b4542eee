"""Contact-centre deflection operators.

Every operator takes a ``contacts`` DataFrame with the neutral contact
columns (see ``sources.standins.CONTACTS``) and an explicit ``as_of`` date;
none reads the clock.  Aggregations are plain ``groupBy`` (partial +
final hash aggregation), and share-of-total windows run only over the
aggregated groups, never over raw contacts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contact_rules as R
from ..functions.core import (
    between_ts,
    classify,
    count_if,
    day_window,
    pct,
    rank_of,
    ts_literal,
)


def in_days(contacts: DataFrame, as_of, lo_days: int, hi_days: int = 1, column: str = "ts") -> DataFrame:
    """Rows whose calendar day lies in ``[as_of - lo_days, as_of - hi_days]``."""
    lo, hi = day_window(as_of, lo_days, hi_days)
    return contacts.where(between_ts(contacts, column, lo, hi))


def share_of_total(agg: DataFrame, count_col: str, name: str = "pct", digits: int = 1, within: list[str] | None = None) -> DataFrame:
    """``count * 100 / SUM(count) OVER (PARTITION BY within)`` on aggregated rows."""
    w = Window.partitionBy(*(within or []))
    return agg.withColumn(name, pct(F.col(count_col), F.sum(count_col).over(w), digits))


def contact_funnel(contacts: DataFrame, channel: str, as_of, days: int = 1, initiation: str | None = None) -> DataFrame:
    """Daily contact funnel for one channel.

    Categories come from the channel's ordered ruleset; ``pct`` is the share
    of all contacts in the window.  Voice and e-mail keep the documented
    business order, chat is ordered by volume.
    """
    base = in_days(contacts.where(R.base_filter(channel, initiation)), as_of, days)
    agg = base.groupBy(R.funnel_category(channel).alias("category")).agg(F.count(F.lit(1)).alias("contacts"))
    out = share_of_total(agg, "contacts")
    if channel == "CHAT":
        return out.orderBy(F.col("contacts").desc(), "category")
    order = R.VOICE_FUNNEL_ORDER if channel == "VOICE" else R.EMAIL_FUNNEL_ORDER
    return out.orderBy(rank_of("category", order))


def voice_outcome_breakdown(contacts: DataFrame, as_of, days: int = 1) -> DataFrame:
    """K5: seven-way voice outcome with share and distinct accounts."""
    base = in_days(contacts.where(R.base_filter("VOICE")), as_of, days)
    outcome = classify(R.voice_outcome_rules(), "7. IVR Abandonment")
    agg = base.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("contacts"),
        F.count_distinct("account").alias("unique_accounts"),
    )
    return share_of_total(agg, "contacts").orderBy("outcome")


def voice_deflection_rates(contacts: DataFrame, as_of, days: int = 1) -> DataFrame:
    """K6: one-row voice deflection / agent / abandonment rates (list A)."""
    base = in_days(contacts.where(R.base_filter("VOICE")), as_of, days)
    deflected = R.voice_deflected(R.SELF_SERVICE_LIST_A)
    agent = R.agent_handled()
    abandoned = F.col("agent_ts").isNull() & (
        F.col("selfservice").isNull() | F.col("selfservice").isin("rejected", "error")
    )
    agg = base.agg(
        F.count(F.lit(1)).alias("total_voice_contacts"),
        count_if(deflected).alias("true_deflections"),
        count_if(agent).alias("reached_agent"),
        count_if(abandoned).alias("abandonments"),
    )
    total = F.col("total_voice_contacts")
    return agg.select(
        "total_voice_contacts",
        "true_deflections",
        pct("true_deflections", total).alias("true_deflection_rate_pct"),
        "reached_agent",
        pct("reached_agent", total).alias("agent_rate_pct"),
        "abandonments",
        pct("abandonments", total).alias("abandonment_rate_pct"),
    )


def take_up_by_intent(contacts: DataFrame, channel: str, as_of, days: int = 1) -> DataFrame:
    """Offered vs taken by intent (voice K23; chat K27)."""
    base = in_days(contacts.where(R.base_filter(channel) & R.in_list("intent", R.OFFERED_INTENTS)), as_of, days)
    taken = R.voice_deflected(R.SELF_SERVICE_LIST_B)
    if channel == "VOICE":
        agg = base.groupBy(F.col("intent")).agg(
            F.count(F.lit(1)).alias("offered"),
            count_if(taken).alias("taken"),
            count_if(F.col("selfservice") == "rejected").alias("rejected"),
            count_if(R.agent_handled()).alias("spoke_to_agent"),
        )
        return agg.withColumn("take_up_rate_pct", pct("taken", "offered", 0)).orderBy(F.col("offered").desc(), "intent")
    bot = F.col("queue_name").isNull() & F.col("agent_ts").isNull() & (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT")
    agg = base.groupBy(F.col("intent")).agg(
        F.count(F.lit(1)).alias("total_with_intent"),
        count_if(taken).alias("deflection_taken"),
        count_if(bot).alias("bot_resolved"),
        count_if(R.agent_handled()).alias("spoke_to_agent"),
    )
    return agg.orderBy(F.col("total_with_intent").desc(), "intent")


def channel_summary(contacts: DataFrame, as_of, days: int = 1) -> DataFrame:
    """Handled / deflected / dropped per channel in one conditional aggregate."""
    scope = R.base_filter("VOICE") | R.base_filter("EMAIL") | R.base_filter("CHAT")
    base = in_days(contacts.where(scope), as_of, days)
    dropped = F.col("queue_name").isNotNull() & F.col("agent_ts").isNull() & (F.col("channel") != "EMAIL")
    agg = base.groupBy("channel").agg(
        F.count(F.lit(1)).alias("total_contacts"),
        count_if(R.agent_handled()).alias("agent_handled"),
        count_if(R.deflected_any_channel()).alias("deflected"),
        count_if(dropped).alias("dropped_in_queue"),
    )
    return agg.select(
        "channel",
        "total_contacts",
        "agent_handled",
        pct("agent_handled", "total_contacts").alias("agent_handled_pct"),
        "deflected",
        "dropped_in_queue",
    ).orderBy(F.col("total_contacts").desc(), "channel")


def safeguard_breakdown(contacts: DataFrame, as_of, days: int = 1, case_days: int = 30, threshold: int = 3) -> DataFrame:
    """E-mail deflection decisions by intent; not-deflected split by case volume.

    Case volume counts inbound e-mails per case over ``case_days``; it is one
    row per case, joined back by case id (a left join, so contacts without a
    case fall in neither blocked bucket).
    """
    email = contacts.where(R.base_filter("EMAIL"))
    subjects = in_days(email.where(R.in_list("intent", R.EMAIL_DEFLECTABLE_INTENTS)), as_of, days).select(
        "intent",
        "case_id",
        F.when((F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT") & F.col("queue_name").isNull(), "DEFLECTED")
        .otherwise("NOT_DEFLECTED")
        .alias("outcome"),
    )
    lo, hi = day_window(as_of, case_days, 0)
    per_case = (
        email.where(F.col("case_id").isNotNull() & (F.col("ts") >= ts_literal(lo, email, "ts")))
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("inbound_emails_on_case"))
    )
    j = subjects.join(per_case, "case_id", "left")
    not_deflected = F.col("outcome") == "NOT_DEFLECTED"
    agg = j.groupBy("intent").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("outcome") == "DEFLECTED").alias("deflected"),
        count_if(not_deflected & (F.col("inbound_emails_on_case") >= threshold)).alias("blocked_by_threshold"),
        count_if(not_deflected & (F.col("inbound_emails_on_case") < threshold)).alias("blocked_by_other_safeguard"),
    )
    return agg.withColumn("deflection_rate_pct", pct("deflected", "total", 0)).orderBy(F.col("total").desc(), "intent")


def deflected_rows(contacts: DataFrame, channel: str) -> DataFrame:
    """The deflected contacts of one channel."""
    cond: Column
    if channel == "VOICE":
        cond = R.voice_deflected(R.SELF_SERVICE_LIST_B)
    elif channel == "CHAT":
        cond = F.col("agent_ts").isNull() & F.col("intent").isNotNull()
    else:
        cond = R.email_deflected()
    return contacts.where(R.base_filter(channel, "INBOUND") & cond)
