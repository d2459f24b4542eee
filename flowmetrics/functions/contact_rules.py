"""Contact-centre rulesets: deflection predicates and ordered classifiers.

Rulesets are data (ordered lists of (predicate, label)) so that the two
documented variants of the same question can both be run (G6, G7).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import Rule, classify, in_list, not_in_list

# --- fixed values that must equal the documented definitions -------------
# Self-service outcomes counted as a voice deflection, list A (overview).
SELF_SERVICE_LIST_A = (
    "makeACardPaymentOnline",
    "submitMeterReadingOnline",
    "renewalOnline",
    "directDebitOnline",
    "checkBalanceOnline",
)
# Self-service outcomes counted as a deflection, list B (channel queries).
SELF_SERVICE_LIST_B = (
    "renewalOnline",
    "moveInOnline",
    "moveOutOnline",
    "submitMeterReadingOnline",
    "makeACardPaymentOnline",
    "directDebitOnline",
)
# Intents the e-mail flow may answer with an automatic response.
EMAIL_DEFLECTABLE_INTENTS = (
    "MovingInIntent",
    "RenewalIntent",
    "MakeACardPaymentIntent",
    "DirectDebitIntent",
    "FinalBillIntent",
    "PaymentIntent",
)
# Intents offered a self-service route (take-up tables).
OFFERED_INTENTS = (
    "RenewalIntent",
    "MovingInIntent",
    "MovingOutIntent",
    "SubmitMeterReadingIntent",
    "MakeACardPaymentIntent",
    "DirectDebitIntent",
)
# Intents the voice flow routes to auto-resolution (flow diagram).
VOICE_FLOW_DEFLECTABLE_INTENTS = (
    "RenewalIntent",
    "MovingOutIntent",
    "SubmitMeterReadingIntent",
    "MakeACardPaymentIntent",
    "DirectDebitIntent",
)
# Failed telecom connections removed by the optional noise filter.
NOISE_DISCONNECT_REASONS = (
    "TELECOM_ORIGINATOR_CANCEL",
    "TELECOM_NUMBER_INVALID",
    "TELECOM_UNANSWERED",
    "TELECOM_BUSY",
    "TELECOM_POTENTIAL_BLOCKING",
    "CUSTOMER_CONNECTION_NOT_ESTABLISHED",
    "DISCARDED",
)
# Self-service outcome -> deflection type label.
DEFLECTION_TYPE_OF = (
    ("renewalOnline", "Renewal"),
    ("moveInOnline", "MovingIn"),
    ("moveOutOnline", "MovingOut"),
    ("submitMeterReadingOnline", "SubmitMeterReading"),
    ("makeACardPaymentOnline", "MakeACardPayment"),
    ("directDebitOnline", "DirectDebit"),
)
# Base initiation method per channel (chat queries use API, G8).
BASE_INITIATION = {"VOICE": "INBOUND", "EMAIL": "INBOUND", "CHAT": "API"}
# -------------------------------------------------------------------------

VOICE_FUNNEL_ORDER = (
    "Agent Handled",
    "Deflection Taken",
    "Deflection Rejected",
    "Dropped in Queue",
    "Dropped Pre-Intent/IDNV",
    "Other/In-Flow Drop",
)
EMAIL_FUNNEL_ORDER = (
    "Agent Handled",
    "Deflection (Auto-Response)",
    "In Queue / Waiting",
    "Spam/OOO Filtered",
    "System Notifications Dropped",
    "Other",
)


def base_filter(channel: str, initiation: str | None = None) -> Column:
    """Channel base filter (K3): channel and its inbound initiation method."""
    method = initiation or BASE_INITIATION[channel]
    return (F.col("channel") == channel) & (F.col("initiation") == method)


def noise_filter(include_spam: bool = True, include_telecom: bool = True) -> Column:
    """Keep rows that are not spam and not failed telecom connections.

    ``spam_verdict`` NULL is kept; ``disconnect_reason`` NULL is dropped by
    ``NOT IN`` exactly as in SQL.
    """
    cond = F.lit(True)
    if include_spam:
        cond = cond & (F.col("spam_verdict").isNull() | (F.col("spam_verdict") != "FAIL"))
    if include_telecom:
        cond = cond & not_in_list("disconnect_reason", NOISE_DISCONNECT_REASONS)
    return cond


def agent_handled() -> Column:
    return F.col("agent_ts").isNotNull()


def voice_deflected(success_list=SELF_SERVICE_LIST_B) -> Column:
    """A18 voice: a self-service route was taken."""
    return in_list("selfservice", success_list)


def email_deflected() -> Column:
    """A18 e-mail: automatic response sent and the contact closed."""
    return (
        (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT")
        & in_list("intent", EMAIL_DEFLECTABLE_INTENTS)
        & F.col("queue_name").isNull()
    )


def chat_deflected() -> Column:
    """A18 chat: the bot closed the chat with an intent and no queue."""
    return (
        F.col("agent_ts").isNull()
        & F.col("queue_name").isNull()
        & (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT")
        & F.col("intent").isNotNull()
    )


def deflected_any_channel() -> Column:
    """Channel-specific deflection flag in one expression."""
    return (
        F.when(F.col("channel") == "VOICE", voice_deflected())
        .when(F.col("channel") == "EMAIL", email_deflected())
        .when(F.col("channel") == "CHAT", chat_deflected())
        .otherwise(F.lit(False))
    )


def deflection_taken() -> Column:
    """Deflection as the weekly report counts it; a chat counts by its self-service route, not by how the bot closed it."""
    return (
        F.when(F.col("channel").isin("VOICE", "CHAT"), voice_deflected())
        .when(F.col("channel") == "EMAIL", email_deflected())
        .otherwise(F.lit(False))
    )


def offered() -> Column:
    """Eligible intent and (self-service or agent or queue)."""
    return in_list("intent", OFFERED_INTENTS) & (
        F.col("selfservice").isNotNull() | F.col("agent_ts").isNotNull() | F.col("queue_name").isNotNull()
    )


def voice_funnel_rules() -> list[Rule]:
    """Voice daily funnel categories (queue drop tested before intent, G7)."""
    return [
        (agent_handled(), "Agent Handled"),
        (voice_deflected(SELF_SERVICE_LIST_B), "Deflection Taken"),
        (F.col("selfservice") == "rejected", "Deflection Rejected"),
        (F.col("queue_name").isNotNull() & F.col("agent_ts").isNull(), "Dropped in Queue"),
        (F.col("intent").isNull(), "Dropped Pre-Intent/IDNV"),
    ]


def voice_outcome_rules() -> list[Rule]:
    """K5: seven-way voice outcome (list A, intent tested before queue, G7)."""
    return [
        (agent_handled(), "1. Reached Agent"),
        (voice_deflected(SELF_SERVICE_LIST_A), "2. TRUE DEFLECTION (to self-service)"),
        (F.col("selfservice") == "rejected", "3. Self-Service Rejected"),
        (F.col("selfservice") == "error", "4. Self-Service Error"),
        (F.coalesce(F.col("intent"), F.col("initial_intent")).isNull(), "5. Early Abandonment (no intent)"),
        (F.col("queue_name").isNotNull(), "6. Queue Abandonment"),
    ]


def email_funnel_rules() -> list[Rule]:
    """E-mail daily funnel categories."""
    return [
        (agent_handled(), "Agent Handled"),
        (email_deflected(), "Deflection (Auto-Response)"),
        (F.col("queue_name") == "Dropped Emails", "Spam/OOO Filtered"),
        (F.col("queue_name").isNotNull() & F.col("agent_ts").isNull(), "In Queue / Waiting"),
        (
            F.col("queue_name").isNull()
            & F.col("intent").isNull()
            & (F.col("disconnect_reason") == "CONTACT_FLOW_DISCONNECT"),
            "System Notifications Dropped",
        ),
    ]


def chat_funnel_rules() -> list[Rule]:
    """Chat daily funnel categories."""
    q_null, i_null = F.col("queue_name").isNull(), F.col("intent").isNull()
    reason = F.col("disconnect_reason")
    return [
        (agent_handled(), "Agent Handled"),
        (voice_deflected(SELF_SERVICE_LIST_B), "Deflection Taken"),
        (~i_null & q_null & (reason == "CONTACT_FLOW_DISCONNECT"), "Bot Resolved (KB Answer)"),
        (reason == "CUSTOMER_CONNECTION_NOT_ESTABLISHED", "Connection Failed"),
        (~q_null & F.col("agent_ts").isNull(), "Dropped in Queue"),
        (~i_null & (reason == "CUSTOMER_DISCONNECT") & q_null, "Left During Bot Chat"),
        (i_null & (reason == "CUSTOMER_DISCONNECT"), "Left Pre-Intent"),
        (i_null & (reason == "CONTACT_FLOW_DISCONNECT"), "Bot Ended (Timeout/No Input)"),
    ]


FUNNEL_RULES = {
    "VOICE": (voice_funnel_rules, "Other/In-Flow Drop"),
    "EMAIL": (email_funnel_rules, "Other"),
    "CHAT": (chat_funnel_rules, "Other"),
}


def funnel_category(channel: str) -> Column:
    rules, default = FUNNEL_RULES[channel]
    return classify(rules(), default)


def deflection_type() -> Column:
    """Simple CASE over the self-service outcome."""
    expr = None
    for value, label in DEFLECTION_TYPE_OF:
        cond = F.col("selfservice") == value
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr

