"""Stage classifiers for the contact flow (Sankey) diagrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contact_rules import VOICE_FLOW_DEFLECTABLE_INTENTS
from .core import classify, in_list, not_in_list

# --- fixed values that must equal the documented definitions -------------
EMAIL_BILLING_INTENTS = ("BillDisputeIntent", "GeneralBillingIntent", "FinalBillIntent", "RefundIntent")
EMAIL_METERING_INTENTS = (
    "SubmitMeterReadingIntent",
    "GeneralMeterReadingIntent",
    "FaultyMeterIntent",
    "FaultySmartMeterIntent",
    "SmartMeterIntent",
    "SmartMeterInstallation",
)
EMAIL_MOVING_INTENTS = ("MovingOutIntent", "MovingInIntent", "MovingHomeIntent")
EMAIL_PAYMENT_INTENTS = ("DirectDebitIntent", "PaymentIntent", "DebtIntent")
CHAT_BOT_RESOLVABLE_INTENTS = (
    "SubmitMeterReadingIntent",
    "MakeACardPaymentIntent",
    "DirectDebitIntent",
    "RenewalIntent",
    "MovingOutIntent",
    "MovingInIntent",
)
CHAT_BILLING_INTENTS = ("GeneralBillingIntent", "BillDisputeIntent", "RefundIntent")
CHAT_COMPLEX_INTENTS = ("DebtIntent", "ComplaintIntent")
CHAT_SALES_INTENTS = ("SolarIntent", "NewCustomerSwitchingIntent", "ExistingCustomerSwitchingIntent")
# -------------------------------------------------------------------------


def voice_stages(return_col: str = "is_return") -> dict[str, Column]:
    """Five voice stages; stage 3 uses NOT IN so NULL intents fall through."""
    intent, queue, agent = F.col("intent"), F.col("queue_name"), F.col("agent_ts")
    valid, reason = F.col("account_valid"), F.col("disconnect_reason")
    deflectable = in_list(intent, VOICE_FLOW_DEFLECTABLE_INTENTS)
    return {
        "stage1": F.when(F.col(return_col), "Return contact").otherwise("New contact"),
        "stage2": F.when(deflectable, "Routed to auto-resolution").otherwise("Routed to ID&V"),
        "stage3": classify(
            [
                (not_in_list(intent, VOICE_FLOW_DEFLECTABLE_INTENTS), "N/A"),
                (queue.isNull() & agent.isNull() & (reason == "CONTACT_FLOW_DISCONNECT"), "Disconnected pre-queue"),
                (valid.isNotNull(), "Proceeded to ID&V"),
                (queue.isNotNull(), "Proceeded to queue"),
            ],
            "Other deflection outcome",
        ),
        "stage4": classify(
            [
                (valid.isin("true", "false"), "ID&V completed"),
                (queue.isNotNull() & valid.isNull(), "Queued (no ID&V)"),
                (queue.isNull() & agent.isNull(), "Abandoned pre-queue"),
            ],
            "Other",
        ),
        "stage5": classify(
            [
                (agent.isNotNull(), "Answered by agent"),
                (queue.isNotNull() & agent.isNull(), "Abandoned from queue"),
                (reason == "CONTACT_FLOW_DISCONNECT", "Disconnected in IVR"),
            ],
            "Other outcome",
        ),
    }


def voice_edges() -> list[tuple[int, str, str, Column | None]]:
    """Five edge sets; edge 3 has no stage-2 filter, so flow is not conserved."""
    return [
        (1, "stage1", "stage2", None),
        (2, "stage2", "stage4", F.col("stage2") == "Routed to ID&V"),
        (2, "stage2", "stage3", (F.col("stage2") == "Routed to auto-resolution") & (F.col("stage3") != "N/A")),
        (3, "stage3", "stage4", F.col("stage3").isin("Proceeded to ID&V", "Proceeded to queue")),
        (4, "stage4", "stage5", F.col("stage4").isin("ID&V completed", "Queued (no ID&V)")),
    ]


def email_stages() -> dict[str, Column]:
    intent, queue, agent, reason = F.col("intent"), F.col("queue_name"), F.col("agent_ts"), F.col("disconnect_reason")
    method = F.col("initiation")
    return {
        "stage1": classify(
            [
                (method == "INBOUND", "Inbound email"),
                (method == "OUTBOUND", "Outbound email"),
                (method == "AGENT_REPLY", "Agent reply"),
                (method == "TRANSFER", "Transfer"),
            ],
            "System/Flow",
        ),
        "stage2": classify(
            [
                (intent.isNull(), "Unclassified"),
                (intent == "FallbackIntent", "Fallback intent"),
                (in_list(intent, EMAIL_BILLING_INTENTS), "Billing related"),
                (in_list(intent, EMAIL_METERING_INTENTS), "Metering related"),
                (in_list(intent, EMAIL_MOVING_INTENTS), "Moving home"),
                (in_list(intent, EMAIL_PAYMENT_INTENTS), "Payments related"),
                (intent == "SolarIntent", "Solar"),
                (intent == "ComplaintIntent", "Complaints"),
            ],
            "Other intent",
        ),
        "stage3": classify(
            [
                (queue.isNull(), "No queue"),
                (queue == "Dropped Emails", "Dropped Emails queue"),
                (queue == "Customer Care - Email", "Customer Care queue"),
                (queue == "Agent Holding Queue", "Agent Holding queue"),
                (queue.like("%Solar%"), "Solar queue"),
                (queue.like("%Collection%"), "Collections queue"),
            ],
            "Specialist queue",
        ),
        "stage4": classify(
            [
                (agent.isNotNull() & reason.isin("AGENT_DISCONNECT", "OTHER"), "Agent handled"),
                (queue == "Dropped Emails", "Dropped"),
                (reason == "DISCARDED", "Discarded"),
                (reason == "TRANSFERRED", "Transferred"),
                (reason == "API", "API processed"),
                ((reason == "CONTACT_FLOW_DISCONNECT") & queue.isNull(), "Flow terminated"),
            ],
            "Other outcome",
        ),
    }


def chat_stages() -> dict[str, Column]:
    intent, queue, agent, reason = F.col("intent"), F.col("queue_name"), F.col("agent_ts"), F.col("disconnect_reason")
    method = F.col("initiation")
    return {
        "stage1": classify(
            [(method == "API", "Web/App chat"), (method == "DISCONNECT", "Reconnection attempt")], "Other"
        ),
        "stage2": classify(
            [
                (intent.isNull(), "No intent captured"),
                (intent == "FallbackIntent", "Fallback intent"),
                (intent == "SpeakToAnAdvisorIntent", "Agent requested"),
                (in_list(intent, CHAT_BOT_RESOLVABLE_INTENTS), "Bot-resolvable intent"),
                (in_list(intent, CHAT_BILLING_INTENTS), "Billing query"),
                (in_list(intent, CHAT_COMPLEX_INTENTS), "Complex issue"),
                (in_list(intent, CHAT_SALES_INTENTS), "Sales/Switching"),
            ],
            "Other intent",
        ),
        "stage3": classify(
            [
                (reason == "CUSTOMER_CONNECTION_NOT_ESTABLISHED", "Connection failed"),
                (queue.isNotNull(), "Escalated to agent queue"),
                ((reason == "CONTACT_FLOW_DISCONNECT") & queue.isNull(), "Bot conversation ended"),
                ((reason == "CUSTOMER_DISCONNECT") & queue.isNull(), "Customer left chatbot"),
            ],
            "Other routing",
        ),
        "stage4": classify(
            [
                (reason == "CUSTOMER_CONNECTION_NOT_ESTABLISHED", "Connection failed"),
                (agent.isNotNull() & (reason == "AGENT_DISCONNECT"), "Agent resolved"),
                (agent.isNotNull() & (reason == "CUSTOMER_DISCONNECT"), "Customer ended with agent"),
                (queue.isNotNull() & agent.isNull(), "Abandoned in queue"),
                ((reason == "CONTACT_FLOW_DISCONNECT") & queue.isNull(), "Bot completed"),
                ((reason == "CUSTOMER_DISCONNECT") & queue.isNull(), "Customer abandoned bot"),
            ],
            "Other outcome",
        ),
    }


def chain_edges(n_stages: int) -> list[tuple[int, str, str, Column | None]]:
    """Unfiltered stage i -> stage i+1 edges (e-mail, chat)."""
    return [(i, f"stage{i}", f"stage{i + 1}", None) for i in range(1, n_stages)]
