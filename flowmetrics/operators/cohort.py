"""Cohort, consent and renewal operators.

Every operator is a conditional aggregation over one row per account (or
one row per customer after a first aggregation), so the work is a single
partial+final hash aggregate per level.  Join fan-out that the reference
counts on purpose (G13) is reproduced with per-account multiplicities, not
by materialising the joined rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import classify, col, count_if, pct, rank_of

# --- fixed values that must equal the documented definitions -------------
OPTED_OUT_STATUSES = ("Unsubscribed", "SoftBounced", "HardBounced")
CONSENT_ORDER = ("Opted In", "Opted Out", "Unknown")
ENDED_ACCOUNT_STATUSES = ("Active", "Closing", "Final")
# -------------------------------------------------------------------------


def consent_status(c: str | Column = "subscription_status", three_way: bool = True) -> Column:
    """Consent mapper (G15): three-way (Unknown kept) or two-way (NULL => Opted Out)."""
    if three_way:
        return classify(
            [(col(c) == "Subscribed", "Opted In"), (col(c).isin(*OPTED_OUT_STATUSES), "Opted Out")], "Unknown"
        )
    return F.when(col(c) == "Subscribed", "Opted In").otherwise("Opted Out")


def renewal_outcome() -> Column:
    """Renewed / Churned / Pending from renewal status, next tariff and account status."""
    renewed = (F.col("ele_rnwl_status") == "Renewed") | (F.col("gas_rnwl_status") == "Renewed")
    has_next = F.col("ele_next_tariff").isNotNull() | F.col("gas_next_tarif").isNotNull()
    closing = (F.col("acc_status") == "Closing") | (F.col("acc_status") == "Final")
    return classify([(renewed, "Renewed"), (has_next, "Renewed"), (closing, "Churned")], "Pending")


def ended_between(lo, hi) -> Column:
    """Tariff (electricity or gas) ended in ``[lo, hi]``."""
    return F.col("ele_cur_tarif_end").between(F.lit(lo), F.lit(hi)) | F.col("gas_cur_tarif_end").between(F.lit(lo), F.lit(hi))


def renewal_rate(df: DataFrame, group: str, denominator: str = "decided") -> DataFrame:
    """Renewal and churn rate per group.

    ``denominator='decided'`` excludes pending (renewed + churned);
    ``'all'`` divides by every ended contract.
    """
    agg = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_contracts_ended"),
        count_if(F.col("renewal_outcome") == "Renewed").alias("renewed_count"),
        count_if(F.col("renewal_outcome") == "Churned").alias("churned_count"),
        count_if(F.col("renewal_outcome") == "Pending").alias("pending_count"),
    )
    den = (
        F.col("renewed_count") + F.col("churned_count")
        if denominator == "decided"
        else F.col("total_contracts_ended")
    )
    return agg.select(
        "*",
        pct("renewed_count", den).alias("renewal_rate_pct"),
        pct("churned_count", den).alias("churn_rate_pct"),
    ).orderBy(rank_of(group, CONSENT_ORDER))


def delta_pp(rates: DataFrame, group: str, rate: str, a: str, b: str, name: str, reverse: bool = False) -> DataFrame:
    """One row with ``rate`` for groups ``a`` and ``b`` and their difference (pp)."""
    ra = F.max(F.when(F.col(group) == a, F.col(rate)))
    rb = F.max(F.when(F.col(group) == b, F.col(rate)))
    out = rates.where(F.col(group).isin(a, b)).agg(ra.alias(f"_a"), rb.alias(f"_b"))
    diff = (F.col("_b") - F.col("_a")) if reverse else (F.col("_a") - F.col("_b"))
    key_a = a.lower().replace(" ", "_")
    key_b = b.lower().replace(" ", "_")
    return out.select(
        F.col("_a").alias(f"{key_a}_{name}"), F.col("_b").alias(f"{key_b}_{name}"), F.round(diff, 2).alias("delta_pp")
    )


def cohort_churn(accounts: DataFrame, cancels: DataFrame, key: str, group: str, digits: int = 2) -> DataFrame:
    """Churn of a cohort; a churned account contributes one row per distinct cancellation.

    ``cancels`` must already be the DISTINCT cancellation tuples; each
    account's count ``m`` becomes its multiplicity (``max(m, 1)`` rows, ``m``
    churned), matching the reference's LEFT JOIN fan-out (G13) exactly.
    """
    m = cancels.groupBy(key).agg(F.count(F.lit(1)).alias("_m"))
    j = accounts.join(m, key, "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    agg = j.groupBy(group).agg(
        F.sum(F.greatest(F.col("_m"), F.lit(1))).cast("long").alias("active_at_period_start"),
        F.sum("_m").cast("long").alias("churned_count"),
    )
    return agg.select(
        group,
        "active_at_period_start",
        "churned_count",
        (F.col("active_at_period_start") - F.col("churned_count")).alias("retained_count"),
        pct("churned_count", "active_at_period_start", digits).alias("churn_rate_pct"),
        pct(F.col("active_at_period_start") - F.col("churned_count"), "active_at_period_start", digits).alias(
            "retention_rate_pct"
        ),
    ).orderBy(rank_of(group, CONSENT_ORDER))


def flag_buckets(df: DataFrame, flags: dict[str, str], by: str, any_name: str = "has_any_interest") -> DataFrame:
    """Per group, count and percent of rows with each flag TRUE, plus "any"."""
    anyc = None
    for f in flags:
        c = F.coalesce(F.col(f), F.lit(False))
        anyc = c if anyc is None else anyc | c
    named = dict(flags)
    named[any_name] = None
    exprs = [count_if(F.col(f) == F.lit(True)).alias(f"{n}_count") for f, n in flags.items()]
    exprs.append(count_if(anyc).alias(f"{any_name}_count"))
    agg = df.groupBy(by).agg(F.count(F.lit(1)).alias("total_accounts"), *exprs)
    pcts = [pct(f"{n}_count", "total_accounts").alias(f"{n}_pct") for n in list(flags.values()) + [any_name]]
    return agg.select("*", *pcts).orderBy(rank_of(by, CONSENT_ORDER))


def flag_combinations(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Every combination of nullable flags (NULL shown as 'NULL') with its share."""
    keys = [F.coalesce(F.col(f).cast("string"), F.lit("NULL")).alias(n) for f, n in flags.items()]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("account_count"))
    return agg.withColumn("pct_of_total", pct("account_count", F.sum("account_count").over(Window.partitionBy()))).orderBy(
        F.col("account_count").desc(), *flags.values()
    )


def per_entity(df: DataFrame, entity: str, account: str, attr: str | None = None) -> DataFrame:
    """One row per entity with its distinct account (and attribute) counts."""
    exprs = [F.count_distinct(account).alias("num_accounts")]
    if attr:
        exprs.append(F.count_distinct(attr).alias("attr_values"))
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*exprs)


def entity_histogram(df: DataFrame, entity: str, account: str) -> DataFrame:
    """AG16/N15: how many entities have n accounts, with share of entities."""
    h = per_entity(df, entity, account).groupBy("num_accounts").agg(F.count(F.lit(1)).alias("customer_count"))
    w = Window.partitionBy()
    return h.select(
        "num_accounts",
        "customer_count",
        F.sum("customer_count").over(w).cast("long").alias("total_customers"),
        pct("customer_count", F.sum("customer_count").over(w)).alias("pct"),
    ).orderBy("num_accounts")


def consistency(df: DataFrame, entity: str, account: str, attr: str) -> DataFrame:
    """Single-account vs multi-account same/different attribute, with share."""
    e = per_entity(df, entity, account, attr)
    label = classify(
        [(F.col("num_accounts") == 1, "Single account"), (F.col("attr_values") == 1, "Multi-account, SAME consent")],
        "Multi-account, DIFFERENT consent",
    )
    agg = e.groupBy(label.alias("consent_consistency")).agg(F.count(F.lit(1)).alias("customer_count"))
    return agg.withColumn("pct", pct("customer_count", F.sum("customer_count").over(Window.partitionBy()))).orderBy(
        F.col("customer_count").desc()
    )


def conflict_examples(df: DataFrame, entity: str, account: str, attr: str, k: int = 5) -> DataFrame:
    """Rows of ``k`` example entities (lowest ids) whose accounts disagree on ``attr``.

    The example list is a top-k (k rows) joined back with a broadcast of
    exactly k keys; the rest is a semi-join, so nothing scales with k.
    """
    agg = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.count_distinct(account).alias("_n"), F.count_distinct(attr).alias("_v")
    )
    picks = agg.where((F.col("_n") > 1) & (F.col("_v") > 1)).select(entity).orderBy(entity).limit(k)
    return df.join(F.broadcast(picks), entity, "left_semi")


def rollup_any(df: DataFrame, entity: str, cond: Column, yes: str, no: str, name: str) -> DataFrame:
    """Entity is ``yes`` when ANY of its rows satisfies ``cond``; share of entities."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.max(F.when(cond, 1).otherwise(0)).alias("_any")
    )
    agg = per.groupBy(F.when(F.col("_any") == 1, yes).otherwise(no).alias(name)).agg(F.count(F.lit(1)).alias("customers"))
    return agg.withColumn("pct", pct("customers", F.sum("customers").over(Window.partitionBy())))


def grain_report(df: DataFrame, entity: str, elec: str, gas: str) -> DataFrame:
    """Rows vs distinct entities and the dual / elec-only / gas-only split."""
    e, g = F.col(elec).isNotNull(), F.col(gas).isNotNull()
    agg = df.agg(
        F.count(F.lit(1)).alias("total_billing_accounts"),
        F.count_distinct(entity).alias("unique_customers"),
        count_if(e & g).alias("dual_fuel_accounts"),
        count_if(e & ~g).alias("elec_only_accounts"),
        count_if(~e & g).alias("gas_only_accounts"),
    )
    return agg.select(
        "total_billing_accounts",
        "unique_customers",
        F.round(F.try_divide(F.col("total_billing_accounts").cast("double"), F.col("unique_customers").cast("double")), 2).alias(
            "accounts_per_customer"
        ),
        "dual_fuel_accounts",
        "elec_only_accounts",
        "gas_only_accounts",
    )


def share_by(df: DataFrame, keys: Sequence[str | Column], within: Sequence[str] = (), count_name: str = "n", digits: int = 1) -> DataFrame:
    """Count per key with percent of total (or of the ``within`` partition)."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    return agg.withColumn("pct", pct(count_name, F.sum(count_name).over(Window.partitionBy(*within)), digits))
