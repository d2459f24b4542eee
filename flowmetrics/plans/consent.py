"""Catalogue: marketing consent, renewal, churn, interests and grain checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.core import ntz

from ..operators import cohort as C
from ..operators.temporal import current_state
from ..operators.temporal import trend
from ..sources.standins import billing_account, cancellation_reasons, cancellations, customer_setting, marketing_master
from .common import ORDERS_AS_OF, with_views

PERIOD_DAYS = 1095
SINCE = ORDERS_AS_OF - dt.timedelta(days=PERIOD_DAYS)  # 1998-08-03
FLAGS = {
    "intend_to_buy_ev": "ev_interest",
    "smart_meter_interest": "smart_meter_interest",
    "ev_tariff_marketing_consent": "ev_tariff_consent",
}


def _active(spark, sf_dir):
    return marketing_master(spark, sf_dir).where(F.col("acc_status") == "Active")


def consent_distribution(spark, sf_dir):
    """Active accounts by consent status with share."""
    m = _active(spark, sf_dir).withColumn("consent_status", C.consent_status())
    return C.share_by(m, ["consent_status"], count_name="accounts").orderBy(F.col("accounts").desc())


def _ended(spark, sf_dir):
    m = marketing_master(spark, sf_dir)
    return m.where(C.ended_between(SINCE, ORDERS_AS_OF) & F.col("acc_status").isin(*C.ENDED_ACCOUNT_STATUSES)).select(
        C.consent_status().alias("consent_status"), C.renewal_outcome().alias("renewal_outcome"), "*"
    )


def renewal_rate_by_consent(spark, sf_dir):
    """Renewal / churn rate excluding pending."""
    return C.renewal_rate(_ended(spark, sf_dir), "consent_status", "decided")


def renewal_rate_all_ended(spark, sf_dir):
    """Renewal / churn rate over every ended contract."""
    return C.renewal_rate(_ended(spark, sf_dir), "consent_status", "all")


def renewal_delta(spark, sf_dir):
    """Opted-in minus opted-out renewal rate (pp)."""
    e = _ended(spark, sf_dir)
    renewed = (
        (F.col("ele_rnwl_status") == "Renewed")
        | (F.col("gas_rnwl_status") == "Renewed")
        | F.col("ele_next_tariff").isNotNull()
        | F.col("gas_next_tarif").isNotNull()
    )
    rates = e.groupBy("consent_status").agg(
        F.round(F.try_divide(F.sum(F.when(renewed, 1).otherwise(0)).cast("double") * 100.0, F.count(F.lit(1)).cast("double")), 1).alias("rate")
    )
    return C.delta_pp(rates, "consent_status", "rate", "Opted In", "Opted Out", "renewal_rate")


def _cancels_in_period(spark, sf_dir):
    ba = current_state(billing_account(spark, sf_dir)).select(F.col("id").alias("billing_account_id"), F.col("number").alias("account_number"))
    c = current_state(cancellations(spark, sf_dir)).where(
        F.col("deleted_at").isNull() & (F.to_date("created_at") >= F.lit(SINCE))
    )
    return c.join(ba, "billing_account_id")


def _cohort(spark, sf_dir):
    return (
        marketing_master(spark, sf_dir)
        .where((F.col("acc_status") == "Active") & (F.to_date("acc_created_dt") < F.lit(SINCE)))
        .select("account_number", C.consent_status().alias("consent_status"))
    )


def cohort_churn(spark, sf_dir):
    """Churn of accounts active before the period; multi-cancel accounts fan out."""
    cancels = _cancels_in_period(spark, sf_dir).select("account_number", "created_at", "reason", "type").distinct()
    return C.cohort_churn(_cohort(spark, sf_dir), cancels, "account_number", "consent_status")


def churn_reasons(spark, sf_dir):
    """Cancellation reasons with share within consent group."""
    m = marketing_master(spark, sf_dir).select("account_number", C.consent_status().alias("consent_status"))
    j = m.join(_cancels_in_period(spark, sf_dir), "account_number")
    return C.share_by(
        j, ["consent_status", F.coalesce("reason", F.lit("Unknown")).alias("cancellation_reason")], ["consent_status"], "cancellation_count"
    ).withColumnRenamed("pct", "pct_of_consent_group").orderBy("consent_status", F.col("cancellation_count").desc())


def churn_delta(spark, sf_dir):
    """Opted-out minus opted-in churn rate, one row per account (no fan-out)."""
    churned = _cancels_in_period(spark, sf_dir).select("account_number").distinct().withColumn("_c", F.lit(1))
    j = _cohort(spark, sf_dir).join(churned, "account_number", "left")
    rates = j.groupBy("consent_status").agg(
        F.round(F.try_divide(F.sum(F.coalesce("_c", F.lit(0))).cast("double") * 100.0, F.count(F.lit(1)).cast("double")), 2).alias("rate")
    )
    return C.delta_pp(rates, "consent_status", "rate", "Opted In", "Opted Out", "churn_rate", reverse=True)


def _with_interests(spark, sf_dir):
    ba = current_state(billing_account(spark, sf_dir)).select(F.col("number").alias("account_number"), "settings_id")
    cs = current_state(customer_setting(spark, sf_dir)).where(F.col("deleted").isNull()).select(
        F.col("id").alias("settings_id"), *FLAGS
    )
    return _active(spark, sf_dir).join(ba, "account_number", "left").join(cs, "settings_id", "left")


def interest_buckets(spark, sf_dir):
    """Interest flags per consent group (dimension filters applied before the left joins, G1)."""
    m = _with_interests(spark, sf_dir).withColumn("consent_status", C.consent_status())
    return C.flag_buckets(m, FLAGS, "consent_status")


def interest_combinations(spark, sf_dir):
    """Combinations of interest flags for opted-in accounts."""
    m = _with_interests(spark, sf_dir).where(F.col("subscription_status") == "Subscribed")
    return C.flag_combinations(m, FLAGS)


def grain_report(spark, sf_dir):
    """Accounts vs customers and fuel split."""
    return C.grain_report(_active(spark, sf_dir), "customer_number", "ele_mpan", "gas_mprn")


def accounts_per_customer(spark, sf_dir):
    """Customers by number of accounts."""
    return C.entity_histogram(_active(spark, sf_dir), "customer_number", "account_number")


def consent_consistency(spark, sf_dir):
    """Is consent held per account or per customer?"""
    return C.consistency(_active(spark, sf_dir), "customer_number", "account_number", "subscription_status")


def conflict_examples(spark, sf_dir):
    """Accounts of five example customers whose accounts disagree on consent."""
    a = _active(spark, sf_dir).select("customer_number", "account_number", "subscription_status", "acc_created_dt")
    return C.conflict_examples(a, "customer_number", "account_number", "subscription_status", 5).orderBy(
        "customer_number", "acc_created_dt", "account_number"
    )


def customer_consent_summary(spark, sf_dir):
    """Customer opted in if any of its accounts is."""
    return C.rollup_any(
        _active(spark, sf_dir), "customer_number", F.col("subscription_status") == "Subscribed", "Opted In", "Opted Out", "customer_consent"
    )


def customer_consent(spark, sf_dir):
    """One row per customer; opted in if any of its active accounts is."""
    a = _active(spark, sf_dir).where(F.col("customer_number").isNotNull())
    opted_in = F.max(F.when(F.col("subscription_status") == "Subscribed", 1).otherwise(0)) == 1
    return a.groupBy("customer_number").agg(F.when(opted_in, "Opted In").otherwise("Opted Out").alias("customer_consent"))


def kpi_summary(spark, sf_dir):
    """Customers, accounts, opted-in accounts and opt-in rate of active accounts."""
    a = _active(spark, sf_dir)
    agg = a.agg(
        F.count_distinct("customer_number").alias("unique_customers"),
        F.count(F.lit(1)).alias("billing_accounts"),
        F.sum(F.when(F.col("subscription_status") == "Subscribed", 1).otherwise(0)).cast("long").alias("opted_in_accounts"),
    )
    return agg.withColumn(
        "opt_in_rate", F.round(F.try_divide(F.col("opted_in_accounts").cast("double") * 100.0, F.col("billing_accounts").cast("double")), 1)
    )


def cancellations_per_month(spark, sf_dir):
    """C3 (A16): current, not-deleted cancellations per month since the period start."""
    c = current_state(cancellations(spark, sf_dir)).where(F.col("created_at") >= ntz(SINCE))
    return trend(c, "created_at", "month", [F.count(F.lit(1)).alias("cancellations")]).orderBy("month")


def cancellation_reasons_count(spark, sf_dir):
    """C4 (J2): cancellations by reason, SCD2-current on both sides of the join."""
    c = current_state(cancellations(spark, sf_dir)).where(F.col("created_at") >= ntz(SINCE))
    r = current_state(cancellation_reasons(spark, sf_dir)).select(F.col("id").alias("reason_id"), F.col("reason").alias("reason_name"))
    return c.join(r, "reason_id").groupBy(F.col("reason_name").alias("reason")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "reason"
    )


def interests_two_way(spark, sf_dir):
    """Interests by consent with the two-way mapper (NULL status counts as Opted Out, G15)."""
    m = _with_interests(spark, sf_dir).withColumn("consent", C.consent_status(three_way=False))
    return C.flag_buckets(m, FLAGS, "consent").select(
        "consent", F.col("total_accounts").alias("total"), "ev_interest_count", "smart_meter_interest_count",
        "ev_tariff_consent_count", F.col("has_any_interest_pct").alias("any_interest_pct"),
    )


def subscription_status_distribution(spark, sf_dir):
    """Active accounts by raw subscription status (NULL is its own group) with share."""
    return C.share_by(_active(spark, sf_dir), ["subscription_status"], count_name="account_count").orderBy(
        F.col("account_count").desc()
    )


def renewal_delta_two_way(spark, sf_dir):
    """Renewal-rate delta with the two-way mapper over known statuses."""
    e = _ended(spark, sf_dir).where(F.col("subscription_status").isNotNull())
    renewed = (
        (F.col("ele_rnwl_status") == "Renewed")
        | (F.col("gas_rnwl_status") == "Renewed")
        | F.col("ele_next_tariff").isNotNull()
        | F.col("gas_next_tarif").isNotNull()
    )
    rates = e.groupBy(C.consent_status(three_way=False).alias("consent")).agg(
        F.round(F.try_divide(F.sum(F.when(renewed, 1).otherwise(0)).cast("double") * 100.0, F.count(F.lit(1)).cast("double")), 1).alias("rate")
    )
    return C.delta_pp(rates, "consent", "rate", "Opted In", "Opted Out", "rate")


QUERIES = {
    "subscription_status_distribution": subscription_status_distribution,
    "renewal_delta_two_way": renewal_delta_two_way,
    "interests_two_way": interests_two_way,
    "kpi_summary": kpi_summary,
    "cancellations_per_month": cancellations_per_month,
    "cancellation_reasons_count": cancellation_reasons_count,
    "consent_distribution": consent_distribution,
    "renewal_rate_by_consent": renewal_rate_by_consent,
    "renewal_rate_all_ended": renewal_rate_all_ended,
    "renewal_delta": renewal_delta,
    "cohort_churn": cohort_churn,
    "churn_reasons": churn_reasons,
    "churn_delta": churn_delta,
    "interest_buckets": interest_buckets,
    "interest_combinations": interest_combinations,
    "grain_report": grain_report,
    "accounts_per_customer": accounts_per_customer,
    "consent_consistency": consent_consistency,
    "conflict_examples": conflict_examples,
    "customer_consent_summary": customer_consent_summary,
    "customer_consent": customer_consent,
}

_CONSENT = """case when subscription_status = 'Subscribed' then 'Opted In'
  when subscription_status in ('Unsubscribed', 'SoftBounced', 'HardBounced') then 'Opted Out' else 'Unknown' end"""
_ENDED = """(ele_cur_tarif_end between date '1998-08-03' and date '2001-08-02'
   or gas_cur_tarif_end between date '1998-08-03' and date '2001-08-02')
  and acc_status in ('Active', 'Closing', 'Final')"""
_OUTCOME = """case when ele_rnwl_status = 'Renewed' or gas_rnwl_status = 'Renewed' then 'Renewed'
  when ele_next_tariff is not null or gas_next_tarif is not null then 'Renewed'
  when acc_status = 'Closing' or acc_status = 'Final' then 'Churned' else 'Pending' end"""
_CANCELS = """
cp as (
  select ba.number as account_number, c.created_at, c.reason, c.type
  from cancellations c join billing_account ba on c.billing_account_id = ba.id
    and ba.effective_to = timestamp '9999-01-01'
  where c.effective_to = timestamp '9999-01-01' and c.deleted_at is null
    and cast(c.created_at as date) >= date '1998-08-03'
)"""
_COHORT = f"""
co as (
  select account_number, {_CONSENT} as consent_status from master
  where acc_status = 'Active' and cast(acc_created_dt as date) < date '1998-08-03'
)"""
_INTERESTS = """
mi as (
  select m.*, cs.intend_to_buy_ev, cs.smart_meter_interest, cs.ev_tariff_marketing_consent
  from master m
  left join billing_account ba on m.account_number = ba.number and ba.effective_to = timestamp '9999-01-01'
  left join customer_setting cs on ba.settings_id = cs.id and cs.effective_to = timestamp '9999-01-01'
    and cs.deleted is null
  where m.acc_status = 'Active'
)"""


def _rate(n, d, k=1):
    return f"round(cast({n} as double) * 100.0 / nullif(cast({d} as double), 0), {k})"


def _renewal(den):
    return f"""
select consent_status, total_contracts_ended, renewed_count, churned_count, pending_count,
       {_rate('renewed_count', den)} as renewal_rate_pct, {_rate('churned_count', den)} as churn_rate_pct
from (
  select {_CONSENT} as consent_status, count(*) as total_contracts_ended,
         count(*) filter (where o = 'Renewed') as renewed_count,
         count(*) filter (where o = 'Churned') as churned_count,
         count(*) filter (where o = 'Pending') as pending_count
  from (select *, {_OUTCOME} as o from master where {_ENDED}) e
  group by 1
) s"""


ORACLE = {
    "consent_distribution": with_views(
        ["master"],
        f"""
select {_CONSENT} as consent_status, count(*) as accounts,
       round(cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double), 1) as pct
from master where acc_status = 'Active' group by 1""",
    ),
    "renewal_rate_by_consent": with_views(["master"], _renewal("renewed_count + churned_count")),
    "renewal_rate_all_ended": with_views(["master"], _renewal("total_contracts_ended")),
    "renewal_delta": with_views(
        ["master"],
        """
select max(case when consent_status = 'Opted In' then rate end) as opted_in_renewal_rate,
       max(case when consent_status = 'Opted Out' then rate end) as opted_out_renewal_rate,
       round(max(case when consent_status = 'Opted In' then rate end)
             - max(case when consent_status = 'Opted Out' then rate end), 2) as delta_pp
from (
  select consent_status, round(cast(sum(r) as double) * 100.0 / nullif(cast(count(*) as double), 0), 1) as rate
  from (select """
        + _CONSENT
        + """ as consent_status,
               case when ele_rnwl_status = 'Renewed' or gas_rnwl_status = 'Renewed'
                         or ele_next_tariff is not null or gas_next_tarif is not null then 1 else 0 end as r
        from master where """
        + _ENDED
        + """) x
  group by 1
) rr where consent_status in ('Opted In', 'Opted Out')""",
    ),
    "cohort_churn": with_views(
        ["master", "billing_account", "cancellations"],
        f"""
select consent_status, count(*) as active_at_period_start, cast(sum(churned) as bigint) as churned_count,
       cast(count(*) - sum(churned) as bigint) as retained_count,
       {_rate('sum(churned)', 'count(*)', 2)} as churn_rate_pct,
       {_rate('count(*) - sum(churned)', 'count(*)', 2)} as retention_rate_pct
from (select co.consent_status, case when c.account_number is not null then 1 else 0 end as churned
      from co left join (select distinct * from cp) c on co.account_number = c.account_number) x
group by consent_status""",
        _CANCELS + "," + _COHORT,
    ),
    "churn_reasons": with_views(
        ["master", "billing_account", "cancellations"],
        f"""
select {_CONSENT} as consent_status, coalesce(cp.reason, 'Unknown') as cancellation_reason,
       count(*) as cancellation_count,
       round(cast(count(*) as double) * 100.0 / cast(sum(count(*)) over (partition by {_CONSENT}) as double), 1) as pct_of_consent_group
from master a join cp on a.account_number = cp.account_number
group by 1, 2""",
        _CANCELS,
    ),
    "churn_delta": with_views(
        ["master", "billing_account", "cancellations"],
        f"""
select max(case when consent_status = 'Opted In' then rate end) as opted_in_churn_rate,
       max(case when consent_status = 'Opted Out' then rate end) as opted_out_churn_rate,
       round(max(case when consent_status = 'Opted Out' then rate end)
             - max(case when consent_status = 'Opted In' then rate end), 2) as delta_pp
from (
  select co.consent_status,
         {_rate('sum(case when c.account_number is not null then 1 else 0 end)', 'count(*)', 2)} as rate
  from co left join (select distinct account_number from cp) c on co.account_number = c.account_number
  group by 1
) x where consent_status in ('Opted In', 'Opted Out')""",
        _CANCELS + "," + _COHORT,
    ),
    "interest_buckets": with_views(
        ["master", "billing_account", "customer_setting"],
        f"""
select consent_status, total_accounts, ev_interest_count, smart_meter_interest_count, ev_tariff_consent_count,
       has_any_interest_count,
       {_rate('ev_interest_count', 'total_accounts')} as ev_interest_pct,
       {_rate('smart_meter_interest_count', 'total_accounts')} as smart_meter_interest_pct,
       {_rate('ev_tariff_consent_count', 'total_accounts')} as ev_tariff_consent_pct,
       {_rate('has_any_interest_count', 'total_accounts')} as has_any_interest_pct
from (
  select {_CONSENT} as consent_status, count(*) as total_accounts,
         count(*) filter (where intend_to_buy_ev = true) as ev_interest_count,
         count(*) filter (where smart_meter_interest = true) as smart_meter_interest_count,
         count(*) filter (where ev_tariff_marketing_consent = true) as ev_tariff_consent_count,
         count(*) filter (where coalesce(intend_to_buy_ev, false) or coalesce(smart_meter_interest, false)
                          or coalesce(ev_tariff_marketing_consent, false)) as has_any_interest_count
  from mi group by 1
) s""",
        _INTERESTS,
    ),
    "interest_combinations": with_views(
        ["master", "billing_account", "customer_setting"],
        """
select coalesce(cast(intend_to_buy_ev as varchar), 'NULL') as ev_interest,
       coalesce(cast(smart_meter_interest as varchar), 'NULL') as smart_meter_interest,
       coalesce(cast(ev_tariff_marketing_consent as varchar), 'NULL') as ev_tariff_consent,
       count(*) as account_count,
       round(cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double), 1) as pct_of_total
from mi where subscription_status = 'Subscribed' group by 1, 2, 3""",
        _INTERESTS,
    ),
    "grain_report": with_views(
        ["master"],
        """
select count(*) as total_billing_accounts, count(distinct customer_number) as unique_customers,
       round(cast(count(*) as double) / nullif(cast(count(distinct customer_number) as double), 0), 2) as accounts_per_customer,
       count(*) filter (where ele_mpan is not null and gas_mprn is not null) as dual_fuel_accounts,
       count(*) filter (where ele_mpan is not null and gas_mprn is null) as elec_only_accounts,
       count(*) filter (where ele_mpan is null and gas_mprn is not null) as gas_only_accounts
from master where acc_status = 'Active'""",
    ),
    "accounts_per_customer": with_views(
        ["master"],
        """
select num_accounts, count(*) as customer_count, cast(sum(count(*)) over () as bigint) as total_customers,
       round(cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double), 1) as pct
from (select customer_number, count(distinct account_number) as num_accounts from master
      where acc_status = 'Active' and customer_number is not null group by 1) x
group by num_accounts""",
    ),
    "consent_consistency": with_views(
        ["master"],
        """
select case when num_accounts = 1 then 'Single account'
            when consent_statuses = 1 then 'Multi-account, SAME consent'
            else 'Multi-account, DIFFERENT consent' end as consent_consistency,
       count(*) as customer_count,
       round(cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double), 1) as pct
from (select customer_number, count(distinct account_number) as num_accounts,
             count(distinct subscription_status) as consent_statuses
      from master where acc_status = 'Active' and customer_number is not null group by 1) x
group by 1""",
    ),
    "conflict_examples": with_views(
        ["master"],
        """
select customer_number, account_number, subscription_status, acc_created_dt from master
where customer_number in (
  select customer_number from master where acc_status = 'Active' and customer_number is not null
  group by customer_number
  having count(distinct account_number) > 1 and count(distinct subscription_status) > 1
  order by customer_number limit 5
) and acc_status = 'Active'""",
    ),
    "customer_consent_summary": with_views(
        ["master"],
        """
select customer_consent, count(*) as customers,
       round(cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double), 1) as pct
from (select customer_number,
             case when max(case when subscription_status = 'Subscribed' then 1 else 0 end) = 1
                  then 'Opted In' else 'Opted Out' end as customer_consent
      from master where acc_status = 'Active' and customer_number is not null group by 1) x
group by customer_consent""",
    ),
}

ORACLE["customer_consent"] = with_views(
    ["master"],
    """
select customer_number, case when bool_or(coalesce(subscription_status = 'Subscribed', false)) then 'Opted In' else 'Opted Out' end as customer_consent
from master where acc_status = 'Active' and customer_number is not null group by 1""",
)
ORACLE["kpi_summary"] = with_views(
    ["master"],
    """
select count(distinct customer_number) as unique_customers, count(*) as billing_accounts,
       count(*) filter (where subscription_status = 'Subscribed') as opted_in_accounts,
       round(cast(count(*) filter (where subscription_status = 'Subscribed') as double) * 100.0
             / nullif(cast(count(*) as double), 0), 1) as opt_in_rate
from master where acc_status = 'Active'""",
)
ORACLE["cancellations_per_month"] = with_views(
    ["cancellations"],
    """
select cast(date_trunc('month', created_at) as date) as month, count(*) as cancellations
from cancellations where effective_to = timestamp '9999-01-01' and created_at >= timestamp '1998-08-03'
group by 1""",
)
ORACLE["cancellation_reasons_count"] = with_views(
    ["cancellations", "cancellation_reasons"],
    """
select r.reason, count(*) as count
from cancellations c join cancellation_reasons r on c.reason_id = r.id and r.effective_to = timestamp '9999-01-01'
where c.effective_to = timestamp '9999-01-01' and c.created_at >= timestamp '1998-08-03'
group by r.reason""",
)

ORACLE["interests_two_way"] = with_views(
    ["master", "billing_account", "customer_setting"],
    """
select case when subscription_status = 'Subscribed' then 'Opted In' else 'Opted Out' end as consent, count(*) as total,
       count(*) filter (where intend_to_buy_ev = true) as ev_interest_count,
       count(*) filter (where smart_meter_interest = true) as smart_meter_interest_count,
       count(*) filter (where ev_tariff_marketing_consent = true) as ev_tariff_consent_count,
       round(cast(count(*) filter (where intend_to_buy_ev = true or smart_meter_interest = true
                                   or ev_tariff_marketing_consent = true) as double) * 100.0 / count(*), 1) as any_interest_pct
from mi group by 1""",
    _INTERESTS,
)

ORACLE["subscription_status_distribution"] = with_views(
    ["master"],
    """select subscription_status, count(*) as account_count,
       round(cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double), 1) as pct
from master where acc_status = 'Active' group by 1""",
)
ORACLE["renewal_delta_two_way"] = with_views(
    ["master"],
    """
select max(case when consent = 'Opted In' then rate end) as opted_in_rate,
       max(case when consent = 'Opted Out' then rate end) as opted_out_rate,
       round(max(case when consent = 'Opted In' then rate end) - max(case when consent = 'Opted Out' then rate end), 2) as delta_pp
from (
  select consent, round(cast(sum(r) as double) * 100.0 / nullif(cast(count(*) as double), 0), 1) as rate
  from (select case when subscription_status = 'Subscribed' then 'Opted In' else 'Opted Out' end as consent,
               case when ele_rnwl_status = 'Renewed' or gas_rnwl_status = 'Renewed'
                         or ele_next_tariff is not null or gas_next_tarif is not null then 1 else 0 end as r
        from master where """
    + _ENDED
    + """ and subscription_status is not null) x
  group by 1
) r""",
)
