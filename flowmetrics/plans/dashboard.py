"""Catalogue: consent dashboard sections, cohort movement and the export sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.core import count_if, pct
from ..operators import cohort as C
from ..operators.temporal import current_state, week_start
from ..sources import standins as S
from .common import ORDERS_AS_OF, with_views
from .consent import PERIOD_DAYS, SINCE

TREND_WEEKS = 12


def dashboard_weekly_summary(spark, sf_dir):
    """N12 section 1: active snapshot per raw status, joined/left in the period.

    The "left" counts are joined on the nullable status, so the NULL status
    group gets no left count (G16), as in the documented query.
    """
    m = S.marketing_master(spark, sf_dir)
    created = F.to_date("acc_created_dt")
    active = m.where(F.col("acc_status") == "Active").groupBy("subscription_status").agg(
        F.count(F.lit(1)).alias("account_count"),
        count_if((F.col("ele_rnwl_status") == "Renewed") | (F.col("gas_rnwl_status") == "Renewed")).alias("renewed_count"),
        count_if(F.col("acc_status") == "Closing").alias("closing_count"),
        count_if(created < F.lit(SINCE)).alias("active_at_period_start"),
        count_if(created >= F.lit(SINCE)).alias("joined_during_period"),
    )
    left = (
        m.where(F.col("acc_status").isin("Closing", "Final") & (F.to_date("acc_closed_dt") >= F.lit(SINCE)))
        .groupBy("subscription_status")
        .agg(F.count(F.lit(1)).alias("left_during_period"))
    )
    return active.join(left, active["subscription_status"] == left["subscription_status"], "left").select(
        active["subscription_status"],
        "account_count",
        "renewed_count",
        "closing_count",
        "active_at_period_start",
        "joined_during_period",
        F.coalesce("left_during_period", F.lit(0)).cast("long").alias("left_during_period"),
    )


def dashboard_renewal_cohort(spark, sf_dir):
    """N12 section 2: contracts ended in the period, renewed vs churned per consent."""
    m = S.marketing_master(spark, sf_dir).where(
        C.ended_between(SINCE, ORDERS_AS_OF) & F.col("acc_status").isin(*C.ENDED_ACCOUNT_STATUSES)
    )
    renewed = (
        (F.col("ele_rnwl_status") == "Renewed")
        | (F.col("gas_rnwl_status") == "Renewed")
        | F.col("ele_next_tariff").isNotNull()
        | F.col("gas_next_tarif").isNotNull()
    )
    not_ren = lambda c: (F.col(c) != "Renewed") | F.col(c).isNull()
    churned = F.col("acc_status").isin("Closing", "Final") & not_ren("ele_rnwl_status") & not_ren("gas_rnwl_status")
    agg = m.groupBy(C.consent_status().alias("consent_status")).agg(
        F.count(F.lit(1)).alias("contracts_ended"), count_if(renewed).alias("renewed"), count_if(churned).alias("churned")
    )
    return agg.withColumn("renewal_rate_pct", pct("renewed", "contracts_ended"))


def dashboard_weekly_trend(spark, sf_dir):
    """N12 section 4: contracts ending per week (Monday) by two-way consent."""
    pb = current_state(S.product_bundle(spark, sf_dir))
    lo = ORDERS_AS_OF - dt.timedelta(weeks=TREND_WEEKS)
    pb = pb.where((F.col("cancel_fl") != "Y") & F.to_date("contracted_to").between(F.lit(lo), F.lit(ORDERS_AS_OF)))
    acct = current_state(S.account_versions(spark, sf_dir)).select(
        F.col("account_id").alias("account_fk"), F.col("account_id").cast("string").alias("account_number")
    ).distinct()
    m = S.marketing_master(spark, sf_dir).select("account_number", "subscription_status")
    j = pb.join(acct, "account_fk").join(m, "account_number", "left")
    return j.groupBy(
        week_start("contracted_to").alias("week_start"), C.consent_status(three_way=False).alias("consent_status")
    ).agg(
        F.count_distinct("account_fk").alias("contracts_ended"), count_if(F.col("follow_on_fl") == "Y").alias("renewed")
    )


def cohort_movement(spark, sf_dir):
    """Start / joined / left / end of period and churn, net growth per consent.

    One pass over the master with a state label instead of a union of two scans.
    """
    m = S.marketing_master(spark, sf_dir)
    state = F.when(F.col("acc_status") == "Active", "Active").when(
        F.col("acc_status").isin("Closing", "Final") & (F.to_date("acc_closed_dt") >= F.lit(SINCE)), "Left"
    )
    a = m.select(C.consent_status().alias("consent_status"), state.alias("state"), F.to_date("acc_created_dt").alias("created")).where(
        F.col("state").isNotNull()
    )
    before = F.col("created") < F.lit(SINCE)
    agg = a.groupBy("consent_status").agg(
        count_if(before).alias("active_at_period_start"),
        count_if(~before & (F.col("state") == "Active")).alias("joined_during_period"),
        count_if(F.col("state") == "Left").alias("left_during_period"),
        count_if(F.col("state") == "Active").alias("active_at_period_end"),
    )
    return agg.select(
        "*",
        pct("left_during_period", "active_at_period_start", 2).alias("churn_rate_pct"),
        pct(F.col("joined_during_period") - F.col("left_during_period"), "active_at_period_start", 2).alias("net_growth_pct"),
    ).orderBy("consent_status")


#: Metrics of each section, in the order of the values its rows carry.
SECTIONS = {
    "weekly_summary": ("account_count", "renewed_count", "active_at_period_start", "joined_during_period", "left_during_period"),
    "renewal_cohort": ("contracts_ended", "renewed", "churned"),
    "interests": ("total", "ev_interest", "smart_meter_interest", "ev_tariff_consent", "any_interest"),
    "weekly_trend": ("contracts_ended", "renewed"),
}
INTEREST_FLAGS = ("intend_to_buy_ev", "smart_meter_interest", "ev_tariff_marketing_consent")


def dashboard_rows(master, interests, bundles, since=SINCE, as_of=ORDERS_AS_OF):
    """What each account adds to the sections: (section, group_key, v1..v5), in one pass over each table.

    ``master`` has one row per account; ``interests`` (account_number, the
    flags) one per account; ``bundles`` (account_number, weeks) one per
    account with its contract weeks and renewals, an array bounded by the
    trend's weeks.  An account the master lacks counts in the trend, as
    opted out.
    """
    j = master.withColumn("_known", F.lit(True)).join(interests, "account_number", "left").join(bundles, "account_number", "full")
    yes = lambda c: F.coalesce(c, F.lit(False))
    known, status = yes(F.col("_known")), F.col("acc_status")
    created, closed = F.to_date("acc_created_dt"), F.to_date("acc_closed_dt")
    active = yes(status == "Active")
    gone = yes(status.isin("Closing", "Final"))
    left = gone & yes(closed >= F.lit(since)) & F.col("subscription_status").isNotNull()
    is_renewed = yes(F.col("ele_rnwl_status") == "Renewed") | yes(F.col("gas_rnwl_status") == "Renewed")
    followed = is_renewed | F.col("ele_next_tariff").isNotNull() | F.col("gas_next_tarif").isNotNull()
    ended = yes(C.ended_between(since, as_of)) & yes(status.isin(*C.ENDED_ACCOUNT_STATUSES))
    flags = [yes(F.col(f)) for f in INTEREST_FLAGS]
    consent = C.consent_status()

    def part(section, key, cond, *values):
        value = [v.cast("long") for v in values] + [F.lit(0).cast("long")] * (5 - len(values))
        return F.when(cond, F.struct(F.lit(section).alias("section"), key.cast("string").alias("group_key"), *[v.alias(f"v{i}") for i, v in enumerate(value, 1)]))

    always = F.lit(True)
    trend = F.transform(
        F.coalesce("weeks", F.array().cast("array<struct<week:date,renewed:bigint>>")),
        lambda w: part("weekly_trend", F.concat_ws("|", w["week"].cast("string"), C.consent_status(three_way=False)), always, F.lit(1), w["renewed"]),
    )
    parts = F.array(
        part("weekly_summary", F.col("subscription_status"), active | left, active, active & is_renewed, active & yes(created < F.lit(since)), active & yes(created >= F.lit(since)), left),
        part("renewal_cohort", consent, ended, always, followed, gone & ~is_renewed),
        part("interests", consent, active, always, *flags, flags[0] | flags[1] | flags[2]),
    )
    parts = F.when(known, F.array_compact(parts)).otherwise(F.array_compact(F.array(part("", consent, F.lit(False)))))
    return j.select(F.inline(F.concat(parts, trend)))


def dashboard_export(spark, sf_dir):
    """The four sections as one long string-valued table for the dashboard.

    Rows ``(section, group_key, metric, value)``: every account adds to its
    sections in one pass, one aggregate sums them, and the sums are unpivoted.
    Write it with ``df.write.json(path)`` to feed the dashboard.
    """
    setting = current_state(S.customer_setting(spark, sf_dir)).where(F.col("deleted").isNull())
    interests = current_state(S.billing_account(spark, sf_dir)).select(F.col("number").alias("account_number"), F.col("settings_id").alias("id")).join(setting, "id").select("account_number", *INTEREST_FLAGS)
    lo = ORDERS_AS_OF - dt.timedelta(weeks=TREND_WEEKS)
    pb = current_state(S.product_bundle(spark, sf_dir)).where((F.col("cancel_fl") != "Y") & F.to_date("contracted_to").between(F.lit(lo), F.lit(ORDERS_AS_OF)))
    accounts = current_state(S.account_versions(spark, sf_dir)).select(F.col("account_id").alias("account_fk")).distinct()
    weeks = pb.join(accounts, "account_fk").groupBy("account_fk", week_start("contracted_to").alias("week")).agg(count_if(F.col("follow_on_fl") == "Y").alias("renewed"))
    bundles = weeks.groupBy(F.col("account_fk").cast("string").alias("account_number")).agg(F.collect_list(F.struct("week", "renewed")).alias("weeks"))
    sums = dashboard_rows(S.marketing_master(spark, sf_dir), interests, bundles).groupBy("section", "group_key").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(1, 6)])
    # a status that only accounts which left still have is no group of the summary
    sums = sums.where((F.col("section") != "weekly_summary") | (F.col("v1") > 0))
    row = lambda m, v: F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value"))
    metrics = None
    for section, names in SECTIONS.items():
        rows = [row(m, F.col(f"v{i}")) for i, m in enumerate(names, 1)]
        if section == "interests":
            rows.append(row("any_interest_pct", pct("v5", "v1")))
        cond = F.col("section") == section
        metrics = F.when(cond, F.array(*rows)) if metrics is None else metrics.when(cond, F.array(*rows))
    return sums.select("section", F.coalesce("group_key", F.lit("NULL")).alias("group_key"), F.inline(metrics))


QUERIES = {
    "dashboard_weekly_summary": dashboard_weekly_summary,
    "dashboard_renewal_cohort": dashboard_renewal_cohort,
    "dashboard_weekly_trend": dashboard_weekly_trend,
    "cohort_movement": cohort_movement,
    "dashboard_export": dashboard_export,
}

_CONSENT = """case when subscription_status = 'Subscribed' then 'Opted In'
  when subscription_status in ('Unsubscribed', 'SoftBounced', 'HardBounced') then 'Opted Out' else 'Unknown' end"""
_SINCE = "date '1998-08-03'"

_WS = f"""
ws as (
  select a.subscription_status, a.account_count, a.renewed_count, a.closing_count, a.active_at_period_start,
         a.joined_during_period, cast(coalesce(l.left_during_period, 0) as bigint) as left_during_period
  from (select subscription_status, count(*) as account_count,
               count(*) filter (where ele_rnwl_status = 'Renewed' or gas_rnwl_status = 'Renewed') as renewed_count,
               count(*) filter (where acc_status = 'Closing') as closing_count,
               count(*) filter (where cast(acc_created_dt as date) < {_SINCE}) as active_at_period_start,
               count(*) filter (where cast(acc_created_dt as date) >= {_SINCE}) as joined_during_period
        from master where acc_status = 'Active' group by 1) a
  left join (select subscription_status, count(*) as left_during_period from master
             where acc_status in ('Closing', 'Final') and cast(acc_closed_dt as date) >= {_SINCE} group by 1) l
    on a.subscription_status = l.subscription_status
)"""
_RC = f"""
rc as (
  select consent_status, contracts_ended, renewed, churned,
         round(cast(renewed as double) * 100.0 / nullif(cast(contracts_ended as double), 0), 1) as renewal_rate_pct
  from (select {_CONSENT} as consent_status, count(*) as contracts_ended,
          count(*) filter (where ele_rnwl_status = 'Renewed' or gas_rnwl_status = 'Renewed'
                           or ele_next_tariff is not null or gas_next_tarif is not null) as renewed,
          count(*) filter (where acc_status in ('Closing', 'Final')
                           and (ele_rnwl_status != 'Renewed' or ele_rnwl_status is null)
                           and (gas_rnwl_status != 'Renewed' or gas_rnwl_status is null)) as churned
        from master
        where (ele_cur_tarif_end between {_SINCE} and date '2001-08-02'
               or gas_cur_tarif_end between {_SINCE} and date '2001-08-02')
          and acc_status in ('Active', 'Closing', 'Final')
        group by 1) x
)"""
_WT = """
wt as (
  select cast(date_trunc('week', pb.contracted_to) as date) as week_start,
         case when m.subscription_status = 'Subscribed' then 'Opted In' else 'Opted Out' end as consent_status,
         count(distinct pb.account_fk) as contracts_ended,
         count(*) filter (where pb.follow_on_fl = 'Y') as renewed
  from product_bundle pb
  join (select distinct account_id from account_versions where effective_to = timestamp '9999-01-01') a
    on pb.account_fk = a.account_id
  left join master m on cast(a.account_id as varchar) = m.account_number
  where pb.effective_to = timestamp '9999-01-01' and pb.cancel_fl != 'Y'
    and cast(pb.contracted_to as date) between date '2001-08-02' - interval 12 week and date '2001-08-02'
  group by 1, 2
)"""

TREND_CTE = _WT

ORACLE = {
    "dashboard_weekly_summary": with_views(["master"], "select * from ws", _WS),
    "dashboard_renewal_cohort": with_views(["master"], "select * from rc", _RC),
    "dashboard_weekly_trend": with_views(["master", "product_bundle", "account_versions"], "select * from wt", _WT),
    "cohort_movement": with_views(
        ["master"],
        f"""
select consent_status,
  count(*) filter (where cast(acc_created_dt as date) < {_SINCE}) as active_at_period_start,
  count(*) filter (where cast(acc_created_dt as date) >= {_SINCE} and state = 'Active') as joined_during_period,
  count(*) filter (where state = 'Left') as left_during_period,
  count(*) filter (where state = 'Active') as active_at_period_end,
  round(cast(count(*) filter (where state = 'Left') as double) * 100.0
        / nullif(cast(count(*) filter (where cast(acc_created_dt as date) < {_SINCE}) as double), 0), 2) as churn_rate_pct,
  round(cast(count(*) filter (where cast(acc_created_dt as date) >= {_SINCE} and state = 'Active')
             - count(*) filter (where state = 'Left') as double) * 100.0
        / nullif(cast(count(*) filter (where cast(acc_created_dt as date) < {_SINCE}) as double), 0), 2) as net_growth_pct
from (
  select {_CONSENT} as consent_status, account_number, acc_created_dt, 'Active' as state from master where acc_status = 'Active'
  union all
  select {_CONSENT}, account_number, acc_created_dt, 'Left' from master
  where acc_status in ('Closing', 'Final') and cast(acc_closed_dt as date) >= {_SINCE}
) a group by consent_status""",
    ),
    "dashboard_export": with_views(
        ["master", "product_bundle", "account_versions", "billing_account", "customer_setting"],
        """
unpivot (
  select 'weekly_summary' as section, coalesce(subscription_status, 'NULL') as group_key, cast(account_count as varchar) as account_count,
    cast(renewed_count as varchar) as renewed_count, cast(active_at_period_start as varchar) as active_at_period_start,
    cast(joined_during_period as varchar) as joined_during_period, cast(left_during_period as varchar) as left_during_period
  from ws
) on columns(* exclude (section, group_key)) into name metric value value
union all from (unpivot (
  select 'renewal_cohort' as section, coalesce(consent_status, 'NULL') as group_key, cast(contracts_ended as varchar) as contracts_ended,
    cast(renewed as varchar) as renewed, cast(churned as varchar) as churned
  from rc
) on columns(* exclude (section, group_key)) into name metric value value)
union all from (unpivot (
  select 'interests' as section, consent_status as group_key, cast(count(*) as varchar) as total,
    cast(count(*) filter (where intend_to_buy_ev) as varchar) as ev_interest,
    cast(count(*) filter (where smart_meter_interest) as varchar) as smart_meter_interest,
    cast(count(*) filter (where ev_tariff_marketing_consent) as varchar) as ev_tariff_consent,
    cast(count(*) filter (where intend_to_buy_ev or smart_meter_interest or ev_tariff_marketing_consent) as varchar) as any_interest,
    cast(round(cast(count(*) filter (where intend_to_buy_ev or smart_meter_interest or ev_tariff_marketing_consent) as double) * 100.0 / count(*), 1) as varchar) as any_interest_pct
  from told group by 2
) on columns(* exclude (section, group_key)) into name metric value value)
union all from (unpivot (
  select 'weekly_trend' as section, cast(week_start as varchar) || '|' || consent_status as group_key,
    cast(contracts_ended as varchar) as contracts_ended, cast(renewed as varchar) as renewed
  from wt
) on columns(* exclude (section, group_key)) into name metric value value)""",
        _WS + "," + _RC + "," + _WT + f""",
told as (
  select {_CONSENT} as consent_status, s.* from master m
  left join billing_account b on b.number = m.account_number and b.effective_to = timestamp '9999-01-01'
  left join customer_setting s on s.id = b.settings_id and s.effective_to = timestamp '9999-01-01' and s.deleted is null
  where m.acc_status = 'Active'
)""",
    ),
}

_ = PERIOD_DAYS
