"""Catalogue: balances, tariffs, expiries, meter mappings, exclusions, exception roots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.core import ntz

from ..operators import links as L
from ..operators.temporal import current_state
from ..sources import standins as S
from ..sources.tables import table
from .common import HISTORY, with_views

NOW = dt.datetime(2001, 8, 2)
MAPPING_AT = dt.datetime(1998, 1, 1)
# Transaction types (the documented query leaves its type lists blank).
DEBIT_TYPES = ("N", "A")
CREDIT_TYPES = ("R",)
# Tariff name buckets.
TARIFF_BUCKETS = (("Fixed", ("%Fixed%",)), ("Variable", ("%Variable%", "%SVT%", "%Flex%")))


def account_balance(spark, sf_dir):
    """Debits and credits per current account."""
    acct = current_state(S.account_versions(spark, sf_dir)).select(
        F.col("account_id").alias("o_custkey"), F.col("account_id").cast("string").alias("account_number")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_fk"), "o_custkey")
    per_order = L.account_balance(orders, current_state(S.transactions(spark, sf_dir)), "order_fk", DEBIT_TYPES, CREDIT_TYPES)
    per_acct = per_order.groupBy("o_custkey").agg(
        F.sum("debits").cast("decimal(38,2)").alias("debits"), F.sum("credits").cast("decimal(38,2)").alias("credits")
    )
    return acct.join(per_acct, "o_custkey").select("account_number", "debits", "credits")


def _live_bundles(spark, sf_dir):
    pb = current_state(S.product_bundle(spark, sf_dir))
    t = ntz(NOW)
    return pb.where((F.col("cancel_fl") != "Y") & (F.col("to_dttm").isNull() | (F.col("to_dttm") > t)))


def tariff_type_split(spark, sf_dir):
    """Distinct accounts per tariff bucket (name patterns)."""
    pb = _live_bundles(spark, sf_dir)
    return (
        pb.groupBy(L.bucket_like("product_name", TARIFF_BUCKETS).alias("tariff_type"))
        .agg(F.count_distinct("account_fk").alias("customer_count"))
        .orderBy(F.col("customer_count").desc())
    )


def accounts_per_product(spark, sf_dir):
    """M2: distinct accounts per product name."""
    return (
        _live_bundles(spark, sf_dir)
        .groupBy("product_name")
        .agg(F.count_distinct("account_fk").alias("customer_count"))
        .orderBy(F.col("customer_count").desc(), "product_name")
    )


def upcoming_expiries(spark, sf_dir):
    """Accounts whose contract ends in the next 90 days, per day."""
    pb = current_state(S.product_bundle(spark, sf_dir)).where(F.col("cancel_fl") != "Y")
    return L.expiries(pb, "contracted_to", "account_fk", NOW, 90, "day")


def expiries_by_month(spark, sf_dir):
    """Accounts due renewal in the next 365 days, per month."""
    pb = current_state(S.product_bundle(spark, sf_dir)).where(F.col("cancel_fl") != "Y")
    return L.expiries(pb, "contracted_to", "account_fk", NOW, 365, "month")


def rts_meter_flags(spark, sf_dir):
    """Per settlement config, is a live mapping to a regime id > 999 present?"""
    configs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("config_fk"))
    return L.valid_mapping_exists(
        configs, "config_fk", S.regime_map(spark, sf_dir), "config_fk", S.regimes(spark, sf_dir), MAPPING_AT
    )


def exclusion_eligibility(spark, sf_dir):
    """Meters on the exclusion list (composite key mpxn, msn) per fuel."""
    flagged = L.exclusion_flag(S.meters(spark, sf_dir), S.exclusion_list(spark, sf_dir), ["mpxn", "msn"])
    status = F.when(F.col("on_exclusion_list"), "INELIGIBLE_ON_EXCLUSION_LIST").otherwise("ELIGIBLE")
    return flagged.groupBy("fuel", status.alias("eligibility")).agg(F.count(F.lit(1)).alias("meters")).orderBy("fuel", "eligibility")


def exception_root_cause(spark, sf_dir):
    """Exceptions rolled up to their root exception's class."""
    return L.root_cause(S.server_exceptions(spark, sf_dir), "id", "root_fk", "exception_class").orderBy(
        F.col("exceptions").desc(), "root_class"
    )


def product_per_account(spark, sf_dir):
    """M1/A5: live tariffs of current accounts: name, start, contract end and end, one row per bundle."""
    acct = current_state(S.account_versions(spark, sf_dir)).select(F.col("account_id").alias("account_fk"))
    return _live_bundles(spark, sf_dir).join(acct, "account_fk").select(
        F.col("account_fk").cast("string").alias("account_number"),
        F.col("product_name").alias("tariff_name"),
        F.col("from_dttm").alias("tariff_start"),
        F.col("contracted_to").alias("contract_end_date"),
        F.col("to_dttm").alias("tariff_end"),
    )


def renewal_status(spark, sf_dir):
    """M6: live, not-deleted, not-cancelled renewals by status (``cancelled = FALSE`` drops NULL)."""
    r = current_state(S.renewals(spark, sf_dir)).where(F.col("deleted").isNull() & (F.col("cancelled") == F.lit(False)))
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "status")


def enrolment_status(spark, sf_dir):
    """M7: enrolments by status since the period start."""
    e = HISTORY.rows(current_state(S.enrolments(spark, sf_dir)), "created_at")
    return e.groupBy("status").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "status")


def broker_renewals(spark, sf_dir):
    """M8: renewals by broker x status."""
    r = HISTORY.rows(current_state(S.renewals(spark, sf_dir)), "created_at").where(F.col("deleted").isNull())
    return r.groupBy("broker", "status").agg(F.count(F.lit(1)).alias("count")).orderBy("broker", F.col("count").desc(), "status")


def accounts_by_payment_method(spark, sf_dir):
    """C16 (J2 chain): current accounts -> current payment-method link -> method type (not SCD2)."""
    a = current_state(S.billing_account(spark, sf_dir)).select(F.col("id").alias("account_id"))
    apm = current_state(S.account_versions(spark, sf_dir)).select(
        "account_id", F.substring("priority", 1, 1).cast("int").alias("payment_method_type_fk")
    )
    pmt = S.payment_method_type(spark, sf_dir).select(F.col("id").alias("payment_method_type_fk"), F.col("name").alias("payment_method"))
    j = a.join(apm, "account_id").join(pmt, "payment_method_type_fk")
    return j.groupBy("payment_method").agg(F.count_distinct("account_id").alias("accounts")).orderBy(F.col("accounts").desc())


QUERIES = {
    "accounts_by_payment_method": accounts_by_payment_method,
    "renewal_status": renewal_status,
    "enrolment_status": enrolment_status,
    "broker_renewals": broker_renewals,
    "account_balance": account_balance,
    "tariff_type_split": tariff_type_split,
    "accounts_per_product": accounts_per_product,
    "upcoming_expiries": upcoming_expiries,
    "expiries_by_month": expiries_by_month,
    "rts_meter_flags": rts_meter_flags,
    "exclusion_eligibility": exclusion_eligibility,
    "exception_root_cause": exception_root_cause,
    "product_per_account": product_per_account,
}

_LIVE = "effective_to = timestamp '9999-01-01' and cancel_fl != 'Y' and (to_dttm is null or to_dttm > timestamp '2001-08-02')"

ORACLE = {
    "account_balance": with_views(
        ["account_versions", "transactions"],
        """
select cast(a.account_id as varchar) as account_number,
       cast(sum(case when t.transaction_type in ('N', 'A') then t.amount else 0 end) as decimal(38, 2)) as debits,
       cast(sum(case when t.transaction_type in ('R') then t.amount else 0 end) as decimal(38, 2)) as credits
from account_versions a
join orders o on o.o_custkey = a.account_id
join transactions t on t.order_fk = o.o_orderkey and t.effective_to = timestamp '9999-01-01'
where a.effective_to = timestamp '9999-01-01'
group by a.account_id""",
    ),
    "tariff_type_split": with_views(
        ["product_bundle"],
        f"""
select case when product_name like '%Fixed%' then 'Fixed'
            when product_name like '%Variable%' or product_name like '%SVT%' or product_name like '%Flex%' then 'Variable'
            else 'Other' end as tariff_type,
       count(distinct account_fk) as customer_count
from product_bundle where {_LIVE} group by 1""",
    ),
    "accounts_per_product": with_views(
        ["product_bundle"],
        f"select product_name, count(distinct account_fk) as customer_count from product_bundle where {_LIVE} group by 1",
    ),
    "upcoming_expiries": with_views(
        ["product_bundle"],
        """
select cast(contracted_to as date) as contract_end_date, count(distinct account_fk) as accounts_expiring
from product_bundle where effective_to = timestamp '9999-01-01' and cancel_fl != 'Y'
  and contracted_to >= timestamp '2001-08-02' and contracted_to <= timestamp '2001-08-02' + interval 90 day
group by 1""",
    ),
    "expiries_by_month": with_views(
        ["product_bundle"],
        """
select strftime(contracted_to, '%Y-%m') as renewal_month, count(distinct account_fk) as accounts_due_renewal
from product_bundle where effective_to = timestamp '9999-01-01' and cancel_fl != 'Y'
  and contracted_to >= timestamp '2001-08-02' and contracted_to <= timestamp '2001-08-02' + interval 365 day
group by 1""",
    ),
    "rts_meter_flags": with_views(
        ["regime_map", "regimes"],
        """
select p.p_partkey as config_fk,
       exists (select 1 from regime_map utm join regimes utpr on utpr.id = utm.regime_fk
               where utm.config_fk = p.p_partkey and utm.delete_fl = 'N'
                 and utm.from_dt <= timestamp '1998-01-01'
                 and (utm.to_dt >= timestamp '1998-01-01' or utm.to_dt is null)
                 and cast(utpr.regime_id as bigint) > 999) as is_rts_meter
from part p""",
    ),
    "exclusion_eligibility": with_views(
        ["meters", "exclusion_list"],
        """
select m.fuel, case when e.mpxn is not null then 'INELIGIBLE_ON_EXCLUSION_LIST' else 'ELIGIBLE' end as eligibility,
       count(*) as meters
from meters m left join (select distinct mpxn, msn from exclusion_list) e on m.mpxn = e.mpxn and m.msn = e.msn
group by 1, 2""",
    ),
    "exception_root_cause": with_views(
        ["server_exceptions"],
        """
select case when e.root_fk is null then e.exception_class else coalesce(r.exception_class, 'UNRESOLVED') end as root_class,
       count(*) as exceptions, count(distinct e.exception_class) as distinct_classes
from server_exceptions e left join server_exceptions r on e.root_fk = r.id
group by 1""",
    ),
    "product_per_account": with_views(
        ["account_versions", "product_bundle"],
        f"""
select cast(b.account_fk as varchar) as account_number, b.product_name as tariff_name,
       b.from_dttm as tariff_start, b.contracted_to as contract_end_date, b.to_dttm as tariff_end
from (select * from product_bundle where {_LIVE}) b
where exists (select 1 from account_versions a where a.account_id = b.account_fk and a.effective_to = timestamp '9999-01-01')""",
    ),
}

ORACLE["renewal_status"] = with_views(
    ["renewals"],
    """select status, count(*) as count from renewals
where effective_to = timestamp '9999-01-01' and deleted is null and cancelled = false group by 1""",
)
ORACLE["enrolment_status"] = with_views(
    ["enrolments"],
    f"""select status, count(*) as count from enrolments
where effective_to = timestamp '9999-01-01' and {HISTORY.sql("enrolments", "created_at")} group by 1""",
)
ORACLE["broker_renewals"] = with_views(
    ["renewals"],
    f"""select broker, status, count(*) as count from renewals
where effective_to = timestamp '9999-01-01' and deleted is null and {HISTORY.sql("renewals", "created_at")} group by 1, 2""",
)

ORACLE["accounts_by_payment_method"] = with_views(
    ["billing_account", "account_versions", "payment_method_type"],
    """select pmt.name as payment_method, count(distinct a.id) as accounts
from billing_account a
join account_versions apm on a.id = apm.account_id and apm.effective_to = timestamp '9999-01-01'
join payment_method_type pmt on cast(substr(apm.priority, 1, 1) as int) = pmt.id
where a.effective_to = timestamp '9999-01-01'
group by pmt.name""",
)
