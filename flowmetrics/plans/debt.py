"""Catalogue: debt collection agencies, past-due snapshots, payments and dunning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.temporal import current_state, latest_snapshot, trend
from ..sources.standins import billing_account, dca_allocation, dunning, pastdue, pastdue_payment
from ..sources.tables import table
from .common import HISTORY, ORDERS_AS_OF, with_views


def dca_accounts_by_status(spark, sf_dir):
    """B1: distinct accounts per agency and account status (current rows)."""
    return (
        current_state(dca_allocation(spark, sf_dir))
        .groupBy("dca_id", "account_status")
        .agg(F.count_distinct("account_number").alias("accounts"))
        .orderBy("dca_id", F.col("accounts").desc(), "account_status")
    )


def dca_allocations_over_time(spark, sf_dir):
    """B3 (A16): accounts allocated per day and agency."""
    a = HISTORY.rows(current_state(dca_allocation(spark, sf_dir)), "job_run_date")
    return trend(a, "job_run_date", "day", [F.count_distinct("account_number").alias("accounts_allocated")], by=["dca_id"], name="allocation_date").orderBy(
        F.col("allocation_date").desc(), "dca_id"
    )


def pastdue_by_status(spark, sf_dir):
    """B5 (A3, AG7): accounts and outstanding balance per status on the latest landing."""
    p = latest_snapshot(pastdue(spark, sf_dir), "landed_date")
    return (
        p.groupBy("status")
        .agg(F.count_distinct("account_number").alias("accounts"), F.sum("outstanding_balance").cast("decimal(38,2)").alias("total_outstanding"))
        .orderBy(F.col("accounts").desc(), "status")
    )


def collected_per_day(spark, sf_dir):
    """B6 (AG8): payments and amount collected per landing day (string amounts cast to double)."""
    p = HISTORY.rows(pastdue_payment(spark, sf_dir), "landed_date")
    return trend(
        p,
        "landed_date",
        "day",
        [F.count(F.lit(1)).alias("payments"), F.round(F.sum(F.col("amount").cast("double")), 2).alias("total_collected")],
        name="date",
    ).orderBy(F.col("date").desc())


def active_dunning(spark, sf_dir):
    """B7 (G2): active dunning instances; a NULL cancel flag is not counted."""
    return current_state(dunning(spark, sf_dir)).where(F.col("cancel_fl") != "Y").agg(
        F.count(F.lit(1)).alias("active_dunning_instances")
    )


def dunning_due(spark, sf_dir):
    """B8 (A56): active dunning instances due in the next 30 days, per due date."""
    d = current_state(dunning(spark, sf_dir)).where(
        (F.col("cancel_fl") != "Y") & F.col("due_dt").between(F.lit(ORDERS_AS_OF), F.lit(ORDERS_AS_OF + dt.timedelta(days=30)))
    )
    return d.groupBy("due_dt").agg(F.count(F.lit(1)).alias("instances")).orderBy("due_dt")


def dca_accounts_by_occupier(spark, sf_dir):
    """B2: distinct accounts per agency and occupier status."""
    return (
        current_state(dca_allocation(spark, sf_dir))
        .groupBy("dca_id", "occupier_status")
        .agg(F.count_distinct("account_number").alias("accounts"))
        .orderBy("dca_id", F.col("accounts").desc(), "occupier_status")
    )


def dca_psr_split(spark, sf_dir):
    """Priority-register split per agency."""
    return (
        current_state(dca_allocation(spark, sf_dir))
        .groupBy("dca_id", "psr")
        .agg(F.count_distinct("account_number").alias("accounts"))
        .orderBy("dca_id", "psr")
    )


def dca_accounts_with_customer(spark, sf_dir):
    """B11 (A5): current agency allocations -> current billing account -> customer (inner joins)."""
    dca = current_state(dca_allocation(spark, sf_dir)).select("account_number", "dca_id", "account_status")
    ba = current_state(billing_account(spark, sf_dir)).select(F.col("number").alias("account_number"), F.col("id").alias("customer_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"))
    return dca.join(ba, "account_number").join(c, "customer_id").select("account_number", "dca_id", "account_status", "customer_name")


QUERIES = {
    "dca_accounts_with_customer": dca_accounts_with_customer,
    "dca_accounts_by_occupier": dca_accounts_by_occupier,
    "dca_psr_split": dca_psr_split,
    "dca_accounts_by_status": dca_accounts_by_status,
    "dca_allocations_over_time": dca_allocations_over_time,
    "pastdue_by_status": pastdue_by_status,
    "collected_per_day": collected_per_day,
    "active_dunning": active_dunning,
    "dunning_due": dunning_due,
}

CUR = "effective_to = timestamp '9999-01-01'"
ORACLE = {
    "dca_accounts_by_status": with_views(
        ["dca_allocation"],
        f"select dca_id, account_status, count(distinct account_number) as accounts from dca_allocation where {CUR} group by 1, 2",
    ),
    "dca_allocations_over_time": with_views(
        ["dca_allocation"],
        f"""select job_run_date as allocation_date, dca_id, count(distinct account_number) as accounts_allocated
from dca_allocation where {CUR} and {HISTORY.sql("dca_allocation", "job_run_date")} group by 1, 2""",
    ),
    "pastdue_by_status": with_views(
        ["pastdue"],
        """select status, count(distinct account_number) as accounts, sum(outstanding_balance) as total_outstanding
from pastdue where landed_date = (select max(landed_date) from pastdue) group by 1""",
    ),
    "collected_per_day": with_views(
        ["pastdue_payment"],
        f"""select landed_date as date, count(*) as payments, round(sum(cast(amount as double)), 2) as total_collected
from pastdue_payment where {HISTORY.sql("pastdue_payment", "landed_date")} group by 1""",
    ),
    "active_dunning": with_views(
        ["dunning"], f"select count(*) as active_dunning_instances from dunning where {CUR} and cancel_fl != 'Y'"
    ),
    "dunning_due": with_views(
        ["dunning"],
        f"""select due_dt, count(*) as instances from dunning where {CUR} and cancel_fl != 'Y'
  and due_dt >= date '2001-08-02' and due_dt <= date '2001-08-02' + 30 group by 1""",
    ),
}

ORACLE["dca_accounts_by_occupier"] = with_views(
    ["dca_allocation"],
    f"select dca_id, occupier_status, count(distinct account_number) as accounts from dca_allocation where {CUR} group by 1, 2",
)
ORACLE["dca_psr_split"] = with_views(
    ["dca_allocation"], f"select dca_id, psr, count(distinct account_number) as accounts from dca_allocation where {CUR} group by 1, 2"
)

ORACLE["dca_accounts_with_customer"] = with_views(
    ["dca_allocation", "billing_account"],
    f"""select dca.account_number, dca.dca_id, dca.account_status, c.c_name as customer_name
from dca_allocation dca
join billing_account ba on dca.account_number = ba.number and ba.effective_to = timestamp '9999-01-01'
join customer c on ba.id = c.c_custkey
where dca.{CUR}""",
)
