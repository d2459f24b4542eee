"""Account links, balances, product buckets, expiries, mappings.

Joins here are dimension lookups or joins between frames that were first
reduced to one row per key (partial aggregation before the shuffle), so a
skewed key is collapsed map-side before it reaches a join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import classify, col, ts_literal


def account_balance(accounts: DataFrame, txns: DataFrame, key: str, debit_types: Sequence, credit_types: Sequence,
                    type_col: str = "transaction_type", amount: str = "amount") -> DataFrame:
    """Debits and credits per account.

    Transactions are summed per account *before* the join (map-side partial
    sums), so the join sees one row per account on each side.
    """
    t = txns.groupBy(key).agg(
        F.sum(F.when(F.col(type_col).isin(*debit_types), F.col(amount)).otherwise(F.lit(0))).alias("debits"),
        F.sum(F.when(F.col(type_col).isin(*credit_types), F.col(amount)).otherwise(F.lit(0))).alias("credits"),
    )
    return accounts.join(t, key)


def bucket_like(c: str | Column, buckets: Sequence[tuple[str, Sequence[str]]], default: str = "Other") -> Column:
    """First bucket whose any ``LIKE`` pattern matches."""
    rules = []
    for label, patterns in buckets:
        cond = None
        for p in patterns:
            m = col(c).like(p)
            cond = m if cond is None else cond | m
        rules.append((cond, label))
    return classify(rules, default)


def expiries(df: DataFrame, ts: str, entity: str, as_of: dt.datetime, days: int, grain: str = "day") -> DataFrame:
    """Distinct entities whose ``ts`` falls in ``[as_of, as_of + days]`` per day or month."""
    hi = as_of + dt.timedelta(days=days)
    w = df.where((F.col(ts) >= ts_literal(as_of, df, ts)) & (F.col(ts) <= ts_literal(hi, df, ts)))
    if grain == "day":
        bucket, bname, name = F.to_date(ts), "contract_end_date", "accounts_expiring"
    else:
        bucket, bname, name = F.date_format(ts, "yyyy-MM"), "renewal_month", "accounts_due_renewal"
    return w.groupBy(bucket.alias(bname)).agg(F.count_distinct(entity).alias(name)).orderBy(bname)


def valid_mapping_exists(configs: DataFrame, key: str, mapping: DataFrame, map_key: str, regimes: DataFrame,
                         at: dt.datetime, threshold: int = 999, name: str = "is_rts_meter") -> DataFrame:
    """Per config key, does a live mapping to a regime with id > threshold exist?

    Batch form of the per-key EXISTS: filter the mapping (not deleted, valid
    at ``at``), join the regime dimension, reduce to distinct config keys,
    then left-join that key set to every config.
    """
    live = mapping.where(
        (F.col("delete_fl") == "N")
        & (F.col("from_dt") <= ts_literal(at, mapping, "from_dt"))
        & (F.col("to_dt").isNull() | (F.col("to_dt") >= ts_literal(at, mapping, "to_dt")))
    )
    hits = (
        live.join(regimes.where(F.col("regime_id").cast("bigint") > threshold), live["regime_fk"] == regimes["id"])
        .select(F.col(map_key).alias(key))
        .distinct()
        .withColumn(name, F.lit(True))
    )
    return configs.select(key).distinct().join(hits, key, "left").select(key, F.coalesce(F.col(name), F.lit(False)).alias(name))


def exclusion_flag(df: DataFrame, excluded: DataFrame, keys: Sequence[str], name: str = "on_exclusion_list") -> DataFrame:
    """Flag rows whose composite key is on an exclusion list (distinct keys, left join)."""
    ex = excluded.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(ex, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def root_cause(df: DataFrame, id_col: str, root_col: str, cls: str) -> DataFrame:
    """Roll exceptions up to their root's class via the self reference.

    A row with no root is its own root; a root id not present in the table
    stays unresolved ('UNRESOLVED').
    """
    roots = df.select(F.col(id_col).alias("_rid"), F.col(cls).alias("_rcls"))
    j = df.join(roots, df[root_col] == roots["_rid"], "left")
    root_cls = F.when(F.col(root_col).isNull(), F.col(cls)).otherwise(F.coalesce("_rcls", F.lit("UNRESOLVED")))
    return j.groupBy(root_cls.alias("root_class")).agg(
        F.count(F.lit(1)).alias("exceptions"), F.count_distinct(cls).alias("distinct_classes")
    )
