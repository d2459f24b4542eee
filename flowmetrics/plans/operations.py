"""Catalogue: industry feed health, anomalies, app errors and timelines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import health as H
from ..operators.temporal import trend
from ..sources.standins import app_errors, cases, feed_files, server_exceptions
from .common import EVENT_DAYS, with_views

TODAY = dt.date(2024, 1, 30)


def _recent(df, column):
    return EVENT_DAYS.rows(df, column)


def feed_health(spark, sf_dir):
    """daily health per fuel."""
    return H.feed_health(_recent(feed_files(spark, sf_dir), "received_ts"), "received_ts", ["fuel"])


def feed_ingestion_status(spark, sf_dir):
    """files and MB by day x fuel x flow x status."""
    f = _recent(feed_files(spark, sf_dir), "received_ts")
    return (
        f.groupBy(F.to_date("received_ts").alias("date"), "fuel", "flow", "status")
        .agg(F.count(F.lit(1)).alias("files"), (F.sum("size_bytes") / 1024 / 1024).alias("total_mb"))
        .orderBy(F.col("date").desc(), "fuel", "flow")
    )


def failed_files(spark, sf_dir):
    """failed files with their log message, newest first."""
    f = _recent(feed_files(spark, sf_dir), "received_ts").where(F.col("status") != "SUCCESS")
    return f.select("received_ts", "fuel", "flow", "file_name", "status", "log_message").orderBy(
        F.col("received_ts").desc(), "file_name"
    )


def daily_file_counts(spark, sf_dir):
    """successful files per day and flow."""
    f = _recent(feed_files(spark, sf_dir), "received_ts").where(F.col("status") == "SUCCESS")
    return trend(f, "received_ts", "day", [F.count(F.lit(1)).alias("file_count")], by=["flow"], name="date").orderBy(
        "flow", F.col("date").desc()
    )


def missing_feeds(spark, sf_dir):
    """flows seen yesterday but not today."""
    return H.missing_keys(feed_files(spark, sf_dir), "flow", "received_ts", TODAY, lookback=1)


def volume_anomalies(spark, sf_dir):
    """flows whose volume today is more than 2 standard deviations off."""
    f = _recent(feed_files(spark, sf_dir), "received_ts").where(F.col("status") == "SUCCESS")
    return H.volume_anomalies(f, "flow", "received_ts", TODAY, 2.0)


def _errors(spark, sf_dir):
    return _recent(app_errors(spark, sf_dir), "created_at").where(F.col("is_error") == F.lit(True))


def errors_by_type(spark, sf_dir):
    """Errors and affected accounts per error type."""
    return (
        _errors(spark, sf_dir)
        .groupBy("error_type")
        .agg(F.count(F.lit(1)).alias("error_count"), F.count_distinct("account").alias("affected_accounts"))
        .orderBy(F.col("error_count").desc(), "error_type")
    )


def top_error_accounts(spark, sf_dir):
    """T4: top-50 accounts by errors (a top-k report; ties broken by account)."""
    agg = _errors(spark, sf_dir).groupBy("account").agg(
        F.count(F.lit(1)).alias("error_count"),
        F.count_distinct("error_type").alias("unique_error_types"),
        F.min("created_at").alias("first_error"),
        F.max("created_at").alias("last_error"),
    )
    return agg.orderBy(F.col("error_count").desc(), "account").limit(50)


def error_contact_lag(spark, sf_dir):
    """T5: first error -> first case, whole hours (top 100 by error count)."""
    c = _recent(cases(spark, sf_dir), "created_at")
    out = H.first_event_lag(_errors(spark, sf_dir), "account", "created_at", c, "account", "created_at")
    return out.orderBy(F.col("error_count").desc(), "account").limit(100)


def error_contact_rate(spark, sf_dir):
    """Share of accounts with each error type that raised a case."""
    c = _recent(cases(spark, sf_dir), "created_at")
    return H.followon_rate(_errors(spark, sf_dir), "account", "error_type", c, "account")


def keyword_cases(spark, sf_dir):
    """Cases whose categories mention errors / app / technical."""
    c = _recent(cases(spark, sf_dir), "created_at")
    hits = H.keyword_filter(c, [("level_1", "%error%"), ("level_1", "%app%"), ("level_2", "%technical%")])
    return hits.select(
        "case_id", "account", F.col("level_1").alias("category"), F.col("level_2").alias("subcategory"), "created_at"
    ).orderBy(F.col("created_at").desc(), "case_id")


def account_timeline(spark, sf_dir):
    """App errors and support cases per account in one timeline."""
    e = _errors(spark, sf_dir).select("account", F.col("created_at").alias("timestamp"), F.col("error_type").alias("type"), F.col("description").alias("detail"))
    c = _recent(cases(spark, sf_dir), "created_at").select(
        "account", F.col("created_at").alias("timestamp"), F.col("level_1").alias("type"), F.col("level_2").alias("detail")
    )
    return H.timeline([("App Error", e), ("Support Case", c)], "account", "timestamp", ["type", "detail"]).orderBy(
        "account", F.col("timestamp").desc()
    )


#: Default key of the account lookup; callers pass their own.
ACCOUNT = 1


def account_errors(spark, sf_dir, account_id=ACCOUNT, limit=100):
    """The newest errors of one account (a top-k report); ties by source row."""
    e = app_errors(spark, sf_dir).where(F.col("is_error") == F.lit(True)).withColumnRenamed("error_type", "event")
    found = H.timeline([("App Error", e)], "account_id", "created_at", ["event", "description", "trace_id"], "error_id", account_id, limit)
    return found.drop("source")


def error_timeline(spark, sf_dir):
    """Errors per day and error type."""
    return trend(_errors(spark, sf_dir), "created_at", "day", [F.count(F.lit(1)).alias("errors")], by=["error_type"], name="date").orderBy(
        F.col("date").desc(), F.col("errors").desc(), "error_type"
    )


def _exceptions(spark, sf_dir):
    return _recent(server_exceptions(spark, sf_dir), "created_dttm")


def exception_classes(spark, sf_dir):
    """Exceptions per class."""
    return _exceptions(spark, sf_dir).groupBy("exception_class").agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "exception_class"
    )


def exception_timeline(spark, sf_dir):
    """Exceptions per day and class."""
    return trend(
        _exceptions(spark, sf_dir), "created_dttm", "day", [F.count(F.lit(1)).alias("exceptions")], by=["exception_class"], name="date"
    ).orderBy(F.col("date").desc(), F.col("exceptions").desc(), "exception_class")


def recent_exceptions(spark, sf_dir):
    """The 100 most recent exceptions (top-k by time; ties by id)."""
    return (
        _exceptions(spark, sf_dir)
        .select("id", "created_dttm", "exception_class", "message")
        .orderBy(F.col("created_dttm").desc(), F.col("id").desc())
        .limit(100)
    )


def daily_data_volume(spark, sf_dir):
    """Feed files and MB of the 30 latest days, a top-k report."""
    f = _recent(feed_files(spark, sf_dir), "received_ts")
    return (
        f.groupBy(F.to_date("received_ts").alias("date"))
        .agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("size_bytes") / 1024 / 1024, 3).alias("total_mb"))
        .orderBy(F.col("date").desc())
        .limit(30)
    )


def latest_feed_files(spark, sf_dir):
    """T11 (O4, top-k): the 100 most recently received files (ties by file id)."""
    return feed_files(spark, sf_dir).orderBy(F.col("received_ts").desc(), F.col("file_id").desc()).limit(100)


QUERIES = {
    "latest_feed_files": latest_feed_files,
    "error_timeline": error_timeline,
    "exception_classes": exception_classes,
    "exception_timeline": exception_timeline,
    "recent_exceptions": recent_exceptions,
    "daily_data_volume": daily_data_volume,
    "feed_health": feed_health,
    "feed_ingestion_status": feed_ingestion_status,
    "failed_files": failed_files,
    "daily_file_counts": daily_file_counts,
    "missing_feeds": missing_feeds,
    "volume_anomalies": volume_anomalies,
    "errors_by_type": errors_by_type,
    "top_error_accounts": top_error_accounts,
    "error_contact_lag": error_contact_lag,
    "error_contact_rate": error_contact_rate,
    "keyword_cases": keyword_cases,
    "account_timeline": account_timeline,
    "account_errors": account_errors,
}

R = EVENT_DAYS.sql("feed_files", "received_ts")
E = "is_error = true and " + EVENT_DAYS.sql("app_errors", "created_at")
C = EVENT_DAYS.sql("cases", "created_at")

ORACLE = {
    "feed_health": with_views(
        ["feed_files"],
        f"""
select date, fuel, total_files, successful, failed,
       round(cast(failed as double) * 100.0 / total_files, 2) as failure_rate_pct
from (select cast(received_ts as date) as date, fuel, count(*) as total_files,
             count(*) filter (where status = 'SUCCESS') as successful,
             count(*) filter (where status != 'SUCCESS') as failed
      from feed_files where {R} group by 1, 2) s""",
    ),
    "feed_ingestion_status": with_views(
        ["feed_files"],
        f"""
select cast(received_ts as date) as date, fuel, flow, status, count(*) as files,
       sum(size_bytes) / 1024 / 1024 as total_mb
from feed_files where {R} group by 1, 2, 3, 4""",
    ),
    "failed_files": with_views(
        ["feed_files"],
        f"select received_ts, fuel, flow, file_name, status, log_message from feed_files where status != 'SUCCESS' and {R}",
    ),
    "daily_file_counts": with_views(
        ["feed_files"],
        f"select cast(received_ts as date) as date, flow, count(*) as file_count from feed_files where {R} and status = 'SUCCESS' group by 1, 2",
    ),
    "missing_feeds": with_views(
        ["feed_files"],
        """
select y.flow as missing_flow
from (select distinct flow from feed_files where cast(received_ts as date) = date '2024-01-29') y
left join (select distinct flow from feed_files where cast(received_ts as date) = date '2024-01-30') t
  on y.flow = t.flow
where t.flow is null""",
    ),
    "volume_anomalies": with_views(
        ["feed_files"],
        f"""
select t.flow, t.file_count as today_count, round(s.avg_count, 1) as avg_count,
       round((t.file_count - s.avg_count) / nullif(s.stddev_count, 0), 2) as z_score
from (select flow, file_count from dv where date = date '2024-01-30') t
join (select flow, avg(file_count) as avg_count, stddev_samp(file_count) as stddev_count from dv group by flow) s
  on t.flow = s.flow
where abs((t.file_count - s.avg_count) / nullif(s.stddev_count, 0)) > 2""",
        f"dv as (select flow, cast(received_ts as date) as date, count(*) as file_count from feed_files where {R} and status = 'SUCCESS' group by 1, 2)",
    ),
    "errors_by_type": with_views(
        ["app_errors"],
        f"select error_type, count(*) as error_count, count(distinct account) as affected_accounts from app_errors where {E} group by 1",
    ),
    "top_error_accounts": with_views(
        ["app_errors"],
        f"""
select account, count(*) as error_count, count(distinct error_type) as unique_error_types,
       min(created_at) as first_error, max(created_at) as last_error
from app_errors where {E} group by account order by error_count desc, account limit 50""",
    ),
    "error_contact_lag": with_views(
        ["app_errors", "cases"],
        f"""
select e.account, e.error_count, e.first_error_time, c.first_contact_time,
       date_sub('hour', e.first_error_time, c.first_contact_time) as hours_to_contact
from (select account, min(created_at) as first_error_time, count(*) as error_count from app_errors where {E} group by 1) e
join (select account, min(created_at) as first_contact_time from cases where {C} group by 1) c on e.account = c.account
where c.first_contact_time > e.first_error_time
order by e.error_count desc, e.account limit 100""",
    ),
    "error_contact_rate": with_views(
        ["app_errors", "cases"],
        f"""
select e.error_type, count(distinct e.account) as accounts_with_error,
       count(distinct case when c.account is not null then e.account end) as accounts_that_contacted,
       round(cast(count(distinct case when c.account is not null then e.account end) as double) * 100.0
             / count(distinct e.account), 2) as contact_rate_pct
from (select distinct account, error_type from app_errors where {E}) e
left join (select distinct account from cases where {C}) c on e.account = c.account
group by e.error_type""",
    ),
    "keyword_cases": with_views(
        ["cases"],
        f"""
select case_id, account, level_1 as category, level_2 as subcategory, created_at from cases
where (lower(level_1) like '%error%' or lower(level_1) like '%app%' or lower(level_2) like '%technical%') and {C}""",
    ),
    "account_errors": with_views(
        ["app_errors"],
        f"""
select account_id, created_at, error_type as event, description, trace_id
from app_errors where is_error and account_id = {ACCOUNT} order by created_at desc, error_id limit 100""",
    ),
    "account_timeline": with_views(
        ["app_errors", "cases"],
        f"""
select 'App Error' as source, account, created_at as timestamp, error_type as type, description as detail
from app_errors where {E}
union all
select 'Support Case', account, created_at, level_1, level_2 from cases where {C}""",
    ),
}

X = EVENT_DAYS.sql("server_exceptions", "created_dttm")
ORACLE["error_timeline"] = with_views(
    ["app_errors"], f"select cast(created_at as date) as date, error_type, count(*) as errors from app_errors where {E} group by 1, 2"
)
ORACLE["exception_classes"] = with_views(
    ["server_exceptions"], f"select exception_class, count(*) as count from server_exceptions where {X} group by 1"
)
ORACLE["exception_timeline"] = with_views(
    ["server_exceptions"],
    f"select cast(created_dttm as date) as date, exception_class, count(*) as exceptions from server_exceptions where {X} group by 1, 2",
)
ORACLE["recent_exceptions"] = with_views(
    ["server_exceptions"],
    f"""select id, created_dttm, exception_class, message from server_exceptions where {X}
order by created_dttm desc, id desc limit 100""",
)
ORACLE["daily_data_volume"] = with_views(
    ["feed_files"],
    f"""select cast(received_ts as date) as date, count(*) as files, round(sum(size_bytes) / 1024 / 1024, 3) as total_mb
from feed_files where {R} group by 1 order by date desc limit 30""",
)

ORACLE["latest_feed_files"] = with_views(
    ["feed_files"], "select * from feed_files order by received_ts desc, file_id desc limit 100"
)
