"""Catalogue: web analytics events (nested parameters, structs) and availability JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nested import availability_features, event_param, latest_shard, load_sharded, session_key
from ..operators.temporal import current_state
from ..sources.sinks import shared_path, write_sharded
from ..sources.standins import web_events, waiting_list
from .common import EVENT_DAYS, with_views


def _shards(spark, sf_dir):
    return EVENT_DAYS.rows(web_events(spark, sf_dir), "event_ts")


def sharded_event_counts(spark, sf_dir):
    """Events and unique users per day shard."""
    return (
        _shards(spark, sf_dir)
        .groupBy("event_date")
        .agg(F.count(F.lit(1)).alias("total_events"), F.count_distinct("user_pseudo_id").alias("unique_users"))
        .orderBy(F.col("event_date").desc())
    )


def recent_shards(spark, sf_dir, days=7):
    """E11 over date shards (A41, S2): the last ``days`` days of the sharded table, all other folders pruned.

    The given table is first laid out in one folder per day; the range is
    counted from its latest shard, by a scalar subquery.
    """
    path = shared_path(spark, "web-events")
    write_sharded(web_events(spark, sf_dir), path)
    first = F.date_format(F.date_sub(F.to_date(latest_shard(spark, path), "yyyyMMdd"), days - 1), "yyyyMMdd")
    return (
        load_sharded(spark, path, first)
        .groupBy("event_date")
        .agg(F.count(F.lit(1)).alias("total_events"), F.count_distinct("user_pseudo_id").alias("unique_users"))
        .orderBy(F.col("event_date").desc())
    )


def top_event_types(spark, sf_dir):
    """Top-30 event names."""
    return (
        _shards(spark, sf_dir)
        .groupBy("event_name")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy(F.col("event_count").desc(), "event_name")
        .limit(30)
    )


def traffic_by_platform(spark, sf_dir):
    """Events and users per platform."""
    return (
        _shards(spark, sf_dir)
        .groupBy("platform")
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_pseudo_id").alias("unique_users"))
        .orderBy(F.col("events").desc())
    )


def traffic_by_device(spark, sf_dir):
    """Struct fields as grouping keys."""
    return (
        _shards(spark, sf_dir)
        .groupBy(F.col("device.category").alias("device_category"), F.col("device.operating_system").alias("operating_system"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_pseudo_id").alias("unique_users"))
        .orderBy(F.col("events").desc(), "device_category", "operating_system")
    )


def top_traffic_sources(spark, sf_dir):
    """Top-20 source x medium by unique users."""
    return (
        _shards(spark, sf_dir)
        .groupBy(F.col("traffic_source.source").alias("source"), F.col("traffic_source.medium").alias("medium"))
        .agg(F.count_distinct("user_pseudo_id").alias("unique_users"), F.count(F.lit(1)).alias("events"))
        .orderBy(F.col("unique_users").desc(), "source", "medium")
        .limit(20)
    )


def top_pages(spark, sf_dir):
    """Top-30 pages by page views (parameter extracted from the nested array)."""
    return (
        _shards(spark, sf_dir)
        .where(F.col("event_name") == "page_view")
        .groupBy(event_param("page_location").alias("page_url"))
        .agg(F.count(F.lit(1)).alias("page_views"))
        .orderBy(F.col("page_views").desc(), "page_url")
        .limit(30)
    )


def sessions_by_browser(spark, sf_dir):
    """Distinct sessions (user + session id) per browser."""
    return (
        _shards(spark, sf_dir)
        .groupBy(F.col("device.browser").alias("browser"))
        .agg(F.count_distinct(session_key()).alias("sessions"))
        .orderBy(F.col("sessions").desc())
    )


def top_geo(spark, sf_dir):
    """Top-20 country x city by unique users."""
    return (
        _shards(spark, sf_dir)
        .groupBy(F.col("geo.country").alias("country"), F.col("geo.city").alias("city"))
        .agg(F.count_distinct("user_pseudo_id").alias("unique_users"))
        .orderBy(F.col("unique_users").desc(), "country", "city")
        .limit(20)
    )


def event_param_extraction(spark, sf_dir):
    """Page views with parameters pulled out of the nested array."""
    return (
        _shards(spark, sf_dir)
        .where(F.col("event_name") == "page_view")
        .select(
            "event_timestamp",
            "event_name",
            event_param("page_location").alias("page_url"),
            event_param("k", "int_value").alias("k_value"),
            event_param("missing_key").alias("page_title"),
        )
    )


def frontend_errors_by_page(spark, sf_dir):
    """Front-end error events and users per page."""
    return (
        _shards(spark, sf_dir)
        .where(F.col("event_name") == "app_error")
        .groupBy(event_param("page_location").alias("page_url"))
        .agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("user_pseudo_id").alias("users"))
        .orderBy(F.col("errors").desc(), "page_url")
    )


def availability_profile(spark, sf_dir):
    """X6 (A42): waiting-list accounts by preference, flexibility and AM/PM."""
    wl = availability_features(current_state(waiting_list(spark, sf_dir)))
    return (
        wl.groupBy("has_preferences", "flexibility_level", "time_preference")
        .agg(F.count(F.lit(1)).alias("accounts"), F.sum("available_slots_count").cast("long").alias("slots"))
        .orderBy(F.col("accounts").desc(), "flexibility_level", "time_preference")
    )


QUERIES = {
    "sharded_event_counts": sharded_event_counts,
    "recent_shards": recent_shards,
    "top_event_types": top_event_types,
    "traffic_by_platform": traffic_by_platform,
    "traffic_by_device": traffic_by_device,
    "top_traffic_sources": top_traffic_sources,
    "top_pages": top_pages,
    "sessions_by_browser": sessions_by_browser,
    "top_geo": top_geo,
    "event_param_extraction": event_param_extraction,
    "frontend_errors_by_page": frontend_errors_by_page,
    "availability_profile": availability_profile,
}

S = EVENT_DAYS.sql("web_events", "event_ts")


def _slot(day, part):
    return f"json_extract_string(customer_availability, '$.{day}.{part}') = 'true'"


_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")
_COUNT = " + ".join(f"case when {_slot(d, p)} then 1 else 0 end" for d in _DAYS for p in ("am", "pm"))
_AM = " or ".join(_slot(d, "am") for d in _DAYS)
_PM = " or ".join(_slot(d, "pm") for d in _DAYS)

ORACLE = {
    "recent_shards": with_views(
        ["web_events"],
        """select event_date, count(*) as total_events, count(distinct user_pseudo_id) as unique_users from web_events
where event_date >= strftime(strptime((select max(event_date) from web_events), '%Y%m%d') - interval 6 day, '%Y%m%d') group by 1""",
    ),
    "sharded_event_counts": with_views(
        ["web_events"],
        f"select event_date, count(*) as total_events, count(distinct user_pseudo_id) as unique_users from web_events where {S} group by 1",
    ),
    "top_event_types": with_views(
        ["web_events"],
        f"select event_name, count(*) as event_count from web_events where {S} group by 1 order by event_count desc, event_name limit 30",
    ),
    "traffic_by_platform": with_views(
        ["web_events"],
        f"select platform, count(*) as events, count(distinct user_pseudo_id) as unique_users from web_events where {S} group by 1",
    ),
    "traffic_by_device": with_views(
        ["web_events"],
        f"""select device_category, operating_system, count(*) as events, count(distinct user_pseudo_id) as unique_users
from web_events where {S} group by 1, 2""",
    ),
    "top_traffic_sources": with_views(
        ["web_events"],
        f"""select source, medium, count(distinct user_pseudo_id) as unique_users, count(*) as events
from web_events where {S} group by 1, 2 order by unique_users desc, source, medium limit 20""",
    ),
    "top_pages": with_views(
        ["web_events"],
        f"""select page_location as page_url, count(*) as page_views from web_events
where {S} and event_name = 'page_view' group by 1 order by page_views desc, page_url limit 30""",
    ),
    "sessions_by_browser": with_views(
        ["web_events"],
        f"""select browser, count(distinct user_pseudo_id || cast(ga_session_id as varchar)) as sessions
from web_events where {S} group by 1""",
    ),
    "top_geo": with_views(
        ["web_events"],
        f"""select country, city, count(distinct user_pseudo_id) as unique_users from web_events where {S}
group by 1, 2 order by unique_users desc, country, city limit 20""",
    ),
    "event_param_extraction": with_views(
        ["web_events"],
        f"""select event_timestamp, event_name, page_location as page_url, k_value, cast(null as varchar) as page_title
from web_events where {S} and event_name = 'page_view'""",
    ),
    "frontend_errors_by_page": with_views(
        ["web_events"],
        f"""select page_location as page_url, count(*) as errors, count(distinct user_pseudo_id) as users
from web_events where {S} and event_name = 'app_error' group by 1""",
    ),
    "availability_profile": with_views(
        ["waiting_list"],
        f"""
select has_preferences, flexibility_level, time_preference, count(*) as accounts, cast(sum(n) as bigint) as slots
from (
  select case when customer_availability is not null and customer_availability != '{{}}'
              and customer_availability != 'null' then 'Yes' else 'No' end as has_preferences,
         ({_COUNT}) as n,
         case when ({_COUNT}) >= 8 then 'Fully Flexible (8-10 slots)'
              when ({_COUNT}) >= 5 then 'Mostly Flexible (5-7 slots)'
              when ({_COUNT}) >= 2 then 'Limited (2-4 slots)'
              when ({_COUNT}) >= 1 then 'Very Limited (1 slot)'
              else 'No Preferences Set' end as flexibility_level,
         case when ({_AM}) and ({_PM}) then 'AM & PM' when ({_AM}) then 'AM Only' when ({_PM}) then 'PM Only'
              else 'Not Set' end as time_preference
  from waiting_list where effective_to = timestamp '9999-01-01'
) x group by 1, 2, 3""",
    ),
}
