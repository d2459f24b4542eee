"""Queries anchored at their table's own latest row give the same counts for a table a year later."""

import tempfile

import pytest
from pyspark.sql import functions as F

from flowmetrics.plans import registry

SF = "/root/testdata/sf0.001"
ANCHORED = {
    "sharded_event_counts": "total_events", "traffic_by_platform": "events", "traffic_by_device": "events", "frontend_errors_by_page": None,
    "feed_health": "total_files", "feed_ingestion_status": "files", "daily_file_counts": "file_count", "errors_by_type": "error_count",
    "error_timeline": "errors", "exception_classes": "count", "keyword_cases": None, "account_timeline": None, "recent_shards": "total_events",
}


@pytest.fixture(scope="module")
def later(spark):
    """The events a year (52 weeks) later, and one row long before all others."""
    folder = tempfile.mkdtemp(prefix="flowmetrics-later-", dir="/tmp")
    events = spark.read.parquet(f"{SF}/events.parquet")
    moved = events.withColumn("ts", F.col("ts") + F.expr("interval 364 days"))
    old = moved.limit(1).withColumn("ts", F.col("ts") - F.expr("interval 100 days"))
    moved.unionByName(old).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ANCHORED))
def test_same_counts_a_year_later(spark, later, name):
    query, count = registry.queries()[name], ANCHORED[name]
    now, then = query(spark, SF), query(spark, later)
    total = lambda df: (df.count(), df.agg(F.sum(count)).first()[0] if count else None)
    assert total(now) == total(then) and now.count() > 0


def test_anchor_reaches_the_scan(spark):
    plan = registry.queries()["traffic_by_platform"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ts" in plan and "subquery" in plan.lower() and "DataFilters: [isnotnull(ts" in plan
