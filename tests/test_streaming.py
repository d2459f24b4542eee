"""Streaming feed health equals the batch operator on the same files."""

import tempfile

import pytest
from pyspark.sql import functions as F

from flowmetrics.operators.health import feed_health
from flowmetrics.sources.standins import feed_files
from flowmetrics.streaming.feed_health import daily_feed_health, publish, published, read_landing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_stream_matches_batch(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _stream_matches_batch(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _stream_matches_batch(spark):
    scratch = tempfile.mkdtemp(prefix="flowmetrics-stream-", dir="/tmp")
    files = feed_files(spark, SF).select("received_ts", "fuel", "status", "flow")
    landing = f"{scratch}/landing"
    # Land the log as several files (one per day) like an arriving feed.
    files.withColumn("d", F.date_format("received_ts", "yyyyMMdd")).repartition("d").drop("d").write.parquet(landing)
    stream = read_landing(spark, landing, files.schema, max_files_per_trigger=3)
    q = publish(daily_feed_health(stream, lateness="60 days"), f"{scratch}/out", "feed_health_test", checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(120)
    got = {tuple(r) for r in published(spark, f"{scratch}/out", ["date", "fuel"]).collect()}
    exp = {
        (r.date, r.fuel, r.total_files, r.successful, r.failed)
        for r in feed_health(files, "received_ts", ["fuel"]).collect()
    }
    assert got == exp and len(got) > 0


def test_streamed_counts_feed_the_anomaly_check(spark):
    import datetime as dt

    from flowmetrics.operators.health import volume_anomalies
    from flowmetrics.streaming.feed_health import anomalies_from_counts, daily_flow_counts

    scratch = tempfile.mkdtemp(prefix="flowmetrics-stream-", dir="/tmp")
    sf = "/root/testdata/sf0.01"
    files = feed_files(spark, sf).select("received_ts", "fuel", "status", "flow")
    landing = f"{scratch}/landing"
    files.withColumn("d", F.date_format("received_ts", "yyyyMMdd")).repartition("d").drop("d").write.parquet(landing)
    counts = daily_flow_counts(read_landing(spark, landing, files.schema, 5), lateness="60 days")
    q = publish(counts, f"{scratch}/counts", "flow_counts_test", checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(180)
    today = dt.date(2024, 1, 30)
    got = {tuple(r) for r in anomalies_from_counts(published(spark, f"{scratch}/counts", ["date", "flow"]), today).collect()}
    exp = {tuple(r) for r in volume_anomalies(files.where(F.col("status") == "SUCCESS"), "flow", "received_ts", today).collect()}
    assert got == exp and len(got) > 0
