"""Sinks and the sharded scan: round trips and partition pruning."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from flowmetrics.functions.nested import latest_shard, load_sharded
from flowmetrics.sources.sinks import write_extract, write_json, write_sharded
from flowmetrics.sources.standins import web_events

SF = "/root/testdata/sf0.001"


def test_sharded_write_and_pruned_range_read(spark):
    scratch = tempfile.mkdtemp(prefix="flowmetrics-shards-", dir="/tmp")
    w = web_events(spark, SF)
    write_sharded(w, f"{scratch}/events")
    got = load_sharded(spark, f"{scratch}/events", "20240105", "20240111")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan
    assert dict(got.dtypes)["event_date"] == "string"
    exp = w.where(F.col("event_date").between("20240105", "20240111")).count()
    assert got.count() == exp > 0


def test_range_from_the_latest_shard_prunes_when_it_runs(spark):
    scratch = tempfile.mkdtemp(prefix="flowmetrics-shards-", dir="/tmp")
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled", None)
    df = spark.range(400).select(F.col("id"), F.date_format(F.date_add(F.lit("2024-12-20").cast("date"), (F.col("id") % 20).cast("int")), "yyyyMMdd").alias("event_date"))
    write_sharded(df, f"{scratch}/t")
    assert spark.range(1).select(latest_shard(spark, f"{scratch}/t")).first()[0] == "20250108"
    first = F.date_format(F.date_sub(F.to_date(latest_shard(spark, f"{scratch}/t"), "yyyyMMdd"), 2), "yyyyMMdd")
    got = load_sharded(spark, f"{scratch}/t", first)
    assert sorted({r.event_date for r in got.collect()}) == ["20250106", "20250107", "20250108"] and got.count() == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "subquery" in plan.lower()
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled", None) == before
    assert load_sharded(spark, f"{scratch}/t", last="20241220").count() == 20


def test_json_export_round_trip(spark):
    scratch = tempfile.mkdtemp(prefix="flowmetrics-json-", dir="/tmp")
    df = spark.range(5).select(F.col("id").cast("string").alias("metric"), (F.col("id") * 2).alias("value"))
    write_json(df, f"{scratch}/out")
    rows = []
    for name in os.listdir(f"{scratch}/out"):
        if name.endswith(".json"):
            with open(f"{scratch}/out/{name}") as fh:
                rows += [json.loads(line) for line in fh if line.strip()]
    assert sorted(r["value"] for r in rows) == [0, 2, 4, 6, 8]


def test_partitioned_extract(spark):
    scratch = tempfile.mkdtemp(prefix="flowmetrics-extract-", dir="/tmp")
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("dim"), F.col("id"))
    write_extract(df, f"{scratch}/x", ["dim"])
    assert sorted(d for d in os.listdir(f"{scratch}/x") if d.startswith("dim=")) == ["dim=0", "dim=1", "dim=2"]
    assert spark.read.parquet(f"{scratch}/x").where("dim = '2'").count() == 33


def test_cli_lists_and_runs(spark, capsys):
    from flowmetrics.__main__ import main

    assert main(["list"]) == 0
    listed = capsys.readouterr().out.splitlines()
    assert len(listed) >= 150 and all(len(line.split()) >= 2 for line in listed)
    scratch = tempfile.mkdtemp(prefix="flowmetrics-cli-", dir="/tmp")
    assert main(["run", "feed_health", "--data", SF, "--show", "0", "--out", f"{scratch}/o"]) == 0
    assert spark.read.parquet(f"{scratch}/o").count() > 0
