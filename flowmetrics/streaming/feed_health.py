"""Structured Streaming feed health (streaming form of A34, feeding A33).

Files arriving in a landing folder are read with ``readStream``; counts are
kept per (day, group) in the state store and emitted in *update* mode: each
micro-batch carries the days that changed, and state of days older than the
watermark is dropped, so it stays bounded by the lateness allowed.  A batch
is written as a version of its own, named by its number; a rerun of a batch
overwrites its own version only, and a reader takes the latest count of each
day and group, so it never sees a table half written.

Days are days of the wall clock of ``ts`` (a timestamp without time zone):
the watermark runs on the start of that day, whatever the session's zone.

The caller passes the checkpoint folder, which on a cluster must be shared;
a restarted driver then resumes from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.core import count_if
from ..operators.health import z_score_anomalies


def read_landing(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream parquet files dropped into ``path`` (schema is required for streams)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def daily_feed_health(
    stream: DataFrame,
    ts: str = "received_ts",
    by: Sequence[str] = ("fuel",),
    status: str = "status",
    ok: str = "SUCCESS",
    lateness: str = "2 days",
) -> DataFrame:
    """Per wall-clock day x group: total, successful and failed files."""
    agg = _by_day(stream, ts, lateness).groupBy("_day", *by).agg(
        F.count(F.lit(1)).alias("total_files"),
        count_if(F.col(status) == ok).alias("successful"),
        count_if(F.col(status) != ok).alias("failed"),
    )
    return agg.select(F.to_date("_day").alias("date"), *by, "total_files", "successful", "failed")


def _by_day(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Adds ``_day``, the start of the row's day, which carries the watermark."""
    return stream.withColumn("_day", F.to_date(ts).cast("timestamp")).withWatermark("_day", lateness)


def publish(df: DataFrame, out_path: str, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``df`` in update mode, each batch a version ``batch=N`` under ``out_path``; read with ``published``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")

    w = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def published(spark: SparkSession, out_path: str, keys: Sequence[str]) -> DataFrame:
    """The latest version of each key of a published stream (one aggregation, combined before the shuffle)."""
    rows = spark.read.parquet(out_path)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_latest"))
    return latest.select(*keys, "_latest.*")


def daily_flow_counts(
    stream: DataFrame, ts: str = "received_ts", flow: str = "flow", status: str = "status", ok: str = "SUCCESS", lateness: str = "2 days"
) -> DataFrame:
    """Successful files per (day, flow): the state the volume-anomaly check (A33) needs.

    The anomaly check itself compares one day with the per-flow history, so
    it runs as a batch over the published counts
    (``anomalies_from_counts``) rather than inside the stream.
    """
    s = _by_day(stream.where(F.col(status) == ok), ts, lateness)
    agg = s.groupBy("_day", flow).agg(F.count(F.lit(1)).alias("file_count"))
    return agg.select(F.to_date("_day").alias("date"), flow, "file_count")


def anomalies_from_counts(counts: DataFrame, today, flow: str = "flow", threshold: float = 2.0) -> DataFrame:
    """A33 over published daily counts (same z-score rule as the batch operator)."""
    return z_score_anomalies(counts, flow, today, threshold)
