"""Alignment of a stream of readings: last valid value of each window, late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import norm_name, usable_number

#: Columns and types of a reading as it arrives.
READING = "incident_id bigint, service_id string, metric_name string, ts double, value_str string, collection_lag_s double, seq bigint"


def stream_windows(readings: DataFrame, *, width: str = "10 seconds", lateness: str = "30 seconds") -> DataFrame:
    """Last valid value of each source and tumbling window of a stream of raw readings.

    Readings later than ``lateness`` behind the watermark are dropped. Works alike on a batch.
    """
    rows = readings.select("incident_id", norm_name("service_id").alias("service_id"), "metric_name", F.timestamp_millis(F.round(F.col("ts") * 1000).cast("bigint")).alias("at"), usable_number("value_str").alias("value"), "seq").filter("service_id is not null and at is not null and value is not null")
    if readings.isStreaming:
        rows = rows.withWatermark("at", lateness)
    out = rows.groupBy(F.window("at", width).alias("w"), "incident_id", "service_id", "metric_name").agg(F.max_by("value", F.struct("at", "seq")).alias("value"), F.count(F.lit(1)).alias("n_readings"))
    return out.select("incident_id", "service_id", "metric_name", F.col("w.start").alias("window_start"), "value", "n_readings")


def stream_alarms(windows: DataFrame, limits: DataFrame) -> DataFrame:
    """Windows whose value is over the limit of its metric. ``limits``: metric_name, limit (static)."""
    return windows.join(F.broadcast(limits), "metric_name").filter(F.col("value") > F.col("limit"))


def read_readings(spark, path: str, max_files: int = 4) -> DataFrame:
    """Stream of raw readings from a folder of Parquet files."""
    return spark.readStream.schema(READING).option("maxFilesPerTrigger", max_files).parquet(path)
