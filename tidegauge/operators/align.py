"""Readings aligned to the windows of their incident without inventing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import epoch_ms, finite, norm_name, usable_number
from tidegauge.plans.runtime import bounded_broadcast

SOURCE = ["incident_id", "service_id", "metric_name"]


def parse_readings(raw: DataFrame) -> DataFrame:
    """Raw rows with the value as a double; text that is no finite number is a NULL value.

    Rows without a service or a finite time are dropped: they belong to no window.
    """
    return raw.select("incident_id", norm_name("service_id").alias("service_id"), "metric_name", epoch_ms("ts").alias("ts_ms"), usable_number("value_str").alias("value"), finite("collection_lag_s").alias("lag_s"), "seq").filter("service_id is not null and ts_ms is not null")


def grid_of(incidents: DataFrame) -> DataFrame:
    """Start, width and number of windows: max(1, whole widths between start and end)."""
    g = incidents.select("incident_id", epoch_ms("t_start").alias("start_ms"), epoch_ms("t_end").alias("end_ms"), epoch_ms("delta_t_s").alias("delta_ms")).filter("delta_ms > 0")
    return g.withColumn("n_windows", F.expr("greatest(1L, (end_ms - start_ms) div delta_ms)"))


def window_grid(incidents: DataFrame) -> DataFrame:
    """One row for each window of each incident."""
    return grid_of(incidents).select("incident_id", F.explode(F.expr("sequence(0L, n_windows - 1)")).alias("window_id"), "start_ms", "delta_ms").select("incident_id", "window_id", (F.col("start_ms") + F.col("window_id") * F.col("delta_ms")).alias("t_start_ms"))


def last_in_window(readings: DataFrame, incidents: DataFrame) -> DataFrame:
    """The last valid reading of each window that has one; of equal times the later arrival counts."""
    grid = bounded_broadcast(grid_of(incidents))
    rows = readings.filter("value is not null").join(grid, "incident_id").filter("ts_ms >= start_ms and ts_ms < start_ms + n_windows * delta_ms")
    return rows.groupBy(*SOURCE, F.expr("(ts_ms - start_ms) div delta_ms").alias("window_id")).agg(F.max_by("value", F.struct("ts_ms", "seq")).alias("value"))


def align(readings: DataFrame, incidents: DataFrame) -> DataFrame:
    """Every window of every source with its last valid reading, or NULL."""
    grid = bounded_broadcast(grid_of(incidents))
    sources = readings.select(*SOURCE).distinct().join(grid, "incident_id")
    windows = sources.select(*SOURCE, "start_ms", "delta_ms", F.explode(F.expr("sequence(0L, n_windows - 1)")).alias("window_id"))
    held = last_in_window(readings, incidents)
    return windows.join(held, [*SOURCE, "window_id"], "left").select(*SOURCE, "window_id", (F.col("start_ms") + F.col("window_id") * F.col("delta_ms")).alias("t_start_ms"), "delta_ms", "value")


def bounded_fill(aligned: DataFrame, most: int = 1) -> DataFrame:
    """Gaps filled from the last value at most ``most`` windows back; leading gaps stay NULL."""
    back = Window.partitionBy(*SOURCE).orderBy("window_id").rowsBetween(-most, 0)
    return aligned.withColumn("filled", F.last("value", ignorenulls=True).over(back))


def alignment_report(filled: DataFrame) -> DataFrame:
    """Windows, windows missing after filling, and a warning for each source."""
    out = filled.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("filled").isNull()).alias("n_missing"))
    return out.select(*SOURCE, "n_windows", "n_missing", F.lit(0).cast("bigint").alias("n_imputed"), F.when(F.col("n_missing") > 0, F.format_string("%d of %d windows missing", "n_missing", "n_windows")).alias("warning"))


def last_delivery(readings: DataFrame) -> DataFrame:
    """Of readings of one source and time the last to arrive."""
    return readings.groupBy(*SOURCE, "ts_ms").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def lag_alarms(readings: DataFrame, incidents: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Readings that arrived later than ``tolerance`` widths, with the window they belong to and the next."""
    rows = readings.join(bounded_broadcast(grid_of(incidents)), "incident_id").filter(F.col("lag_s") * 1000.0 > F.col("delta_ms") * tolerance)
    window = F.expr("cast(floor((ts_ms - start_ms) / delta_ms) as bigint)")
    return rows.select(*SOURCE, "seq", window.alias("window_id"), (window + 1).alias("late_window_id"))


def within_incident(readings: DataFrame, incidents: DataFrame) -> DataFrame:
    """Readings from the start to the end of their incident, both ends included."""
    return readings.join(bounded_broadcast(grid_of(incidents).select("incident_id", "start_ms", "end_ms")), "incident_id").filter("ts_ms between start_ms and end_ms").drop("start_ms", "end_ms")


def wide(aligned: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each incident, service and window with a column for each metric."""
    return aligned.groupBy("incident_id", "service_id", "window_id").pivot("metric_name", metrics).agg(F.avg("value"))


def fill_forward_zero(wide_rows: DataFrame, metrics: list[str]) -> DataFrame:
    """The compatible imputation: last value however old, then 0. Not the default anywhere."""
    back = Window.partitionBy("incident_id", "service_id").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    return wide_rows.select("incident_id", "service_id", "window_id", *(F.coalesce(F.last(m, ignorenulls=True).over(back), F.lit(0.0)).alias(m) for m in metrics))


def complete_rows(wide_rows: DataFrame, metrics: list[str], least: int = 20) -> DataFrame:
    """Rows that have every metric, of services with at least ``least`` of them."""
    rows = wide_rows.dropna("any", subset=metrics)
    enough = Window.partitionBy("incident_id", "service_id")
    return rows.withColumn("_n", F.count(F.lit(1)).over(enough)).filter(F.col("_n") >= least).drop("_n")


def first_half_baseline(aligned: DataFrame) -> DataFrame:
    """Mean and sample deviation (plus 1e-9) of the first half of the values of each source."""
    order = Window.partitionBy(*SOURCE).orderBy("window_id")
    rows = aligned.filter("value is not null").withColumn("_rn", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*SOURCE)))
    head = rows.filter(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
    return head.groupBy(*SOURCE).agg(F.avg("value").alias("mean"), (F.stddev_samp("value") + 1e-9).alias("std"), F.count(F.lit(1)).alias("n_baseline"))


def window_index(time: Column, delta: Column) -> Column:
    """Number of the window a time falls into."""
    return F.floor(time / delta)
