"""Queries of the general problems (intervals, grid, spikes) over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.grid import grid_streams, grid_windows
from tidegauge.operators.intervals import intervention_periods
from tidegauge.operators.spikes import implausible_readings
from tidegauge.plans.runtime import load

SIX_HOURS_MS = 6 * 3600 * 1000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of each service and interface, and the gaps of at most six hours."""
    return intervention_periods(load(spark, d, "interventions"), SIX_HOURS_MS)


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Periods, gaps of any length and covered time of each service and interface."""
    rows = intervention_periods(load(spark, d, "interventions"))
    length = F.col("end_ms") - F.col("start_ms")
    return rows.groupBy("destination_service", "interface").agg(F.count_if(F.col("kind") == "period").alias("n_periods"), F.sum(F.when(F.col("kind") == "period", length)).alias("covered_ms"), F.coalesce(F.sum(F.when(F.col("kind") == "gap", length)), F.lit(0)).alias("gap_ms"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a source that the regression marks missing: without a usable reading."""
    rows = grid_windows(load(spark, d, "raw_metrics"), load(spark, d, "incidents"))
    return rows.filter("missing").select("incident_id", "service_id", "metric_name", "window_id")


def p4_windows(spark: SparkSession, d: str) -> DataFrame:
    """Value or missing mark, readings and effective support of each window."""
    rows = grid_windows(load(spark, d, "raw_metrics"), load(spark, d, "incidents"))
    return rows.select("incident_id", "service_id", "metric_name", "window_id", "n_readings", F.round("support", 4).alias("support"), (F.round("value", 3) + 0.0).alias("value"), "missing")


def p4_streams(spark: SparkSession, d: str) -> DataFrame:
    """The grid in the form of aligned streams."""
    return grid_streams(load(spark, d, "raw_metrics"), load(spark, d, "incidents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that spike, stick or cannot be."""
    return implausible_readings(load(spark, d, "raw_metrics")).select("seq")


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    """The same readings with source, value and reason."""
    return implausible_readings(load(spark, d, "raw_metrics"))


_NAME = "translate(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '_. ', '---')"
_PERIODS = f"""
WITH valid AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM interventions)
  WHERE rn = 1 OR record_id IS NULL),
spans AS (
  SELECT {_NAME.format('destination_service')} AS destination_service,
         lower(regexp_replace(interface, '^\\s+|\\s+$', '', 'g')) AS interface,
         CAST(round(t_applied * 1000) AS BIGINT) AS s,
         CAST(round(coalesce(CASE WHEN isfinite(t_rolled_back) THEN t_rolled_back END, t_applied + lease_s) * 1000) AS BIGINT) AS e
  FROM valid
  WHERE coalesce(upper(trim(status)), '') NOT IN ('PENDING', 'FAILED')
    AND interface IS NOT NULL AND destination_service IS NOT NULL AND isfinite(t_applied)),
marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY destination_service, interface ORDER BY s, e
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
  FROM spans WHERE e > s),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY destination_service, interface ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS period
  FROM marked),
periods AS (
  SELECT destination_service, interface, period, min(s) AS s, max(e) AS e
  FROM numbered GROUP BY destination_service, interface, period),
both_kinds AS (
  SELECT destination_service, interface, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
  UNION ALL
  SELECT destination_service, interface, 'gap', e, next_s FROM (
    SELECT *, lead(s) OVER (PARTITION BY destination_service, interface ORDER BY s) AS next_s FROM periods)
  WHERE next_s IS NOT NULL)
"""
_USABLE = """
  CASE WHEN regexp_full_match(regexp_replace(value_str, '^\\s+|\\s+$', '', 'g'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
        AND isfinite(try_cast(regexp_replace(value_str, '^\\s+|\\s+$', '', 'g') AS DOUBLE))
       THEN try_cast(regexp_replace(value_str, '^\\s+|\\s+$', '', 'g') AS DOUBLE) END
"""
_GRID = f"""
WITH grid AS (
  SELECT incident_id, CAST(round(t_start * 1000) AS BIGINT) AS s, CAST(round(t_end * 1000) AS BIGINT) AS e,
         CAST(round(delta_t_s * 1000) AS BIGINT) AS w FROM incidents),
delivered AS (
  SELECT incident_id, {_NAME.format('service_id')} AS service_id, metric_name,
         CAST(round(CASE WHEN isfinite(ts) THEN ts END * 1000) AS BIGINT) AS t, {_USABLE} AS y
  FROM raw_metrics WHERE service_id IS NOT NULL),
windows AS (
  SELECT incident_id, service_id, metric_name, s, e, w, unnest(range(CAST(ceil((e - s) / w) AS BIGINT))) AS window_id
  FROM (SELECT DISTINCT incident_id, service_id, metric_name FROM delivered) JOIN grid USING (incident_id)),
readings AS (
  SELECT DISTINCT incident_id, service_id, metric_name, t, y, (t - s) / w AS u, CAST(floor((t - s) / w) AS BIGINT) AS home, t < e AS inside
  FROM delivered JOIN grid USING (incident_id) WHERE t IS NOT NULL AND y IS NOT NULL),
near AS (
  SELECT *, home + unnest([-1, 0, 1]) AS window_id FROM readings),
weighted AS (
  SELECT *, u - window_id - 0.5::DOUBLE AS x,
         CASE WHEN abs(u - window_id - 0.5::DOUBLE) < 1.5::DOUBLE THEN 1.0::DOUBLE - ((u - window_id - 0.5::DOUBLE) / 1.5::DOUBLE) * ((u - window_id - 0.5::DOUBLE) / 1.5::DOUBLE) ELSE 0.0::DOUBLE END AS k
  FROM near),
sums AS (
  SELECT incident_id, service_id, metric_name, window_id, sum(k) AS s0, sum(k * x) AS s1, sum(k * x * x) AS s2, sum(k * y) AS t0,
         sum(k * x * y) AS t1, sum(k * k) AS q0, count(*) FILTER (WHERE home = window_id AND inside) AS n_readings
  FROM weighted GROUP BY ALL)
"""

QUERIES = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p4_found": p4_found, "p4_windows": p4_windows, "p4_streams": p4_streams, "p6_found": p6_found, "p6_flags": p6_flags}

SQL = {
    "p1_found": _PERIODS + f"SELECT * FROM both_kinds WHERE kind = 'period' OR end_ms - start_ms <= {SIX_HOURS_MS}",
    "p1_coverage": _PERIODS + """
SELECT destination_service, interface, count(*) FILTER (WHERE kind = 'period') AS n_periods,
       CAST(sum(end_ms - start_ms) FILTER (WHERE kind = 'period') AS BIGINT) AS covered_ms,
       CAST(coalesce(sum(end_ms - start_ms) FILTER (WHERE kind = 'gap'), 0) AS BIGINT) AS gap_ms
FROM both_kinds GROUP BY destination_service, interface
""",
    "p4_found": _GRID + """
SELECT incident_id, service_id, metric_name, window_id FROM windows
LEFT JOIN sums USING (incident_id, service_id, metric_name, window_id) WHERE coalesce(n_readings, 0) = 0
""",
    "p4_windows": _GRID + """
SELECT incident_id, service_id, metric_name, window_id, coalesce(n_readings, 0) AS n_readings,
       round(CASE WHEN q0 > 0 THEN s0 * s0 / q0 ELSE 0 END, 4) AS support,
       round(CASE WHEN n_readings > 0 THEN CASE WHEN s0 * s2 - s1 * s1 > 1e-9::DOUBLE * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END END, 3) + 0.0::DOUBLE AS value,
       coalesce(n_readings, 0) = 0 AS missing
FROM windows LEFT JOIN sums USING (incident_id, service_id, metric_name, window_id)
""",
}
