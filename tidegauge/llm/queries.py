"""Queries of the problems on training data over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.mixing import Mixture
from tidegauge.llm.nearest import nearest_windows
from tidegauge.llm.overlap import cross_split_overlaps, overlap_classes, overlap_report
from tidegauge.llm.quantiles import day_lists, percentiles
from tidegauge.llm.spam import spam_documents, spam_shares
from tidegauge.llm.tokenize import encode_corpus
from tidegauge.plans.runtime import load


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the wall times of each method and stage, and over all."""
    return percentiles(day_lists(load(spark, d, "stage_log"), load(spark, d, "runtime_metrics")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training scenario and an equal or almost equal one of another split."""
    pairs = cross_split_overlaps(load(spark, d, "scenarios"))
    return pairs.select(F.least("training_id", "other_id").alias("fault_id_a"), F.greatest("training_id", "other_id").alias("fault_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation scenarios that overlap with the training split, by class, with their numbers of links."""
    return overlap_classes(load(spark, d, "scenarios"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps counted for each split and source set."""
    return overlap_report(load(spark, d, "scenarios"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Valid interventions with the nearest window of their service."""
    return nearest_windows(load(spark, d, "interventions"), load(spark, d, "aligned_streams")).select("record_id", "incident_id", "window_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(load(spark, d, "documents"), keep=["doc_id"])


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each mix with their number of copies."""
    return Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).copies


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each mix and source."""
    return Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents more than half of which is keyword stuffing, links or tags."""
    return spam_documents(load(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document in such blocks."""
    return spam_shares(load(spark, d, "documents")).select("doc_id", F.round("spam_share", 4).alias("spam_share"))


_NAME = "translate(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '_. ', '---')"
_SCENARIOS = f"""
WITH shown AS (
  SELECT DISTINCT fault_id, {_NAME.format('root_cause_service')} AS root, {_NAME.format('fault_type')} AS fault,
         {_NAME.format('split')} AS split, {_NAME.format('source_set')} AS source_set,
         list_sort(list_distinct(list_transform(causal_path, lambda e: {_NAME.format('e[1]')} || '>' || {_NAME.format('e[2]')}))) AS edges
  FROM scenarios WHERE root_cause_service IS NOT NULL AND fault_type IS NOT NULL AND split IS NOT NULL AND len(causal_path) > 0),
pairs AS (
  SELECT a.fault_id AS training_id, b.fault_id AS other_id, b.split, b.source_set, a.edges = b.edges AS exact
  FROM shown a JOIN shown b ON a.root = b.root AND a.fault = b.fault AND a.split = 'development' AND b.split <> 'development'
  WHERE len(a.edges) - len(list_intersect(a.edges, b.edges)) <= 1 AND len(b.edges) - len(list_intersect(a.edges, b.edges)) <= 1)
"""

QUERIES = {"p2_percentiles": p2_percentiles, "p3_found": p3_found, "p3_classes": p3_classes, "p3_report": p3_report, "p5_found": p5_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_shares": p9_shares}

def _ranked(where: str, keys: str) -> str:
    """Percentiles by rank ceil(n * p / 1000) over the rows that count."""
    cut = ", ".join(f"max(v) FILTER (WHERE rn = (n * {p} + 999) // 1000) AS {c}" for p, c in ((500, "p50"), (900, "p90"), (950, "p95"), (990, "p99"), (999, "p999")))
    over = f"PARTITION BY {keys} " if keys else ""
    return f"(SELECT {keys + ', ' if keys else ''}max(n) AS n, {cut} FROM (SELECT *, row_number() OVER ({over}ORDER BY v) AS rn, count(*) OVER ({over}) AS n FROM counted WHERE {where}) {'GROUP BY ' + keys if keys else ''})"


SQL = {
    "p2_percentiles": f"""
WITH counted AS (
  SELECT trim(method_id) AS method_id, {_NAME.format('stage_name')} AS stage_name, wall_time_s AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY record_no ORDER BY ingested_at DESC) AS rn FROM stage_log)
  WHERE rn = 1 AND isfinite(wall_time_s) AND wall_time_s >= 0)
SELECT 'group' AS scope, method_id, stage_name, n, p50, p90, p95, p99, p999, 0 AS rank_error
FROM {_ranked("method_id IN (SELECT method_id FROM runtime_metrics) AND stage_name IS NOT NULL", "method_id, stage_name")}
UNION ALL
SELECT 'all', NULL, NULL, n, p50, p90, p95, p99, p999, 0 FROM {_ranked("true", "")}
""",
    "p3_found": _SCENARIOS + "SELECT least(training_id, other_id) AS fault_id_a, greatest(training_id, other_id) AS fault_id_b FROM pairs",
    "p3_classes": _SCENARIOS + """
SELECT other_id AS fault_id, upper(replace(any_value(pairs.split), '-', '_')) AS split, any_value(pairs.source_set) AS source_set,
       sha256(any_value(root) || '|' || upper(replace(any_value(fault), '-', '_')) || '|' || array_to_string(any_value(edges), ',')) AS class_id,
       count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE NOT exact) AS n_near
FROM pairs JOIN shown ON fault_id = other_id GROUP BY other_id
""",
    "p3_report": _SCENARIOS + """
SELECT upper(replace(split, '-', '_')) AS split, source_set, count(DISTINCT other_id) AS n_overlapping,
       count(DISTINCT other_id) FILTER (WHERE exact) AS n_exact, count(*) AS n_pairs
FROM pairs GROUP BY split, source_set
""",
    "p5_found": f"""
WITH records AS (
  SELECT record_id, {_NAME.format('destination_service')} AS service, CAST(round(t_applied * 1000) AS BIGINT) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM interventions)
  WHERE rn = 1 AND isfinite(t_applied)),
windows AS (
  SELECT DISTINCT {_NAME.format('service_id')} AS service, incident_id, window_id, CAST(round(t_start * 1000) AS BIGINT) AS s
  FROM (SELECT service_id, incident_id, unnest(window_ids) AS window_id, unnest(t_starts) AS t_start, unnest("values") AS v
        FROM aligned_streams WHERE metric_name = 'lat_p99')
  WHERE v IS NOT NULL AND NOT isnan(v)),
near AS (
  SELECT record_id, incident_id, window_id,
         row_number() OVER (PARTITION BY record_id ORDER BY abs(t - s), s, incident_id, window_id) AS rn
  FROM records JOIN windows USING (service) WHERE abs(t - s) <= 15000)
SELECT record_id, incident_id, window_id FROM near WHERE rn = 1
""",
}
