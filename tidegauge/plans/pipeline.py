"""The whole analysis of all incidents at once, from raw readings to ranked causes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators import align, causal, detect, diverge, graph, select
from tidegauge.operators.intervals import valid_interventions
from tidegauge.plans.runtime import cut_lineage, load


@dataclass
class Analysis:
    """Lazy stages of the pipeline over one data folder; nothing runs before an action."""

    spark: SparkSession
    folder: str
    metric: str = "lat_p99"

    def __post_init__(self) -> None:
        d = self.folder
        self.incidents = load(self.spark, d, "incidents")
        self.readings = align.parse_readings(load(self.spark, d, "raw_metrics"))
        self.scenarios = load(self.spark, d, "scenarios")

    @property
    def aligned(self) -> DataFrame:
        return align.align(self.readings, self.incidents)

    @cached_property
    def series(self) -> DataFrame:
        """Aligned windows of the pipeline's metric, written once as every later stage reads them."""
        return cut_lineage(align.align(self.readings.filter(F.col("metric_name") == self.metric), self.incidents))

    @property
    def deviations(self) -> DataFrame:
        series = self.series
        return detect.deviations(series, align.first_half_baseline(series))

    @cached_property
    def scores(self) -> DataFrame:
        return cut_lineage(detect.anomaly_scores(self.deviations))

    @cached_property
    def edges(self) -> DataFrame:
        """Call graph: the distinct edges of all causal paths."""
        return cut_lineage(graph.path_edges(self.scenarios).select("src", "dst").distinct())

    @cached_property
    def incident_edges(self) -> DataFrame:
        """Calls between services that were observed in the same incident: its own graph."""
        seen = self.series.filter("value is not null").select("incident_id", "service_id").distinct()
        calls = seen.withColumnRenamed("service_id", "src").join(self.edges, "src")
        return cut_lineage(calls.join(seen.withColumnRenamed("service_id", "dst"), ["incident_id", "dst"]).select("incident_id", "src", "dst"))

    @cached_property
    def subgraph(self) -> DataFrame:
        """At most 15 services of each incident: the anomalous ones and their parents."""
        return cut_lineage(graph.anomaly_subgraph(self.scores.select("incident_id", "service_id", F.round("max_z", 2).alias("score")), self.edges))

    @cached_property
    def pag(self) -> DataFrame:
        """Edges discovered among the services of each incident's subgraph, hidden common causes too.

        Gaps hold the value before them, and 0 where there is none, so all services share all windows.
        """
        rows = self.series.join(self.subgraph.select("incident_id", "service_id"), ["incident_id", "service_id"], "left_semi")
        held = F.last("value", ignorenulls=True).over(Window.partitionBy("incident_id", "service_id").orderBy("t_start_ms"))
        series = rows.select("incident_id", F.col("t_start_ms").alias("time"), F.col("service_id").alias("variable"), F.coalesce(held, F.lit(0.0)).alias("value"))
        return cut_lineage(causal.discover(series, ["incident_id"]))

    @cached_property
    def evidence(self) -> DataFrame:
        """Calls (incident_id, src, dst) whose callee moved by more than its threshold while the caller was probed.

        Windows during probes are few, so the comparison has no floor of sample size.
        """
        records = valid_interventions(load(self.spark, self.folder, "interventions"))
        probes = records.filter("applied_ms is not null and destination_service is not null and coalesce(status, '') not in ('PENDING', 'FAILED')")
        probes = detect.in_incident(probes.withColumnRenamed("destination_service", "service_id"), "applied_ms", self.incidents)
        samples = cut_lineage(detect.probe_samples(self.series, probes, self.edges))
        found = diverge.evaluate_divergence(samples, ["incident_id", "src", "dst"])
        return cut_lineage(found.select("incident_id", "src", "dst", "n_base", "n_post", "w1", "theta", "exceeds"))

    @cached_property
    def hidden(self) -> DataFrame:
        """Pairs with a hidden common cause in the scenarios' oracle graphs."""
        pag = causal.pag_from_paths(self.scenarios).filter("edge_type = 'BIDIRECTED'")
        return pag.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()

    @property
    def ranked(self) -> DataFrame:
        return detect.rank_divergence(self.deviations, self.incident_edges, self.evidence.filter("exceeds").select("incident_id", "src", "dst"), bidirected=self.hidden)

    @property
    def ranked_discovered(self) -> DataFrame:
        """The ranking in the graph that discovery finds for each incident, with its hidden common causes."""
        pag = self.pag
        directed = pag.filter("edge_type = 'DIRECTED'").select("incident_id", "src", "dst")
        hidden = pag.filter("edge_type = 'BIDIRECTED'").select("incident_id", F.col("src").alias("a"), F.col("dst").alias("b"))
        return detect.rank_divergence(self.deviations, directed, self.evidence.filter("exceeds").select("incident_id", "src", "dst"), bidirected=hidden)

    @property
    def updated_edges(self) -> DataFrame:
        """Confidence of the calls of each incident after the evidence of its probes."""
        calls = self.incident_edges.select(F.col("incident_id").alias("run_id"), "src", "dst", F.lit(0.5).alias("confidence"))
        shown = self.evidence.select(F.col("incident_id").alias("run_id"), F.col("src").alias("source"), F.col("dst").alias("target"), "exceeds")
        return select.update_edges(calls, shown)

    @property
    def samples(self) -> DataFrame:
        """First and second half of each series as the two sides of a comparison."""
        rows = self.series.filter("value is not null")
        part = Window.partitionBy("incident_id", "service_id")
        rows = rows.withColumn("_rn", F.row_number().over(part.orderBy("window_id"))).withColumn("_n", F.count(F.lit(1)).over(part))
        return rows.select("incident_id", "service_id", F.when(F.col("_rn") * 2 <= F.col("_n"), "base").otherwise("post").alias("side"), F.col("_rn").alias("idx"), "value")

    @property
    def divergence(self) -> DataFrame:
        """With the reference pipeline's 1,000 permutations and 200 resamples."""
        return diverge.divergence(cut_lineage(self.samples), ["incident_id", "service_id"], replicates=1000, resamples=200)

    @cached_property
    def candidates(self) -> DataFrame:
        """Anomalous services with their initial belief and blast radius."""
        reach = graph.closure(self.edges, [], paths=False)
        n = self.edges.select(F.explode(F.array("src", "dst")).alias("s")).distinct().count()
        blast = graph.blast_radius(reach, [], n)
        hot = detect.over_threshold(self.scores).select("incident_id", "service_id", F.col("max_z").alias("score"))
        rows = select.initial_posterior(hot, ["incident_id"]).join(blast, "service_id", "left")
        return rows.select("incident_id", "service_id", "p", F.lit("LATENCY").alias("kind"), F.coalesce("blast_radius", F.lit(0.0)).alias("blast_radius"), F.lit(None).cast("double").alias("impact"), F.lit(None).cast("double").alias("rollback_cost"))

    @cached_property
    def costs(self) -> DataFrame:
        return cut_lineage(select.probe_costs(self.candidates, ["incident_id"]))

    @property
    def selection(self) -> DataFrame:
        return select.greedy_selection(self.costs, ["incident_id"])
