"""Every comparison method on every scenario, over the oracle metrics of the scenario.

Where the call graph can be held by every worker, a scenario is judged where its row is
(``plans.judge``), so that neither its series nor its pairs are ever written. Beyond that the
methods run as joins over tables of all scenarios, with the same results.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import norm_name
from tidegauge.operators import detect, graph, held, methods, select, simulate
from tidegauge.plans import judge
from tidegauge.plans.runtime import cut_lineage, load, scratch_folder


class Trials:
    """Detection, ranking and all methods for scenarios in place of incidents; nothing runs before an action."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.scenarios = load(spark, folder, "scenarios")

    @cached_property
    def series(self) -> DataFrame:
        rows = simulate.oracle_series(self.scenarios)
        return cut_lineage(rows.select(F.col("fault_id").alias("incident_id"), "service_id", "window_id", (F.col("window_id") * judge.STEP_MS).alias("t_start_ms"), F.lit(judge.STEP_MS).cast("bigint").alias("delta_ms"), "value"))

    @cached_property
    def incidents(self) -> DataFrame:
        return self.series.select("incident_id", F.lit(0.0).alias("t_start")).distinct()

    @property
    def deviations(self) -> DataFrame:
        """Against the steps before the injection."""
        before = self.series.filter(F.col("window_id") < judge.BEFORE)
        base = before.groupBy("incident_id", "service_id").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") + 1e-9).alias("std"))
        return detect.deviations(self.series, base)

    @cached_property
    def scores(self) -> DataFrame:
        return cut_lineage(detect.anomaly_scores(self.deviations))

    @cached_property
    def edges(self) -> DataFrame:
        """Call graph: the distinct edges of all causal paths."""
        return cut_lineage(graph.path_edges(self.scenarios).select("src", "dst").distinct())

    @cached_property
    def reach(self) -> DataFrame:
        return graph.closure(self.edges, [], paths=False)

    @cached_property
    def costs(self) -> DataFrame:
        n = self.edges.select(F.explode(F.array("src", "dst"))).distinct().count()
        hot = detect.over_threshold(self.scores).select("incident_id", "service_id", F.col("max_z").alias("score"))
        rows = select.initial_posterior(hot, ["incident_id"]).join(graph.blast_radius(self.reach, [], n), "service_id", "left")
        none = F.lit(None).cast("double")
        rows = rows.select("incident_id", "service_id", "p", F.lit("LATENCY").alias("kind"), F.coalesce("blast_radius", F.lit(0.0)).alias("blast_radius"), none.alias("impact"), none.alias("rollback_cost"))
        return cut_lineage(select.probe_costs(rows, ["incident_id"]))

    @cached_property
    def truth(self) -> DataFrame:
        rows = self.scenarios.filter("fault_id is not null").select(F.col("fault_id").alias("incident_id"), norm_name("root_cause_service").alias("root"), F.coalesce("confounded", F.lit(False)).alias("confounded"))
        return rows.groupBy("incident_id").agg(F.max(F.struct("root", "confounded")).alias("r")).select("incident_id", "r.*")

    @cached_property
    def results(self) -> DataFrame:
        """method, fault_id, truth, confounded, not_identifiable, top_candidates, abstained, latency_s, total_ed_s.

        Written once as Parquet, of which a query reads only its columns.
        """
        calls = held.held_graph(self.edges)
        if calls is None:
            return cut_lineage(self.joined)
        spark, folder = self.scenarios.sparkSession, scratch_folder(self.scenarios.sparkSession)
        judge.judged(self.scenarios, calls, held.all_reach_counts(spark, calls)).write.parquet(folder)
        return spark.read.parquet(folder)

    @property
    def joined(self) -> DataFrame:
        """The results by joins, for call graphs of any size."""
        key = ["incident_id"]
        reach, costs = self.reach, self.costs
        own = graph.path_edges(self.scenarios).withColumnRenamed("fault_id", "incident_id")  # each scenario's oracle graph
        ranked = cut_lineage(detect.rank_divergence(self.deviations, own))
        parts = [
            methods.observational(self.incidents, ranked, self.scores),
            methods.propagated(self.incidents, self.scores, reach),
            methods.earliest_alert(self.incidents, self.deviations),
            methods.probing("RANDOM", self.incidents, costs, costs, select.random_selection(costs, key)),
            methods.probing("ONE_SHOT", self.incidents, costs, costs, select.greedy_selection(costs, key)),
            methods.oracle(self.incidents, self.truth.select("incident_id", "root"), self.scores.select("incident_id", "service_id")),
            methods.unavailable(self.incidents),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.join(self.truth, "incident_id")
        return out.select("method", F.col("incident_id").alias("fault_id"), F.col("root").alias("truth"), "confounded", F.lit(False).alias("not_identifiable"), "top_candidates", "abstained", "latency_s", "total_ed_s")
