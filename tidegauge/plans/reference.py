"""Queries of the operators for telemetry, detection, graphs, divergence, selection and evaluation.

Every query runs over whole tables. The SQL is written independently of the DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import norm_label, norm_name
from tidegauge.operators import align, causal, detect, diverge, evaluate, graph, guard, held, methods, select, simulate
from tidegauge.plans.pipeline import Analysis
from tidegauge.plans.reference_sql import SQL
from tidegauge.plans.runtime import cut_lineage, load
from tidegauge.plans.trials import Trials
from tidegauge.sources import telemetry

__all__ = ["QUERIES", "SQL"]

KEY = ["incident_id", "service_id"]


def _r(*cols: str, dp: int = 6) -> list:
    return [F.round(c, dp).alias(c) for c in cols]


def _with_rounded(df: DataFrame, *cols: str, dp: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, dp) for c in cols})


# Telemetry and alignment


def s3_s4_responses(spark: SparkSession, d: str) -> DataFrame:
    """Range responses built from the readings, parsed back and averaged over equal times."""
    raw = load(spark, d, "raw_metrics").filter("service_id is not null and ts is not null and not isnan(ts)")
    pairs = raw.groupBy("incident_id", "service_id", "metric_name").agg(F.collect_list(F.array(F.col("ts").cast("string"), F.col("value_str"))).alias("values"))
    body = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), F.array(F.struct(F.create_map(F.lit("job"), F.col("service_id")).alias("metric"), F.col("values"))).alias("result")).alias("data")))
    series = telemetry.series_of(pairs.select("incident_id", "service_id", "metric_name", body.alias("body")), ["incident_id", "service_id", "metric_name"])
    return series.groupBy("incident_id", "service_id", "metric_name").agg(F.count(F.lit(1)).alias("n_times"), F.round(F.sum(F.when(F.abs("value") < 1e6, F.col("value"))), 6).alias("sum_value"))


def s2_counter_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rate of the running count of interventions of each service."""
    rows = guard.valid_latest(load(spark, d, "interventions")).filter("applied_ms is not null and destination_service is not null")
    order = Window.partitionBy("destination_service").orderBy("applied_ms", "record_id")
    counter = rows.select(F.col("destination_service").alias("service_id"), (F.col("applied_ms") / 1000).alias("time"), F.row_number().over(order).cast("double").alias("value")).groupBy("service_id", "time").agg(F.max("value").alias("value"))
    return _with_rounded(telemetry.counter_rate(counter, ["service_id"]), "rate")


def s2_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    """99th percentile of the lag of each metric from cumulative buckets."""
    raw = load(spark, d, "raw_metrics").filter("collection_lag_s is not null")
    bounds = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, float("inf")]
    counts = raw.groupBy("metric_name").agg(*(F.count_if(F.col("collection_lag_s") <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    buckets = counts.select("metric_name", F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))).alias("s")).select("metric_name", "s.*")
    return _with_rounded(telemetry.histogram_quantile(buckets, ["metric_name"], 0.99), "quantile")


def s5_parse(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each metric whose text is a finite number, and their mean."""
    r = align.parse_readings(load(spark, d, "raw_metrics"))
    return r.groupBy("metric_name").agg(F.count("value").alias("n_valid"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.round(F.max("value"), 3).alias("max_value"))


def s8_split(spark: SparkSession, d: str) -> DataFrame:
    """Split by position of the scenarios in order of their id."""
    ids = load(spark, d, "scenarios").select("fault_id").filter("fault_id is not null").distinct()
    # Positions over all scenarios: a range sort and a prefix of partition counts, no single task.
    return _positions(ids, "fault_id").select("fault_id", telemetry.split_of(F.col("_at"), F.col("_n")).alias("split"))


def _positions(df: DataFrame, by: str) -> DataFrame:
    """Global positions from 0 without a global window: sorted partitions plus their offsets."""
    parts = df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    # Ranges are sampled, so rows and offsets must read the same ones.
    parts = cut_lineage(parts).withColumn("_in", F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(F.lit(1))))
    return parts.join(F.broadcast(offsets.select("_p", "_off", "_n")), "_p").withColumn("_at", F.col("_off") + F.col("_in")).drop("_p", "_m", "_in", "_off")


def s12_oracle_pag(spark: SparkSession, d: str) -> DataFrame:
    return causal.pag_from_paths(load(spark, d, "scenarios")).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fault_id").alias("n_scenarios"))


def s16_manifest(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.manifest(load(spark, d, "services"), "service_id")


def s18_guard(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.access_audit(load(spark, d, "scenarios"))


def s19_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Configurations that name a secret: those of services without a number of replicas, or with many, do."""
    word = F.when(F.col("replicas").isNull(), "api_key").when(F.col("replicas") > 4, "Token").when(F.col("replicas") == 1, "private_KEY password")
    config = F.to_json(F.struct("service_id", "replicas", word.alias("uses")))
    return telemetry.secret_scan(load(spark, d, "services").select("service_id", config.alias("config")), "service_id", "config")


def s21_phrases(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.phrase_scan(load(spark, d, "documents"), "doc_id", "text", r"(?i)held|proven|guarantee")


def s22_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "interventions").filter("record_id is not null").select("record_id", "ingested_at", "status", "rollback_attempts")
    return telemetry.last_wins(rows, ["record_id"], "ingested_at").select("record_id", norm_label("status").alias("status"), "rollback_attempts")


def t1_grid(spark: SparkSession, d: str) -> DataFrame:
    return align.window_grid(load(spark, d, "incidents"))


def t2_last_in_window(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(align.last_in_window(align.parse_readings(load(spark, d, "raw_metrics")), load(spark, d, "incidents")), "value")


def t3_bounded_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = align.bounded_fill(Analysis(spark, d).aligned)
    return rows.select("incident_id", "service_id", "metric_name", "window_id", *_r("value", "filled"))


def t4_report(spark: SparkSession, d: str) -> DataFrame:
    return align.alignment_report(align.bounded_fill(Analysis(spark, d).aligned))


def t5_last_delivery(spark: SparkSession, d: str) -> DataFrame:
    rows = align.last_delivery(align.parse_readings(load(spark, d, "raw_metrics")).filter("value is not null"))
    return rows.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("sum_seq"))


def t8_lag_alarms(spark: SparkSession, d: str) -> DataFrame:
    return align.lag_alarms(align.parse_readings(load(spark, d, "raw_metrics")), load(spark, d, "incidents"))


def t9_within(spark: SparkSession, d: str) -> DataFrame:
    rows = align.within_incident(align.parse_readings(load(spark, d, "raw_metrics")), load(spark, d, "incidents"))
    return rows.groupBy("incident_id", "metric_name").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def t10_wide(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(align.wide(Analysis(spark, d).aligned, guard.METRICS), *guard.METRICS)


def t11_fill_zero(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(align.fill_forward_zero(align.wide(Analysis(spark, d).aligned, guard.METRICS), guard.METRICS), *guard.METRICS)


def t12_complete(spark: SparkSession, d: str) -> DataFrame:
    rows = align.complete_rows(align.wide(Analysis(spark, d).aligned, guard.METRICS), ["lat_p99", "rps"])
    return rows.groupBy("incident_id", "service_id").agg(F.count(F.lit(1)).alias("n_rows"))


def t13_baseline(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(align.first_half_baseline(Analysis(spark, d).aligned), "mean", "std", dp=5)


# Detection


def a1_scores(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(Analysis(spark, d).scores, "max_z", "mean_z", dp=2)


def a3_anomalous(spark: SparkSession, d: str) -> DataFrame:
    return detect.over_threshold(Analysis(spark, d).scores).select(*KEY, "n")


def a4_persistence(spark: SparkSession, d: str) -> DataFrame:
    return detect.persistent_divergence(Analysis(spark, d).deviations).select(*KEY, "t_star_ms", "run_length")


def a5_precedence(spark: SparkSession, d: str) -> DataFrame:
    return detect.precedence(detect.persistent_divergence(Analysis(spark, d).deviations), 10_000).select(*KEY, "t_star_ms", "r2", "n_ties")


def a12_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Earliest-divergence ranking of every incident: the flagship."""
    return Analysis(spark, d).ranked.select(*KEY, "t_star_ms", "run_length", "n_ties", "r2", "r3", "r4", "confidence", "boundary_limited", "identifiability", "rank", "path")


def a8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose callee is compared before and during probes of the caller."""
    return _with_rounded(Analysis(spark, d).evidence, "w1", "theta", dp=6)


def a13_latency(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(detect.detection_latency(detect.persistent_divergence(Analysis(spark, d).deviations), load(spark, d, "incidents")), "latency_s", dp=3)


# Graphs


def g1_time_sliced(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    sliced = graph.time_sliced(a.series.filter("value is not null").select("incident_id", "service_id", "window_id"), a.edges)
    return sliced.groupBy("incident_id", "edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("dst_window") <= F.col("src_window")).alias("n_backward"))


def g2_collapse(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    return graph.collapse(graph.time_sliced(a.series.filter("value is not null").select("incident_id", "service_id", "window_id"), a.edges))


def g3_closure(spark: SparkSession, d: str) -> DataFrame:
    """Reachable pairs and shortest paths of the call graph, by joins if no worker can hold it."""
    edges = Analysis(spark, d).edges
    calls = held.held_graph(edges)
    if calls is not None:
        return held.all_paths(spark, calls)
    return graph.closure(edges, []).select("src", "dst", "depth", F.array_join("path", ">").alias("path"))


def g4_scenario_paths(spark: SparkSession, d: str) -> DataFrame:
    """Reachable pairs inside each scenario's own path."""
    reach = graph.closure(graph.path_edges(load(spark, d, "scenarios")), ["fault_id"], paths=False)
    return reach.groupBy("fault_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("depth").alias("max_depth"))


def g6_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.topological_depth(graph.path_edges(load(spark, d, "scenarios")), ["fault_id"])


def g8_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return graph.skeleton(Analysis(spark, d).edges, [])


def g10_subgraph(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    scores = a.scores.select(*KEY, F.round("max_z", 2).alias("score"))
    return graph.anomaly_subgraph(scores, a.edges, a.hidden)


def g12_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_degrees(Analysis(spark, d).edges, [])


def g14_blast(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    return _with_rounded(graph.blast_radius(graph.closure(a.edges, [], paths=False), [], load(spark, d, "services").count()), "blast_radius")


# Divergence


def d1_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(diverge.wasserstein(Analysis(spark, d).samples, KEY), "w1", dp=4)


def d3_variation(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(diverge.total_variation(Analysis(spark, d).samples, KEY), "tv", dp=4)


def d4_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(diverge.iqr_threshold(Analysis(spark, d).samples, KEY), "theta", dp=8)


def d8_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of each series compared: distances, grade and threshold."""
    rows = diverge.divergence(cut_lineage(Analysis(spark, d).samples), KEY)
    return _with_rounded(rows, "theta", "w1", "tv", dp=8).select(*KEY, "n_base", "n_post", "grade", "theta", "w1", "tv", "exceeds", "note")


def d8_inference(spark: SparkSession, d: str) -> DataFrame:
    """The same with p-values of 1,000 permutations and intervals of 200 resamples."""
    rows = _with_rounded(Analysis(spark, d).divergence, "theta", "w1", "tv", "p_value", "w1_low", "w1_high", dp=8)
    return rows.select(*KEY, "n_base", "n_post", "grade", "theta", "w1", "tv", "p_value", "w1_low", "w1_high", "exceeds", "significant", "note")


def d6_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Permutation p-values of the mean window values of each metric: even against odd incidents."""
    return _with_rounded(diverge.permutation_test(_method_samples(spark, d), ["method_id"], 10_000), "p_value")


def d6_wall_times(spark: SparkSession, d: str) -> DataFrame:
    """Permutation p-values of wall times of each method: first against second half of the days."""
    return _with_rounded(diverge.permutation_test(_wall_times(spark, d), ["method_id"], 10_000), "p_value")


def _wall_times(spark: SparkSession, d: str) -> DataFrame:
    """Usable wall times, once for each record_no, by half of the days recorded."""
    log = load(spark, d, "stage_log").groupBy("record_no").agg(F.max(F.struct("ingested_at", "method_id", "wall_time_s", "recorded_at")).alias("r")).select("r.*")
    log = log.filter("method_id is not null and recorded_at is not null and wall_time_s >= 0 and wall_time_s < double('inf')").select("method_id", F.to_date("recorded_at").alias("_day"), F.col("wall_time_s").alias("value"))
    # One row a day.
    days = log.select("_day").distinct().select("_day", F.ntile(2).over(Window.orderBy("_day")).alias("_half"))
    return log.join(F.broadcast(days), "_day").select("method_id", F.when(F.col("_half") == 1, "base").otherwise("post").alias("side"), "value")


def d7_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(diverge.bootstrap_interval(_method_samples(spark, d), ["method_id"], 1000), "w1_low", "w1_high", dp=4)


def _method_samples(spark: SparkSession, d: str) -> DataFrame:
    """Mean window value of each service by metric, odd against even incidents."""
    rows = align.align(align.parse_readings(load(spark, d, "raw_metrics")), load(spark, d, "incidents")).filter("value is not null")
    means = rows.groupBy("metric_name", "incident_id", "service_id").agg(F.round(F.avg("value"), 3).alias("value"))
    return means.select(F.col("metric_name").alias("method_id"), F.when(F.col("incident_id") % 2 == 0, "base").otherwise("post").alias("side"), F.concat_ws("/", "incident_id", "service_id").alias("idx"), "value")


# Selection


def l1_entropy(spark: SparkSession, d: str) -> DataFrame:
    hot = detect.over_threshold(Analysis(spark, d).scores).select(*KEY, F.round("max_z", 2).alias("score"))
    return _with_rounded(select.entropy(select.initial_posterior(hot, ["incident_id"]), ["incident_id"]), "entropy", dp=5)


def l2_posterior(spark: SparkSession, d: str) -> DataFrame:
    hot = detect.over_threshold(Analysis(spark, d).scores).select(*KEY, F.round("max_z", 2).alias("score"))
    return select.initial_posterior(hot, ["incident_id"]).select(*KEY, *_r("p", dp=5))


def l3_costs(spark: SparkSession, d: str) -> DataFrame:
    return Analysis(spark, d).costs.select(*KEY, *_r("eig", "cost", "utility", dp=3), "authorization")


def l6_selection(spark: SparkSession, d: str) -> DataFrame:
    """Probes chosen in each incident by utility, with the reason to stop."""
    return _with_rounded(Analysis(spark, d).selection, "entropy_after", dp=5)


def l7_random_selection(spark: SparkSession, d: str) -> DataFrame:
    """Probes chosen in the order of a digest."""
    return _with_rounded(select.random_selection(Analysis(spark, d).costs, ["incident_id"]), "entropy_after", dp=5)


def l8_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Whether each incident's probes are of different services."""
    return select.distinct_services(Analysis(spark, d).selection, ["incident_id"])


def l9_expected_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy expected after probing each candidate."""
    return _with_rounded(select.expected_entropy_after(Analysis(spark, d).costs, ["incident_id"]), "entropy_after", dp=5)


def l11_posterior_update(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs of each incident after the divergence of its services as evidence."""
    a = Analysis(spark, d)
    hot = detect.over_threshold(a.scores).select(*KEY, F.round("max_z", 2).alias("score"))
    prior = select.initial_posterior(hot, ["incident_id"]).select(*KEY, "p")
    evidence = diverge.total_variation(a.samples, KEY).select("incident_id", F.col("service_id").alias("target"), F.col("tv").alias("c"))
    return _with_rounded(select.update_posterior(prior, evidence, ["incident_id"]), "p", dp=5)


def l10_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edge confidences of each scenario after evidence on one of its edges."""
    edges = graph.path_edges(load(spark, d, "scenarios")).select(F.col("fault_id").alias("run_id"), "src", "dst").withColumn("confidence", F.lit(None).cast("double"))
    first = edges.groupBy("run_id").agg(F.min(F.struct("src", "dst")).alias("e")).select("run_id", F.col("e.src").alias("source"), F.col("e.dst").alias("target"), (F.length("e.src") % 2 == 0).alias("exceeds"))
    return _with_rounded(select.update_edges(edges, first), "confidence")


# Records


def i1_precision(spark: SparkSession, d: str) -> DataFrame:
    rows = guard.precision_check(guard.valid_latest(load(spark, d, "interventions")))
    return rows.select("record_id", *_r("relative_error"), "verdict")


def i4_clean_windows(spark: SparkSession, d: str) -> DataFrame:
    return guard.clean_windows(guard.valid_latest(load(spark, d, "interventions"))).select("record_id", "n_concurrent", "clean")


def i7_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return guard.dispatch(load(spark, d, "scenarios").dropDuplicates(["fault_id"])).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def i11_cascade(spark: SparkSession, d: str) -> DataFrame:
    """First time the error rate of a service has been high for over thirty seconds."""
    a = Analysis(spark, d, metric="err_rate")
    return guard.error_cascade(a.series, KEY, threshold=0.1)


def v1_violations(spark: SparkSession, d: str) -> DataFrame:
    """Readings that break a row rule, by rule."""
    bad = guard.violations(load(spark, d, "raw_metrics"), guard.reading_rules())
    return bad.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# Causal


def c1_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Causal edges among the metrics of each service and incident."""
    a = Analysis(spark, d)
    series = a.aligned.select(*KEY, F.col("t_start_ms").alias("time"), F.col("metric_name").alias("variable"), "value")
    return causal.discover(series, KEY)


def c1_services(spark: SparkSession, d: str) -> DataFrame:
    """Causal edges and hidden common causes among the services of each incident's anomaly subgraph."""
    return Analysis(spark, d).pag


def c2_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of each pair of metrics over all services."""
    a = Analysis(spark, d)
    series = a.aligned.select(*KEY, F.col("t_start_ms").alias("time"), F.col("metric_name").alias("variable"), "value")
    pairs = causal.moments(series, KEY).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    return causal.correlations(pairs).select("a", "b", "n", (F.round("r", 3) + 0.0).alias("r"))


def c9_identify(spark: SparkSession, d: str) -> DataFrame:
    """Identifiability of every ordered pair of nodes of every scenario's oracle graph."""
    pag = causal.pag_from_paths(load(spark, d, "scenarios"))
    nodes = pag.select("fault_id", F.explode(F.array("src", "dst")).alias("src")).distinct()
    # A scenario's own few nodes.
    pairs = nodes.join(nodes.withColumnRenamed("src", "dst"), "fault_id").filter("src <> dst")
    return causal.identify(pag, pairs, ["fault_id"])


# Evaluation


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Every comparison method on every scenario."""
    return Trials(spark, d).results


def e1_attribution(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.attribution_metrics(_results(spark, d))
    return _with_rounded(out, *[c for c, t in out.dtypes if t == "double"], dp=4)


def e3_runtime(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(evaluate.runtime_metrics(load(spark, d, "stage_log")), "mean_s", "median_s", "p95_s", "max_s", dp=3)


def e4_cost(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(evaluate.cost_metrics(_results(spark, d)), "mean_ed_s", "median_ed_s", "sum_ed_s", "max_ed_s", "mean_budget_share", dp=3)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """First against second window mean of each service and metric."""
    rows = Analysis(spark, d).aligned.filter("value is not null")
    means = rows.groupBy("metric_name", "incident_id", "service_id").agg(F.min_by("value", "window_id").alias("x"), F.max_by("value", "window_id").alias("y"))
    return means


def e6_cliffs(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(evaluate.cliffs_delta(_pairs(spark, d), ["metric_name"]), "delta")


def e7_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(evaluate.signed_ranks(_pairs(spark, d).select("metric_name", "x", "y"), ["metric_name"]), "z", dp=4).select("metric_name", "n", "w_plus", "z", "tied")


def e7_pvalues(spark: SparkSession, d: str) -> DataFrame:
    """One-sided signed-rank p-value of each metric."""
    ranks = evaluate.signed_ranks(_pairs(spark, d).select("metric_name", "x", "y"), ["metric_name"])
    return evaluate.wilcoxon_pvalues(ranks).select("metric_name", "n", "w_plus", (F.round("p", 6) + 0.0).alias("p"))


def _pvalues(spark: SparkSession, d: str) -> DataFrame:
    """P-value of each method and stage that more than 70 per cent of its records take under a second."""
    log = load(spark, d, "stage_log").filter("record_no is not null").groupBy("record_no").agg(F.max(F.struct("ingested_at", "method_id", norm_name("stage_name").alias("stage"), "wall_time_s")).alias("r")).select("r.*")
    log = log.filter("method_id is not null and stage is not null and wall_time_s >= 0 and wall_time_s < double('inf')")
    counts = log.groupBy(F.col("method_id").alias("family"), F.col("stage").alias("hypothesis")).agg(F.count_if(F.col("wall_time_s") < 1.0).alias("k"), F.count(F.lit(1)).alias("n"))
    return evaluate.binomial_pvalues(counts).withColumn("p", F.round("p", 9) + 0.0)


def e10_holm(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(evaluate.holm(_pvalues(spark, d).drop("k", "n"), ["family"]), "p", "threshold", dp=7)


def e11_bh(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(evaluate.benjamini_hochberg(_pvalues(spark, d).drop("k", "n"), ["family"]), "p", "adjusted", dp=7)


def e14_power(spark: SparkSession, d: str) -> DataFrame:
    """Power for the scenarios at hand and the number needed."""
    n = load(spark, d, "scenarios").select("fault_id").distinct().count()
    return spark.createDataFrame([(n, round(evaluate.power_of(n), 6), evaluate.required_n())], "n bigint, power double, required_n int")


def e17_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.type_by_split(load(spark, d, "scenarios"))


def e18_latency_cdf(spark: SparkSession, d: str) -> DataFrame:
    return _with_rounded(evaluate.latency_cdf(_results(spark, d)), "share")


def e19_repeatability(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "stage_log").filter("method_id is not null and wall_time_s >= 0").groupBy("record_no").agg(F.max(F.struct("method_id", "wall_time_s")).alias("r")).select("r.*")
    return _with_rounded(evaluate.repeatability(log, ["method_id"], "wall_time_s"), "mean", "median", "sd", "iqr", dp=3)


def e21_report(spark: SparkSession, d: str) -> DataFrame:
    """Report cells of all listed methods; those without results are pending."""
    methods_df = load(spark, d, "runtime_metrics").select(F.col("method_id").alias("method"))
    runs = evaluate.runtime_metrics(load(spark, d, "stage_log")).select(F.col("method_id").alias("method"), "n_runs", "max_peak_mb")
    return evaluate.report_rows(methods_df, runs, ["n_runs", "max_peak_mb"])


# Methods and models


def b1_observational(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    return _listed(methods.observational(a.incidents, a.ranked, a.scores))


def b4_sieve(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    return _listed(methods.propagated(a.incidents, a.scores, graph.closure(a.edges, [], 5, paths=False)))


def b3_one_shot(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    costs = a.costs
    return _listed(methods.probing("ONE_SHOT", a.incidents, a.candidates, costs, select.greedy_selection(costs, ["incident_id"])))


def b2_random(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    costs = a.costs
    return _listed(methods.probing("RANDOM", a.incidents, a.candidates, costs, select.random_selection(costs, ["incident_id"])))


def b7_threshold(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    return _listed(methods.earliest_alert(a.incidents, a.deviations))


def b7_page_rank(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    services = load(spark, d, "services").select("service_id")
    weights = services.join(detect.over_threshold(a.scores).groupBy("service_id").agg(F.count(F.lit(1)).cast("double").alias("weight")), "service_id", "left").fillna(0.0)
    return _with_rounded(methods.page_rank(a.edges, weights), "score", dp=6)


def _listed(out: DataFrame) -> DataFrame:
    return out.select("method", "incident_id", F.array_join(F.transform("top_candidates", lambda c: c["service"]), ",").alias("services"), "abstained", "abstention_reason", F.round("latency_s", 3).alias("latency_s"), "total_ed_s")


def s9_fault_series(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic metric series of every scenario, summed up by scenario."""
    sc = load(spark, d, "scenarios")
    reach = graph.closure(graph.path_edges(sc), ["fault_id"], paths=False)
    roots = sc.select("fault_id", norm_name("root_cause_service").alias("src")).distinct()
    depths = reach.join(roots, ["fault_id", "src"]).select("fault_id", F.col("dst").alias("service_id"), "depth")
    rows = simulate.fault_series(sc, depths)
    return rows.groupBy("fault_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("lat_p99"), 3).alias("max_lat"), F.round(F.sum("err_rate"), 3).alias("sum_err"))


QUERIES = {f.__name__: f for f in (
    s2_counter_rate, s2_histogram_quantile, s3_s4_responses, s5_parse, s8_split, s9_fault_series, s12_oracle_pag, s16_manifest, s18_guard, s19_secrets, s21_phrases, s22_last_wins,
    t1_grid, t2_last_in_window, t3_bounded_fill, t4_report, t5_last_delivery, t8_lag_alarms, t9_within, t10_wide, t11_fill_zero, t12_complete, t13_baseline,
    a1_scores, a3_anomalous, a4_persistence, a5_precedence, a8_evidence, a12_ranking, a13_latency,
    g1_time_sliced, g2_collapse, g3_closure, g4_scenario_paths, g6_depth, g8_skeleton, g10_subgraph, g12_degrees, g14_blast,
    d1_wasserstein, d3_variation, d4_threshold, d6_permutation, d6_wall_times, d7_bootstrap, d8_divergence, d8_inference,
    l1_entropy, l2_posterior, l3_costs, l6_selection, l7_random_selection, l8_distinct, l9_expected_entropy, l10_edges, l11_posterior_update,
    i1_precision, i4_clean_windows, i7_dispatch, i11_cascade, v1_violations,
    c1_discovery, c1_services, c2_correlation, c9_identify,
    e1_attribution, e3_runtime, e4_cost, e6_cliffs, e7_wilcoxon, e7_pvalues, e10_holm, e11_bh, e14_power, e17_counts, e18_latency_cdf, e19_repeatability, e21_report,
    b1_observational, b2_random, b3_one_shot, b4_sieve, b7_threshold, b7_page_rank,
)}

