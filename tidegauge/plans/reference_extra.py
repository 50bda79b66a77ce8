"""Queries of sources, checks, graphs, models, methods and tests that the other modules leave out, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import norm_label, norm_name
from tidegauge.operators import causal, detect, diverge, evaluate, graph, guard, methods, select, simulate
from tidegauge.operators.intervals import valid_interventions
from tidegauge.plans import reference as base
from tidegauge.plans import reference_more as more
from tidegauge.plans import reference_sql as sql
from tidegauge.plans.pipeline import Analysis
from tidegauge.plans.runtime import load, scratch_folder
from tidegauge.sources import scenarios as results
from tidegauge.sources import telemetry

KEY = ["incident_id", "service_id"]
#: Fields of a scenario in a file.
_SCENARIO = ["fault_id", "name", "root_cause_service", "fault_type", "injected_at_t", "expected_recovery_t", "causal_path", "confounded", "confounder_description", "affected_services", "split", "ground_truth_locked", "seed"]


# Sources


def s2_error_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of failed interventions of each service."""
    rows = guard.valid_latest(load(spark, d, "interventions")).filter("destination_service is not null")
    calls = rows.groupBy(F.col("destination_service").alias("service_id"), F.when(F.col("status") == "FAILED", "ERROR").otherwise("OK").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return telemetry.error_ratio(calls, ["service_id"]).select("service_id", F.round("err_rate", 6).alias("err_rate"))


def s3_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Reasons why responses are refused: of services, those cut short, those of status error, and valid ones."""
    good = '{"status":"success","data":{"resultType":"matrix","result":[]}}'
    body = F.when(F.col("replicas").isNull(), '{"status":"succ').when(F.col("replicas") % 2 == 1, '{"status":"error"}').otherwise(good)
    bad = telemetry.rejected_responses(load(spark, d, "services").select("service_id", body.alias("body")))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def s11_oracle_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Oracle metric of every scenario, summed up by service."""
    rows = simulate.oracle_series(load(spark, d, "scenarios"))
    return rows.groupBy("fault_id", "service_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("peak"))


def s14_scenario_files(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios written as files of the form {split, n_scenarios, scenarios} and read back, counted by split."""
    once = load(spark, d, "scenarios").filter("fault_id is not null").select(*_SCENARIO).distinct()
    part = F.pmod(F.xxhash64("fault_id"), F.lit(64))  # a file's document holds a part of a split
    docs = once.groupBy("split", part.alias("part")).agg(F.count(F.lit(1)).alias("n_scenarios"), F.collect_list(F.struct(*once.columns)).alias("scenarios"))
    path = scratch_folder(spark)
    docs.select(F.to_json(F.struct("split", "n_scenarios", "scenarios")).alias("value")).write.text(path)
    rows = telemetry.scenario_files(spark, path, multi_line=False)
    return rows.groupBy(norm_label("split").alias("split")).agg(F.countDistinct("fault_id").alias("n"), F.sum(F.coalesce(F.size("causal_path"), F.lit(0))).alias("n_edges"))


def s17_tables(spark: SparkSession, d: str) -> DataFrame:
    """Services written in partitions and read back, counted by namespace."""
    path = scratch_folder(spark)
    telemetry.write_table(load(spark, d, "services"), path, partition_by=["namespace"])
    return spark.read.parquet(path).groupBy(F.col("namespace").cast("string").alias("namespace")).agg(F.count(F.lit(1)).alias("n"), F.sum("replicas").alias("replicas"))


def s20_results(spark: SparkSession, d: str) -> DataFrame:
    """Result files of each method written and loaded, with their category of evidence."""
    path = scratch_folder(spark)
    rows = load(spark, d, "runtime_metrics").select(F.col("method_id").alias("experiment"), (F.col("n_scenarios") % 2 == 0).alias("live_telemetry_used"), "n_scenarios")
    telemetry.write_table(rows, path, "json", ["experiment"])
    return results.result_files(spark, path + "/*/*.json").select(F.regexp_replace("experiment", "experiment=", "").alias("experiment"), "category", "n_scenarios")


def t6_selection(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a value of the pipeline's metric in each incident."""
    return Analysis(spark, d).series.groupBy("incident_id").agg(F.countDistinct("service_id").alias("n_services"), F.count("value").alias("n_values"))


# Graphs and causes


def g5_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    """Number and least length of the ways from the root of each scenario to every other node of its path."""
    sc = load(spark, d, "scenarios")
    edges = graph.path_edges(sc)
    nodes = edges.select("fault_id", F.explode(F.array("src", "dst")).alias("dst")).distinct()
    pairs = sc.select("fault_id", norm_name("root_cause_service").alias("src")).filter("src is not null").distinct().join(nodes, "fault_id")
    ways = graph.simple_paths(edges, ["fault_id"], pairs)
    return ways.groupBy("fault_id", "src", "dst").agg(F.count(F.lit(1)).alias("n_ways"), F.min(F.size("path") - 1).alias("least_edges"))


def g7_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Directed part of each scenario's oracle graph."""
    return graph.directed_part(causal.pag_from_paths(load(spark, d, "scenarios")), ["fault_id"])


def g9_lookups(spark: SparkSession, d: str) -> DataFrame:
    """What the oracle graph of each scenario says of each pair of its nodes."""
    pag = causal.pag_from_paths(load(spark, d, "scenarios"))
    nodes = pag.select("fault_id", F.explode(F.array("src", "dst")).alias("a")).distinct()
    pairs = nodes.join(nodes.withColumnRenamed("a", "b"), "fault_id").filter("a > b")
    return graph.pair_lookup(pag, ["fault_id"], pairs)


def c1_generators(spark: SparkSession, d: str) -> DataFrame:
    """Edges found in the generated data whose structure is known."""
    return causal.discover(simulate.generated_series(spark), ["model"])


def a12_discovered(spark: SparkSession, d: str) -> DataFrame:
    """The ranking of every incident in the graph that discovery finds among its services."""
    rows = Analysis(spark, d).ranked_discovered
    return rows.select(*KEY, "t_star_ms", "r2", "r3", "r4", "confidence", "boundary_limited", "identifiability", "rank", "path")


def l10_probes(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of the calls of each incident after the evidence of its probes."""
    return Analysis(spark, d).updated_edges.select(F.col("run_id").alias("incident_id"), "src", "dst", F.round("confidence", 6).alias("confidence"))


def l12_structure(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each scenario after evidence against its first edge and for the reverse of its last."""
    edges = graph.path_edges(load(spark, d, "scenarios")).select(F.col("fault_id").alias("run_id"), "src", "dst").withColumn("confidence", F.when(F.length("src") % 2 == 0, 0.2).otherwise(0.6))
    ends = edges.groupBy("run_id").agg(F.min(F.struct("src", "dst")).alias("a"), F.max(F.struct("src", "dst")).alias("b"))
    first = ends.select("run_id", F.col("a.src").alias("source"), F.col("a.dst").alias("target"), F.lit(False).alias("exceeds"))
    last = ends.select("run_id", F.col("b.dst").alias("source"), F.col("b.src").alias("target"), F.lit(True).alias("exceeds"))
    return select.update_structure(edges, first.unionByName(last), graph.closure(edges, ["run_id"], paths=False))


# Records


def _records(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "interventions")
    cols = ["ingested_at", "latency_ms", "precision_achieved", "isolation_verified", "t_rolled_back", "packet_loss_pct", "jitter_ms", "tc_handle"]
    more_of = raw.filter("record_id is not null").groupBy("record_id").agg(F.max(F.struct(*cols)).alias("r")).select("record_id", *(f"r.{c}" for c in cols if c != "ingested_at"))
    own = valid_interventions(raw).filter("record_id is not null")
    return own.join(more_of, "record_id").withColumn("rolled_back", F.col("t_rolled_back").isNotNull() & ~F.isnan(F.coalesce("t_rolled_back", F.lit(0.0))))


def i2_commands(spark: SparkSession, d: str) -> DataFrame:
    """Places of the shaping command of each record: device, band and what it names, without rounding."""
    rows = guard.shaping_command(load(spark, d, "interventions")).select("record_id", "band", "command").distinct()
    return rows.select("record_id", "band", F.regexp_extract("command", r"dev (\S+) parent (\S+) handle (\S+) netem", 0).alias("place"))


def i4_checks(spark: SparkSession, d: str) -> DataFrame:
    """The five validity checks of each record."""
    return guard.five_checks(_records(spark, d))


def i5_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Statuses that do not follow their predecessor, by status, over the deliveries of each record."""
    phase = F.when(norm_label("status") == "PENDING", "PREPARE").when(norm_label("status") == "APPLIED", "AUTHORIZE").when(norm_label("status") == "VERIFIED", "APPLY").otherwise("VERIFY")
    rows = load(spark, d, "interventions").filter("record_id is not null").select("record_id", phase.alias("phase"), "ingested_at").groupBy("record_id", "phase").agg(F.min("ingested_at").alias("at"))
    events = rows.select("record_id", F.struct("at", "phase").alias("seq"), "phase")
    return guard.lifecycle_violations(events).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


def i8_verification(spark: SparkSession, d: str) -> DataFrame:
    """Whether a fault counts as injected, with the kind by the band of each record."""
    band = F.regexp_extract("tc_handle", r"(\d+)", 1)
    fault = F.when(band == "1", "NETWORK_LATENCY").when(band == "2", "PACKET_LOSS").otherwise("SERVICE_DEGRADATION")
    measured = F.when(band == "1", F.col("precision_achieved") * F.col("latency_ms")).when(band == "2", F.col("packet_loss_pct")).otherwise(F.col("jitter_ms") * 5)
    rows = _records(spark, d).select("record_id", fault.alias("fault"), F.col("latency_ms").alias("expected"), measured.alias("measured"))
    return guard.verify_fault(rows).groupBy("fault", "confirmed").agg(F.count(F.lit(1)).alias("n"))


def i9_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Splits that do not have the number of scenarios of a manifest."""
    return results.manifest_check(load(spark, d, "scenarios"), {"DEVELOPMENT": 1, "VALIDATION": 1, "HELD_OUT_TEST": 0, "OTHER": 0})


def i10_gate(spark: SparkSession, d: str) -> DataFrame:
    """Decision before a probe of each service; the first three namespaces are approved."""
    r = F.coalesce("replicas", F.lit(0))
    probes = load(spark, d, "services").select(
        "service_id", (~F.col("instrumented")).alias("kill"), "namespace", F.when(r != 3, F.col("service_id")).alias("target"), (r * 100.0).alias("cumulative_s"), F.lit(30.0).alias("seconds"),
        F.col("replicas").isNull().alias("mutates"), (r / 10.0).alias("blast_radius"), (r / 100.0).alias("impact"), (1.0 - r / 5.0).alias("confidence"), (r == 1).alias("override"),
    )
    names = load(spark, d, "services").select("namespace").distinct().orderBy("namespace").limit(3).collect()
    gate = guard.pre_gate(probes, [r.namespace for r in names], r"-eval-[a-z]$")
    return gate.select("service_id", "hard_stop", "warnings", "level", "decision")


def i13_failures(spark: SparkSession, d: str) -> DataFrame:
    """First failure of each run by the notes of its stages, and whether it only abstained."""
    code = F.when(F.col("notes") == "retry", "TELEMETRY_GAP").when(F.col("notes") == "warm cache", "NO_DIVERGENCE").when(F.col("notes") == "shared host", "INSUFFICIENT_EVIDENCE")
    rows = load(spark, d, "stage_log").select("run_id", "record_no", code.alias("code")).filter("code is not null and run_id is not null and record_no is not null")
    first = guard.failure_summary(rows.groupBy("run_id", F.col("record_no").alias("seq")).agg(F.max("code").alias("code")))
    return first.groupBy("primary_code", "is_abstention").agg(F.count(F.lit(1)).alias("n"))


# Methods, models and tests


def b7_ochiai(spark: SparkSession, d: str) -> DataFrame:
    """Ochiai score of each service: anomalous latency against incidents in which errors were high."""
    a = Analysis(spark, d)
    errors = Analysis(spark, d, metric="err_rate").series.groupBy("incident_id").agg(F.coalesce(F.max(F.col("value") > 0.1), F.lit(False)).alias("failed"))
    events = a.scores.join(errors, "incident_id", "left").select("service_id", (F.col("max_z") > 3).alias("anomalous"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return methods.ochiai(events).select("service_id", "n_af", "n_as", "n_f", F.round("score", 6).alias("score"))


def b7_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Services of each incident by how isolated their windows are among those of all first halves."""
    a = Analysis(spark, d)
    return base._listed(methods.isolation_forest(a.incidents, a.aligned, guard.METRICS))


def m3_models(spark: SparkSession, d: str) -> DataFrame:
    """Means of all variables of all seven models, observed and under intervention on the first."""
    out = None
    for name, model in simulate.MODELS.items():
        first = model.order()[0]
        for kind, m in (("observed", model), ("do", model.do(**{first: 2.0}))):
            cols = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in m.order())))
            rows = m.sample(spark, 2000).select(F.lit(name).alias("model"), F.lit(kind).alias("kind"), cols.alias("s")).select("model", "kind", "s.*")
            out = rows if out is None else out.unionByName(rows)
    return out.groupBy("model", "kind", "variable").agg((F.round(F.avg("value"), 6) + 0.0).alias("mean"))


def d9_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of each series compared without a floor of sample size."""
    out = diverge.evaluate_divergence(Analysis(spark, d).samples, KEY)
    return out.select(*KEY, "n_base", "n_post", *(F.round(c, 6).alias(c) for c in ("w1", "theta", "tv")), "exceeds")


def d10_type_one(spark: SparkSession, d: str) -> DataFrame:
    """Rejections among 200 null trials of 50 against 50 normal values, 1,000 permutations each."""
    trials = spark.range(200).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"))
    noise = telemetry.normal_draw(F.concat_ws(":", F.lit("null"), "trial", "k"))
    tests = diverge.permutation_test(trials.select("trial", F.when(F.col("k") < 50, "base").otherwise("post").alias("side"), noise.alias("value")), ["trial"], 1000)
    return diverge.type_one_rate(tests).select("n_trials", F.round("rejection_rate", 6).alias("rejection_rate"), "gate")


def e6_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of Cliff's delta of each metric over 2,000 resamples."""
    out = evaluate.cliffs_interval(base._pairs(spark, d), ["metric_name"])
    return out.select("metric_name", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def e8_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first and second values of each metric are equivalent within a margin of 5."""
    out = evaluate.equivalence_tests(base._pairs(spark, d), ["metric_name"], 5.0)
    return out.select("metric_name", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "p")), "equivalent")


def e9_binomial(spark: SparkSession, d: str) -> DataFrame:
    """P-value of each method and stage that more than 70 per cent of its records take under a second."""
    return base._pvalues(spark, d).select(F.col("family").alias("method_id"), F.col("hypothesis").alias("stage_name"), "k", "n", (F.round("p", 6) + 0.0).alias("p"))


def e13_power(spark: SparkSession, d: str) -> DataFrame:
    """Power of the signed-rank test at the number of scenarios of each split."""
    n = load(spark, d, "scenarios").filter("split is not null").groupBy(norm_label("split").alias("split")).agg(F.countDistinct("fault_id").alias("n"))
    return n.withColumn("power", F.round(evaluate._p_column(lambda k: evaluate.power_of(int(k)), "n"), 6))


def e15_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Times of the stages collect and fci of each run paired by place, with what each method's pairs differ by."""
    log = load(spark, d, "stage_log").filter("record_no is not null").groupBy("record_no").agg(F.max(F.struct("ingested_at", "run_id", "method_id", norm_name("stage_name").alias("stage"), "wall_time_s")).alias("r")).select("record_no", "r.*").filter("run_id is not null and wall_time_s >= 0 and wall_time_s < double('inf')")
    x, y = (log.filter(F.col("stage") == s) for s in ("collect", "fci"))
    return evaluate.paired(x, y, ["run_id"], "record_no", "wall_time_s").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum(F.col("x") - F.col("y")), 3).alias("difference"))


QUERIES = {f.__name__: f for f in (
    s2_error_ratio, s3_rejected, s11_oracle_metrics, s14_scenario_files, s17_tables, s20_results, t6_selection, g5_simple_paths, g7_conversion, g9_lookups, c1_generators, a12_discovered, l10_probes, l12_structure,
    i2_commands, i4_checks, i5_lifecycle, i8_verification, i9_manifest, i10_gate, i13_failures, b7_ochiai, b7_isolation, m3_models, d9_evaluate, d10_type_one,
    e6_interval, e8_equivalence, e9_binomial, e13_power, e15_pairing,
)}


def _model_sql() -> str:
    parts = []
    for name, model in simulate.MODELS.items():
        for kind, m in (("observed", model), ("do", model.do(**{model.order()[0]: 2.0}))):
            table = "(SELECT i AS id FROM range(2000) t(i))"
            for v in m.order():
                parents, constant, scale = m.equations[v]
                label = f"'42:{v}:' || id"
                noise = f" + {scale}::DOUBLE * {sql.normal_of(label)}" if scale else ""
                value = f"{constant}::DOUBLE{noise}" + "".join(f" + {c}::DOUBLE * {q}" for q, c in parents.items())
                table = f"(SELECT *, {value} AS {v} FROM {table})"
            for v in m.order():
                parts.append(f"SELECT '{name}' AS model, '{kind}' AS kind, '{v}' AS variable, round(avg({v}), 6) + 0.0::DOUBLE AS mean FROM {table}")
    return " UNION ALL ".join(parts)


def upper_tail(z: str) -> str:
    """P(Z > z) of the normal distribution by its series, exact to double precision for |z| < 8."""
    series = f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()) - {z} * {z} / 2)))"
    return f"(CASE WHEN {z} > 8 THEN 0 WHEN {z} < -8 THEN 1 ELSE 0.5::DOUBLE - sign({z}) * {series} / sqrt(2 * pi()) END)"


_RANKED_P = f"""
exact AS (
  SELECT 0 AS r, list_transform(range(0, 1276), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ways
  UNION ALL SELECT r + 1, list_transform(range(0, 1276), lambda s: ways[s + 1] + CASE WHEN s >= r + 1 THEN ways[s - r] ELSE 0 END) FROM exact WHERE r < 50),
tests AS (
  SELECT metric_name, n, w_plus, z, tied, CASE WHEN n <= 50 AND NOT tied THEN (SELECT list_sum(ways[w_plus::INT + 1:]) / power(2, r) FROM exact WHERE r = q.n) ELSE {upper_tail('z')} END AS p
  FROM ({{ranks}}) q)"""


def _rank_sql() -> str:
    """The signed ranks of each metric, not rounded."""
    return sql.SQL["e7_wilcoxon"].split("FROM ranked GROUP BY metric_name)")[0].replace("\nWITH ", "", 1) + "FROM ranked GROUP BY metric_name), ranks AS (SELECT metric_name, n, w_plus, (w_plus - n * (n + 1) / 4 - 0.5::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z, t > 0 AS tied FROM w)"


_RANKS = f"WITH RECURSIVE {_rank_sql()}, {_RANKED_P.replace('{ranks}', 'SELECT * FROM ranks')}"
_CHECKED = f"""
own AS (
  SELECT record_id, {sql.NAME.format('destination_service')} AS service, {sql.LABEL.format('status')} AS status, latency_ms, precision_achieved, coalesce(isolation_verified, false) AS isolation_verified, packet_loss_pct, jitter_ms, tc_handle,
         CAST(round(CASE WHEN isfinite(t_applied) THEN t_applied END * 1000) AS BIGINT) AS a, t_rolled_back IS NOT NULL AND NOT isnan(t_rolled_back) AS rolled_back,
         CAST(round(coalesce(CASE WHEN isfinite(t_rolled_back) THEN t_rolled_back END, CASE WHEN isfinite(t_applied + lease_s) THEN t_applied + lease_s END) * 1000) AS BIGINT) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM interventions WHERE record_id IS NOT NULL) WHERE rn = 1)"""
_MS = "[0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'inf'::DOUBLE]"

SQL = {
    "s2_error_ratio": f"WITH {sql.LATEST} SELECT destination_service AS service_id, round(avg(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END), 6) AS err_rate FROM latest WHERE destination_service IS NOT NULL GROUP BY ALL",
    "s2_histogram_quantile": f"""
WITH b AS (SELECT metric_name, le, count(*) FILTER (WHERE collection_lag_s <= le) AS n FROM raw_metrics CROSS JOIN (SELECT unnest({_MS}) AS le) WHERE collection_lag_s IS NOT NULL GROUP BY ALL),
o AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY metric_name) AS total FROM b WINDOW w AS (PARTITION BY metric_name ORDER BY le)),
hit AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY le) AS rn FROM o WHERE n >= 0.99::DOUBLE * total AND total > 0)
SELECT metric_name, round(CASE WHEN isinf(le) THEN lo WHEN n > below THEN lo + (le - lo) * (0.99::DOUBLE * total - below) / (n - below) ELSE le END, 6) AS quantile FROM hit WHERE rn = 1""",
    "s3_rejected": "SELECT CASE WHEN replicas IS NULL THEN 'malformed' ELSE 'status' END AS reason, count(*) AS n FROM services WHERE replicas IS NULL OR replicas % 2 = 1 GROUP BY ALL",
    "s6_mock": f"SELECT service_id, count(*) AS n, round(avg(50 + 5 * {sql.normal_of(chr(39) + '42:' + chr(39) + ' || service_id || ' + chr(39) + ':' + chr(39) + ' || k')}), 6) AS mean FROM (SELECT DISTINCT service_id FROM services) CROSS JOIN range(30) t(k) GROUP BY service_id",
    "s9_fault_series": f"""
WITH RECURSIVE {sql.PATHS}, {sql.OWN_REACH},
once AS (SELECT DISTINCT ON (fault_id) fault_id, {sql.NAME.format('root_cause_service')} AS root, {sql.LABEL.format('fault_type')} AS fault, injected_at_t AS t0, expected_recovery_t AS t1, coalesce(confounded, false) AS confounded, affected_services
         FROM scenarios WHERE fault_id IS NOT NULL AND injected_at_t IS NOT NULL AND expected_recovery_t IS NOT NULL),
svc AS (SELECT DISTINCT fault_id, root, fault, t0, t1, confounded, service FROM (SELECT *, unnest(list_transform(affected_services, lambda x: {sql.NAME.format('x')})) AS service FROM once)),
deep AS (SELECT svc.*, CASE WHEN service = root THEN 0 ELSE coalesce(w.depth, 3) END AS depth FROM svc LEFT JOIN own_walk w ON w.fault_id = svc.fault_id AND w.src = root AND w.dst = service),
effects(f, lat, err) AS (VALUES {', '.join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in simulate.EFFECTS.items())}),
cells AS (
  SELECT fault_id, coalesce(lat, {simulate.OTHER_EFFECT[0]}) AS lat, coalesce(err, {simulate.OTHER_EFFECT[1]}::DOUBLE) AS err, depth,
         k >= floor(t0 / 10) + depth AND k < floor(t1 / 10) AND (depth = 0 OR NOT confounded) AS hit
  FROM (SELECT *, unnest(range(0, ceil((t1 + 120) / 10)::BIGINT)) AS k FROM deep) LEFT JOIN effects ON f = fault)
SELECT fault_id, count(*) AS n, round(max(CASE WHEN hit THEN 50 * greatest(1, lat * power(0.9::DOUBLE, depth)) ELSE 50 END), 3) AS max_lat,
  round(sum(CASE WHEN hit THEN least(1, 0.001::DOUBLE + err * power(0.8::DOUBLE, depth)) ELSE 0.001::DOUBLE END), 3) AS sum_err FROM cells GROUP BY fault_id""",
    "s11_oracle_metrics": f"WITH {sql.ORACLE} SELECT fault_id, service AS service_id, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS peak FROM oracle_series GROUP BY ALL",
    "s14_scenario_files": f"SELECT {sql.LABEL.format('split')} AS split, count(DISTINCT fault_id) AS n, CAST(sum(coalesce(len(causal_path), 0)) AS BIGINT) AS n_edges FROM (SELECT DISTINCT {', '.join(_SCENARIO)} FROM scenarios WHERE fault_id IS NOT NULL) GROUP BY ALL",
    "s17_tables": "SELECT namespace, count(*) AS n, CAST(sum(replicas) AS BIGINT) AS replicas FROM services GROUP BY namespace",
    "s20_results": "SELECT method_id AS experiment, CASE WHEN n_scenarios % 2 = 0 THEN 'LIVE' ELSE 'SYNTHETIC' END AS category, n_scenarios FROM runtime_metrics",
    "t6_selection": f"WITH {sql.DEVIATIONS} SELECT incident_id, count(DISTINCT service_id) AS n_services, count(v) AS n_values FROM series GROUP BY incident_id",
    "g5_simple_paths": f"""
WITH RECURSIVE {sql.PATHS}, roots AS (SELECT DISTINCT fault_id, {sql.NAME.format('root_cause_service')} AS src FROM scenarios WHERE root_cause_service IS NOT NULL),
ways AS (
  SELECT fault_id, src, src AS node, [src] AS path FROM roots
  UNION ALL SELECT w.fault_id, w.src, e.dst, list_append(path, e.dst) FROM ways w JOIN path_edges e ON e.fault_id = w.fault_id AND e.src = w.node WHERE NOT list_contains(path, e.dst))
SELECT fault_id, src, node AS dst, count(*) AS n_ways, min(len(path) - 1) AS least_edges FROM ways WHERE len(path) > 1 GROUP BY ALL""",
    "g7_conversion": f"""
SELECT DISTINCT fault_id, {sql.NAME.format('e[1]')} AS src, {sql.NAME.format('e[2]')} AS dst FROM (SELECT fault_id, unnest(causal_path) AS e FROM (SELECT DISTINCT ON (fault_id) * FROM scenarios)) WHERE e[1] IS NOT NULL AND e[2] IS NOT NULL""",
    "g9_lookups": f"""
WITH once AS (SELECT DISTINCT ON (fault_id) fault_id, confounded, causal_path FROM scenarios),
steps AS (SELECT fault_id, confounded, i, {sql.NAME.format('e[1]')} AS src, {sql.NAME.format('e[2]')} AS dst FROM (SELECT fault_id, confounded, unnest(causal_path) AS e, unnest(range(len(causal_path))) AS i FROM once) WHERE e[1] IS NOT NULL AND e[2] IS NOT NULL),
pag AS (SELECT DISTINCT fault_id, src, dst, 'DIRECTED' AS kind FROM steps UNION ALL SELECT fault_id, src, dst, 'BIDIRECTED' FROM steps WHERE confounded AND i = 0),
nodes AS (SELECT fault_id, src AS x FROM pag UNION SELECT fault_id, dst FROM pag),
pairs AS (SELECT n.fault_id, n.x AS a, m.x AS b FROM nodes n JOIN nodes m ON n.fault_id = m.fault_id AND n.x > m.x),
seen AS (SELECT fault_id, greatest(src, dst) AS a, least(src, dst) AS b, string_agg(src || '>' || dst || ':' || kind, ',' ORDER BY src || '>' || dst || ':' || kind) AS edge_types, bool_or(kind = 'BIDIRECTED') AS h FROM pag GROUP BY ALL)
SELECT fault_id, a, b, edge_types IS NOT NULL AS has_edge, edge_types, coalesce(h, false) AS hidden_cause FROM pairs LEFT JOIN seen USING (fault_id, a, b)""",
    "l11_posterior_update": f"""
WITH {sql.HOT}{sql.SAMPLES[len(sql.ALIGNED):]},
facts AS (SELECT incident_id, service_id AS target, least(greatest(tv, 1e-6), 1 - 1e-6) AS c FROM tv),
lik AS (SELECT incident_id, target, ln(greatest(3 * c * c, 1e-12)) AS hit, ln(greatest(3 * (1 - c) * (1 - c), 1e-12)) AS miss FROM facts),
logs AS (SELECT p.incident_id, p.service_id, ln(p.p) + coalesce((SELECT sum(CASE WHEN l.target = p.service_id THEN hit ELSE miss END) FROM lik l WHERE l.incident_id = p.incident_id), 0) AS g FROM prior p WHERE p.p > 0),
scaled AS (SELECT *, exp(g - max(g) OVER (PARTITION BY incident_id)) AS w FROM logs)
SELECT incident_id, service_id, round(w / sum(w) OVER (PARTITION BY incident_id), 5) AS p FROM scaled""",
    "l10_probes": f"""
WITH {sql.PATHS}, {sql.DEVIATIONS.strip()}, {sql.EVIDENCE}, {sql.OBSERVED},
every_edge AS (SELECT incident_id, src, dst, true AS known FROM inc_edges UNION ALL SELECT incident_id, src, dst, false FROM (SELECT incident_id, src, dst FROM evidence EXCEPT SELECT incident_id, src, dst FROM inc_edges)),
into_target AS (SELECT e.incident_id, e.src, e.dst, list(CASE WHEN v.src IS NULL OR (NOT known AND v.src < e.src) THEN 1 WHEN v.src = e.src AND v.exceeds THEN 1.2::DOUBLE WHEN v.src = e.src OR v.exceeds THEN 0.9::DOUBLE ELSE 1 END ORDER BY v.src) AS factors
  FROM every_edge e LEFT JOIN evidence v ON v.incident_id = e.incident_id AND v.dst = e.dst GROUP BY ALL)
SELECT incident_id, src, dst, round(list_reduce(list_prepend(0.5::DOUBLE, factors), lambda c, f: least(greatest(c * f, 0.05), 0.95)), 6) AS confidence FROM into_target""",
    "l12_structure": f"""
WITH RECURSIVE {sql.PATHS}, {sql.OWN_REACH}, e AS (SELECT fault_id, src, dst, CASE WHEN length(src) % 2 = 0 THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM path_edges),
first AS (SELECT DISTINCT ON (fault_id) fault_id, src, dst FROM e ORDER BY fault_id, src, dst), last AS (SELECT DISTINCT ON (fault_id) fault_id, e.dst AS src, e.src AS dst FROM e ORDER BY fault_id, e.src DESC, e.dst DESC)
SELECT fault_id AS run_id, src, dst, confidence FROM e WHERE confidence >= 0.3 OR NOT EXISTS (SELECT 1 FROM first f WHERE f.fault_id = e.fault_id AND f.src = e.src AND f.dst = e.dst)
UNION ALL SELECT fault_id, src, dst, 0.5::DOUBLE FROM last l WHERE NOT EXISTS (SELECT 1 FROM own_walk w WHERE w.fault_id = l.fault_id AND w.src = l.src AND w.dst = l.dst)""",
    "i2_commands": """
SELECT DISTINCT record_id, try_cast(regexp_extract(tc_handle, '(\\d+)', 1) AS INT) AS band,
  CASE WHEN try_cast(regexp_extract(tc_handle, '(\\d+)', 1) AS INT) BETWEEN 1 AND 3 AND interface IS NOT NULL
       THEN 'dev ' || lower(trim(interface)) || ' parent 1:' || regexp_extract(tc_handle, '(\\d+)', 1) || ' handle ' || regexp_extract(tc_handle, '(\\d+)', 1) || ': netem' END AS place FROM interventions""",
    "i4_checks": f"""
WITH {_CHECKED}, placed AS (
  SELECT *, greatest(coalesce(e, a), a) AS fin FROM own WHERE a IS NOT NULL AND service IS NOT NULL),
seen AS (
  SELECT record_id, NOT coalesce(abs(precision_achieved * latency_ms - latency_ms) / greatest(1, latency_ms) >= 0.2, false) AS precision_check,
         count(*) OVER (PARTITION BY service ORDER BY a RANGE BETWEEN 60000 PRECEDING AND 60000 FOLLOWING) = 1 AS clean_window,
         coalesce(max(fin) OVER (PARTITION BY service ORDER BY a, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= a, true) AND coalesce(lead(a) OVER (PARTITION BY service ORDER BY a, record_id) >= fin, true) AS concurrent_event_free,
         rolled_back AND coalesce(status, '') <> 'FAILED' AS recovery_confirmed, isolation_verified FROM placed)
SELECT *, precision_check AND clean_window AND concurrent_event_free AND recovery_confirmed AND isolation_verified AS valid FROM seen""",
    "i5_lifecycle": f"""
WITH p AS (SELECT record_id, CASE {sql.LABEL.format('status')} WHEN 'PENDING' THEN 1 WHEN 'APPLIED' THEN 2 WHEN 'VERIFIED' THEN 3 ELSE 4 END AS place, min(ingested_at) AS t FROM interventions WHERE record_id IS NOT NULL GROUP BY ALL),
n AS (SELECT list_extract(['PREPARE', 'AUTHORIZE', 'APPLY', 'VERIFY'], place) AS phase, place, coalesce(lag(place) OVER (PARTITION BY record_id ORDER BY t, list_extract(['PREPARE', 'AUTHORIZE', 'APPLY', 'VERIFY'], place)), 0) AS prev FROM p)
SELECT phase, count(*) AS n FROM n WHERE prev + 1 <> place GROUP BY phase""",
    "i8_verification": f"""
WITH {_CHECKED}, f AS (SELECT regexp_extract(tc_handle, '(\\d+)', 1) AS band, * FROM own),
m AS (SELECT CASE band WHEN '1' THEN 'NETWORK_LATENCY' WHEN '2' THEN 'PACKET_LOSS' ELSE 'SERVICE_DEGRADATION' END AS fault,
  coalesce(CASE band WHEN '1' THEN precision_achieved * latency_ms >= coalesce(latency_ms, 0) / 2 WHEN '2' THEN packet_loss_pct > 0 ELSE jitter_ms * 5 >= 50 END, false) AS confirmed FROM f)
SELECT fault, confirmed, count(*) AS n FROM m GROUP BY ALL""",
    "i9_manifest": f"""
WITH want(split, expected) AS (VALUES ('DEVELOPMENT', 1), ('VALIDATION', 1), ('HELD_OUT_TEST', 0), ('OTHER', 0)), have AS (SELECT {sql.LABEL.format('split')} AS split, count(DISTINCT fault_id) AS n FROM scenarios GROUP BY ALL)
SELECT split, expected::BIGINT AS expected, coalesce(n, 0) AS n FROM want LEFT JOIN have USING (split) WHERE coalesce(n, 0) <> expected""",
    "i10_gate": """
WITH p AS (SELECT *, coalesce(replicas, 0) AS r FROM services), g AS (
  SELECT *, CASE WHEN NOT instrumented THEN 'KILL_SWITCH' WHEN NOT regexp_matches(namespace, '-eval-[a-z]$') OR namespace NOT IN (SELECT DISTINCT namespace FROM services ORDER BY namespace LIMIT 3) THEN 'NAMESPACE' WHEN r = 3 THEN 'TARGET'
    WHEN r * 100 + 30 > 600 THEN 'BUDGET' WHEN replicas IS NULL THEN 'DATA_MUTATION' END AS hard_stop FROM p)
SELECT service_id, hard_stop, concat_ws(',', CASE WHEN r / 10 >= 0.3::DOUBLE THEN 'BLAST_RADIUS' END, CASE WHEN r / 100 >= 0.05::DOUBLE THEN 'SLA_IMPACT' END) AS warnings,
  CASE WHEN r = 1 THEN 'AUTONOMOUS' WHEN r / 10 < 0.1::DOUBLE AND r / 100 < 0.01::DOUBLE THEN 'AUTONOMOUS' WHEN 1 - r / 5 < 0.3::DOUBLE THEN 'DENIED' ELSE 'SUPERVISED' END AS level, CASE WHEN hard_stop IS NULL THEN 'ALLOW' ELSE 'DENY' END AS decision FROM g""",
    "i13_failures": """
WITH c AS (SELECT run_id, record_no, max(CASE notes WHEN 'retry' THEN 'TELEMETRY_GAP' WHEN 'warm cache' THEN 'NO_DIVERGENCE' WHEN 'shared host' THEN 'INSUFFICIENT_EVIDENCE' END) AS code FROM stage_log WHERE run_id IS NOT NULL AND record_no IS NOT NULL GROUP BY ALL),
f AS (SELECT run_id, arg_min(code, record_no) AS primary_code, bool_and(code <> 'TELEMETRY_GAP') AS is_abstention FROM c WHERE code IS NOT NULL GROUP BY run_id)
SELECT primary_code, is_abstention, count(*) AS n FROM f GROUP BY ALL""",
    "b1_observational": f"""
WITH RECURSIVE r AS ({sql.SQL['a12_ranking']}), z AS (WITH {sql.DEVIATIONS} SELECT incident_id, service_id, mean_z FROM scores),
j AS (SELECT r.*, mean_z, bool_or(confidence <> 'NONE') OVER (PARTITION BY incident_id) AS sure, row_number() OVER (PARTITION BY incident_id ORDER BY mean_z DESC, service_id) AS k FROM r JOIN z USING (incident_id, service_id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY mean_z DESC, service_id) AS rn FROM j WHERE CASE WHEN sure THEN confidence <> 'NONE' ELSE k <= 3 END),
best AS (SELECT incident_id, string_agg(service_id, ',' ORDER BY rn) AS services FROM kept WHERE rn <= 5 GROUP BY incident_id),
late AS (SELECT incident_id, (min(t_star_ms) - any_value(CAST(round(t_start * 1000) AS BIGINT))) / 1000 AS s FROM r JOIN incidents USING (incident_id) GROUP BY incident_id)
SELECT 'OBS' AS method, incident_id, coalesce(services, '') AS services, services IS NULL AS abstained, CASE WHEN services IS NULL THEN 'NO_DIVERGENCE' END AS abstention_reason, CASE WHEN services IS NOT NULL THEN round(s, 3) END AS latency_s, 0.0::DOUBLE AS total_ed_s
FROM (SELECT DISTINCT incident_id FROM incidents) LEFT JOIN best USING (incident_id) LEFT JOIN late USING (incident_id)""",
    "b4_sieve": f"""
WITH RECURSIVE {sql.CLOSURE}, {sql.DEVIATIONS.strip()},
gains AS (SELECT a.incident_id, a.service_id, sum(power(0.5::DOUBLE, depth * (depth + 1) / 2) * b.max_z) AS g FROM scores a JOIN reach ON reach.src = a.service_id AND depth <= 5 JOIN scores b ON b.incident_id = a.incident_id AND b.service_id = reach.dst GROUP BY ALL),
placed AS (SELECT s.incident_id, s.service_id, row_number() OVER (PARTITION BY s.incident_id ORDER BY max_z + coalesce(g, 0) DESC, s.service_id) AS rn FROM scores s LEFT JOIN gains USING (incident_id, service_id) WHERE max_z > 3),
best AS (SELECT incident_id, string_agg(service_id, ',' ORDER BY rn) AS services FROM placed WHERE rn <= 5 GROUP BY incident_id)
SELECT 'SIEVE' AS method, incident_id, coalesce(services, '') AS services, services IS NULL AS abstained, CASE WHEN services IS NULL THEN 'NO_ANOMALY' END AS abstention_reason, CAST(NULL AS DOUBLE) AS latency_s, 0.0::DOUBLE AS total_ed_s
FROM (SELECT DISTINCT incident_id FROM incidents) LEFT JOIN best USING (incident_id)""",
    "b7_ochiai": f"""
WITH {sql.DEVIATIONS}, failed AS (SELECT incident_id, coalesce(max(v) > 0.1, false) AS failed FROM aligned WHERE metric_name = 'err_rate' AND v IS NOT NULL GROUP BY incident_id),
ev AS (SELECT service_id, max_z > 3 AS hot, coalesce(failed, false) AS failed FROM scores LEFT JOIN failed USING (incident_id)),
c AS (SELECT service_id, count(*) FILTER (WHERE hot AND failed) AS n_af, count(*) FILTER (WHERE hot AND NOT failed) AS n_as, count(*) FILTER (WHERE failed) AS n_f FROM ev GROUP BY service_id)
SELECT *, round(CASE WHEN n_f * (n_af + n_as) > 0 THEN n_af / sqrt(n_f * (n_af + n_as)) ELSE 0 END, 6) AS score FROM c""",
    "m3_models": _model_sql(),
    "b7_page_rank": f"""
WITH RECURSIVE {sql.PATHS}, {sql.DEVIATIONS.strip()},
weights AS (SELECT s.service_id, coalesce(w, 0) AS w FROM services s LEFT JOIN (SELECT service_id, count(*) AS w FROM scores WHERE max_z > 3 GROUP BY service_id) USING (service_id)),
base AS (SELECT service_id, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 0.0::DOUBLE END AS b FROM weights),
back AS (SELECT dst AS service_id, src AS into_id, count(*) OVER (PARTITION BY dst) AS deg FROM edges),
rank AS (
  SELECT 0 AS k, service_id, b, b AS score FROM base
  UNION ALL
  SELECT k + 1, service_id, b, 0.15::DOUBLE * b + 0.85::DOUBLE * (coalesce((SELECT sum(r.score / back.deg) FROM rank r JOIN back USING (service_id) WHERE back.into_id = rank.service_id), 0)
         + b * coalesce((SELECT sum(r.score) FROM rank r WHERE r.service_id NOT IN (SELECT service_id FROM back)), 0)) FROM rank WHERE k < 150)
SELECT service_id, round(score, 6) AS score FROM rank WHERE k = 150""",
    "c9_identify": f"""
WITH RECURSIVE {sql.PATHS}, {sql.OWN_REACH},
once AS (SELECT DISTINCT ON (fault_id) fault_id, confounded, causal_path FROM scenarios),
steps AS (SELECT fault_id, confounded, i, {sql.NAME.format('e[1]')} AS src, {sql.NAME.format('e[2]')} AS dst FROM (SELECT fault_id, confounded, unnest(causal_path) AS e, unnest(range(len(causal_path))) AS i FROM once) WHERE e[1] IS NOT NULL AND e[2] IS NOT NULL),
sure AS (SELECT DISTINCT fault_id, src, dst FROM steps), hid AS (SELECT DISTINCT fault_id, src, dst FROM steps WHERE confounded AND i = 0),
both_ways AS (SELECT fault_id, src AS a, dst AS b FROM hid UNION SELECT fault_id, dst, src FROM hid),
nodes AS (SELECT fault_id, src AS x FROM sure UNION SELECT fault_id, dst FROM sure),
ask AS (SELECT n.fault_id, n.x AS src, m.x AS dst FROM nodes n JOIN nodes m ON m.fault_id = n.fault_id AND m.x <> n.x),
turned AS (SELECT DISTINCT s.fault_id, s.dst AS src FROM sure s JOIN own_walk w ON w.fault_id = s.fault_id AND w.src = s.dst AND w.dst = s.src),
parents AS (SELECT fault_id, dst AS src, string_agg(src, ',' ORDER BY src) AS adj FROM sure GROUP BY ALL),
mids AS (SELECT a.fault_id, a.src, b.dst, string_agg(DISTINCT a.dst, ',' ORDER BY a.dst) AS m FROM sure a JOIN sure b ON b.fault_id = a.fault_id AND b.src = a.dst GROUP BY ALL),
ivs AS (SELECT ask.fault_id, ask.src, ask.dst, min(s.src) AS iv FROM ask JOIN sure s ON s.fault_id = ask.fault_id AND s.dst = ask.src
        WHERE NOT EXISTS (SELECT 1 FROM both_ways h WHERE h.fault_id = ask.fault_id AND h.a = s.src AND h.b = ask.dst) GROUP BY ALL),
facts AS (
  SELECT ask.*, EXISTS (SELECT 1 FROM both_ways h WHERE h.fault_id = ask.fault_id AND h.a = ask.src) AS hidden, m, iv, w.src IS NOT NULL AS way, d.src IS NULL AS apart,
         CASE WHEN t.src IS NULL THEN coalesce(adj, '') ELSE '' END AS adj
  FROM ask LEFT JOIN mids USING (fault_id, src, dst) LEFT JOIN ivs USING (fault_id, src, dst) LEFT JOIN own_walk w USING (fault_id, src, dst) LEFT JOIN sure d USING (fault_id, src, dst)
  LEFT JOIN parents USING (fault_id, src) LEFT JOIN turned t USING (fault_id, src)),
said AS (SELECT *, CASE WHEN NOT hidden THEN 'BACKDOOR' WHEN m IS NOT NULL AND apart THEN 'FRONTDOOR' WHEN way AND iv IS NOT NULL THEN 'INSTRUMENT' ELSE 'NONE' END AS method FROM facts)
SELECT fault_id, src, dst, CASE method WHEN 'BACKDOOR' THEN 'IDENTIFIABLE' WHEN 'FRONTDOOR' THEN 'IDENTIFIABLE' WHEN 'INSTRUMENT' THEN 'CONDITIONALLY_IDENTIFIABLE' ELSE CASE WHEN way THEN 'REQUIRES_INTERVENTION' ELSE 'NOT_IDENTIFIABLE' END END AS status, method,
  CASE WHEN method = 'BACKDOOR' THEN adj END AS adjustment, CASE WHEN method = 'FRONTDOOR' THEN m END AS mediators, CASE WHEN method = 'INSTRUMENT' THEN iv END AS instrument FROM said""",
    "d9_evaluate": f"""
WITH {sql.SAMPLES} SELECT incident_id, service_id, coalesce(w1.n_base, 0) AS n_base, coalesce(w1.n_post, 0) AS n_post, round(coalesce(w1.w1, 0), 6) AS w1, round(coalesce(theta.theta, 0), 6) AS theta, round(coalesce(tv.tv, 0), 6) AS tv,
  coalesce(w1.w1 > coalesce(theta.theta, 0), false) AS exceeds FROM (SELECT DISTINCT incident_id, service_id FROM samples) LEFT JOIN w1 USING (incident_id, service_id) LEFT JOIN theta USING (incident_id, service_id) LEFT JOIN tv USING (incident_id, service_id)""",
    "e6_interval": f"""
WITH {sql.PAIRS}, two AS (SELECT metric_name, 'x' AS side, x AS v FROM pairs UNION ALL SELECT metric_name, 'y', y FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY metric_name, side ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY metric_name, side) AS n FROM two),
d AS (SELECT metric_name, side, rep, (CASE WHEN side = 'x' THEN {more._draw(43, 'rep', 'i')} ELSE {more._draw(44, 'rep', 'i')} END % n)::BIGINT AS i FROM r CROSS JOIN range(0, 2000) t(rep)),
v AS (SELECT metric_name, side, rep, v, n FROM d JOIN r USING (metric_name, side, i)),
ranked AS (SELECT *, rank() OVER (PARTITION BY metric_name, rep ORDER BY v) + (count(*) OVER (PARTITION BY metric_name, rep, v) - 1) / 2 AS rk FROM v),
u AS (SELECT metric_name, rep, sum(rk) FILTER (WHERE side = 'x') AS rx, count(*) FILTER (WHERE side = 'x') AS nx, count(*) FILTER (WHERE side = 'y') AS ny FROM ranked GROUP BY ALL)
SELECT metric_name, round(quantile_cont(2 * (rx - nx * (nx + 1) / 2) / (nx * ny) - 1, 0.025), 6) AS low, round(quantile_cont(2 * (rx - nx * (nx + 1) / 2) / (nx * ny) - 1, 0.975), 6) AS high FROM u GROUP BY metric_name""",
    "e7_pvalues": _RANKS + " SELECT metric_name, n, w_plus, round(p, 6) + 0.0::DOUBLE AS p FROM tests",
    "e12_confirmatory": _RANKS + """, placed AS (SELECT *, row_number() OVER (ORDER BY p, metric_name) AS r, count(*) OVER () AS m FROM tests)
SELECT 'H' AS family, metric_name AS hypothesis, round(p, 6) + 0.0::DOUBLE AS p, round(0.05::DOUBLE / (m - r + 1), 9) AS threshold, p <= 0.05::DOUBLE / (m - r + 1) AS rejected FROM placed""",
    "e9_binomial": f"WITH {sql.PVALUES} SELECT family AS method_id, hypothesis AS stage_name, k, n, round(p, 6) + 0.0::DOUBLE AS p FROM pvalues",
    "e13_power": f"WITH c AS (SELECT {sql.LABEL.format('split')} AS split, count(DISTINCT fault_id) AS n FROM scenarios WHERE split IS NOT NULL GROUP BY ALL), z AS (SELECT *, 1.6448536269514722::DOUBLE - 0.3::DOUBLE * sqrt(3 * n) AS z FROM c) SELECT split, n, round({upper_tail('z')}, 6) AS power FROM z",
    "e14_power": f"""
WITH c AS (SELECT count(DISTINCT fault_id) + count(DISTINCT CASE WHEN fault_id IS NULL THEN 1 END) AS n FROM scenarios), many AS (SELECT i AS n FROM range(1, 1000) t(i)),
z AS (SELECT n, 1.6448536269514722::DOUBLE - 0.3::DOUBLE * sqrt(3 * n) AS z FROM (SELECT n FROM c UNION SELECT n FROM many)), pw AS (SELECT n, {upper_tail('z')} AS power FROM z)
SELECT c.n, round(pw.power, 6) AS power, (SELECT min(n) FROM pw WHERE power >= 0.8)::INT AS required_n FROM c JOIN pw USING (n)""",
    "e15_pairing": f"""
WITH once AS (SELECT *, {sql.NAME.format('stage_name')} AS stage FROM (SELECT *, row_number() OVER (PARTITION BY record_no ORDER BY ingested_at DESC) AS rn FROM stage_log WHERE record_no IS NOT NULL) WHERE rn = 1 AND run_id IS NOT NULL AND isfinite(wall_time_s) AND wall_time_s >= 0),
x AS (SELECT run_id, wall_time_s AS v, row_number() OVER (PARTITION BY run_id ORDER BY record_no, wall_time_s) AS k FROM once WHERE stage = 'collect'),
y AS (SELECT run_id, wall_time_s AS v, row_number() OVER (PARTITION BY run_id ORDER BY record_no, wall_time_s) AS k FROM once WHERE stage = 'fci')
SELECT run_id, count(*) AS n_pairs, round(sum(x.v - y.v), 3) AS difference FROM x JOIN y USING (run_id, k) GROUP BY run_id""",
}
