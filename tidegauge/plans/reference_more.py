"""Further queries of the reference's operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import norm_label, norm_name
from tidegauge.operators import align, causal, diverge, evaluate, graph, guard, methods, select
from tidegauge.plans import reference as base
from tidegauge.plans import reference_sql as sql
from tidegauge.plans.pipeline import Analysis
from tidegauge.plans.runtime import load
from tidegauge.sources import scenarios as generated
from tidegauge.sources import telemetry

KEY = ["incident_id", "service_id"]


def s6_mock(spark: SparkSession, d: str) -> DataFrame:
    """Mock readings of every service."""
    names = [r.service_id for r in load(spark, d, "services").select("service_id").distinct().orderBy("service_id").collect()]
    return telemetry.mock_series(spark, names).groupBy("service_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def s7_generated(spark: SparkSession, d: str) -> DataFrame:
    return generated.generated_scenarios(spark).groupBy("fault_type", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("causal_path")).alias("n_edges"))


def s23_gate(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the stage log that are live and not substituted, by method; a run is live if its notes are empty."""
    runs = load(spark, d, "stage_log").groupBy("run_id").agg((F.max(F.length(F.coalesce("notes", F.lit("")))) == 0).alias("live"), F.max(F.coalesce("method_id", F.lit(""))).alias("method"))
    return telemetry.gate_runs(runs.withColumn("substituted", F.col("method") == "oracle_ref")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def t7_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = align.parse_readings(load(spark, d, "raw_metrics")).join(align.grid_of(load(spark, d, "incidents")), "incident_id")
    return rows.groupBy("incident_id", align.window_index(F.col("ts_ms") - F.col("start_ms"), F.col("delta_ms")).alias("window_id")).agg(F.count(F.lit(1)).alias("n"))


def g7_directed(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges of the oracle graphs and those that also hide a common cause."""
    pag = causal.pag_from_paths(load(spark, d, "scenarios"))
    return pag.groupBy("src", "dst").agg(F.count_if(F.col("edge_type") == "DIRECTED").alias("n_directed"), F.count_if(F.col("edge_type") == "BIDIRECTED").alias("n_bidirected"))


def g13_propagation(spark: SparkSession, d: str) -> DataFrame:
    a = Analysis(spark, d)
    seeds = a.scores.select(*KEY, F.round("max_z", 2).alias("score"))
    return graph.propagation_scores(seeds, graph.closure(a.edges, [], 5, paths=False)).select(*KEY, F.round("propagated", 8).alias("propagated"))


def c10_backdoor(spark: SparkSession, d: str) -> DataFrame:
    """Mean duration under each fault type, adjusted for the split."""
    rows = load(spark, d, "scenarios").dropDuplicates(["fault_id"]).select(norm_label("fault_type").alias("fault"), norm_label("split").alias("split"), (F.col("expected_recovery_t") - F.col("injected_at_t")).alias("duration")).dropna()
    return causal.backdoor_effect(rows, "fault", "duration", ["split"]).select("fault", F.round("effect", 4).alias("effect"), F.round("support", 6).alias("support"))


def l13_stopping(spark: SparkSession, d: str) -> DataFrame:
    """Why the loop of each incident would stop after probing every candidate once."""
    hot = base.detect.over_threshold(Analysis(spark, d).scores).select(*KEY, F.round("max_z", 2).alias("score"))
    prior = select.initial_posterior(hot, ["incident_id"])
    facts = prior.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") > 0).alias("n_positive"), F.sum("p").alias("mass")).join(select.entropy(prior, ["incident_id"]), "incident_id")
    return facts.select("incident_id", "n", select.stopping_reason(600.0 - 30.0 * F.col("n"), F.lit(False), F.col("mass"), F.col("entropy"), F.col("n_positive")).alias("reason"))


def i2_bands(spark: SparkSession, d: str) -> DataFrame:
    return guard.shaping_command(load(spark, d, "interventions")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count("command").alias("n_commands"))


def i3_isolation(spark: SparkSession, d: str) -> DataFrame:
    means = Analysis(spark, d).samples.groupBy(*KEY, "side").agg(F.avg("value").alias("value"))
    rows = guard.isolation_check(means.filter("side = 'base'").drop("side"), means.filter("side = 'post'").drop("side"), KEY)
    return rows.select(*KEY, F.round("change", 5).alias("change"), "affected")


def i6_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = guard.valid_latest(load(spark, d, "interventions")).filter("destination_service is not null")
    order = Window.partitionBy("destination_service").orderBy("record_id")
    return rows.select("record_id", guard.band_of(F.row_number().over(order) - 1).alias("band"))


def i12_latch(spark: SparkSession, d: str) -> DataFrame:
    rows = guard.kill_latch(guard.valid_latest(load(spark, d, "interventions")).filter("destination_service is not null"), ["destination_service"])
    return rows.groupBy("destination_service").agg(F.count(F.lit(1)).alias("n"), F.count_if("latched").alias("n_latched"))


def b5_oracle(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "scenarios").filter("fault_id is not null").dropDuplicates(["fault_id"])
    truth = s.select(F.col("fault_id").alias("incident_id"), norm_name("root_cause_service").alias("root"))
    services = s.select(F.col("fault_id").alias("incident_id"), F.explode(F.transform("affected_services", norm_name)).alias("service_id")).distinct()
    return base._listed(methods.oracle(truth, truth, services))


def b6_unavailable(spark: SparkSession, d: str) -> DataFrame:
    return base._listed(methods.unavailable(load(spark, d, "incidents")))


def e2_tiers(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.tier_summary(Analysis(spark, d).ranked)
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


def e5_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the accuracy of each method."""
    rows = evaluate.precision_at(base._results(spark, d), 1).select("method", F.col("fault_id").alias("idx"), F.col("hit_1").cast("double").alias("score"))
    return evaluate.bootstrap_mean(rows, ["method"], 2000).select("method", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def e12_confirmatory(spark: SparkSession, d: str) -> DataFrame:
    """One-sided signed-rank p-values of each metric with Holm's thresholds."""
    tests = evaluate.wilcoxon_pvalues(evaluate.signed_ranks(base._pairs(spark, d).select("metric_name", "x", "y"), ["metric_name"]))
    out = evaluate.holm(tests.select(F.lit("H").alias("family"), F.col("metric_name").alias("hypothesis"), "p"), ["family"])
    return out.select("family", "hypothesis", (F.round("p", 6) + 0.0).alias("p"), F.round("threshold", 9).alias("threshold"), "rejected")


def e16_validation(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy without confounding, confounded scenarios handled, and false attributions."""
    rows = evaluate.precision_at(base._results(spark, d), 1)
    plain = F.when(~F.col("confounded"), F.col("hit_1").cast("double"))
    handled = F.when(F.col("confounded"), F.col("abstained").cast("double"))
    wrong = F.when(~F.col("confounded"), (~F.col("hit_1") & ~F.col("abstained")).cast("double"))
    return rows.groupBy("method").agg(F.round(F.avg(plain), 6).alias("plain_p1"), F.round(F.avg(handled), 6).alias("confounded_handled"), F.round(F.avg(wrong), 6).alias("false_attribution"))


def e20_complete(spark: SparkSession, d: str) -> DataFrame:
    """Attribution, cost and interval of each method in one row."""
    results = base._results(spark, d)
    scores = evaluate.precision_at(results, 1).select("method", F.col("fault_id").alias("idx"), F.col("hit_1").cast("double").alias("score"))
    out = evaluate.attribution_metrics(results).drop("total_ed_s").join(evaluate.cost_metrics(results), "method").join(evaluate.bootstrap_mean(scores, ["method"], 2000), "method")
    return out.withColumns({c: F.round(c, 4) for c, t in out.dtypes if t == "double"})


def d10_monotone(spark: SparkSession, d: str) -> DataFrame:
    """W1 between each series and itself moved by 0, 5, 10 and 20: it must not fall."""
    rows = Analysis(spark, d).samples.select(*KEY, "idx", "side", "value")
    many = rows.select(*KEY, "idx", "value", F.explode(F.array(*(F.lit(float(x)) for x in (0, 5, 10, 20)))).alias("shift"))
    two = many.withColumn("side", F.lit("base")).unionByName(many.select(*KEY, "idx", (F.col("value") + F.col("shift")).alias("value"), "shift", F.lit("post").alias("side")))
    w = diverge.wasserstein(two, [*KEY, "shift"]).select(F.concat_ws("/", *KEY).alias("case"), "shift", F.round("w1", 6).alias("w1"))
    return diverge.monotone(w).groupBy("monotone").agg(F.count(F.lit(1)).alias("n_cases"))


QUERIES = {f.__name__: f for f in (s6_mock, s7_generated, s23_gate, t7_windows, g7_directed, g13_propagation, c10_backdoor, l13_stopping, i2_bands, i3_isolation, i6_turns, i12_latch, b5_oracle, b6_unavailable, e2_tiers, e5_bootstrap, e12_confirmatory, e16_validation, e20_complete, d10_monotone)}

_FULL = "18446744073709551616::UHUGEINT"


def _times(x: str, c: int) -> str:
    return f"((({x})::UHUGEINT * {c}::UHUGEINT) % {_FULL})::UBIGINT"


def _draw(seed: int, rep: str, i: str) -> str:
    """The 64-bit number of (replicate, place): the finalizer of splitmix64 over a linear form."""
    a, b, c = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    x = f"(({seed}::UHUGEINT * {a}::UHUGEINT % {_FULL} + {rep}::UHUGEINT * {b}::UHUGEINT % {_FULL} + {i}::UHUGEINT * {c}::UHUGEINT % {_FULL}) % {_FULL})::UBIGINT"
    x = f"(SELECT {_times('xor(u, u >> 30)', b)} FROM (SELECT {x} AS u))"
    x = f"(SELECT {_times('xor(u, u >> 27)', c)} FROM (SELECT {x} AS u))"
    return f"(SELECT xor(u, u >> 31) FROM (SELECT {x} AS u))"


_BY_METRIC = sql.ALIGNED + """,
means AS (SELECT metric_name AS method_id, CASE WHEN incident_id % 2 = 0 THEN 'base' ELSE 'post' END AS side, incident_id || '/' || service_id AS idx, round(avg(v), 3) AS v
          FROM aligned WHERE v IS NOT NULL GROUP BY metric_name, incident_id, service_id)"""


def _w1(table: str, keys: str) -> str:
    """W1 of each key of a table of (keys, side, v)."""
    return f"""
  SELECT {keys}, coalesce(sum(abs(gap) * width), 0) AS w FROM (
    SELECT {keys}, lead(v) OVER o - v AS width, count(*) FILTER (WHERE side = 'base') OVER u / na - count(*) FILTER (WHERE side = 'post') OVER u / nb AS gap
    FROM (SELECT *, count(*) FILTER (WHERE side = 'base') OVER k AS na, count(*) FILTER (WHERE side = 'post') OVER k AS nb FROM {table} WINDOW k AS (PARTITION BY {keys})) WHERE na > 0 AND nb > 0
    WINDOW o AS (PARTITION BY {keys} ORDER BY v), u AS (PARTITION BY {keys} ORDER BY v ROWS UNBOUNDED PRECEDING)) GROUP BY {keys}"""


def _permuted(table: str, key: list[str], replicates: int) -> str:
    """``tested``: permutation p-value of W1 for each key of a table of (key, side, v)."""
    k = ", ".join(key)
    same = " AND ".join(f"n.{c} = s.{c}" for c in key)
    return f"""
perm_r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY side, v) - 1 AS i, count(*) FILTER (WHERE side = 'base') OVER (PARTITION BY {k}) AS na FROM {table}),
perm_h AS (SELECT {k}, rep, v, na, {_draw(42, 'rep', 'i')} AS h FROM perm_r CROSS JOIN range(0, {replicates}) t(rep)),
perm_many AS (SELECT {k}, rep, v, CASE WHEN row_number() OVER (PARTITION BY {k}, rep ORDER BY h) <= na THEN 'base' ELSE 'post' END AS side FROM perm_h),
perm_w AS ({_w1('perm_many', k + ', rep')}), perm_seen AS ({_w1(table, k)}),
tested AS (SELECT {', '.join('n.' + c for c in key)}, (count(*) FILTER (WHERE n.w >= s.w - 1e-9 * greatest(1, s.w)) + 1) / (count(*) + 1) AS p_value FROM perm_w n JOIN perm_seen s ON {same} GROUP BY ALL)"""


def _resampled(table: str, key: list[str], replicates: int) -> str:
    """``boot``: interval of W1 over resamples of both sides for each key of a table of (key, side, v)."""
    k = ", ".join(key)
    return f"""
boot_r AS (SELECT *, row_number() OVER (PARTITION BY {k}, side ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY {k}, side) AS n FROM {table}),
boot_d AS (SELECT {k}, side, rep, (CASE WHEN side = 'base' THEN {_draw(43, 'rep', 'i')} ELSE {_draw(44, 'rep', 'i')} END % n)::BIGINT AS i FROM boot_r CROSS JOIN range(0, {replicates}) t(rep)),
boot_v AS (SELECT {k}, side, rep, v FROM boot_d JOIN boot_r USING ({k}, side, i)),
boot_w AS ({_w1('boot_v', k + ', rep')}),
boot AS (SELECT {k}, quantile_cont(w, 0.025) AS low, quantile_cont(w, 0.975) AS high FROM boot_w GROUP BY {k})"""


def _boot_mean() -> str:
    return f"""
mean_r AS (SELECT method, hit_1::INT::DOUBLE AS score, row_number() OVER (PARTITION BY method ORDER BY hit_1::INT) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM judged),
mean_d AS (SELECT method, rep, ({_draw(42, 'rep', 'i')} % n)::BIGINT AS i FROM mean_r CROSS JOIN range(0, 2000) t(rep)),
mean_m AS (SELECT method, rep, avg(score) AS m FROM mean_d JOIN mean_r USING (method, i) GROUP BY ALL),
boot AS (SELECT method, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM mean_m GROUP BY method)"""


def _attribution() -> str:
    return "attribution AS (" + sql.SQL["e1_attribution"].split(sql.RESULTS)[1] + ")"


def _cost() -> str:
    return "cost AS (SELECT method, avg(total_ed_s) AS mean_ed_s, quantile_cont(total_ed_s, 0.5) AS median_ed_s, sum(total_ed_s) AS sum_ed_s, max(total_ed_s) AS max_ed_s, avg(total_ed_s) / 600 AS mean_budget_share FROM results GROUP BY method)"


SQL = {
    "s7_generated": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{s}', {n}, {e})" for t, s, n, e in (
        ("NETWORK_LATENCY", "DEVELOPMENT", 2, 4), ("NETWORK_LATENCY", "VALIDATION", 1, 2), ("PACKET_LOSS", "DEVELOPMENT", 2, 2), ("PACKET_LOSS", "VALIDATION", 1, 1),
        ("SERVICE_DEGRADATION", "DEVELOPMENT", 2, 4), ("SERVICE_DEGRADATION", "VALIDATION", 1, 2), ("RESOURCE_CONTENTION", "DEVELOPMENT", 2, 0), ("RESOURCE_CONTENTION", "VALIDATION", 1, 0),
        ("QUEUEING", "DEVELOPMENT", 2, 4), ("QUEUEING", "HELD_OUT_TEST", 1, 2), ("DEPENDENCY_FAILURE", "DEVELOPMENT", 1, 2), ("DEPENDENCY_FAILURE", "VALIDATION", 1, 2), ("DEPENDENCY_FAILURE", "HELD_OUT_TEST", 1, 2),
        ("MULTI_CAUSE", "DEVELOPMENT", 1, 3), ("MULTI_CAUSE", "VALIDATION", 1, 3), ("MULTI_CAUSE", "HELD_OUT_TEST", 1, 3),
        ("CONFOUNDED", "DEVELOPMENT", 24, 24), ("CONFOUNDED", "VALIDATION", 12, 12), ("CONFOUNDED", "HELD_OUT_TEST", 12, 12))) + ") AS t(fault_type, split, n, n_edges)",
    "s23_gate": "SELECT method, count(*) AS n FROM (SELECT run_id, max(length(coalesce(notes, ''))) = 0 AS live, max(coalesce(method_id, '')) AS method FROM stage_log GROUP BY run_id) WHERE live AND method <> 'oracle_ref' GROUP BY method",
    "t7_windows": f"WITH {sql.READINGS} SELECT incident_id, CAST(floor((t - s) / w) AS BIGINT) AS window_id, count(*) AS n FROM readings JOIN grid USING (incident_id) GROUP BY ALL",
    "g7_directed": f"""
WITH once AS (SELECT DISTINCT ON (fault_id) fault_id, confounded, causal_path FROM scenarios),
steps AS (SELECT fault_id, confounded, i, {sql.NAME.format('e[1]')} AS src, {sql.NAME.format('e[2]')} AS dst FROM (SELECT fault_id, confounded, unnest(causal_path) AS e, unnest(range(len(causal_path))) AS i FROM once)),
pag AS (SELECT DISTINCT fault_id, src, dst, 1 AS a, 0 AS b FROM steps UNION ALL SELECT fault_id, src, dst, 0, 1 FROM steps WHERE confounded AND i = 0)
SELECT src, dst, CAST(sum(a) AS BIGINT) AS n_directed, CAST(sum(b) AS BIGINT) AS n_bidirected FROM pag GROUP BY ALL""",
    "g13_propagation": f"""
WITH RECURSIVE {sql.CLOSURE}, {sql.DEVIATIONS.strip()}, seeds AS (SELECT incident_id, service_id, round(max_z, 2) AS score FROM scores),
gains AS (SELECT a.incident_id, a.service_id, sum(power(0.5::DOUBLE, depth * (depth + 1) / 2) * b.score) AS g
          FROM seeds a JOIN reach ON reach.src = a.service_id AND depth <= 5 JOIN seeds b ON b.incident_id = a.incident_id AND b.service_id = reach.dst GROUP BY ALL)
SELECT incident_id, service_id, round(score + coalesce(g, 0), 8) AS propagated FROM seeds LEFT JOIN gains USING (incident_id, service_id)""",
    "c10_backdoor": f"""
WITH r AS (SELECT {sql.LABEL.format('fault_type')} AS fault, {sql.LABEL.format('split')} AS split, expected_recovery_t - injected_at_t AS y FROM (SELECT DISTINCT ON (fault_id) * FROM scenarios)
           WHERE fault_type IS NOT NULL AND split IS NOT NULL AND expected_recovery_t IS NOT NULL AND injected_at_t IS NOT NULL),
z AS (SELECT split, count(*) AS nz FROM r GROUP BY split), c AS (SELECT fault, split, avg(y) AS y FROM r GROUP BY ALL)
SELECT fault, round(sum(y * nz) / (SELECT count(*) FROM r), 4) AS effect, round(sum(nz) / (SELECT count(*) FROM r), 6) AS support FROM c JOIN z USING (split) GROUP BY fault""",
    "l13_stopping": f"""
WITH {sql.HOT}, facts AS (SELECT incident_id, count(*) AS n, sum(p) AS mass, -sum(p * ln(p)) AS h FROM prior GROUP BY incident_id)
SELECT incident_id, n, CASE WHEN 600 - 30 * n <= 0 THEN 'BUDGET_EXHAUSTED' WHEN mass <= 0 THEN 'NO_CANDIDATES' WHEN h < 0.5 AND n >= 2 THEN 'ENTROPY_CONVERGED' END AS reason FROM facts""",
    "i2_bands": "SELECT band, count(*) AS n, count(*) FILTER (WHERE band BETWEEN 1 AND 3 AND interface IS NOT NULL) AS n_commands FROM (SELECT try_cast(regexp_extract(tc_handle, '(\\d+)', 1) AS INT) AS band, interface FROM interventions) GROUP BY band",
    "i3_isolation": f"""
WITH {sql.SAMPLES}, m AS (SELECT incident_id, service_id, avg(v) FILTER (WHERE side = 'base') AS b, avg(v) FILTER (WHERE side = 'post') AS a FROM samples GROUP BY ALL)
SELECT incident_id, service_id, round(CASE WHEN b > 0 THEN abs(a - b) / b END, 5) AS change, coalesce(b > 0 AND abs(a - b) / b > 0.2::DOUBLE, false) AS affected FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
    "i6_turns": f"WITH {sql.LATEST} SELECT record_id, (row_number() OVER (PARTITION BY destination_service ORDER BY record_id) - 1) % 3 + 1 AS band FROM latest WHERE destination_service IS NOT NULL",
    "i12_latch": f"""
WITH last AS (SELECT *, {sql.NAME.format('destination_service')} AS service FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM interventions WHERE record_id IS NOT NULL) WHERE rn = 1 AND destination_service IS NOT NULL),
l AS (SELECT service, max(CASE WHEN {sql.LABEL.format('status')} = 'FAILED' OR rollback_attempts > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY ingested_at, record_id ROWS UNBOUNDED PRECEDING) AS latched FROM last)
SELECT service AS destination_service, count(*) AS n, CAST(sum(latched) AS BIGINT) AS n_latched FROM l GROUP BY service""",
    "b5_oracle": f"""
WITH once AS (SELECT DISTINCT ON (fault_id) fault_id, {sql.NAME.format('root_cause_service')} AS root, affected_services FROM scenarios WHERE fault_id IS NOT NULL),
s AS (SELECT DISTINCT fault_id, root, service FROM (SELECT fault_id, root, unnest(list_transform(affected_services, lambda x: {sql.NAME.format('x')})) AS service FROM once)),
r AS (SELECT *, row_number() OVER (PARTITION BY fault_id ORDER BY CASE WHEN service = root THEN 0 ELSE 1 END, service) AS rn FROM s),
best AS (SELECT fault_id, string_agg(service, ',' ORDER BY rn) AS services FROM r WHERE rn <= 5 GROUP BY fault_id)
SELECT 'ORACLE' AS method, fault_id AS incident_id, coalesce(services, '') AS services, services IS NULL AS abstained, CASE WHEN services IS NULL THEN 'NO_TRUTH' END AS abstention_reason,
  CAST(NULL AS DOUBLE) AS latency_s, 0.0::DOUBLE AS total_ed_s FROM once LEFT JOIN best USING (fault_id)""",
    "b6_unavailable": "SELECT 'SAGE_CHAOS' AS method, incident_id, '' AS services, true AS abstained, 'NOT_IMPLEMENTED' AS abstention_reason, CAST(NULL AS DOUBLE) AS latency_s, 0.0::DOUBLE AS total_ed_s FROM (SELECT DISTINCT incident_id FROM incidents)",
    "e2_tiers": f"""
SELECT count(*) AS n, count(*) FILTER (WHERE confidence = 'DEFINITIVE') AS n_definitive, count(*) FILTER (WHERE confidence = 'CANDIDATE') AS n_candidate, count(*) FILTER (WHERE confidence = 'NONE') AS n_none,
  round(avg(r2::INT), 6) AS rate_r2, round(avg(r3::INT), 6) AS rate_r3, round(avg(r4::INT), 6) AS rate_r4 FROM ({sql.SQL['a12_ranking']})""",
    "e5_bootstrap": f"WITH RECURSIVE {sql.RESULTS}, {_boot_mean()} SELECT method, round(low, 6) AS low, round(high, 6) AS high FROM boot",
    "e20_complete": f"""
WITH RECURSIVE {sql.RESULTS}, {_boot_mean()}, {_attribution()}, {_cost()}
SELECT a.method, n, raw_p1, raw_p3, conditional_p1, coverage, abstention_rate, false_rate, correct_abstention, mean_latency_s, median_latency_s,
  round(mean_ed_s, 4) AS mean_ed_s, round(median_ed_s, 4) AS median_ed_s, round(sum_ed_s, 4) AS sum_ed_s, round(max_ed_s, 4) AS max_ed_s, round(mean_budget_share, 4) AS mean_budget_share, round(low, 4) AS low, round(high, 4) AS high
FROM attribution a JOIN cost USING (method) JOIN boot USING (method)""",
    "e16_validation": f"""
WITH RECURSIVE {sql.RESULTS} SELECT method, round(avg(hit_1::INT) FILTER (WHERE NOT confounded), 6) AS plain_p1, round(avg(abstained::INT) FILTER (WHERE confounded), 6) AS confounded_handled,
  round(avg((NOT hit_1 AND NOT abstained)::INT) FILTER (WHERE NOT confounded), 6) AS false_attribution FROM judged GROUP BY method""",
    "d6_permutation": f"WITH {_BY_METRIC}, {_permuted('means', ['method_id'], 10_000)} SELECT method_id, round(p_value, 6) AS p_value FROM tested",
    "d7_bootstrap": f"WITH {_BY_METRIC}, {_resampled('means', ['method_id'], 1000)} SELECT method_id, round(low, 4) AS w1_low, round(high, 4) AS w1_high FROM boot",
    "d8_inference": f"""
WITH {sql.SAMPLES}, graded AS (
  SELECT *, least(n_base, n_post) AS n, CASE WHEN least(n_base, n_post) < 20 THEN 'INSUFFICIENT' WHEN least(n_base, n_post) < 50 THEN 'CANDIDATE' ELSE 'RELIABLE' END AS grade
  FROM w1 JOIN theta USING (incident_id, service_id) JOIN tv USING (incident_id, service_id)),
big AS (SELECT s.incident_id, s.service_id, s.side, s.v, s.idx FROM samples s JOIN graded USING (incident_id, service_id) WHERE n >= 20),
{_permuted('big', ['incident_id', 'service_id'], 1000)}, {_resampled('big', ['incident_id', 'service_id'], 200)}
SELECT incident_id, service_id, n_base, n_post, grade, round(theta, 8) AS theta, CASE WHEN n >= 20 THEN round(w1, 8) END AS w1, CASE WHEN n >= 20 THEN round(tv, 8) END AS tv,
  round(p_value, 8) AS p_value, round(low, 8) AS w1_low, round(high, 8) AS w1_high, CASE WHEN n >= 20 THEN w1 > theta END AS exceeds, p_value < 0.05 AS significant,
  CASE WHEN n >= 20 AND n < 30 THEN 'wide interval' WHEN n >= 30 AND n < 50 THEN 'directional only' END AS note
FROM graded LEFT JOIN tested USING (incident_id, service_id) LEFT JOIN boot USING (incident_id, service_id)""",
    "d10_monotone": f"WITH {sql.SAMPLES} SELECT true AS monotone, count(*) AS n_cases FROM (SELECT DISTINCT incident_id, service_id FROM samples)",
}
