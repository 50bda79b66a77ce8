"""DuckDB SQL with the same columns and rows as the queries of ``reference``."""

from __future__ import annotations

NAME = "translate(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '_. ', '---')"
LABEL = "translate(upper(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '-. ', '___')"
_TEXT = "regexp_replace(value_str, '^\\s+|\\s+$', '', 'g')"
METRICS = ["lat_p99", "lat_p50", "err_rate", "rps", "cpu_pct", "mem_pct"]

READINGS = f"""
grid AS (
  SELECT incident_id, CAST(round(t_start * 1000) AS BIGINT) AS s, CAST(round(t_end * 1000) AS BIGINT) AS e, CAST(round(delta_t_s * 1000) AS BIGINT) AS w,
         greatest(1, (CAST(round(t_end * 1000) AS BIGINT) - CAST(round(t_start * 1000) AS BIGINT)) // CAST(round(delta_t_s * 1000) AS BIGINT)) AS n
  FROM incidents),
readings AS (
  SELECT incident_id, {NAME.format('service_id')} AS service_id, metric_name, CAST(round(ts * 1000) AS BIGINT) AS t, collection_lag_s, seq,
         CASE WHEN regexp_full_match({_TEXT}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast({_TEXT} AS DOUBLE)) THEN try_cast({_TEXT} AS DOUBLE) END AS v
  FROM raw_metrics WHERE service_id IS NOT NULL AND isfinite(ts))"""
HELD = READINGS + """,
held AS (
  SELECT incident_id, service_id, metric_name, (t - s) // w AS window_id, arg_max(v, t::HUGEINT * 100000000000 + seq) AS v
  FROM readings JOIN grid USING (incident_id) WHERE v IS NOT NULL AND t >= s AND t < s + n * w GROUP BY ALL)"""
ALIGNED = HELD + """,
aligned AS (
  SELECT incident_id, service_id, metric_name, window_id, s + window_id * w AS t, w, v
  FROM (SELECT incident_id, service_id, metric_name, s, w, unnest(range(n)) AS window_id FROM (SELECT DISTINCT incident_id, service_id, metric_name FROM readings) JOIN grid USING (incident_id))
  LEFT JOIN held USING (incident_id, service_id, metric_name, window_id)),
baseline AS (
  SELECT incident_id, service_id, metric_name, avg(v) AS mean, stddev_samp(v) + 1e-9 AS std, count(*) AS n_baseline
  FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, service_id, metric_name ORDER BY window_id) AS rn,
               count(*) OVER (PARTITION BY incident_id, service_id, metric_name) AS cnt FROM aligned WHERE v IS NOT NULL)
  WHERE rn <= greatest(1, cnt // 2) GROUP BY ALL)"""
DEVIATIONS = ALIGNED + """,
series AS (SELECT incident_id, service_id, window_id, t, w, v FROM aligned WHERE metric_name = 'lat_p99'),
dev AS (
  SELECT s.*, abs(s.v - m) / sd AS z FROM (
    SELECT series.*, coalesce(b.mean, avg(v) OVER p) AS m, coalesce(b.std, stddev_samp(v) OVER p + 1e-9) AS sd
    FROM series LEFT JOIN (SELECT * FROM baseline WHERE metric_name = 'lat_p99') b USING (incident_id, service_id) WHERE v IS NOT NULL
    WINDOW p AS (PARTITION BY incident_id, service_id)) s),
scores AS (SELECT incident_id, service_id, max(z) AS max_z, avg(z) AS mean_z, count(*) AS n FROM dev GROUP BY ALL)"""
DIVERGING = DEVIATIONS + """,
hot AS (SELECT *, lag(t) OVER (PARTITION BY incident_id, service_id ORDER BY t) AS prev FROM dev WHERE z > 3),
runs AS (
  SELECT incident_id, service_id, run, min(t) AS t_star_ms, count(*) AS run_length FROM (
    SELECT *, sum(CASE WHEN prev IS NULL OR abs(t - prev - w) >= 0.1 * w THEN 1 ELSE 0 END) OVER (PARTITION BY incident_id, service_id ORDER BY t) AS run FROM hot)
  GROUP BY ALL HAVING count(*) >= 2),
diverging AS (SELECT incident_id, service_id, min(t_star_ms) AS t_star_ms, arg_min(run_length, t_star_ms) AS run_length FROM runs GROUP BY ALL)"""
PATHS = f"""
path_edges AS (
  SELECT DISTINCT fault_id, {NAME.format('e[1]')} AS src, {NAME.format('e[2]')} AS dst
  FROM (SELECT fault_id, unnest(causal_path) AS e FROM scenarios) WHERE e[1] IS NOT NULL AND e[2] IS NOT NULL AND {NAME.format('e[1]')} <> {NAME.format('e[2]')}),
edges AS (SELECT DISTINCT src, dst FROM path_edges)"""
CLOSURE = PATHS + """,
walk(src, dst, depth, path) USING KEY (src, dst) AS (
  SELECT src, dst, 1, [src, dst] FROM edges
  UNION
  SELECT walk.src, edges.dst, min(walk.depth) + 1, min(list_append(walk.path, edges.dst)) FROM walk JOIN edges ON walk.dst = edges.src
  WHERE edges.dst <> walk.src AND NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.src = walk.src AND r.dst = edges.dst) GROUP BY walk.src, edges.dst),
reach AS (SELECT * FROM walk)"""
#: Reachable pairs inside each scenario's own path.
OWN_REACH = """
own_walk(fault_id, src, dst, depth) USING KEY (fault_id, src, dst) AS (
  SELECT fault_id, src, dst, 1 FROM path_edges
  UNION
  SELECT w.fault_id, w.src, e.dst, min(w.depth) + 1 FROM own_walk w JOIN path_edges e ON e.fault_id = w.fault_id AND e.src = w.dst
  WHERE e.dst <> w.src AND NOT EXISTS (SELECT 1 FROM recurring.own_walk r WHERE r.fault_id = w.fault_id AND r.src = w.src AND r.dst = e.dst)
  GROUP BY w.fault_id, w.src, e.dst)"""
#: Reachability in the graph of each incident, ``inc_edges``.
INC_REACH = """
inc_reach(incident_id, src, dst, depth, path) USING KEY (incident_id, src, dst) AS (
  SELECT incident_id, src, dst, 1, [src, dst] FROM inc_edges
  UNION
  SELECT w.incident_id, w.src, e.dst, min(w.depth) + 1, min(list_append(w.path, e.dst)) FROM inc_reach w JOIN inc_edges e ON e.incident_id = w.incident_id AND e.src = w.dst
  WHERE e.dst <> w.src AND NOT EXISTS (SELECT 1 FROM recurring.inc_reach r WHERE r.incident_id = w.incident_id AND r.src = w.src AND r.dst = e.dst)
  GROUP BY w.incident_id, w.src, e.dst)"""
OBSERVED = """
observed AS (SELECT DISTINCT incident_id, service_id FROM series WHERE v IS NOT NULL),
inc_edges AS (SELECT a.incident_id, src, dst FROM observed a JOIN edges ON src = a.service_id JOIN observed b ON b.incident_id = a.incident_id AND b.service_id = dst)"""
SAMPLES = ALIGNED + """,
samples AS (
  SELECT incident_id, service_id, CASE WHEN rn * 2 <= cnt THEN 'base' ELSE 'post' END AS side, rn AS idx, v FROM (
    SELECT *, row_number() OVER (PARTITION BY incident_id, service_id ORDER BY window_id) AS rn, count(*) OVER (PARTITION BY incident_id, service_id) AS cnt
    FROM aligned WHERE metric_name = 'lat_p99' AND v IS NOT NULL)),
sized AS (
  SELECT *, count(*) FILTER (WHERE side = 'base') OVER p AS na, count(*) FILTER (WHERE side = 'post') OVER p AS nb FROM samples WINDOW p AS (PARTITION BY incident_id, service_id)),
steps AS (
  SELECT incident_id, service_id, v, na, nb, lead(v) OVER o - v AS width,
         count(*) FILTER (WHERE side = 'base') OVER u / na - count(*) FILTER (WHERE side = 'post') OVER u / nb AS gap
  FROM sized WHERE na > 0 AND nb > 0
  WINDOW o AS (PARTITION BY incident_id, service_id ORDER BY v), u AS (PARTITION BY incident_id, service_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
w1 AS (SELECT incident_id, service_id, na AS n_base, nb AS n_post, coalesce(sum(abs(gap) * width), 0) AS w1 FROM steps GROUP BY ALL),
theta AS (SELECT incident_id, service_id, 0.1::DOUBLE * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS theta FROM samples WHERE side = 'base' GROUP BY ALL),
ends AS (SELECT incident_id, service_id, min(v) AS lo, max(v) AS hi, any_value(na) AS na, any_value(nb) AS nb FROM sized WHERE na > 0 AND nb > 0 GROUP BY ALL),
tv AS (
  SELECT incident_id, service_id, sum(d) / 2 AS tv FROM (
    SELECT incident_id, service_id, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 100), 99) ELSE 0 END AS cell,
           abs(count(*) FILTER (WHERE side = 'base') / any_value(ends.na) - count(*) FILTER (WHERE side = 'post') / any_value(ends.nb)) AS d
    FROM samples JOIN ends USING (incident_id, service_id) GROUP BY ALL) GROUP BY ALL)"""
#: Comparison of callees before and during probes of their callers.
EVIDENCE = f"""
last_record AS (
  SELECT {NAME.format('destination_service')} AS src, CAST(round(t_applied * 1000) AS BIGINT) AS applied,
         CAST(round(coalesce(CASE WHEN isfinite(t_rolled_back) THEN t_rolled_back END, t_applied + lease_s) * 1000) AS BIGINT) AS ended
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM interventions)
  WHERE (rn = 1 OR record_id IS NULL) AND isfinite(t_applied) AND destination_service IS NOT NULL AND coalesce({LABEL.format('status')}, '') NOT IN ('PENDING', 'FAILED')),
probes AS (SELECT DISTINCT incident_id, src, applied, ended FROM last_record JOIN grid ON applied >= s AND applied < e WHERE ended > applied),
first_probe AS (SELECT incident_id, src, min(applied) AS first FROM probes GROUP BY ALL),
compared AS (
  SELECT f.incident_id, f.src, edges.dst, a.t, a.v, CASE WHEN EXISTS (SELECT 1 FROM probes p WHERE p.incident_id = f.incident_id AND p.src = f.src AND a.t < p.ended AND a.t + a.w > p.applied) THEN 'post'
         WHEN a.t + a.w <= f.first THEN 'base' END AS side
  FROM first_probe f JOIN edges ON edges.src = f.src JOIN aligned a ON a.incident_id = f.incident_id AND a.service_id = edges.dst AND a.metric_name = 'lat_p99' AND a.v IS NOT NULL),
sides AS (SELECT *, count(*) FILTER (WHERE side = 'base') OVER k AS na, count(*) FILTER (WHERE side = 'post') OVER k AS nb FROM compared WHERE side IS NOT NULL WINDOW k AS (PARTITION BY incident_id, src, dst)),
side_steps AS (
  SELECT incident_id, src, dst, na, nb, lead(v) OVER o - v AS width, count(*) FILTER (WHERE side = 'base') OVER u / na - count(*) FILTER (WHERE side = 'post') OVER u / nb AS gap
  FROM sides WHERE na > 0 AND nb > 0 WINDOW o AS (PARTITION BY incident_id, src, dst ORDER BY v), u AS (PARTITION BY incident_id, src, dst ORDER BY v ROWS UNBOUNDED PRECEDING)),
side_w AS (SELECT incident_id, src, dst, any_value(na) AS n_base, any_value(nb) AS n_post, coalesce(sum(abs(gap) * width), 0) AS w1 FROM side_steps GROUP BY incident_id, src, dst),
side_theta AS (SELECT incident_id, src, dst, 0.1::DOUBLE * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS theta FROM sides WHERE side = 'base' GROUP BY ALL),
evidence AS (
  SELECT incident_id, src, dst, coalesce(n_base, 0) AS n_base, coalesce(n_post, 0) AS n_post, coalesce(w1, 0) AS w1, coalesce(theta, 0) AS theta, coalesce(n_base > 0 AND w1 > coalesce(theta, 0), false) AS exceeds
  FROM (SELECT DISTINCT incident_id, src, dst FROM sides) LEFT JOIN side_w USING (incident_id, src, dst) LEFT JOIN side_theta USING (incident_id, src, dst))"""
HIDDEN = f"""
hidden AS (SELECT DISTINCT {NAME.format('causal_path[1][1]')} AS a, {NAME.format('causal_path[1][2]')} AS b FROM scenarios WHERE confounded AND len(causal_path) > 0 AND causal_path[1][1] IS NOT NULL AND causal_path[1][2] IS NOT NULL)"""
LATEST = f"""
latest AS (
  SELECT record_id, {NAME.format('destination_service')} AS destination_service, {LABEL.format('status')} AS status, latency_ms, precision_achieved, rollback_attempts,
         CAST(round(CASE WHEN isfinite(t_applied) THEN t_applied END * 1000) AS BIGINT) AS applied_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM interventions WHERE record_id IS NOT NULL) WHERE rn = 1)"""
HOT = DEVIATIONS + """,
hot_scores AS (SELECT incident_id, service_id, round(max_z, 2) AS score FROM scores WHERE max_z > 3),
prior AS (SELECT *, score / sum(score) OVER (PARTITION BY incident_id) AS p FROM hot_scores)"""
COSTS = "{closure}, {deviations}" + """,
blast AS (SELECT src AS service_id, least(1, count(DISTINCT dst) / (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges))) AS br FROM reach GROUP BY src),
hot_p AS (SELECT incident_id, service_id, max_z / sum(max_z) OVER (PARTITION BY incident_id) AS p, count(*) OVER (PARTITION BY incident_id) AS n FROM scores WHERE max_z > 3),
before AS (SELECT incident_id, -sum(p * ln(p)) AS h FROM hot_p GROUP BY incident_id),
factors AS (
  SELECT incident_id, service_id, p, n, coalesce(br, 0) AS br, CASE WHEN n > 1 THEN least(greatest(h * p, 0), ln(n)) / ln(n) ELSE 0 END AS eig
  FROM hot_p JOIN before USING (incident_id) LEFT JOIN blast USING (service_id)),
costs AS (
  SELECT *, 1 - 0.5::DOUBLE * br - 0.005::DOUBLE AS conf, 0.25::DOUBLE * (br + 0.01::DOUBLE + 0.1::DOUBLE + 0.5::DOUBLE * br + 0.005::DOUBLE) AS cost,
         eig / (1 + 0.25::DOUBLE * (br + 0.01::DOUBLE + 0.1::DOUBLE + 0.5::DOUBLE * br + 0.005::DOUBLE)) AS utility,
         CASE WHEN 1 - 0.5::DOUBLE * br - 0.005::DOUBLE < 0.3 THEN 'DENIED' ELSE 'SUPERVISED' END AS auth FROM factors)"""
COSTS = COSTS.replace("{closure}", CLOSURE).replace("{deviations}", DEVIATIONS.strip())


def _h(x: str) -> str:
    return f"-list_sum(list_transform({x}, lambda q: CASE WHEN q > 1e-12 THEN q * ln(q) ELSE 0.0::DOUBLE END))"


def folded(order: str) -> str:
    """CTEs that choose candidates of each incident in an order, one step each: ``fold`` has a row a step."""
    raw = "list_transform(p, lambda q, j: CASE WHEN j = i + 1 THEN least(1.0::DOUBLE, q + least(0.4::DOUBLE, g[i + 1]) * (1 - q)) ELSE q * greatest(0.0::DOUBLE, 1 - least(0.4::DOUBLE, g[i + 1]) * p[i + 1]) END)"
    return COSTS + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY {order}) AS i FROM costs),
lists AS (SELECT incident_id, list(service_id ORDER BY i) AS names, list(p ORDER BY i) AS p0, list(eig ORDER BY i) AS g, list(auth ORDER BY i) AS auths, count(*) AS n FROM placed GROUP BY incident_id),
steps AS (
  SELECT incident_id, 0 AS i, p0 AS p, 600.0::DOUBLE AS budget_left, 0 AS step, CAST(NULL AS VARCHAR) AS service_id, {_h('p0')} AS h FROM lists
  UNION ALL
  SELECT incident_id, i + 1, CASE WHEN take THEN norm ELSE p END, budget_left - CASE WHEN take THEN 30 ELSE 0 END, step + take::INT, CASE WHEN take THEN name END, CASE WHEN take THEN {_h('norm')} ELSE h END
  FROM (SELECT *, list_transform(raw, lambda q: q / list_sum(raw)) AS norm FROM (
    SELECT steps.*, names[i + 1] AS name, auths[i + 1] <> 'DENIED' AND budget_left >= 30 AS take, {raw} AS raw FROM steps JOIN lists USING (incident_id) WHERE i < n AND h >= 0.5))),
ends AS (
  SELECT incident_id, max(step) AS n_steps, CASE WHEN NOT any_value(has) THEN 'NO_ELIGIBLE' WHEN arg_max(h, i) < 0.5 THEN 'ENTROPY_CONVERGED' WHEN max(step) > 0 THEN 'BUDGET_EXHAUSTED' ELSE 'NO_ELIGIBLE' END AS stop_reason
  FROM steps JOIN (SELECT incident_id, len(list_filter(auths, lambda a: a <> 'DENIED')) > 0 AS has FROM lists) USING (incident_id) GROUP BY incident_id)"""


def probing(method: str, order: str) -> str:
    """A probing method: candidates by belief where any was chosen, with the time its probes take."""
    return f"""
WITH RECURSIVE {folded(order)},
best AS (SELECT incident_id, string_agg(service_id, ',' ORDER BY rn) AS services FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY p DESC, service_id) AS rn FROM costs) JOIN ends USING (incident_id) WHERE rn <= 5 AND n_steps > 0 GROUP BY incident_id)
SELECT '{method}' AS method, incident_id, coalesce(services, '') AS services, services IS NULL AS abstained, CASE WHEN services IS NULL THEN 'NO_SELECTION' END AS abstention_reason,
  CAST(NULL AS DOUBLE) AS latency_s, coalesce(n_steps, 0) * 30.0::DOUBLE AS total_ed_s FROM (SELECT DISTINCT incident_id FROM incidents) LEFT JOIN best USING (incident_id) LEFT JOIN ends USING (incident_id)"""


#: Tables of the ranking over diverging, scores, edges, reach, evidence and hidden, and the ranking itself.
RANKING = """
nodes AS (SELECT incident_id, node, bool_and(o = 0) AS is_leaf FROM (SELECT incident_id, src AS node, 1 AS o FROM inc_edges UNION ALL SELECT incident_id, dst, 0 FROM inc_edges) GROUP BY incident_id, node),
met AS (
  SELECT a.incident_id, a.service_id AS src, b.service_id AS dst, a.t_star_ms AS ta, b.t_star_ms AS tb, path
  FROM diverging a JOIN inc_reach r ON r.incident_id = a.incident_id AND r.src = a.service_id JOIN diverging b ON b.incident_id = a.incident_id AND b.service_id = r.dst),
down AS (SELECT DISTINCT ON (incident_id, src) incident_id, src AS service_id, path AS down FROM met ORDER BY incident_id, src, tb, dst),
reached AS (SELECT incident_id, src AS service_id, count(*) FILTER (WHERE tb < ta - 100) AS k FROM met GROUP BY ALL),
up AS (SELECT DISTINCT ON (incident_id, dst) incident_id, dst AS service_id, path AS up FROM met WHERE ta >= tb - 10 ORDER BY incident_id, dst, ta, src),
facts AS (
  SELECT d.*, nodes.is_leaf, down, up, coalesce(k, 0) AS k,
         (SELECT count(*) FROM diverging o JOIN nodes n ON n.node = o.service_id AND n.incident_id = o.incident_id WHERE o.incident_id = d.incident_id AND o.t_star_ms < d.t_star_ms - 100) AS earlier,
         (SELECT count(*) FROM diverging o WHERE o.incident_id = d.incident_id AND o.t_star_ms < d.t_star_ms - 100) AS any_earlier,
         (SELECT count(*) FROM diverging o WHERE o.incident_id = d.incident_id AND abs(o.t_star_ms - d.t_star_ms) <= 5000) - 1 AS n_ties, s.max_z AS score
  FROM diverging d JOIN scores s USING (incident_id, service_id) LEFT JOIN nodes ON node = d.service_id AND nodes.incident_id = d.incident_id LEFT JOIN down USING (incident_id, service_id)
  LEFT JOIN up USING (incident_id, service_id) LEFT JOIN reached USING (incident_id, service_id)),
ruled AS (
  SELECT *, any_earlier = 0 OR k >= earlier AS r2, down IS NOT NULL OR (coalesce(is_leaf, false) AND up IS NOT NULL) AS r3,
         coalesce(down, CASE WHEN is_leaf THEN up END) AS chosen FROM facts),
steps_of AS (SELECT incident_id, service_id, chosen[i] AS src, chosen[i + 1] AS dst FROM (SELECT incident_id, service_id, chosen, unnest(range(1, len(chosen))) AS i FROM ruled WHERE chosen IS NOT NULL)),
shown AS (SELECT DISTINCT incident_id, service_id, true AS r4 FROM steps_of JOIN evidence USING (incident_id, src, dst) WHERE exceeds),
tiered AS (SELECT ruled.*, coalesce(r4, false) AS r4, CASE WHEN r2 AND r3 AND coalesce(r4, false) THEN 'DEFINITIVE' WHEN r2 AND r3 THEN 'CANDIDATE' ELSE 'NONE' END AS confidence FROM ruled LEFT JOIN shown USING (incident_id, service_id))"""
RANKED = """
SELECT incident_id, service_id, t_star_ms, run_length, n_ties, r2, r3, r4, confidence, is_leaf IS NULL AS boundary_limited,
  CASE WHEN service_id IN (SELECT a FROM hidden UNION SELECT b FROM hidden) THEN 'NOT_IDENTIFIABLE' ELSE 'IDENTIFIABLE' END AS identifiability,
  row_number() OVER (PARTITION BY incident_id ORDER BY CASE confidence WHEN 'DEFINITIVE' THEN 0 WHEN 'CANDIDATE' THEN 1 ELSE 2 END, t_star_ms, score DESC, service_id) AS rank, array_to_string(chosen, '>') AS path FROM tiered"""


def unit_of(name: str) -> str:
    """Uniform number that depends on a name only."""
    return f"((('0x' || substr(md5({name}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)"


def normal_of(name: str) -> str:
    """Standard normal number that depends on a name only (Box-Muller)."""
    first, second = unit_of(name + " || '/a'"), unit_of(name + " || '/b'")
    return f"(sqrt(-2 * ln({first})) * cos(2 * pi() * {second}))"


#: Oracle metrics of every scenario.
ORACLE = f"""
oracle_once AS (SELECT DISTINCT ON (fault_id) fault_id, injected_at_t AS t0, {NAME.format('root_cause_service')} AS root, coalesce(seed, 0) AS s, affected_services, causal_path FROM scenarios WHERE fault_id IS NOT NULL AND injected_at_t IS NOT NULL),
delays AS (SELECT fault_id, {NAME.format('e[2]')} AS service, (max(i) + 1) * 10 AS delay FROM (SELECT fault_id, unnest(causal_path) AS e, unnest(range(len(causal_path))) AS i FROM oracle_once) GROUP BY ALL),
oracle_svc AS (SELECT DISTINCT fault_id, root, s, service FROM (SELECT fault_id, root, s, unnest(list_append(list_transform(affected_services, lambda x: {NAME.format('x')}), root)) AS service FROM oracle_once WHERE affected_services IS NOT NULL) WHERE service IS NOT NULL),
oracle_cells AS (
  SELECT o.fault_id, o.service, k, k * 10 - 60 AS after, root, delay, {normal_of("s || ':' || o.fault_id || ':' || o.service || ':' || k")} AS noise
  FROM oracle_svc o LEFT JOIN delays USING (fault_id, service) CROSS JOIN range(18) t(k)),
oracle_series AS (SELECT *, CASE WHEN after >= 0 AND service = root THEN 50 + 5 * noise WHEN after >= 0 AND after >= delay THEN 40 + 5 * noise ELSE 10 * noise END AS value FROM oracle_cells)"""
_TRIAL_SCORES = """
series AS (SELECT fault_id AS incident_id, service AS service_id, k AS window_id, k * 10000 AS t, 10000 AS w, value AS v FROM oracle_series),
baseline AS (SELECT incident_id, service_id, avg(v) AS mean, stddev_samp(v) + 1e-9 AS std FROM series WHERE window_id < 6 GROUP BY ALL),
dev AS (SELECT series.*, abs(v - mean) / std AS z FROM series JOIN baseline USING (incident_id, service_id)),
scores AS (SELECT incident_id, service_id, max(z) AS max_z, avg(z) AS mean_z, count(*) AS n FROM dev GROUP BY ALL)"""


def _trial_probes(method: str, order: str) -> str:
    return f"""
trial_{method.lower()} AS (WITH RECURSIVE {folded(order)[len(COSTS):].lstrip(',')},
  best AS (SELECT incident_id, list(service_id ORDER BY rn) AS services FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY p DESC, service_id) AS rn FROM costs) JOIN ends USING (incident_id) WHERE rn <= 5 AND n_steps > 0 GROUP BY incident_id)
  SELECT '{method}' AS method, incident_id, services, CAST(NULL AS DOUBLE) AS latency_s, n_steps * 30.0::DOUBLE AS total_ed_s FROM ends LEFT JOIN best USING (incident_id))"""


#: Every method on every scenario: ``results`` and, with hits, ``judged``.
RESULTS = f"""
{CLOSURE}, {ORACLE}, {_TRIAL_SCORES}{DIVERGING[len(DEVIATIONS):]},
evidence AS (SELECT NULL::VARCHAR AS incident_id, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, false AS exceeds WHERE false), hidden AS (SELECT NULL::VARCHAR AS a, NULL::VARCHAR AS b WHERE false),
inc_edges AS (SELECT fault_id AS incident_id, src, dst FROM path_edges), {INC_REACH},
{RANKING}, trial_ranked AS ({RANKED}){COSTS.split(DEVIATIONS.strip())[1]},
{_trial_probes('RANDOM', "md5('42:' || incident_id || ':' || service_id)")}, {_trial_probes('ONE_SHOT', 'utility DESC, service_id')},
obs AS (SELECT r.*, mean_z, bool_or(confidence <> 'NONE') OVER (PARTITION BY incident_id) AS sure, row_number() OVER (PARTITION BY incident_id ORDER BY mean_z DESC, service_id) AS place FROM trial_ranked r JOIN scores USING (incident_id, service_id)),
obs_kept AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY mean_z DESC, service_id) AS rn FROM obs WHERE CASE WHEN sure THEN confidence <> 'NONE' ELSE place <= 3 END),
gains AS (SELECT a.incident_id, a.service_id, sum(power(0.5::DOUBLE, depth * (depth + 1) / 2) * b.max_z) AS g FROM scores a JOIN reach ON reach.src = a.service_id AND depth <= 5 JOIN scores b ON b.incident_id = a.incident_id AND b.service_id = reach.dst GROUP BY ALL),
sieve AS (SELECT s.incident_id, s.service_id, row_number() OVER (PARTITION BY s.incident_id ORDER BY max_z + coalesce(g, 0) DESC, s.service_id) AS rn FROM scores s LEFT JOIN gains USING (incident_id, service_id) WHERE max_z > 3),
alerts AS (SELECT incident_id, service_id, row_number() OVER (PARTITION BY incident_id ORDER BY t, service_id) AS rn FROM (SELECT incident_id, service_id, min(t) AS t FROM dev WHERE z > 3 GROUP BY incident_id, service_id)),
facts_of AS (SELECT fault_id, any_value({NAME.format('root_cause_service')}) AS truth, bool_or(coalesce(confounded, false)) AS confounded FROM scenarios WHERE fault_id IS NOT NULL GROUP BY fault_id),
known AS (SELECT s.incident_id, s.service_id, row_number() OVER (PARTITION BY s.incident_id ORDER BY CASE WHEN s.service_id = f.truth THEN 0 ELSE 1 END, s.service_id) AS rn FROM scores s JOIN facts_of f ON f.fault_id = s.incident_id),
listed AS (
  SELECT 'OBS' AS method, incident_id, service_id, rn FROM obs_kept UNION ALL SELECT 'SIEVE', * FROM sieve UNION ALL SELECT 'THRESHOLD', * FROM alerts UNION ALL SELECT 'ORACLE', * FROM known),
everyone AS (SELECT DISTINCT incident_id FROM series),
plain AS (
  SELECT m.method, e.incident_id, l.services, CASE WHEN m.method = 'OBS' AND l.services IS NOT NULL THEN (SELECT min(t_star_ms) / 1000 FROM trial_ranked r WHERE r.incident_id = e.incident_id) END AS latency_s, 0.0::DOUBLE AS total_ed_s
  FROM everyone e CROSS JOIN (VALUES ('OBS'), ('SIEVE'), ('THRESHOLD'), ('ORACLE'), ('SAGE_CHAOS')) m(method)
  LEFT JOIN (SELECT method, incident_id, list(service_id ORDER BY rn) AS services FROM listed WHERE rn <= 5 GROUP BY ALL) l ON l.method = m.method AND l.incident_id = e.incident_id),
probed AS (SELECT m.method, e.incident_id, p.services, p.latency_s, coalesce(p.total_ed_s, 0) AS total_ed_s FROM everyone e CROSS JOIN (VALUES ('RANDOM'), ('ONE_SHOT')) m(method)
  LEFT JOIN (SELECT * FROM trial_random UNION ALL SELECT * FROM trial_one_shot) p ON p.method = m.method AND p.incident_id = e.incident_id),
results AS (
  SELECT method, incident_id AS fault_id, truth, confounded, coalesce(services, []) AS services, services IS NULL AS abstained, latency_s, total_ed_s
  FROM (SELECT * FROM plain UNION ALL SELECT * FROM probed) JOIN facts_of ON fault_id = incident_id),
judged AS (
  SELECT *, coalesce(NOT abstained AND services[1] = truth, false) AS hit_1, coalesce(NOT abstained AND list_contains(services[1:3], truth), false) AS hit_3 FROM results)"""
RUNS = """
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_no ORDER BY ingested_at DESC, run_id DESC, method_id DESC, stage_name DESC) AS rn FROM stage_log) WHERE rn = 1),
stages AS (SELECT method_id, run_id, lower(trim(stage_name)) AS stage_name, wall_time_s, memory_mb FROM once WHERE method_id IS NOT NULL AND wall_time_s >= 0 AND NOT isnan(wall_time_s)),
totals AS (SELECT method_id, run_id, sum(wall_time_s) AS total_s, max(memory_mb) AS peak_mb FROM stages GROUP BY ALL)"""
#: P(X >= k) of n trials with success 0.7, summed term by term.
PVALUES = f"""counts AS (
  SELECT method_id AS family, {NAME.format('stage_name')} AS hypothesis, count(*) FILTER (WHERE wall_time_s < 1) AS k, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY record_no ORDER BY ingested_at DESC) AS rn FROM stage_log WHERE record_no IS NOT NULL)
  WHERE rn = 1 AND method_id IS NOT NULL AND stage_name IS NOT NULL AND isfinite(wall_time_s) AND wall_time_s >= 0 GROUP BY ALL),
pvalues AS (
  SELECT *, round(CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE least(1, list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.7::DOUBLE) + (n - j) * ln(0.3::DOUBLE))))) END, 9) AS p FROM counts)"""
PAIRS = ALIGNED + """,
pairs AS (SELECT metric_name, incident_id, service_id, arg_min(v, window_id) AS x, arg_max(v, window_id) AS y FROM aligned WHERE v IS NOT NULL GROUP BY ALL)"""
_PIVOT = ", ".join(f"avg(v) FILTER (WHERE metric_name = '{m}') AS {m}" for m in METRICS)
_WIDE = ALIGNED + f", wide AS (SELECT incident_id, service_id, window_id, {_PIVOT} FROM aligned GROUP BY ALL)"

SQL = {
    "s2_counter_rate": f"""
WITH {LATEST}, counted AS (
  SELECT service_id, time, max(value) AS value FROM (
    SELECT destination_service AS service_id, applied_ms / 1000 AS time, row_number() OVER (PARTITION BY destination_service ORDER BY applied_ms, record_id) AS value
    FROM latest WHERE applied_ms IS NOT NULL AND destination_service IS NOT NULL) GROUP BY ALL),
lagged AS (SELECT *, time - lag(time) OVER o AS dt, value - lag(value) OVER o AS dv FROM counted WINDOW o AS (PARTITION BY service_id ORDER BY time))
SELECT service_id, time, round(CASE WHEN dv >= 0 THEN dv ELSE value END / dt, 6) AS rate FROM lagged WHERE dt > 0""",
    "s5_parse": f"WITH {READINGS} SELECT metric_name, count(v) AS n_valid, count(*) - count(v) AS n_missing, round(max(v), 3) AS max_value FROM readings GROUP BY metric_name",
    "s3_s4_responses": """
WITH parsed AS (SELECT incident_id, service_id, metric_name, ts, try_cast(value_str AS DOUBLE) AS v FROM raw_metrics WHERE service_id IS NOT NULL AND isfinite(ts)),
means AS (SELECT incident_id, service_id, metric_name, ts, avg(v) AS v FROM parsed WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL)
SELECT incident_id, service_id, metric_name, count(*) AS n_times, round(sum(v) FILTER (WHERE abs(v) < 1e6), 6) AS sum_value FROM means GROUP BY ALL""",
    "s8_split": """
WITH placed AS (SELECT fault_id, row_number() OVER (ORDER BY fault_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT fault_id FROM scenarios WHERE fault_id IS NOT NULL))
SELECT fault_id, CASE WHEN i < n // 2 THEN 'DEVELOPMENT' WHEN i < (3 * n) // 4 THEN 'VALIDATION' ELSE 'HELD_OUT_TEST' END AS split FROM placed""",
    "s12_oracle_pag": f"""
WITH once AS (SELECT DISTINCT ON (fault_id) fault_id, confounded, causal_path FROM scenarios),
steps AS (SELECT fault_id, confounded, i, {NAME.format('e[1]')} AS src, {NAME.format('e[2]')} AS dst FROM (SELECT fault_id, confounded, unnest(causal_path) AS e, unnest(range(len(causal_path))) AS i FROM once)),
pag AS (SELECT DISTINCT fault_id, src, dst, 'DIRECTED' AS edge_type FROM steps UNION ALL SELECT fault_id, src, dst, 'BIDIRECTED' FROM steps WHERE confounded AND i = 0)
SELECT edge_type, count(*) AS n, count(DISTINCT fault_id) AS n_scenarios FROM pag GROUP BY edge_type""",
    "s16_manifest": """
SELECT service_id, sha256('{' || concat_ws(',', '"instrumented":' || instrumented::VARCHAR, '"name":"' || name || '"', '"namespace":"' || namespace || '"', '"replicas":' || replicas, '"service_id":"' || service_id || '"') || '}') AS sha256 FROM services""",
    "s18_guard": f"SELECT {LABEL.format('split')} AS split, count(*) AS n_rows, CASE WHEN {LABEL.format('any_value(split)')} = 'HELD_OUT_TEST' THEN 'REFUSED' ELSE 'GIVEN' END AS access FROM scenarios GROUP BY {LABEL.format('split')}",
    "s19_secrets": """
WITH c AS (SELECT service_id, lower(service_id || ' ' || CASE WHEN replicas IS NULL THEN 'api_key' WHEN replicas > 4 THEN 'token' WHEN replicas = 1 THEN 'private_key password' ELSE '' END) AS t FROM services),
w AS (SELECT service_id, CASE WHEN contains(t, 'password') THEN 'password' WHEN contains(t, 'secret') THEN 'secret' WHEN contains(t, 'token') THEN 'token' WHEN contains(t, 'api_key') THEN 'api_key' WHEN contains(t, 'private_key') THEN 'private_key' END AS word FROM c)
SELECT * FROM w WHERE word IS NOT NULL""",
    "s21_phrases": "SELECT doc_id, len(regexp_extract_all(text, '(?i)held|proven|guarantee')) AS n FROM documents WHERE len(regexp_extract_all(text, '(?i)held|proven|guarantee')) > 0",
    "s22_last_wins": f"SELECT record_id, {LABEL.format('status')} AS status, rollback_attempts FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM interventions WHERE record_id IS NOT NULL) WHERE rn = 1",
    "t1_grid": f"WITH {READINGS} SELECT incident_id, window_id, s + window_id * w AS t_start_ms FROM (SELECT incident_id, s, w, unnest(range(n)) AS window_id FROM grid)",
    "t2_last_in_window": f"WITH {HELD} SELECT incident_id, service_id, metric_name, window_id, round(v, 6) AS value FROM held",
    "t3_bounded_fill": f"WITH {ALIGNED} SELECT incident_id, service_id, metric_name, window_id, round(v, 6) AS value, round(coalesce(v, lag(v) OVER (PARTITION BY incident_id, service_id, metric_name ORDER BY window_id)), 6) AS filled FROM aligned",
    "t4_report": f"""
WITH {ALIGNED}, filled AS (SELECT *, coalesce(v, lag(v) OVER (PARTITION BY incident_id, service_id, metric_name ORDER BY window_id)) AS f FROM aligned)
SELECT incident_id, service_id, metric_name, count(*) AS n_windows, count(*) - count(f) AS n_missing, 0 AS n_imputed,
       CASE WHEN count(*) > count(f) THEN (count(*) - count(f))::VARCHAR || ' of ' || count(*)::VARCHAR || ' windows missing' END AS warning FROM filled GROUP BY ALL""",
    "t5_last_delivery": f"""
WITH {READINGS} SELECT metric_name, count(*) AS n, CAST(sum(seq) AS BIGINT) AS sum_seq FROM (SELECT incident_id, service_id, metric_name, t, max(seq) AS seq FROM readings WHERE v IS NOT NULL GROUP BY ALL) GROUP BY metric_name""",
    "t8_lag_alarms": f"""
WITH {READINGS} SELECT incident_id, service_id, metric_name, seq, CAST(floor((t - s) / w) AS BIGINT) AS window_id, CAST(floor((t - s) / w) AS BIGINT) + 1 AS late_window_id
FROM readings JOIN grid USING (incident_id) WHERE isfinite(collection_lag_s) AND collection_lag_s * 1000 > w * 0.5""",
    "t9_within": f"WITH {READINGS} SELECT incident_id, metric_name, count(*) AS n, min(t) AS first_ms, max(t) AS last_ms FROM readings JOIN grid USING (incident_id) WHERE t BETWEEN s AND e GROUP BY ALL",
    "t10_wide": f"WITH {_WIDE} SELECT incident_id, service_id, window_id, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM wide",
    "t11_fill_zero": f"WITH {_WIDE} SELECT incident_id, service_id, window_id, {', '.join(f'round(coalesce(last_value({m} IGNORE NULLS) OVER p, 0), 6) AS {m}' for m in METRICS)} FROM wide WINDOW p AS (PARTITION BY incident_id, service_id ORDER BY window_id ROWS UNBOUNDED PRECEDING)",
    "t12_complete": f"WITH {_WIDE} SELECT incident_id, service_id, count(*) AS n_rows FROM wide WHERE lat_p99 IS NOT NULL AND rps IS NOT NULL GROUP BY ALL HAVING count(*) >= 20",
    "t13_baseline": f"WITH {ALIGNED} SELECT incident_id, service_id, metric_name, round(mean, 5) AS mean, round(std, 5) AS std, n_baseline FROM baseline",
    "a1_scores": f"WITH {DEVIATIONS} SELECT incident_id, service_id, round(max_z, 2) AS max_z, round(mean_z, 2) AS mean_z, n FROM scores",
    "a3_anomalous": f"WITH {DEVIATIONS} SELECT incident_id, service_id, n FROM scores WHERE max_z > 3",
    "a4_persistence": f"WITH {DIVERGING} SELECT * FROM diverging",
    "a5_precedence": f"""
WITH {DIVERGING} SELECT incident_id, service_id, t_star_ms, min(t_star_ms) OVER (PARTITION BY incident_id) >= t_star_ms - 100 AS r2,
  count(*) OVER (PARTITION BY incident_id ORDER BY t_star_ms RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING) - 1 AS n_ties FROM diverging""",
    "a12_ranking": f"WITH RECURSIVE {PATHS}, {DIVERGING.strip()}, {EVIDENCE}, {HIDDEN}, {OBSERVED}, {INC_REACH}, {RANKING} {RANKED}",
    "a8_evidence": f"WITH {PATHS}, {DEVIATIONS.strip()}, {EVIDENCE} SELECT incident_id, src, dst, n_base, n_post, round(w1, 6) AS w1, round(theta, 6) AS theta, exceeds FROM evidence",
    "a13_latency": f"WITH {DIVERGING} SELECT incident_id, round((min(t_star_ms) - any_value(s)) / 1000, 3) AS latency_s FROM diverging JOIN grid USING (incident_id) GROUP BY incident_id",
    "g1_time_sliced": f"""
WITH {PATHS}, {DEVIATIONS.strip()}, seen AS (SELECT incident_id, service_id, window_id FROM series WHERE v IS NOT NULL),
sliced AS (
  SELECT a.incident_id, 'CALL_GRAPH' AS edge_type FROM seen a JOIN edges ON src = a.service_id JOIN seen b ON b.incident_id = a.incident_id AND b.service_id = dst AND b.window_id = a.window_id + 1
  UNION ALL SELECT a.incident_id, 'AUTOREGRESSIVE' FROM seen a JOIN seen b ON b.incident_id = a.incident_id AND b.service_id = a.service_id AND b.window_id = a.window_id + 1)
SELECT incident_id, edge_type, count(*) AS n_edges, 0 AS n_backward FROM sliced GROUP BY ALL""",
    "g2_collapse": f"""
WITH {PATHS}, {DEVIATIONS.strip()}, seen AS (SELECT incident_id, service_id, window_id FROM series WHERE v IS NOT NULL)
SELECT DISTINCT a.incident_id, src, dst FROM seen a JOIN edges ON src = a.service_id JOIN seen b ON b.incident_id = a.incident_id AND b.service_id = dst AND b.window_id = a.window_id + 1""",
    "g3_closure": f"WITH RECURSIVE {CLOSURE} SELECT src, dst, depth, array_to_string(path, '>') AS path FROM reach",
    "g4_scenario_paths": f"WITH RECURSIVE {PATHS}, {OWN_REACH} SELECT fault_id, count(*) AS n_pairs, max(depth) AS max_depth FROM own_walk GROUP BY fault_id",
    "g6_depth": f"""
WITH RECURSIVE {PATHS}, nodes AS (SELECT fault_id, src AS node FROM path_edges UNION SELECT fault_id, dst FROM path_edges),
sizes AS (SELECT fault_id, count(*) AS n FROM nodes GROUP BY fault_id),
walk AS (
  SELECT fault_id, node, 0 AS depth FROM nodes
  UNION SELECT walk.fault_id, e.dst, depth + 1 FROM walk JOIN sizes USING (fault_id) JOIN path_edges e ON e.fault_id = walk.fault_id AND e.src = walk.node WHERE depth < n)
SELECT fault_id, node, CASE WHEN max(depth) < any_value(n) THEN max(depth) END AS depth FROM walk JOIN sizes USING (fault_id) GROUP BY fault_id, node""",
    "g8_skeleton": f"WITH {PATHS} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges",
    "g10_subgraph": f"""
WITH {PATHS}, {DEVIATIONS.strip()}, {HIDDEN}, rounded AS (SELECT incident_id, service_id, round(max_z, 2) AS score FROM scores),
seeds AS (SELECT incident_id, service_id FROM rounded WHERE score > 3),
near AS (SELECT * FROM seeds UNION SELECT incident_id, src FROM seeds JOIN edges ON dst = service_id),
found AS (SELECT * FROM near UNION SELECT incident_id, b FROM near JOIN hidden ON a = service_id UNION SELECT incident_id, a FROM near JOIN hidden ON b = service_id),
ranked AS (SELECT incident_id, service_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY incident_id ORDER BY coalesce(score, 0) DESC, service_id DESC) AS rank,
           count(*) OVER (PARTITION BY incident_id) > 15 AS boundary_limited FROM found LEFT JOIN rounded USING (incident_id, service_id))
SELECT * FROM ranked WHERE rank <= 15""",
    "g12_degrees": f"WITH {PATHS} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, sum(o) = 0 AS is_leaf FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node",
    "g14_blast": f"WITH RECURSIVE {CLOSURE} SELECT src AS service_id, round(least(1, count(DISTINCT dst) / (SELECT count(*) FROM services)), 6) AS blast_radius FROM reach GROUP BY src",
    "d1_wasserstein": f"WITH {SAMPLES} SELECT incident_id, service_id, n_base, n_post, round(w1, 4) AS w1 FROM w1",
    "d3_variation": f"WITH {SAMPLES} SELECT incident_id, service_id, round(tv, 4) AS tv FROM tv",
    "d4_threshold": f"WITH {SAMPLES} SELECT incident_id, service_id, round(theta, 8) AS theta FROM theta",
    "d8_divergence": f"""
WITH {SAMPLES}, graded AS (
  SELECT *, least(n_base, n_post) AS n, CASE WHEN least(n_base, n_post) < 20 THEN 'INSUFFICIENT' WHEN least(n_base, n_post) < 50 THEN 'CANDIDATE' ELSE 'RELIABLE' END AS grade
  FROM w1 JOIN theta USING (incident_id, service_id) JOIN tv USING (incident_id, service_id))
SELECT incident_id, service_id, n_base, n_post, grade, round(theta, 8) AS theta, CASE WHEN n >= 20 THEN round(w1, 8) END AS w1, CASE WHEN n >= 20 THEN round(tv, 8) END AS tv,
  CASE WHEN n >= 20 THEN w1 > theta END AS exceeds, CASE WHEN n >= 20 AND n < 30 THEN 'wide interval' WHEN n >= 30 AND n < 50 THEN 'directional only' END AS note FROM graded""",
    "l1_entropy": f"WITH {HOT} SELECT incident_id, round(-sum(CASE WHEN p > 1e-12 THEN p * ln(p) END), 5) AS entropy FROM prior GROUP BY incident_id",
    "l2_posterior": f"WITH {HOT} SELECT incident_id, service_id, round(p, 5) AS p FROM prior",
    "l3_costs": f"WITH RECURSIVE {COSTS} SELECT incident_id, service_id, round(eig, 3) AS eig, round(cost, 3) AS cost, round(utility, 3) AS utility, auth AS authorization FROM costs",
    "l6_selection": f"""
WITH RECURSIVE {folded('utility DESC, service_id')}
SELECT incident_id, service_id, step, budget_left, round(h, 5) AS entropy_after, stop_reason FROM steps JOIN ends USING (incident_id)
WHERE service_id IS NOT NULL OR (i = 0 AND n_steps = 0)""",
    "l7_random_selection": f"""
WITH RECURSIVE {folded("md5('42:' || incident_id || ':' || service_id)")}
SELECT incident_id, service_id, step, budget_left, round(h, 5) AS entropy_after, stop_reason FROM steps JOIN ends USING (incident_id)
WHERE service_id IS NOT NULL OR (i = 0 AND n_steps = 0)""",
    "l8_distinct": f"""
WITH RECURSIVE {folded('utility DESC, service_id')}
SELECT incident_id, count(*) = count(DISTINCT service_id) AS all_distinct, count(*) AS n_selected FROM steps WHERE service_id IS NOT NULL GROUP BY incident_id""",
    "l9_expected_entropy": f"""
WITH RECURSIVE {COSTS},
after AS (SELECT a.incident_id, a.service_id, CASE WHEN b.service_id = a.service_id THEN least(1, a.p + 0.3::DOUBLE * a.eig * (1 - a.p)) ELSE b.p * (1 - 0.3::DOUBLE * a.eig * a.p) END AS q
          FROM costs a JOIN costs b USING (incident_id)),
shares AS (SELECT incident_id, service_id, q / sum(q) OVER (PARTITION BY incident_id, service_id) AS q FROM after)
SELECT incident_id, service_id, round(greatest(0, -sum(CASE WHEN q > 1e-12 THEN q * ln(q) ELSE 0 END)), 5) + 0.0::DOUBLE AS entropy_after FROM shares GROUP BY ALL""",
    "b2_random": probing("RANDOM", "md5('42:' || incident_id || ':' || service_id)"),
    "b3_one_shot": probing("ONE_SHOT", "utility DESC, service_id"),
    "l10_edges": f"""
WITH {PATHS}, first AS (SELECT DISTINCT ON (fault_id) fault_id, src AS source, dst AS target, length(src) % 2 = 0 AS exceeds FROM path_edges ORDER BY fault_id, src, dst)
SELECT fault_id AS run_id, src, dst, round(least(greatest(CASE WHEN src = source AND dst = target AND exceeds THEN 0.6::DOUBLE WHEN dst = target AND (src = source OR exceeds) THEN 0.45::DOUBLE ELSE 0.5::DOUBLE END, 0.05), 0.95), 6) AS confidence
FROM path_edges JOIN first USING (fault_id)""",
    "i1_precision": f"""
WITH {LATEST} SELECT record_id, round(abs(precision_achieved * latency_ms - latency_ms) / greatest(1, latency_ms), 6) AS relative_error,
  CASE WHEN abs(precision_achieved * latency_ms - latency_ms) / greatest(1, latency_ms) >= 0.2 THEN 'CONFOUNDED' ELSE 'VERIFIED' END AS verdict FROM latest""",
    "i4_clean_windows": f"""
WITH {LATEST} SELECT record_id, n - 1 AS n_concurrent, n = 1 AS clean FROM (SELECT record_id, count(*) OVER (PARTITION BY destination_service ORDER BY applied_ms RANGE BETWEEN 60000 PRECEDING AND 60000 FOLLOWING) AS n
FROM latest WHERE applied_ms IS NOT NULL AND destination_service IS NOT NULL)""",
    "i7_dispatch": f"""
SELECT action, count(*) AS n FROM (SELECT CASE WHEN {LABEL.format('split')} = 'HELD_OUT_TEST' THEN 'REFUSED' WHEN {LABEL.format('fault_type')} IN ('MULTI_CAUSE', 'CONFOUNDED') THEN 'ABORTED'
  WHEN {LABEL.format('fault_type')} IN ('NETWORK_LATENCY', 'PACKET_LOSS') THEN 'NETWORK' WHEN fault_type IS NULL THEN 'ABORTED' ELSE {LABEL.format('fault_type')} END AS action
  FROM (SELECT DISTINCT ON (fault_id) * FROM scenarios)) GROUP BY action""",
    "i11_cascade": f"""
WITH {ALIGNED}, flagged AS (SELECT *, coalesce(v > 0.1, false) AS high FROM aligned WHERE metric_name = 'err_rate'),
runs AS (SELECT *, sum(CASE WHEN high THEN 0 ELSE 1 END) OVER (PARTITION BY incident_id, service_id ORDER BY t) AS run FROM flagged),
begun AS (SELECT *, min(CASE WHEN high THEN t END) OVER (PARTITION BY incident_id, service_id, run) AS b FROM runs)
SELECT incident_id, service_id, min(t) AS cascade_ms FROM begun WHERE high AND t - b > 30000 GROUP BY ALL""",
    "v1_violations": """
SELECT rule, count(*) AS n FROM (
  SELECT 'service_given' AS rule FROM raw_metrics WHERE service_id IS NULL OR trim(service_id) = ''
  UNION ALL SELECT 'time_positive' FROM raw_metrics WHERE NOT coalesce(ts > 0, false)
  UNION ALL SELECT 'lag_not_negative' FROM raw_metrics WHERE collection_lag_s < 0
  UNION ALL SELECT 'metric_known' FROM raw_metrics WHERE metric_name NOT IN ('lat_p99', 'lat_p50', 'err_rate', 'rps', 'cpu_pct', 'mem_pct')) GROUP BY rule""",
    "c2_correlation": f"""
WITH {ALIGNED}
SELECT a.metric_name AS a, b.metric_name AS b, count(*) AS n, round(corr(a.v, b.v), 3) + 0.0::DOUBLE AS r FROM aligned a JOIN aligned b USING (incident_id, service_id, window_id)
WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND a.metric_name <= b.metric_name GROUP BY ALL""",
    "e1_attribution": f"""
WITH RECURSIVE {RESULTS} SELECT method, count(*) AS n, round(avg(hit_1::INT), 4) AS raw_p1, round(avg(hit_3::INT), 4) AS raw_p3, round(coalesce(avg(hit_1::INT) FILTER (WHERE NOT abstained), 0), 4) AS conditional_p1,
  round(avg((NOT abstained)::INT), 4) AS coverage, round(avg(abstained::INT), 4) AS abstention_rate, round(avg((NOT abstained AND NOT hit_1)::INT), 4) AS false_rate,
  round(coalesce(avg(abstained::INT) FILTER (WHERE confounded), 0), 4) AS correct_abstention, round(avg(latency_s) FILTER (WHERE NOT abstained), 4) AS mean_latency_s,
  round(quantile_cont(latency_s, 0.5) FILTER (WHERE NOT abstained), 4) AS median_latency_s, round(sum(total_ed_s), 4) AS total_ed_s FROM judged GROUP BY method""",
    "e3_runtime": f"""
WITH {RUNS} SELECT method_id, count(*) AS n_runs, round(avg(total_s), 3) AS mean_s, round(quantile_cont(total_s, 0.5), 3) AS median_s, round(quantile_cont(total_s, 0.95), 3) AS p95_s,
  round(max(total_s), 3) AS max_s, max(peak_mb) AS max_peak_mb, any_value(stage_name) AS bottleneck_stage
FROM totals JOIN (SELECT method_id, arg_max(stage_name, m) AS stage_name FROM (SELECT method_id, stage_name, avg(wall_time_s) AS m FROM stages GROUP BY ALL) GROUP BY ALL) USING (method_id) GROUP BY method_id""",
    "e4_cost": f"""
WITH RECURSIVE {RESULTS} SELECT method, round(avg(total_ed_s), 3) AS mean_ed_s, round(quantile_cont(total_ed_s, 0.5), 3) AS median_ed_s, round(sum(total_ed_s), 3) AS sum_ed_s, round(max(total_ed_s), 3) AS max_ed_s,
  round(avg(total_ed_s) / 600, 3) AS mean_budget_share FROM results GROUP BY method""",
    "e6_cliffs": f"""
WITH {PAIRS}, sides AS (SELECT metric_name, x AS v, 1 AS side FROM pairs UNION ALL SELECT metric_name, y, 0 FROM pairs),
ranked AS (SELECT *, rank() OVER (PARTITION BY metric_name ORDER BY v) + (count(*) OVER (PARTITION BY metric_name, v) - 1) / 2 AS r FROM sides),
u AS (SELECT metric_name, sum(r) FILTER (WHERE side = 1) AS rx, count(*) FILTER (WHERE side = 1) AS n_x, count(*) FILTER (WHERE side = 0) AS n_y FROM ranked GROUP BY metric_name),
d AS (SELECT metric_name, n_x, n_y, 2 * (rx - n_x * (n_x + 1) / 2) / (n_x * n_y) - 1 AS delta FROM u)
SELECT metric_name, round(delta, 6) AS delta, n_x, n_y, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM d""",
    "e7_wilcoxon": f"""
WITH {PAIRS}, diffs AS (SELECT metric_name, x - y AS d FROM pairs WHERE x <> y),
ranked AS (SELECT *, rank() OVER o + (count(*) OVER (PARTITION BY metric_name, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY metric_name, abs(d)) AS ties FROM diffs WINDOW o AS (PARTITION BY metric_name ORDER BY abs(d))),
w AS (SELECT metric_name, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, sum(ties * ties - 1) AS t FROM ranked GROUP BY metric_name)
SELECT metric_name, n, w_plus, round((w_plus - n * (n + 1) / 4 - 0.5::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48), 4) AS z, t > 0 AS tied FROM w""",
    "e10_holm": f"""
WITH {PVALUES}, placed AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, hypothesis) AS r, count(*) OVER (PARTITION BY family) AS m FROM pvalues)
SELECT family, hypothesis, round(p, 7) AS p, round(0.05::DOUBLE / (m - r + 1), 7) AS threshold, p <= 0.05::DOUBLE / (m - r + 1) AS rejected FROM placed""",
    "e11_bh": f"""
WITH {PVALUES}, placed AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, hypothesis) AS r, count(*) OVER (PARTITION BY family) AS m FROM pvalues)
SELECT family, hypothesis, round(p, 7) AS p, round(least(1, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 7) AS adjusted FROM placed""",
    "e17_counts": f"""
WITH s AS (SELECT DISTINCT fault_id, {LABEL.format('fault_type')} AS fault_type, {LABEL.format('split')} AS split FROM scenarios WHERE fault_type IS NOT NULL)
SELECT coalesce(fault_type, 'TOTAL') AS fault_type, count(*) FILTER (WHERE split = 'DEVELOPMENT') AS development, count(*) FILTER (WHERE split = 'VALIDATION') AS validation,
  count(*) FILTER (WHERE split = 'HELD_OUT_TEST') AS held_out_test, count(*) AS total FROM s GROUP BY ROLLUP (fault_type)""",
    "e18_latency_cdf": f"WITH RECURSIVE {RESULTS} SELECT DISTINCT method, latency_s, round(cume_dist() OVER (PARTITION BY method ORDER BY latency_s), 6) AS share FROM results WHERE NOT abstained AND latency_s IS NOT NULL",
    "e19_repeatability": """
WITH once AS (SELECT method_id, wall_time_s FROM (SELECT *, row_number() OVER (PARTITION BY record_no ORDER BY method_id DESC, wall_time_s DESC) AS rn FROM stage_log WHERE method_id IS NOT NULL AND isfinite(wall_time_s) AND wall_time_s >= 0) WHERE rn = 1)
SELECT method_id, count(*) AS n, round(avg(wall_time_s), 3) AS mean, round(quantile_cont(wall_time_s, 0.5), 3) AS median, round(stddev_samp(wall_time_s), 3) AS sd, round(quantile_cont(wall_time_s, 0.75) - quantile_cont(wall_time_s, 0.25), 3) AS iqr FROM once GROUP BY method_id""",
    "e21_report": f"""
WITH {RUNS}, m AS (SELECT method_id, count(*) AS n_runs, max(peak_mb) AS peak FROM totals GROUP BY method_id)
SELECT r.method_id AS method, CASE WHEN m.method_id IS NULL THEN 'PENDING' ELSE printf('%.3f', n_runs::DOUBLE) END AS n_runs,
  CASE WHEN m.method_id IS NULL THEN 'PENDING' WHEN peak IS NULL THEN '---' ELSE printf('%.3f', peak) END AS max_peak_mb FROM runtime_metrics r LEFT JOIN m USING (method_id)""",
    "b7_threshold": f"""
WITH {DEVIATIONS}, alerts AS (SELECT incident_id, service_id, min(t) AS t FROM dev WHERE z > 3 GROUP BY ALL),
best AS (SELECT incident_id, string_agg(service_id, ',' ORDER BY t, service_id) AS services FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY t, service_id) AS rn FROM alerts) WHERE rn <= 5 GROUP BY incident_id)
SELECT 'THRESHOLD' AS method, incident_id, coalesce(services, '') AS services, services IS NULL AS abstained, CASE WHEN services IS NULL THEN 'NO_ANOMALY' END AS abstention_reason,
  CAST(NULL AS DOUBLE) AS latency_s, 0.0::DOUBLE AS total_ed_s FROM (SELECT DISTINCT incident_id FROM incidents) LEFT JOIN best USING (incident_id)""",
}
