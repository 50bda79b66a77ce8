"""Hand-made cases of the operators; whole tables are compared with SQL by compare.py."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.special import beta_inc, binomial_sf, normal_cdf, signed_rank_sf, t_sf
from tidegauge.operators import align, causal, detect, diverge, evaluate, graph, guard, methods, select, simulate
from tidegauge.sources import telemetry
from tidegauge.streaming.align import stream_windows

READINGS = "incident_id bigint, service_id string, metric_name string, ts double, value_str string, collection_lag_s double, seq bigint"


def aligned(spark, readings, end=40.0):
    raw = spark.createDataFrame([(1, "a", "m", float(t), v, 0.0, i) for i, (t, v) in enumerate(readings)], READINGS)
    inc = spark.createDataFrame([(1, 0.0, end, 10.0)], "incident_id bigint, t_start double, t_end double, delta_t_s double")
    return align.align(align.parse_readings(raw), inc)


def column(df, name, order="window_id"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


@pytest.mark.parametrize(
    ("readings", "fill", "end", "want"),
    [
        ([(0, "50"), (10, "52"), (20, "55"), (30, "53")], 1, 40.0, [50, 52, 55, 53]),
        ([(0, "50"), (30, "60")], 0, 40.0, [50, None, None, 60]),
        ([(0, "50"), (30, "60")], 1, 40.0, [50, 50, None, 60]),
        ([(0, "NaN"), (10, "50")], 0, 20.0, [None, 50]),
        ([(10, "50")], 1, 20.0, [None, 50]),
        ([(1, "5"), (9, "7")], 0, 10.0, [7]),
        ([(1, "5"), (9, "+Inf")], 0, 10.0, [5]),
    ],
)
def test_alignment_cases(spark, readings, fill, end, want):
    rows = align.bounded_fill(aligned(spark, readings, end), fill)
    assert column(rows, "filled") == want


def series(spark, values, key="a", start=0):
    return [(1, key, (start + 10 * i) * 1000, 10_000, float(v)) for i, v in enumerate(values)]


SERIES = "incident_id bigint, service_id string, t_start_ms bigint, delta_ms bigint, value double"
BASE = "incident_id bigint, service_id string, mean double, std double"


def ranked(spark, rows, base, edges):
    dev = detect.deviations(spark.createDataFrame(rows, SERIES), spark.createDataFrame(base, BASE))
    out = detect.rank_divergence(dev, spark.createDataFrame(edges, "src string, dst string"))
    return {r.service_id: r for r in out.collect()}


def test_divergence_alone_has_no_candidate(spark):
    r = ranked(spark, series(spark, [50] * 5, "A"), [(1, "A", 0.0, 10.0)], [("X", "Y")])
    assert r["A"].confidence == "NONE" and not r["A"].r3 and r["A"].boundary_limited


def test_chain_ranks_the_source_first(spark):
    rows = series(spark, [0, 50, 50, 0, 0, 0], "A") + series(spark, [0, 0, 0, 0, 50, 50], "B")
    r = ranked(spark, rows, [(1, "A", 0.0, 10.0), (1, "B", 0.0, 10.0)], [("A", "B")])
    assert (r["A"].confidence, r["A"].rank, r["A"].path) == ("CANDIDATE", 1, "A>B") and r["B"].confidence == "NONE"


def test_leaf_fallback(spark):
    rows = series(spark, [0, 50, 50, 0, 0, 0], "A") + series(spark, [0, 0, 0, 50, 50, 0], "B")
    r = ranked(spark, rows, [(1, "A", 0.0, 10.0), (1, "B", 0.0, 10.0)], [("B", "A")])
    assert r["A"].r3 and r["A"].path == "B>A"


@pytest.mark.parametrize("values", [[30] * 5, [0, 90, 0, 90, 0]])
def test_no_lasting_divergence(spark, values):
    assert ranked(spark, series(spark, values), [(1, "a", 0.0, 10.0)], [("X", "Y")]) == {}


def test_evidence_makes_it_definitive(spark):
    rows = series(spark, [0, 50, 50, 0, 0, 0], "A") + series(spark, [0, 0, 0, 0, 50, 50], "B")
    dev = detect.deviations(spark.createDataFrame(rows, SERIES), spark.createDataFrame([(1, "A", 0.0, 10.0), (1, "B", 0.0, 10.0)], BASE))
    edges = spark.createDataFrame([("A", "B")], "src string, dst string")
    out = detect.rank_divergence(dev, edges, edges, bidirected=spark.createDataFrame([("A", "Z")], "a string, b string")).filter("service_id = 'A'").first()
    assert out.confidence == "DEFINITIVE" and out.identifiability == "NOT_IDENTIFIABLE"


def test_closure_ends_on_cycles_and_takes_the_least_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("b", "e")], "src string, dst string")
    got = {(r.src, r.dst): (r.depth, "".join(r.path)) for r in graph.closure(edges, [], 6).collect()}
    assert got["a", "e"] == (2, "abe") and ("a", "a") not in got and got["c", "e"] == (3, "cabe") and len(got) == 13


CHAIN = [(f"n{i}", f"n{i + 1}") for i in range(7)]


def chain_analysis(spark, monkeypatch, edges):
    from tidegauge.plans.pipeline import Analysis

    monkeypatch.setattr(Analysis, "edges", spark.createDataFrame(edges, "src string, dst string"))


def test_reachability_has_no_bound(spark, monkeypatch):
    from tidegauge.plans import reference

    cycle = graph.closure(spark.createDataFrame([*CHAIN, ("n7", "n0")], "src string, dst string"), [])
    assert cycle.count() == 56 and cycle.agg(F.max("depth")).first()[0] == 7
    chain_analysis(spark, monkeypatch, CHAIN)
    got = {(r.src, r.dst): (r.depth, r.path) for r in reference.g3_closure(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 28 and got["n0", "n7"] == (7, ">".join(f"n{i}" for i in range(8)))
    far = series(spark, [0, 50, 50, 0, 0, 0], "n0") + series(spark, [0, 0, 0, 0, 50, 50], "n6")
    r = ranked(spark, far, [(1, "n0", 0.0, 10.0), (1, "n6", 0.0, 10.0)], CHAIN)
    assert r["n0"].confidence == "CANDIDATE" and r["n0"].path == ">".join(f"n{i}" for i in range(7))
    seeds = spark.createDataFrame([(1, f"n{i}", 1.0) for i in range(8)], "incident_id bigint, service_id string, score double")
    gain = graph.propagation_scores(seeds, graph.closure(spark.createDataFrame(CHAIN, "src string, dst string"), [])).filter("service_id = 'n0'").first().propagated
    assert gain == pytest.approx(1 + sum(0.5 ** (d * (d + 1) / 2) for d in range(1, 6)))


def test_depth_in_scenarios_has_no_bound(spark, tmp_path):
    from tidegauge.plans import reference

    chain = [list(e) for e in CHAIN] + [["n7", "n8"]]
    loop = [["a", "b"], ["b", "c"], ["c", "b"], ["c", "d"], ["x", "d"]]
    rows = [("f", "n0", chain, True), ("g", "a", loop, False)]
    spark.createDataFrame(rows, "fault_id string, root_cause_service string, causal_path array<array<string>>, confounded boolean").write.parquet(str(tmp_path / "scenarios.parquet"))
    got = {(r.fault_id, r.node): r.depth for r in reference.g6_depth(spark, str(tmp_path)).collect()}
    assert [got["f", f"n{i}"] for i in range(9)] == list(range(9))
    assert (got["g", "a"], got["g", "x"]) == (0, 0) and got["g", "b"] is got["g", "c"] is got["g", "d"] is None
    paths = {r.fault_id: (r.n_pairs, r.max_depth) for r in reference.g4_scenario_paths(spark, str(tmp_path)).collect()}
    assert paths["f"] == (36, 8)
    pag = causal.pag_from_paths(spark.read.parquet(str(tmp_path / "scenarios.parquet"))).filter("fault_id = 'f'")
    far = causal.identify(pag, spark.createDataFrame([("f", "n0", "n8")], "fault_id string, src string, dst string"), ["fault_id"]).first()
    assert far.status == "REQUIRES_INTERVENTION"


SUBGRAPHS = [
    ([("root", "middle"), ("middle", "leaf")], {"root": 5.0, "middle": 4.0, "leaf": 3.5}, [], {"root", "middle", "leaf"}),
    ([("hidden", "observed"), ("observed", "leaf")], {"observed": 4.5, "leaf": 3.5}, [], {"hidden", "observed", "leaf"}),
    ([("r", "h1"), ("h1", "h2"), ("h2", "o")], {"o": 5.0}, [], {"h2", "o"}),
    ([("A", "leaf"), ("B", "leaf")], {"A": 4.5, "leaf": 3.5}, [("A", "C")], {"A", "B", "leaf", "C"}),
]


@pytest.mark.parametrize(("edges", "scores", "both", "want"), SUBGRAPHS)
def test_anomaly_subgraphs(spark, edges, scores, both, want):
    out = graph.anomaly_subgraph(spark.createDataFrame([(1, k, v) for k, v in scores.items()], "incident_id bigint, service_id string, score double"), spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(both, "a string, b string"))
    rows = out.collect()
    assert {r.service_id for r in rows} == want and not any(r.boundary_limited for r in rows)


def test_pruning_keeps_the_highest_names(spark):
    out = graph.anomaly_subgraph(spark.createDataFrame([(1, f"s{i:02d}", 5.0) for i in range(20)], "incident_id bigint, service_id string, score double"), spark.createDataFrame([("x", "y")], "src string, dst string")).collect()
    assert {r.service_id for r in out} == {f"s{i:02d}" for i in range(5, 20)} and all(r.boundary_limited for r in out)


def samples(spark, a, b):
    return spark.createDataFrame([("k", "base", i, float(x)) for i, x in enumerate(a)] + [("k", "post", i, float(x)) for i, x in enumerate(b)], "k string, side string, idx int, value double")


def test_wasserstein_cases(spark):
    assert diverge.wasserstein(samples(spark, [3, 1, 2], [5, 2, 2.5]), ["k"]).first().w1 == pytest.approx(7 / 6)
    rng = np.random.default_rng(1)
    a = rng.normal(100, 20, 60).tolist()
    assert diverge.wasserstein(samples(spark, a, a), ["k"]).first().w1 == pytest.approx(0)
    assert diverge.wasserstein(samples(spark, a, [x + 7 for x in a]), ["k"]).first().w1 == pytest.approx(7)
    assert diverge.wasserstein(samples(spark, a, []), ["k"]).count() == 0


@pytest.mark.parametrize(("n", "want"), [(5, "INSUFFICIENT"), (20, "CANDIDATE"), (49, "CANDIDATE"), (50, "RELIABLE")])
def test_grades(spark, n, want):
    r = diverge.divergence(samples(spark, range(n), [x + 100 for x in range(n)]), ["k"]).first()
    assert r.grade == want and (r.w1 is None) == (want == "INSUFFICIENT") and r.theta is not None


def test_resampled_inference(spark):
    rng = np.random.default_rng(3)
    far = diverge.divergence(samples(spark, rng.normal(0, 1, 30), rng.normal(4, 1, 30)), ["k"], replicates=40).first()
    assert far.p_value == pytest.approx(1 / 41) and far.w1_low < far.w1 < far.w1_high * 1.5 and far.significant
    near = diverge.divergence(samples(spark, rng.normal(0, 1, 30), rng.normal(0, 1, 30)), ["k"], replicates=40).first()
    assert near.p_value > 0.05


def test_resampling_at_full_counts(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 30), rng.normal(3, 1, 31)
    df = samples(spark, a, b)
    assert diverge.permutation_test(df, ["k"], 10_000).first().p_value == pytest.approx(1 / 10_001)
    small = samples(spark, [1, 2, 3], [2.5, 4, 6])
    # 20 splits of six values: the exact share of those at least as far apart.
    v = [1, 2, 3, 2.5, 4, 6]
    w = [np.abs(np.sort([v[i] for i in s]) - np.sort([v[i] for i in range(6) if i not in s])).mean() for s in combinations(range(6), 3)]
    assert diverge.permutation_test(small, ["k"], 10_000).first().p_value == pytest.approx(np.mean(np.array(w) >= w[0] - 1e-9), abs=0.02)
    # Both sides are drawn apart: two equal samples are not resampled alike.
    same = diverge.bootstrap_interval(samples(spark, a, a), ["k"], 1000).first()
    ref = [np.abs(np.sort(rng.choice(a, 30)) - np.sort(rng.choice(a, 30))).mean() for _ in range(4000)]
    assert same.w1_low == pytest.approx(np.percentile(ref, 2.5), rel=0.15) and same.w1_high == pytest.approx(np.percentile(ref, 97.5), rel=0.15)
    r = diverge.divergence(df, ["k"], replicates=1000, resamples=200).first()
    assert r.p_value == pytest.approx(1 / 1001) and r.w1_low < r.w1 < r.w1_high and r.significant


def test_replicates_of_a_large_key_are_spread(spark, monkeypatch):
    df = samples(spark, range(40), [x + 2 for x in range(41)])
    whole = diverge.permutation_test(df, ["k"], 3000).first().p_value
    monkeypatch.setattr(diverge, "CELLS", 8100)
    parts = diverge.spread(diverge._sides(df, ["k"]), 3000, F.size("xs") + F.size("ys")).collect()
    assert len(parts) == 12 and sum(len(reps) for p in parts for reps in diverge.replicate_blocks(3000, 81, p.part, p.parts)) == 3000
    assert 0 < whole < 1 and diverge.permutation_test(df, ["k"], 3000).first().p_value == whole  # however it is spread


def test_registered_counts_of_resampling(spark, monkeypatch):
    from tidegauge.plans import reference, reference_more

    seen = {}
    for module, name in ((diverge, "permutation_test"), (diverge, "bootstrap_interval"), (evaluate, "bootstrap_mean")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, key, n, *more, _real=real, _name=name: seen.setdefault(_name, []).append(n) or _real(df, key, n, *more))
    d = "/root/testdata/sf0.001"
    for f in (reference.d6_permutation, reference.d6_wall_times, reference.d7_bootstrap, reference_more.e5_bootstrap, reference_more.e20_complete):
        f(spark, d)
    assert seen == {"permutation_test": [10_000, 10_000], "bootstrap_interval": [1000], "bootstrap_mean": [2000, 2000]}
    assert {"p_value", "w1_low", "w1_high", "significant"} <= set(reference.d8_inference(spark, d).columns)


def test_draws_are_even():
    x = diverge.draws(42, np.arange(2000), 50)
    share = np.bincount((x % np.uint64(50)).astype(int).ravel(), minlength=50) / x.size
    assert np.abs(share - 0.02).max() < 0.002 and len(np.unique(x)) == x.size
    first = np.argmin(x, axis=1)
    assert np.abs(np.bincount(first, minlength=50) / 2000 - 0.02).max() < 0.012


def test_divergence_without_a_floor(spark):
    df = samples(spark, [1.0, 2.0], [4.0]).unionByName(samples(spark, [1.0], []).withColumn("k", F.lit("z")))
    rows = {r.k: r for r in diverge.evaluate_divergence(df, ["k"], replicates=50).collect()}
    one = next(r for k, r in rows.items() if k != "z")
    assert one.w1 == pytest.approx(2.5) and one.exceeds and 0 < one.p_value <= 1
    assert (rows["z"].w1, rows["z"].tv, rows["z"].exceeds, rows["z"].p_value, rows["z"].w1_high) == (0.0, 0.0, False, 1.0, 0.0)


def test_simple_paths_and_lookups(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "c", "a"), (1, "c", "d"), (2, "a", "b")], "k int, src string, dst string")
    pairs = spark.createDataFrame([(1, "a", "d"), (2, "a", "d"), (1, "a", "a")], "k int, src string, dst string")
    assert {(r.k, "".join(r.path)) for r in graph.simple_paths(edges, ["k"], pairs).collect()} == {(1, "abcd"), (1, "acd")}
    pag = spark.createDataFrame([("x", "y", "BIDIRECTED"), ("x", "y", "DIRECTED"), ("y", "z", "DIRECTED")], "src string, dst string, edge_type string")
    ask = spark.createDataFrame([("y", "x"), ("z", "y"), ("x", "z")], "a string, b string")
    got = {(r.a, r.b): (r.has_edge, r.edge_types, r.hidden_cause) for r in graph.pair_lookup(pag, [], ask).collect()}
    assert got == {("y", "x"): (True, "x>y:BIDIRECTED,x>y:DIRECTED", True), ("z", "y"): (True, "y>z:DIRECTED", False), ("x", "z"): (False, None, False)}


def test_evidence_of_probes_and_definitive_rank(spark):
    inc = spark.createDataFrame([(1, 0.0, 400.0)], "incident_id bigint, t_start double, t_end double")
    probes = spark.createDataFrame([("a", 200_000, 300_000), ("a", 200_000, 300_000), ("a", 390_000, 390_000), ("b", 500_000, 600_000)], "service_id string, applied_ms bigint, ended_ms bigint")
    inside = detect.in_incident(probes, "applied_ms", inc)
    assert inside.count() == 3
    rows = [(1, s, k * 10_000, 10_000, (90.0 if s == "b" and 20 <= k < 30 else 50.0) + k % 3) for s in "ab" for k in range(40)]
    series = spark.createDataFrame(rows, "incident_id bigint, service_id string, t_start_ms bigint, delta_ms bigint, value double")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = detect.probe_samples(series, inside, edges)
    assert {(r.side, r.idx // 10_000) for r in got.collect()} == {("base", k) for k in range(20)} | {("post", k) for k in range(20, 30)}
    hit = diverge.evaluate_divergence(got, ["incident_id", "src", "dst"]).filter("exceeds")
    dev = spark.createDataFrame([(1, s, k * 10_000, 10_000, 9.0 if k >= 20 + (s == "b") else 0.5) for s in "ab" for k in range(40)], "incident_id bigint, service_id string, t_start_ms bigint, delta_ms bigint, z double")
    ranked = {r.service_id: r for r in detect.rank_divergence(dev, edges, hit.select("incident_id", "src", "dst"), bidirected=spark.createDataFrame([("b", "z")], "a string, b string")).collect()}
    assert ranked["a"].confidence == "DEFINITIVE" and ranked["a"].r4 and ranked["b"].identifiability == "NOT_IDENTIFIABLE"
    other = hit.select(F.lit(7).cast("bigint").alias("incident_id"), "src", "dst")
    assert {r.confidence for r in detect.rank_divergence(dev, edges, other).collect()} == {"CANDIDATE", "NONE"}


def test_posterior_update_by_hand(spark):
    prior = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5), (2, "A", 1.0)], "run int, service_id string, p double")
    got = {(r.run, r.service_id): r.p for r in select.update_posterior(prior, spark.createDataFrame([(1, "A", 0.9)], "run int, target string, c double"), ["run"]).collect()}
    assert got[1, "A"] == pytest.approx(2.43 / 2.46) and got[1, "A"] + got[1, "B"] == pytest.approx(1) and got[2, "A"] == 1


def test_edge_and_structure_updates(spark):
    edges = spark.createDataFrame([(1, "a", "b", 0.5), (1, "c", "b", 0.2), (1, "c", "d", 0.9)], "run_id int, src string, dst string, confidence double")
    hit = spark.createDataFrame([(1, "a", "b", True)], "run_id int, source string, target string, exceeds boolean")
    got = {(r.src, r.dst): round(r.confidence, 3) for r in select.update_edges(edges, hit).collect()}
    assert got == {("a", "b"): 0.6, ("c", "b"): 0.18, ("c", "d"): 0.9}
    # Two pieces in order: the second weakens what the first raised and creates its own edge; d>b is not there before.
    two = spark.createDataFrame([(1, 1, "a", "b", True), (1, 2, "d", "b", True), (1, 3, "d", "b", False)], "run_id int, seq int, source string, target string, exceeds boolean")
    got = {(r.src, r.dst): round(r.confidence, 4) for r in select.update_edges(edges, two).collect()}
    assert got == {("a", "b"): 0.54, ("c", "b"): 0.162, ("c", "d"): 0.9, ("d", "b"): 0.54}
    miss = spark.createDataFrame([(1, "c", "b", False), (1, "d", "a", True)], "run_id int, source string, target string, exceeds boolean")
    out = select.update_structure(edges, miss, graph.closure(edges, ["run_id"], 3))
    assert {(r.src, r.dst) for r in out.collect()} == {("a", "b"), ("c", "d"), ("d", "a")}


def test_selection_respects_budget_and_authorization(spark):
    rows = [(1, s, "LATENCY", p, br, None, None) for s, p, br in (("a", 0.4, 0.0), ("b", 0.3, 0.1), ("c", 0.3, 0.0))]
    costs = select.probe_costs(spark.createDataFrame(rows, "run int, service_id string, kind string, p double, blast_radius double, impact double, rollback_cost double"), ["run"])
    got = [(r.service_id, r.budget_left) for r in select.greedy_selection(costs, ["run"], budget=70.0).orderBy("step").collect()]
    assert got == [("a", 40.0), ("c", 10.0)]
    first = select.greedy_selection(costs, ["run"], budget=30.0).first()
    gain, p = costs.filter("service_id = 'a'").first().eig, np.array([0.4, 0.3, 0.3])
    new = np.array([0.4 + min(0.4, gain) * 0.6, *(p[1:] * (1 - min(0.4, gain) * 0.4))])
    new /= new.sum()
    assert first.entropy_after == pytest.approx(-(new * np.log(new)).sum()) and first.stop_reason == "BUDGET_EXHAUSTED"
    none = select.greedy_selection(costs, ["run"], theta=9.0).collect()
    assert [(r.service_id, r.step, r.stop_reason) for r in none] == [(None, 0, "ENTROPY_CONVERGED")]
    assert select.greedy_selection(costs, ["run"], budget=10.0).first().stop_reason == "NO_ELIGIBLE"
    assert select.distinct_services(select.random_selection(costs, ["run"]), ["run"]).first().all_distinct


def test_corrections_by_hand(spark):
    p = spark.createDataFrame([("f", "x", 0.01), ("f", "y", 0.04), ("f", "z", 0.03)], "family string, hypothesis string, p double")
    assert {r.hypothesis: round(r.threshold, 6) for r in evaluate.holm(p, ["family"]).collect()} == {"x": 0.016667, "y": 0.05, "z": 0.025}
    assert {r.hypothesis: round(r.adjusted, 6) for r in evaluate.benjamini_hochberg(p, ["family"]).collect()} == {"x": 0.03, "y": 0.04, "z": 0.04}
    assert evaluate.cliffs_delta(spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 2.0), ("k", 3.0, 2.0)], "k string, x double, y double"), ["k"]).first().delta == pytest.approx(0)


def test_special_functions():
    assert normal_cdf(1.96) == pytest.approx(0.9750021, abs=1e-6)
    assert t_sf(2.228, 10) == pytest.approx(0.025, abs=1e-4) and t_sf(-2.228, 10) == pytest.approx(0.975, abs=1e-4)
    assert binomial_sf(8, 10, 0.7) == pytest.approx(sum(math.comb(10, k) * 0.7**k * 0.3 ** (10 - k) for k in range(8, 11)))
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert signed_rank_sf(15, 5) == pytest.approx(1 / 32) and signed_rank_sf(0, 5) == 1
    assert evaluate.required_n() == 23 and evaluate.power_of(23) >= 0.8
    assert evaluate.equivalence(0.0, 0.05, 40, 0.05) < 0.001 and evaluate.equivalence(0.1, 0.05, 40, 0.05) > 0.9
    assert evaluate.wilcoxon_greater(0.0, 0, None, False) == 0.5


MARKS = [((-1, 1), "DIRECTED", False), ((1, -1), "DIRECTED", True), ((1, 1), "BIDIRECTED", False), ((2, 2), "UNDIRECTED", False), ((2, 1), "PARTIALLY_DIRECTED", False)]


@pytest.mark.parametrize(("marks", "kind", "turned"), MARKS)
def test_edge_marks(marks, kind, turned):
    assert causal.edge_type(*marks) == (kind, turned)


def pag_of(spark, model, n=1500, hide=()):
    df = simulate.MODELS[model].sample(spark, n)
    names = [c for c in df.columns if c != "id" and c not in hide]
    long = df.select(F.lit(1).alias("run"), F.col("id").alias("time"), F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in names))).alias("s")).select("run", "time", "s.*")
    return {(r.src, r.dst): r.edge_type for r in causal.discover(long, ["run"]).collect()}


def test_discovery(spark):
    chain = pag_of(spark, "chain")
    assert {frozenset(e) for e in chain} == {frozenset("XZ"), frozenset("ZY")}
    collider = pag_of(spark, "collider")
    assert {frozenset(e) for e in collider} == {frozenset("XZ"), frozenset("YZ")} and all(d == "Z" and k == "PARTIALLY_DIRECTED" for (_, d), k in collider.items())
    diamond = pag_of(spark, "diamond")
    assert frozenset("AD") not in {frozenset(e) for e in diamond} and frozenset("BC") not in {frozenset(e) for e in diamond}
    assert {frozenset(e) for e in pag_of(spark, "confounder", hide=("U",))} == {frozenset("XY")}
    with pytest.raises(causal.TooManyVariables):
        causal.Search(np.eye(16), 100)


def test_discovery_between_services(spark, monkeypatch):
    from tidegauge.plans.pipeline import Analysis

    # x and y each drive z; the far service is outside the subgraph.
    rng = np.random.default_rng(11)
    x, y = rng.normal(0, 1, 400), rng.normal(0, 1, 400)
    values = {"x": x, "y": y, "z": x + y + rng.normal(0, 0.3, 400), "far": x}
    rows = [(1, s, i * 10_000, 10_000, None if i == 7 else float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
    monkeypatch.setattr(Analysis, "series", spark.createDataFrame(rows, SERIES))
    monkeypatch.setattr(Analysis, "scores", spark.createDataFrame([(1, "x", 5.0), (1, "y", 5.0), (1, "z", 9.0), (1, "far", 1.0)], "incident_id bigint, service_id string, max_z double"))
    monkeypatch.setattr(Analysis, "edges", spark.createDataFrame([("z", "q")], "src string, dst string"))
    got = {(r.incident_id, r.src, r.dst): r.edge_type for r in Analysis(spark, "/root/testdata/sf0.001").pag.collect()}
    assert got == {(1, "x", "z"): "PARTIALLY_DIRECTED", (1, "y", "z"): "PARTIALLY_DIRECTED"}


IDENT = [
    ([("X", "Y", "BIDIRECTED")], "NOT_IDENTIFIABLE"),
    ([("X", "Y", "DIRECTED")], "IDENTIFIABLE"),
    ([("X", "Y", "PARTIALLY_DIRECTED")], "CONDITIONALLY_IDENTIFIABLE"),
    ([("X", "M", "DIRECTED"), ("M", "Y", "DIRECTED"), ("X", "Y", "BIDIRECTED")], "IDENTIFIABLE"),
    ([("X", "Y", "DIRECTED"), ("X", "W", "BIDIRECTED")], "REQUIRES_INTERVENTION"),
    ([("V", "X", "DIRECTED"), ("X", "Y", "DIRECTED"), ("X", "Y", "BIDIRECTED")], "CONDITIONALLY_IDENTIFIABLE"),
    ([("X", "Z", "DIRECTED")], "NOT_IDENTIFIABLE"),
]


@pytest.mark.parametrize(("edges", "want"), IDENT)
def test_identifiability(spark, edges, want):
    pag = spark.createDataFrame([(1, *e) for e in edges], "run int, src string, dst string, edge_type string")
    assert causal.identify(pag, spark.createDataFrame([(1, "X", "Y")], "run int, src string, dst string"), ["run"], 3).first().status == want


def test_models(spark):
    m = simulate.MODELS["confounder"]
    seen, done = m.sample(spark, 3000), m.do(X=2.0).sample(spark, 3000)
    assert seen.stat.corr("X", "Y") > 0.5 and abs(done.agg(F.avg("Y")).first()[0]) < 0.1
    assert m.equations["X"][0] == {"U": 0.8} and ("U", "X") in m.edges()
    with pytest.raises(KeyError):
        m.do(Q=1.0)
    with pytest.raises(ValueError, match="cycle"):
        simulate.Model({"a": ({"b": 1.0}, 0, 1), "b": ({"a": 1.0}, 0, 1)}).order()
    assert spark.range(1).select(simulate.queue_length(F.lit(0.5), F.lit(1.0))).first()[0] == pytest.approx(1.0)


def test_responses(spark):
    ok = '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{},"values":[[10,"1"],[20,"NaN"],[30,"x"],[40,"+Inf"]]},{"metric":{},"values":[[10,"3"]]}]}}'
    raw = spark.createDataFrame([(1, ok), (2, '{"status":"error"}'), (3, "{oops"), (4, None), (5, '{"status":"success","data":{"resultType":"matrix","result":[]}}')], "k int, body string")
    assert {(r.time, r.value) for r in telemetry.series_of(raw, ["k"]).collect()} == {(10.0, 2.0)} | ({(40.0, float("inf"))} if spark.sql("select try_cast('+Inf' as double) v").first().v else set())
    assert {(r.k, r.reason) for r in telemetry.rejected_responses(raw).collect()} >= {(2, "status"), (3, "malformed")}


def test_counters_and_histograms(spark):
    c = spark.createDataFrame([("a", 0.0, 5.0), ("a", 10.0, 25.0), ("a", 20.0, 4.0)], "k string, time double, value double")
    assert [r.rate for r in telemetry.counter_rate(c, ["k"]).orderBy("time").collect()] == [2.0, 0.4]
    h = spark.createDataFrame([("a", 1.0, 50), ("a", 2.0, 100), ("a", float("inf"), 100), ("b", 1.0, 0), ("b", float("inf"), 10)], "k string, le double, n bigint")
    got = {r.k: r.quantile for r in telemetry.histogram_quantile(h, ["k"], 0.75).collect()}
    assert got == {"a": 1.5, "b": 1.0}


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "validation.json"
    path.write_text('{"split":"VALIDATION","n_scenarios":1,"scenarios":[{"fault_id":"x","root_cause_service":"a","causal_path":[["a","b"]],"split":"HELD_OUT_TEST"}]}')
    rows = telemetry.scenario_files(spark, str(path))
    assert rows.first().causal_path == [["a", "b"]] and telemetry.without_held_out(rows).count() == 0 and telemetry.without_held_out(rows, token=True).count() == 1
    for form in ("parquet", "json", "csv", "orc"):
        telemetry.write_table(spark.range(3), str(tmp_path / form), form)
        assert spark.read.format(form).option("header", True).load(str(tmp_path / form)).count() == 3
    assert telemetry.latex_rows(spark.createDataFrame([("a_b", 1.5), (None, None)], "x string, y double")).collect()[0].line == r"a\_b & 1.500 \\"
    assert telemetry.mock_series(spark, ["a", "b"], anomaly="b").filter("value = 75").count() == 2


def test_gates_and_records(spark):
    probes = spark.createDataFrame([(False, "eval-x", "t", 0.0, 30.0, False, 0.4, 0.0, 0.9, False), (True, "prod", None, 0.0, 30.0, True, 0.0, 0.0, 0.2, True), (False, "prod", "t", 0.0, 1.0, False, 0.0, 0.0, 0.2, False), (False, "eval-x", "t", 590.0, 30.0, False, 0.0, 0.0, 0.2, False)], "kill boolean, namespace string, target string, cumulative_s double, seconds double, mutates boolean, blast_radius double, impact double, confidence double, override boolean")
    got = [(r.decision, r.hard_stop, r.warnings, r.level) for r in guard.pre_gate(probes, ["eval-x"], "^eval-.+$").collect()]
    assert got == [("ALLOW", None, "BLAST_RADIUS", "SUPERVISED"), ("DENY", "KILL_SWITCH", "", "AUTONOMOUS"), ("DENY", "NAMESPACE", "", "AUTONOMOUS"), ("DENY", "BUDGET", "", "AUTONOMOUS")]
    events = spark.createDataFrame([("a", 1, "PREPARE"), ("a", 2, "APPLY"), ("b", 1, "PREPARE"), ("b", 2, "AUTHORIZE")], "record_id string, seq int, phase string")
    assert [(r.record_id, r.phase) for r in guard.lifecycle_violations(events).collect()] == [("a", "APPLY")]
    fails = spark.createDataFrame([("r", 1, "NOT_IDENTIFIABLE"), ("r", 2, "TIMEOUT"), ("s", 1, "BOUNDARY_LIMITED")], "run_id string, seq int, code string")
    assert {(r.run_id, r.primary_code, r.is_abstention) for r in guard.failure_summary(fails).collect()} == {("r", "NOT_IDENTIFIABLE", False), ("s", "BOUNDARY_LIMITED", True)}


def test_methods_abstain_where_there_is_nothing(spark):
    inc = spark.createDataFrame([(1, 0.0)], "incident_id bigint, t_start double")
    assert methods.unavailable(inc).first().abstained
    truth = spark.createDataFrame([(1, "b")], "incident_id bigint, root string")
    out = methods.oracle(inc, truth, spark.createDataFrame([(1, "a"), (1, "b")], "incident_id bigint, service_id string")).first()
    assert [c.service for c in out.top_candidates] == ["b", "a"] and not out.abstained
    events = spark.createDataFrame([("a", True, True), ("a", False, False), ("b", True, False), ("b", False, True)], "service_id string, anomalous boolean, failed boolean")
    assert {r.service_id: r.score for r in methods.ochiai(events).collect()} == {"a": 1.0, "b": 0.0}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, " A_b", "m", 1000.0 + t, v, 0.0, i) for i, (t, v) in enumerate([(1.0, "1"), (9.0, "2"), (9.0, "3"), (12.0, "NaN"), (15.0, "4"), (None or 31.0, "5")])]
    df = spark.createDataFrame(rows, READINGS)
    df.write.parquet(str(tmp_path / "in"))
    stream = stream_windows(spark.readStream.schema(READINGS).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = {(r.window_start, r.value, r.n_readings) for r in stream_windows(df).collect()}
    assert {(r.window_start, r.value, r.n_readings) for r in spark.sql("select * from windows").collect()} == want and {w[1] for w in want} == {3.0, 4.0, 5.0}
