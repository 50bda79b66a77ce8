"""Checks, generators, methods and tests by hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import causal, evaluate, graph, guard, methods, simulate
from tidegauge.operators.methods import IsolationForest
from tidegauge.plans.runtime import running_totals
from tidegauge.sources.registry import experiment_settings, read_registry


def test_five_checks(spark):
    rows = [
        ("a", "web", "APPLIED", 0, 10_000, True, 50.0, 1.0, True),
        ("b", "web", "FAILED", 500_000, 510_000, True, 50.0, 1.5, None),
        ("c", "web", "APPLIED", 505_000, None, False, 50.0, None, True),
        ("d", None, "APPLIED", 0, None, True, 50.0, 1.0, True),
        ("e", "db", None, 0, 90_000, True, None, None, False),
        ("f", "db", "VERIFIED", 90_000, 95_000, True, 1.0, 1.0, True),
    ]
    df = spark.createDataFrame(rows, "record_id string, destination_service string, status string, applied_ms bigint, ended_ms bigint, rolled_back boolean, latency_ms double, precision_achieved double, isolation_verified boolean")
    got = {r[0]: tuple(r)[1:] for r in guard.five_checks(df).collect()}
    assert got == {
        "a": (True, True, True, True, True, True),
        "b": (False, False, False, False, False, False),
        "c": (True, False, False, False, True, False),
        "e": (True, True, True, True, False, False),
        "f": (True, True, True, True, True, True),
    }


def test_fault_verification(spark):
    rows = [("NETWORK_LATENCY", 100.0, 50.0), ("NETWORK_LATENCY", 100.0, 49.0), ("NETWORK_LATENCY", None, 0.0), ("PACKET_LOSS", None, 0.0), ("QUEUEING", None, 2.0), ("SERVICE_DEGRADATION", None, 50.0), ("RESOURCE_CONTENTION", None, 39.0), ("DEPENDENCY_FAILURE", None, 1.0), ("OTHER", 1.0, 9.0), ("PACKET_LOSS", 1.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, fault string, expected double, measured double")
    assert [r.confirmed for r in guard.verify_fault(df).orderBy("i").collect()] == [True, False, True, False, True, True, False, True, False, False]


def test_oracle_series(spark):
    sc = spark.createDataFrame([("f", "A ", 100.0, [["a", "b"], ["b", "c"], ["a", "b"]], ["b", "c", "z"], 3)], "fault_id string, root_cause_service string, injected_at_t double, causal_path array<array<string>>, affected_services array<string>, seed bigint")
    rows = {(r.service_id, r.time): r.value for r in simulate.oracle_series(sc.unionByName(sc)).collect()}
    assert len(rows) == 4 * 18 and {s for s, _ in rows} == {"a", "b", "c", "z"}
    mean = {s: np.mean([v for (x, t), v in rows.items() if x == s and t >= 130]) for s in "abcz"}
    assert abs(mean["a"] - 50) < 6 and abs(mean["b"] - 40) < 6 and abs(mean["c"] - 40) < 6 and abs(mean["z"]) < 12
    assert rows["c", 110.0] < 30 < rows["c", 120.0]  # second in the path: two steps
    assert rows["b", 120.0] < 30 < rows["b", 130.0]  # its last place counts


def test_generated_structures_are_found(spark):
    edges = {}
    for r in causal.discover(simulate.generated_series(spark, 500), ["model"]).collect():
        edges.setdefault(r.model, {})[frozenset((r.src, r.dst))] = (r.src, r.dst, r.edge_type)
    assert set(edges["chain"]) == {frozenset("XY"), frozenset("YZ")} and set(edges["mediated"]) == {frozenset("XM"), frozenset("MY")}
    assert set(edges["latent"]) == {frozenset("XY")} and edges["latent"][frozenset("XY")][2] != "DIRECTED"
    assert set(edges["collider"]) == {frozenset("XZ"), frozenset("YZ")} and all(dst == "Z" for _, dst, _ in edges["collider"].values())


def test_a_cycle_without_chords_is_undirected():
    # A Gaussian field on a square: opposite corners are independent given the others.
    precision = np.array([[1.0, 0.3, 0.0, 0.3], [0.3, 1.0, 0.3, 0.0], [0.0, 0.3, 1.0, 0.3], [0.3, 0.0, 0.3, 1.0]])
    cov = np.linalg.inv(precision)
    corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    mark = causal.Search(corr, 5000).run()
    assert {(i, j) for i in range(4) for j in range(4) if mark[i, j]} == {(i, (i + s) % 4) for i in range(4) for s in (1, 3)}
    assert all(mark[i, j] == causal.TAIL for i in range(4) for j in range(4) if mark[i, j])


def test_tails_behind_an_undirected_edge():
    s = causal.Search(np.eye(3), 10)
    s.mark[:] = 0
    s.mark[0, 1], s.mark[1, 0], s.mark[1, 2], s.mark[2, 1] = causal.TAIL, causal.TAIL, causal.CIRCLE, causal.CIRCLE
    assert s._selected() and s.mark[2, 1] == causal.TAIL and s.mark[1, 2] == causal.CIRCLE
    s.mark[0, 1], s.mark[2, 1] = causal.CIRCLE, causal.CIRCLE  # a -o b o-o c, a and c apart
    assert s._selected() and s.mark[2, 1] == causal.TAIL


def test_too_many_variables_are_said(spark):
    rows = [(1, t, f"v{i:02d}", float((t * 7 + i * 3) % 11)) for t in range(6) for i in range(16)]
    got = causal.discover(spark.createDataFrame(rows, "k int, time int, variable string, value double"), ["k"]).collect()
    assert [(r.k, r.src, r.edge_type) for r in got] == [(1, None, "TOO_MANY_VARIABLES")]


def test_a_parent_behind_its_child_is_not_adjusted_for(spark):
    pag = spark.createDataFrame([(1, "p", "x", "DIRECTED"), (1, "x", "y", "DIRECTED"), (2, "p", "x", "DIRECTED"), (2, "x", "y", "DIRECTED"), (2, "x", "p", "DIRECTED")], "k int, src string, dst string, edge_type string")
    ask = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "k int, src string, dst string")
    assert {r.k: r.adjustment for r in causal.identify(pag, ask, ["k"]).collect()} == {1: "p", 2: ""}


def test_isolated_rows_score_higher():
    rng = np.random.default_rng(1)
    forest = IsolationForest(rng.normal(0, 1, (2000, 3)))
    usual, odd = forest.score(rng.normal(0, 1, (200, 3))), forest.score(np.array([[8.0, 0.0, 0.0], [6.0, -6.0, 6.0]]))
    assert odd[0] > np.quantile(usual, 0.9) and odd[1] > np.max(usual) and odd[1] > 0.6 > 0.55 > np.median(usual)
    assert IsolationForest(np.zeros((0, 3))).score(np.zeros((2, 3))).tolist() == [0.0, 0.0]
    assert np.allclose(IsolationForest(np.ones((50, 2))).score(np.ones((3, 2))), IsolationForest(np.ones((50, 2))).score(np.ones((1, 2)))[0])


def test_isolation_ranks_the_odd_service(spark):
    rng = np.random.default_rng(4)
    rows = [(1, s, m, k, (90.0 if s == "bad" and k > 35 else 50.0) + float(rng.normal())) for s in ("a", "bad", "c") for m in ("lat_p99", "rps") for k in range(60)]
    aligned = spark.createDataFrame(rows, "incident_id bigint, service_id string, metric_name string, window_id bigint, value double")
    out = {r.incident_id: r for r in methods.isolation_forest(spark.createDataFrame([(1,), (2,)], "incident_id bigint"), aligned, ["lat_p99", "rps"]).collect()}
    assert out[1].top_candidates[0].service == "bad" and out[2].abstained and out[2].abstention_reason == "NO_DATA"


def test_page_rank_is_the_fixed_point(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "c")], "src string, dst string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 2.0), ("d", 0.0), ("lone", 1.0)], "service_id string, weight double")
    names = ["a", "b", "c", "d", "lone"]
    base = np.array([0.25, 0, 0.5, 0, 0.25])
    out = {"b": ["a"], "c": ["b", "a", "d"], "a": ["c"]}
    m = np.array([[1 / len(out[q]) if q in out and p in out[q] else base[names.index(p)] if q not in out else 0.0 for q in names] for p in names])
    want = np.linalg.solve(np.eye(5) - 0.85 * m, 0.15 * base)
    got = {r.service_id: r.score for r in methods.page_rank(edges, weights).collect()}
    assert [got[n] for n in names] == pytest.approx(want.tolist(), abs=1e-7)


def test_pairing_and_small_tests(spark):
    x = spark.createDataFrame([("r", i, float(i)) for i in range(4)], "k string, o int, v double")
    y = spark.createDataFrame([("r", i, 10.0 * i) for i in (3, 5)], "k string, o int, v double")
    assert sorted(tuple(r) for r in evaluate.paired(x, y, ["k"], "o", "v").collect()) == [("r", 1, 0.0, 30.0), ("r", 2, 1.0, 50.0)]
    p = evaluate.binomial_pvalues(spark.createDataFrame([(7, 10), (0, 5)], "k bigint, n bigint")).collect()
    assert [r.p for r in p] == pytest.approx([0.6496107, 1.0], abs=1e-6)
    pairs = spark.createDataFrame([("m", v + 0.1, v) for v in (1.0, 2.0, 4.0, 7.0)] + [("far", v + 9 + v / 10, v) for v in (1.0, 2.0, 4.0)], "metric string, x double, y double")
    got = {r.metric: r.equivalent for r in evaluate.equivalence_tests(pairs, ["metric"], 1.0).collect()}
    assert got == {"m": True, "far": False}
    w = evaluate.wilcoxon_pvalues(evaluate.signed_ranks(pairs, ["metric"])).collect()
    assert {r.metric: r.p for r in w}["far"] == pytest.approx(0.125)


def test_interval_of_cliffs_delta(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0.5, 1, 40), rng.normal(0, 1, 40)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("k", None, 0.0)], "k string, x double, y double")
    r = evaluate.cliffs_interval(df, ["k"]).first()
    y = np.append(y, 0.0)
    ref = [np.sign(rng.choice(x, 40)[:, None] - rng.choice(y, 41)[None]).mean() for _ in range(2000)]
    assert r.low == pytest.approx(np.percentile(ref, 2.5), abs=0.05) and r.high == pytest.approx(np.percentile(ref, 97.5), abs=0.05)


def test_directed_part(spark):
    pag = spark.createDataFrame([("a", "b", "DIRECTED"), ("b", "c", "PARTIALLY_DIRECTED"), ("a", "c", "BIDIRECTED"), ("c", "d", "UNDIRECTED")], "src string, dst string, edge_type string")
    assert {(r.src, r.dst) for r in graph.directed_part(pag, []).collect()} == {("a", "b"), ("b", "c")}


def test_runs_without_a_number_each_count(spark):
    log = spark.createDataFrame([(None, "r1", "m", "s", 1.0, 5.0), (None, "r1", "m", "s", 2.0, 6.0), (1, "r2", "m", "s", 4.0, 1.0), (1, "r2", "m", "s", 4.0, 1.0)], "record_no bigint, run_id string, method_id string, stage_name string, wall_time_s double, memory_mb double")
    r = evaluate.runtime_metrics(log.withColumn("ingested_at", F.lit(0))).first()
    assert r.n_runs == 2 and r.max_s == 4.0 and r.mean_s == pytest.approx(3.5)


def test_running_totals_over_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 3 else None, int(v), int(rng.integers(1, 9))) for i, v in enumerate(rng.permutation(400))] + [("one", 5, 2)]
    df = spark.createDataFrame(rows, "k string, v int, n int").repartition(7)
    got = {(r.k, r.v): r.n_before for r in running_totals(df, ["k"], "v", ["n"]).collect()}
    assert got == {(k, v): sum(m for j, w, m in rows if j == k and w < v) for k, v, _ in rows}
    assert running_totals(df.filter("false"), ["k"], "v", ["n"]).count() == 0


def test_registry(tmp_path):
    (tmp_path / "r.json").write_text('{"experiments": {"E1": {"seed": 3}}}')
    (tmp_path / "none.json").write_text("")
    assert experiment_settings(str(tmp_path / "r.json"), "E1") == {"seed": 3} and read_registry(str(tmp_path / "none.json")) == {}
    with pytest.raises(KeyError, match="E1"):
        experiment_settings(str(tmp_path / "r.json"), "E2")
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("experiments:\n  E1:\n    seed: 4\n")
    assert experiment_settings(str(tmp_path / "r.yaml"), "E1") == {"seed": 4}


def test_stage_log(spark):
    from tidegauge.plans.instrument import StageLog

    log = StageLog()
    assert log.bottleneck is None and log.total_s == 0 and log.table(spark).count() == 0
    with log.stage("collect") as facts:
        facts["n_rows"] = spark.range(1000).count()
    with pytest.raises(ValueError), log.stage("fci", "quick"):
        raise ValueError("no")
    rows = {r.stage_name: r for r in log.table(spark).collect()}
    assert rows["collect"].n_rows == 1000 and rows["collect"].notes == "" and rows["fci"].notes == "failed: ValueError"
    assert log.bottleneck == "collect" and log.total_s >= rows["collect"].wall_time_s > 0
