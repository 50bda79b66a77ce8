"""Reachability in graphs that every worker holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_trials import SMALL, written

from tidegauge.operators import graph, held
from tidegauge.plans import reference


@pytest.mark.parametrize("n,m", [(40, 90), (60, 60), (5, 0)])
def test_held_graph(spark, n, m):
    rng = np.random.default_rng(n)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (m, 2)).tolist()], "src string, dst string")
    calls = held.held_graph(edges)
    far = graph.closure(edges, []).withColumn("path", F.array_join("path", ">"))
    want = {(r.src, r.dst): (r.depth, r.path) for r in far.collect()}
    assert {(r.src, r.dst): (r.depth, r.path) for r in held.all_paths(spark, calls).collect()} == want
    names = calls.names.to_pylist()
    assert held.all_reach_counts(spark, calls).tolist() == [sum(a == x for a, _ in want) for x in names]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(names)), np.arange(len(names))))
    a, b = a[a != b], b[a != b]
    depths = [want.get((names[i], names[j]), (0,))[0] for i, j in zip(a, b, strict=True)]
    assert calls.depths(a, b, 3).tolist() == [d if d <= 3 else 0 for d in depths]


def test_closure_writes_only_its_edges(spark):
    reference.g12_degrees(spark, SMALL)
    before, _ = written(spark)
    reference.g3_closure(spark, SMALL).collect()
    assert written(spark)[0] - before <= 1


def test_graphs_too_large_to_hold(spark, monkeypatch):
    monkeypatch.setattr(held, "HELD_EDGES", 3)
    assert held.held_graph(spark.createDataFrame([("a", "b")] * 4, "src string, dst string")) is None
    got = reference.g3_closure(spark, SMALL)
    monkeypatch.undo()
    assert not got.exceptAll(reference.g3_closure(spark, SMALL)).count()
