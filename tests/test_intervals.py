import datetime as dt
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidegauge.operators import intervals
from tidegauge.operators.intervals import intervention_periods, merge_intervals, merge_lists


def brute(rows, max_gap=None):
    out = set()
    keys = {k for k, s, e in rows}
    for k in keys:
        spans = sorted((s, e) for kk, s, e in rows if kk == k and s is not None and e is not None and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False) if max_gap is None or b[0] - a[1] <= max_gap}
    return out


def found(df):
    return {tuple(r) for r in df.collect()}


SCHEMA = "k string, s bigint, e bigint, _block bigint, spans string"


@pytest.mark.parametrize("block", [10, 1_000, 10**9])
def test_merge_against_brute_force_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(intervals, "BLOCK_MS", block)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(-500, 4000), s + rng.choice([1, 3, 20, 700]), 0, "x") for _ in range(400)]
    rows += rows[:30] + [("hot", i * 2, i * 2 + 2, 1, "y") for i in range(200)]
    got = found(merge_intervals(spark.createDataFrame(rows, SCHEMA), ["k"], "s", "e", max_gap_ms=50))
    assert got == brute([r[:3] for r in rows], 50)


def test_missing_reversed_and_empty(spark):
    rows = [("a", None, 5, 0, ""), ("a", 5, None, 0, ""), ("a", 9, 3, 0, ""), ("a", 4, 4, 0, "")]
    assert found(merge_intervals(spark.createDataFrame(rows, SCHEMA), ["k"], "s", "e")) == set()
    assert found(merge_intervals(spark.createDataFrame([], SCHEMA), ["k"], "s", "e")) == set()
    one = spark.createDataFrame([("a", 1, 2, 0, ""), ("a", 2, 3, 0, "")], SCHEMA)
    assert found(merge_intervals(one, ["k"], "s", "e")) == {("a", "period", 1, 3)}


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(1, 9))))
def test_linear_merge(items):
    import numpy as np

    items.sort(key=lambda x: x[0])  # every interval is a list of its own
    row, s = (np.array([x[i] for x in items], dtype=np.int64) for i in (0, 1))
    e = s + np.array([x[2] for x in items], dtype=np.int64)
    part = np.arange(len(row)) - np.searchsorted(row, row)
    r, a, b = merge_lists(row, part, s, e)
    got = {(int(k), "period", int(x), int(y)) for k, x, y in zip(r, a, b, strict=True)}
    assert got == {x for x in brute(list(zip(row.tolist(), s.tolist(), e.tolist(), strict=True))) if x[1] == "period"}


@pytest.mark.parametrize("fan", [2, 3])
def test_trees_of_several_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(intervals, "FAN", fan)
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.7 else "b", s := rng.randrange(0, 9000), s + rng.choice([1, 4, 9]), 0, "x") for _ in range(900)]
    rows += [("hot", 100, 104, 0, "x")] * 100
    df = spark.createDataFrame(rows, SCHEMA).repartition(11)
    assert found(merge_intervals(df, ["k"], "s", "e")) == brute([r[:3] for r in rows])


def test_valid_record_rules(spark):
    at = dt.datetime(2024, 1, 1)
    later = at + dt.timedelta(seconds=5)
    schema = "record_id string, destination_service string, interface string, t_applied double, t_rolled_back double, lease_s double, status string, ingested_at timestamp, kind string"
    rows = [
        ("1", "Web_A ", " ETH0", 10.0, None, 5.0, "APPLIED", at, "z"),
        ("1", "web-a", "eth0", 10.0, 12.0, 5.0, "rolled_back", later, "z"),
        ("2", "web.a", "eth0", 12.0, None, 3.0, "VERIFIED", at, "z"),
        ("3", "web-a", "eth0", 0.0, 50.0, None, "pending", at, "z"),
        ("4", "web-a", None, 0.0, 50.0, None, "APPLIED", at, "z"),
        ("5", "web-a", "eth0", None, 50.0, 1.0, "APPLIED", at, "z"),
        ("6", "web-a", "eth0", 30.0, 20.0, 9.0, "APPLIED", at, "z"),
        ("7", "web-a", "eth0", 40.0, float("nan"), None, "APPLIED", at, "z"),
        (None, "web-a", "eth0", 16.0, 17.0, None, None, None, "z"),
        (None, None, "eth0", 16.0, 17.0, None, None, None, "z"),
    ]
    assert found(intervention_periods(spark.createDataFrame(rows, schema))) == {("web-a", "eth0", "period", 10000, 15000), ("web-a", "eth0", "gap", 15000, 16000), ("web-a", "eth0", "period", 16000, 17000)}
