import numpy as np
import pytest

from tidegauge.operators import spikes
from tidegauge.operators.spikes import implausible, implausible_readings

RAW = "incident_id bigint, service_id string, metric_name string, ts double, value_str string, collection_lag_s double, seq bigint, t string, own string"


def judge(values, metric="rps"):
    v = np.array(values, float)
    return implausible(np.zeros(len(v), int), v, np.array([metric], object)).tolist()


def wave(n, seed=0, level=100.0):
    return (level + np.random.default_rng(seed).normal(0, 1, n)).round(3).tolist()


def test_spikes_alone_and_in_groups():
    v = wave(60)
    v[10] = 300.0
    v[20:23] = [2.0, 2.1, 1.9]
    v[40:44] = [300.0] * 4  # four are a change of level
    r = judge(v)
    assert [i for i, x in enumerate(r) if x == "spike"] == [10, 20, 21, 22]


def test_lasting_changes_of_level_are_no_spikes():
    assert set(judge(wave(40) + wave(40, 1, 180.0))) == {""}


def test_first_and_last_readings_have_no_level_around_them():
    v = wave(40)
    v[0] = v[-1] = 900.0
    assert "spike" not in judge(v)


def test_physical_limits():
    assert judge([-1, 0.5, 1.0, 1.2], "err_rate") == ["impossible", "", "", "impossible"]
    assert judge([101.0, 100.0], "cpu_pct") == ["impossible", ""] and judge([101.0], "lat_p99") == [""]


def test_stuck_runs_only_where_values_seldom_repeat():
    v = wave(50)
    v[20:28] = [v[20]] * 8
    assert [i for i, x in enumerate(judge(v)) if x == "stuck"] == list(range(20, 28))
    v[27] += 0.5
    assert "stuck" not in judge(v)
    assert set(judge([5.0] * 60)) == {""}
    coarse = np.round(np.array(wave(80)) / 5).repeat(2) * 5
    assert "stuck" not in judge(coarse)


def test_constant_source_with_a_spike():
    v = [44.0] * 50
    v[20] = 236.0
    assert judge(v) == [""] * 20 + ["spike"] + [""] * 29
    assert judge([]) == [] and judge([1.0]) == [""]


def rows_of(values, service="a", start=0):
    return [(1, service, "rps", 1000.0 + 10 * i, str(v), None, start + i, "clash", "clash") for i, v in enumerate(values)]


def test_deliveries_nulls_and_clashing_columns(spark):
    v = wave(40)
    v[15] = 900.0
    rows = rows_of(v) + [(1, " A", "rps", 1150.0, "9e2", 3.0, 500, "", ""), (1, None, "rps", 1150.0, "900", None, 501, "", ""), (1, "a", "rps", None, "900", None, 502, "", ""), (1, "a", "rps", 1160.5, None, None, 503, "", ""), (1, "a", None, 1.0, "-4", None, 504, "", "")]
    got = {(r.seq, r.reason) for r in implausible_readings(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {(15, "spike"), (500, "spike"), (504, "impossible")}
    assert implausible_readings(spark.createDataFrame([], RAW)).count() == 0


@pytest.mark.parametrize("chunk", [40, 150, 700])
def test_long_sources_in_pieces_agree_with_whole_ones(spark, monkeypatch, chunk):
    v = wave(900, 5)
    for i in (100, 333, 500, 501, 777):
        v[i] = 500.0
    v[640:650] = [v[640]] * 10
    v[222] = -1.0
    # Rounded in its first half: values repeat ordinarily, so a run of equal ones is none that sticks.
    half = np.array(wave(600, 7))
    half[:300] = np.round(half[:300])
    half[450:460] = half[450]
    # Most readings in one burst, and one far off in time.
    burst = rows_of(wave(500, 9), "c", 9000)
    burst = [(*r[:3], 2000.0 + i * 0.5 if i < 499 else 9e6, *r[4:]) for i, r in enumerate(burst)]
    burst[250] = (*burst[250][:4], "999", *burst[250][5:])
    rows = rows_of(v) + rows_of(v[:200], "a", 7000) + rows_of(half.tolist(), "b", 5000) + burst + rows_of(wave(30), "d", 8000)
    df = spark.createDataFrame(rows, RAW)
    whole = {(r.seq, r.reason) for r in implausible_readings(df).collect()}
    assert {s for s, x in whole if x == "stuck"} == set(range(640, 650)) and (9250, "spike") in whole and (7100, "spike") in whole
    monkeypatch.setattr(spikes, "CHUNK", chunk)
    assert {(r.seq, r.reason) for r in implausible_readings(df).collect()} == whole


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_short_sources(n):
    assert len(judge(wave(n))) == n
