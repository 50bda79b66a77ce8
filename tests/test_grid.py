import pytest

from tidegauge.operators import grid
from tidegauge.operators.grid import grid_streams, grid_windows

RAW = "incident_id bigint, service_id string, metric_name string, ts double, value_str string, collection_lag_s double, seq bigint, window_id string, y int"
INC = "incident_id bigint, t_start double, t_end double, delta_t_s double, service_id string"


def raw(spark, readings, source=(1, "a", "m")):
    return spark.createDataFrame([(*source, t, v, None, i, "clash", 1) for i, (t, v) in enumerate(readings)], RAW)


def incident(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], INC)


@pytest.mark.parametrize("dense", [100_000, 1])
def test_windows_values_and_marks(spark, monkeypatch, dense):
    monkeypatch.setattr(grid, "DENSE_SOURCE", dense)
    readings = [(100.0, "1"), (105.0, " 2.0 "), (105.0, "2"), (125.0, "+4e0"), (131.0, "NaN"), (139.0, "4,5"), (None, "9"), (160.0, "7"), (99.0, "0")]
    rows = {r.window_id: r for r in grid_windows(raw(spark, readings), incident(spark, (1, 100.0, 155.0, 10.0))).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5]  # the last window is cut short by t_end
    assert [rows[k].n_readings for k in range(6)] == [2, 0, 1, 0, 0, 0]
    assert [rows[k].missing for k in range(6)] == [False, True, False, True, True, True]
    assert rows[1].value is None and rows[1].estimate is not None and rows[4].n_readings == 0
    assert 1.0 <= rows[0].support <= 3.0


def test_a_straight_line_is_reproduced(spark):
    readings = [(100.0 + 3.3 * i, str(2.0 + 0.5 * (3.3 * i))) for i in range(80)]
    for r in grid_windows(raw(spark, readings), incident(spark, (1, 100.0, 360.0, 10.0))).collect():
        assert r.value == pytest.approx(2.0 + 0.5 * (r.window_id * 10 + 5), abs=1e-6)


def test_blocks_do_not_matter(spark, monkeypatch):
    readings = [(100.0 + 7.1 * i, str(i % 5)) for i in range(200)]
    inc = incident(spark, (1, 100.0, 1500.0, 10.0))
    whole = {r.window_id: (r.n_readings, r.estimate and round(r.estimate, 9)) for r in grid_windows(raw(spark, readings), inc).collect()}
    monkeypatch.setattr(grid, "DENSE_SOURCE", 3)
    assert whole == {r.window_id: (r.n_readings, r.estimate and round(r.estimate, 9)) for r in grid_windows(raw(spark, readings), inc).collect()}


def test_sources_without_readings_services_or_incidents(spark):
    inc = incident(spark, (1, 0.0, 30.0, 10.0), (1, 0.0, 30.0, 10.0), (2, None, 5.0, 1.0), (3, 9.0, 5.0, 1.0))
    unusable = raw(spark, [(None, None), (5.0, "n/a")])
    assert [(r.window_id, r.missing) for r in grid_windows(unusable, inc).orderBy("window_id").collect()] == [(0, True), (1, True), (2, True)]
    assert grid_windows(raw(spark, [(5.0, "1")], (1, None, "m")), inc).count() == 0
    assert grid_windows(raw(spark, [(5.0, "1")], (9, "a", "m")), inc).count() == 0
    assert grid_windows(raw(spark, [(5.0, "1")], (1, "a", None)), inc).count() == 3
    empty = spark.createDataFrame([], RAW)
    assert grid_windows(empty, inc).count() == 0 and grid_windows(raw(spark, [(5.0, "1")]), incident(spark)).count() == 0
    s = grid_streams(raw(spark, [(5.0, "1")]), inc).collect()
    assert [(r.window_ids, r.values, r.n_missing, r.n_imputed) for r in s] == [([0, 1, 2], [1.0, None, None], 2, 0)]
