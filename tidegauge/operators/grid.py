"""Irregular readings onto the regular grid of windows of an incident.

Method: local polynomial regression with a compact kernel. Readings are indexed by (source, block
of windows, window); each grid time takes the readings of its own and the two neighbouring windows,
weighted by an Epanechnikov kernel of half-width 1.5 windows around the middle of the window, and
solves the weighted local line from their moments. Moments are sums, so they combine before a
shuffle. The effective support of a window is (sum w)^2 / sum w^2, once over all readings near it and
once over those inside it; a window is missing where the support inside it is insufficient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import epoch_ms, norm_name, usable_number
from tidegauge.plans.runtime import bounded_broadcast, cut_lineage

#: Windows in a block; a block is one row of the index.
BLOCK_WINDOWS = 32
#: Half-width of the kernel in windows.
HALF_WIDTH = 1.5
#: Rows of a source up to which the readings of its blocks are kept as arrays, with the same result.
DENSE_SOURCE = 100_000
SOURCE = ["incident_id", "service_id", "metric_name"]
_MOMENTS = ["_s0", "_s1", "_s2", "_t0", "_t1", "_q0", "_s0_in", "_q0_in"]


def window_grid(incidents: DataFrame) -> DataFrame:
    """Start, width and number of windows of each incident, in whole ms.

    The last window starts before ``t_end``. An incident with a NULL time, no width or no extent
    has no windows; of repeated incident rows the greatest counts.
    """
    g = incidents.select("incident_id", epoch_ms("t_start").alias("start_ms"), epoch_ms("t_end").alias("end_ms"), epoch_ms("delta_t_s").alias("delta_ms")).filter("delta_ms > 0 and end_ms > start_ms and incident_id is not null")
    return g.groupBy("incident_id").agg(F.max(F.struct("start_ms", "end_ms", "delta_ms")).alias("g")).select("incident_id", "g.*", F.expr("cast(ceil((g.end_ms - g.start_ms) / g.delta_ms) as bigint)").alias("n_windows"))


def _kernel_moments(x: Column, y: Column, inside: Column) -> list[Column]:
    w = F.when(F.abs(x) < HALF_WIDTH, 1.0 - (x / HALF_WIDTH) * (x / HALF_WIDTH)).otherwise(0.0)
    own = F.when(inside, w).otherwise(0.0)
    sums = [w, w * x, w * x * x, w * y, w * x * y, w * w, own, own * own]
    return [F.sum(c).alias(n) for c, n in zip(sums, _MOMENTS, strict=True)]


def _support(s0: str, q0: str) -> Column:
    return F.when(F.col(q0) > 0, F.col(s0) * F.col(s0) / F.col(q0)).otherwise(0.0)


def grid_windows(raw: DataFrame, incidents: DataFrame, *, min_support: float = 1.0) -> DataFrame:
    """One row for each window of each source: its estimate or a missing mark.

    Columns: incident_id, service_id, metric_name, window_id, n_readings (distinct usable readings
    inside the window), support (effective number of readings near it), estimate (regression value
    at the middle of the window), value (the estimate, or NULL where the window is missing) and
    missing (before any filling: the support of the readings inside it is under ``min_support``,
    which one reading just gives). A source is a (incident, service, metric) with any row and a
    service; one whose readings are all unusable has all its windows missing. A reading is usable if
    its time is finite and its text a finite number; deliveries of the same source, time and value
    count once. NULL metrics form a source of their own; sources of unknown incidents have no grid;
    empty tables give no rows; other columns are ignored.
    """
    grid = bounded_broadcast(window_grid(incidents))
    given = raw.filter("service_id is not null")
    metric = F.col("metric_name").cast("string").alias("metric_name")
    # Sources are counted by name as it is spelled, which needs no parsing.
    spelled = given.groupBy("incident_id", "service_id", metric).agg(F.count(F.lit(1)).alias("_n"))
    sources = spelled.withColumn("service_id", norm_name("service_id")).groupBy(*SOURCE).agg(F.sum("_n").alias("_n"))
    sources = cut_lineage(sources.join(grid, "incident_id").select(*SOURCE, "_n", "n_windows"))
    blocks = F.explode(F.expr(f"sequence(0L, (n_windows - 1) div {BLOCK_WINDOWS})")).alias("_block")
    blocks = sources.select(*SOURCE, "n_windows", blocks)
    rows = given.select("incident_id", norm_name("service_id").alias("service_id"), metric, epoch_ms("ts").alias("ts_ms"), usable_number("value_str").alias("y"))
    # Position in units of windows, once for the window itself and once for each neighbour's block.
    at = rows.filter("ts_ms is not null and y is not null").join(grid, "incident_id").filter("ts_ms < end_ms + 2 * delta_ms and ts_ms >= start_ms - 2 * delta_ms")
    place = (F.col("ts_ms") - F.col("start_ms")) / F.col("delta_ms")
    at = at.select(*SOURCE, "y", place.alias("_u"), F.expr("cast(floor((ts_ms - start_ms) / delta_ms) as bigint)").alias("_home"), (F.col("ts_ms") < F.col("end_ms")).alias("_inside"), "n_windows")
    near = at.withColumn("_block", F.explode(F.expr(f"array_distinct(transform(filter(array(_home - 1, _home, _home + 1), k -> k >= 0 and k < n_windows), k -> k div {BLOCK_WINDOWS}))")))
    reading = F.struct("_home", "_u", "y", "_inside")
    none = F.lit(None).cast(near.select(reading.alias("r")).schema["r"].dataType)
    seeds = blocks.select(*SOURCE, "_block", "n_windows", none.alias("_r"))
    index = near.select(*SOURCE, "_block", "n_windows", reading.alias("_r")).unionByName(seeds)
    dense = sources.filter(F.col("_n") > DENSE_SOURCE).select(*SOURCE)
    if dense.isEmpty():
        moments = _moments_of_arrays(index)
    else:
        # Sources too dense for arrays: the same moments, from rows that are combined before the shuffle.
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in SOURCE]
        mark = bounded_broadcast(dense).alias("b")
        sparse = _moments_of_arrays(index.alias("a").join(mark, same, "left_anti"))
        moments = sparse.unionByName(_moments_of_rows(index.alias("a").join(mark, same, "left_semi").distinct()))
    # Two readings at different places carry a line; otherwise the local mean is all there is.
    det = F.col("_s0") * F.col("_s2") - F.col("_s1") * F.col("_s1")
    mean = F.col("_t0") / F.when(F.col("_s0") > 0, F.col("_s0"))
    slope = (F.col("_s2") * F.col("_t0") - F.col("_s1") * F.col("_t1")) / F.when(det > 0, det)
    line = F.when(det > 1e-9 * F.col("_s0") * F.col("_s0"), slope).otherwise(mean)
    missing = _support("_s0_in", "_q0_in") < min_support
    out = moments.select(*SOURCE, "window_id", F.col("_in").alias("n_readings"), _support("_s0", "_q0").alias("support"), line.alias("estimate"), missing.alias("missing"))
    return out.select(*SOURCE, "window_id", "n_readings", "support", "estimate", F.when(~F.col("missing"), F.col("estimate")).alias("value"), "missing")


_PLACES = f"""
    if(_r is null,
       transform(sequence(_block * {BLOCK_WINDOWS}, least(n_windows, (_block + 1) * {BLOCK_WINDOWS}) - 1), k -> named_struct('k', k, 'x', cast(null as double), 'y', cast(null as double), 'i', false)),
       transform(filter(array(_r._home - 1, _r._home, _r._home + 1), k -> k >= 0 and k < n_windows and k div {BLOCK_WINDOWS} = _block),
                 k -> named_struct('k', k, 'x', _r._u - k - 0.5D, 'y', _r.y, 'i', k = _r._home and _r._inside)))
"""


def _sum_by_window(places: DataFrame) -> DataFrame:
    x, y = F.col("p.x"), F.col("p.y")
    return places.groupBy(*SOURCE, "_block", F.col("p.k").alias("window_id")).agg(*_kernel_moments(x, y, F.col("p.i")), F.count_if(F.col("p.i")).alias("_in"))


def _moments_of_arrays(index: DataFrame) -> DataFrame:
    """Readings gathered once for each (source, block); the sums by window need no further shuffle."""
    held = index.groupBy(*SOURCE, "_block").agg(F.max("n_windows").alias("n_windows"), F.collect_set("_r").alias("_rs"))
    places = held.select(*SOURCE, "_block", "n_windows", F.explode(F.expr("array_append(_rs, cast(null as struct<_home:bigint,_u:double,y:double,_inside:boolean>))")).alias("_r")).select(*SOURCE, "_block", F.explode(F.expr(_PLACES)).alias("p"))
    return _sum_by_window(places)


def _moments_of_rows(index: DataFrame) -> DataFrame:
    """The same sums from rows; salted by nothing, as partial sums are combined before the shuffle."""
    return _sum_by_window(index.select(*SOURCE, "_block", F.explode(F.expr(_PLACES)).alias("p")))


def grid_streams(raw: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row for each source in the form of an aligned stream: window_ids, values, n_missing.

    Missing windows have a NULL value. n_imputed is 0: nothing is invented.
    """
    return grid_windows(raw, incidents).groupBy(*SOURCE).agg(F.array_sort(F.collect_list(F.struct("window_id", "value"))).alias("_w"), F.count_if("missing").alias("n_missing")).select(*SOURCE, F.col("_w.window_id").alias("window_ids"), F.col("_w.value").alias("values"), "n_missing", F.lit(0).cast("bigint").alias("n_imputed"))
