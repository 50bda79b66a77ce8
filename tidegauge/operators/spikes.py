"""Implausible readings of a source: impossible values, spikes and stuck runs.

Method: robust exponentially weighted control charts. Each source has a running mean and scale;
a suspected value is clipped before it updates either, so a spike cannot pull its own limits. An
excursion that returns to the level before it within three readings is a spike; one that stays is
a change of level, from which the chart starts again. Run-length counters find stuck values and
physical limits the impossible ones. The charts of all sources of a batch advance together, one
reading each step.

What is normal for a source (scatter, level, repeats, constant values) is always taken over the whole
source. A source too long for one task is cut by rank; its pieces give mergeable counts (log-spaced
histograms, distinct values) that are joined and handed back, and each piece is charted from a few
hundred readings before it, beyond which a chart forgets. So results do not depend on how a source is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import epoch_ms, norm_name, usable_number
from tidegauge.plans.runtime import bounded_broadcast, cut_lineage, running_totals

SOURCE = ["incident_id", "service_id", "metric_name"]
#: Weight of a new reading in the running mean and in the running scale.
MEAN_WEIGHT, SCALE_WEIGHT = 0.3, 0.05
#: Scales from the mean at which a value is suspected, and at which a returning excursion is a spike.
SUSPECT, FAR = 6.0, 9.0
#: A suspected value enters the mean no further than this many scales off.
CLIP = 2.0
#: Longest spike and shortest stuck run in readings.
SPIKE_LEN, STUCK_LEN = 3, 8
#: Share of repeats, and of distinct values, beyond which a source repeats ordinarily.
REPEATS, DISTINCT, LEAST_REST = 0.06, 0.7, 5
#: Rows of a piece of a source; a source of up to so many is one piece.
CHUNK = 20_000
#: Readings charted before a piece (the scale forgets at 0.95 a reading, the mean at 0.7) and after it.
BEFORE, AFTER = 512, 64
#: Width in ms of the time cells that pieces are made of.
CELL_MS = 64
#: Bins of an octave in the histograms that medians are taken from.
OCTAVE = 1024
#: Metrics that are shares of 1 or of 100; every metric is at least 0.
UPPER_LIMITS = {"err_rate": 1.0, "cpu_pct": 100.0, "mem_pct": 100.0}
#: Cells of the padded matrix that is charted at once.
CELLS = 2_000_000


def _binned(x: np.ndarray) -> np.ndarray:
    """Values not below 0 by log-spaced bin; 0 has a bin of its own under all others."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.ceil(np.log2(x) * OCTAVE), -(2.0**31)).astype(np.int64)


def _bin_value(b: np.ndarray) -> np.ndarray:
    return np.where(b > -(2**31), np.exp2(b / OCTAVE), 0.0)


def _scale_of(steps: tuple[np.ndarray, np.ndarray], values: tuple[np.ndarray, np.ndarray], quantum: float, metric: str) -> float:
    """Scale of a source from histograms (bins, counts) of its steps and values and its least step.

    Taken from the steps between readings, which level changes hardly touch.
    """

    def median(bins: np.ndarray, n: np.ndarray) -> float:
        if not len(bins):
            return 0.0
        upto = np.cumsum(n)
        at = np.searchsorted(upto, [(upto[-1] + 1) // 2, upto[-1] // 2 + 1])
        return float(_bin_value(bins[at]).mean())

    s = median(*steps) * 1.4826 / np.sqrt(2)
    level = median(*values)
    bins, n = steps
    small = (bins > -(2**31)) & (bins <= _binned(np.array([2.5 * quantum]))[0])
    # Rounded readings: a step that a source takes often, and that is small against its level, is ordinary.
    often = n[small].sum() >= max(4 if level > 0 else 8, 0.08 * n.sum())
    coarse = often and (quantum <= 0.35 * level or level == 0)
    least = 1e-9 if s > 0 else max(0.02 * level, 0.001 if metric == "err_rate" else 0.05)
    return max(s, least, 0.7 * quantum if coarse else 0.0)


def _ordinary_scatter(row: np.ndarray, v: np.ndarray, n_rows: int, metric: np.ndarray) -> np.ndarray:
    """:func:`_scale_of` for each source held whole."""
    same = row[1:] == row[:-1]
    step, at = np.abs(np.diff(v))[same], row[1:][same]
    steps = _binned(step)
    s = _middle(_bin_value(steps), at, n_rows) * 1.4826 / np.sqrt(2)
    level = _middle(_bin_value(_binned(v)), row, n_rows)
    moved = step > 0
    quantum = pd.Series(step[moved]).groupby(at[moved]).min().reindex(range(n_rows), fill_value=0.0).to_numpy()
    small = moved & (steps <= _binned(2.5 * quantum)[at])
    n_small = np.bincount(at[small], minlength=n_rows)
    n_steps = np.bincount(at, minlength=n_rows)
    often = n_small >= np.maximum(np.where(level > 0, 4, 8), 0.08 * n_steps)
    coarse = often & ((quantum <= 0.35 * level) | (level == 0))
    flat = np.maximum(0.02 * level, np.where(metric == "err_rate", 0.001, 0.05))
    least = np.maximum(np.where(s > 0, 1e-9, flat), np.where(coarse, 0.7 * quantum, 0.0))
    return np.maximum(s, least)


def _middle(x: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    return pd.Series(x).groupby(row).median().reindex(range(n_rows), fill_value=0.0).to_numpy()


def chart_spikes(x: np.ndarray, n: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Spikes of padded series: ``x`` has a row for each step and a column for each source."""
    steps, cols = x.shape
    flags = np.zeros(x.shape, bool)
    if not cols:
        return flags
    first = np.where(np.arange(min(5, steps))[:, None] < n, x[:5], np.nan)
    mean = np.nanmedian(first, axis=0)
    s = scale.copy()
    out = np.zeros(cols, np.int64)
    nearest = np.full(cols, np.inf)
    recent = np.zeros((SPIKE_LEN + 1, cols))
    for t in range(steps):
        v, live = x[t], t < n
        d = v - mean
        off = np.abs(d) / s
        suspect = live & (off > SUSPECT)
        back = live & ~suspect & (out > 0)
        spike = back & (out <= SPIKE_LEN) & (nearest > FAR) & (t > out)
        for k in range(1, SPIKE_LEN + 1):
            if t >= k:
                flags[t - k] |= spike & (out >= k)
        out = np.where(suspect, out + 1, np.where(live, 0, out))
        nearest = np.where(suspect, np.minimum(nearest, off), np.inf)
        recent = np.vstack([recent[1:], v[None]])
        moved = suspect & (out > SPIKE_LEN)
        take = np.clip(d, -CLIP * s, CLIP * s)
        mean = np.where(moved, np.median(recent, axis=0), np.where(live & ~suspect, mean + MEAN_WEIGHT * take, mean))
        s = np.where(live & ~suspect, np.maximum((1 - SCALE_WEIGHT) * s + SCALE_WEIGHT * np.minimum(1.25 * np.abs(d), CLIP * s), 0.75 * scale), s)
        out = np.where(moved, 0, out)
    return flags


def _runs(row: np.ndarray, v: np.ndarray, metric: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of readings sorted by source and time: impossible, begins a run of equal values, is in a long run."""
    upper = np.array([UPPER_LIMITS.get(m, np.inf) for m in metric])
    cannot = (v < 0) | (v > upper[row])
    opens = np.ones(len(v), bool)
    opens[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
    run = np.cumsum(opens) - 1
    return cannot, opens, np.bincount(run)[run] >= STUCK_LEN


def _seldom(n_rest: np.ndarray, repeats: np.ndarray, distinct: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Whether values seldom repeat outside long runs, from counts of the source or columns of them."""
    return ~constant & (n_rest >= LEAST_REST) & (repeats <= REPEATS * n_rest) & (distinct >= DISTINCT * n_rest)


def _chart_all(r: np.ndarray, w: np.ndarray, n_rows: int, scale: np.ndarray) -> np.ndarray:
    """Spikes among charted readings of many sources, in groups of sources of like length."""
    spike = np.zeros(len(w), bool)
    n = np.bincount(r, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = np.arange(len(r)) - begin[r]
    by_length = np.argsort(n, kind="stable")
    by_length = by_length[n[by_length] > 0]
    lo = 0
    while lo < len(by_length):
        hi = lo + 1
        while hi < len(by_length) and n[by_length[hi]] * (hi + 1 - lo) <= CELLS:
            hi += 1
        cols = by_length[lo:hi]
        at = np.full(n_rows, -1)
        at[cols] = np.arange(len(cols))
        mine = np.flatnonzero(at[r] >= 0)
        x = np.zeros((n[cols].max(), len(cols)))
        x[place[mine], at[r[mine]]] = w[mine]
        spike[mine] = chart_spikes(x, n[cols], scale[cols])[place[mine], at[r[mine]]]
        lo = hi
    return spike


def implausible(row: np.ndarray, v: np.ndarray, metric: np.ndarray) -> np.ndarray:
    """Reason of each reading ('' where plausible), for sources held whole, sorted by source and time."""
    n_rows = len(metric)
    reason = np.full(len(v), "", dtype=object)
    if not len(v):
        return reason
    cannot, opens, long_run = _runs(row, v, metric)
    # A value that comes back in several long runs is the source's constant level.
    begun = pd.DataFrame({"row": row[long_run & opens], "v": v[long_run & opens]})
    constant = np.zeros(n_rows, bool)
    constant[begun.loc[begun.duplicated(), "row"].unique()] = True

    def repeats_seldom(rest: np.ndarray) -> np.ndarray:
        n_rest = np.bincount(row[rest], minlength=n_rows)
        repeats = np.bincount(row[rest & ~opens], minlength=n_rows)
        distinct = pd.Series(v[rest]).groupby(row[rest]).nunique().reindex(range(n_rows), fill_value=0).to_numpy()
        return _seldom(n_rest, repeats, distinct, constant)

    # Of a stuck run only the first reading enters the chart, or the scale would shrink.
    charted = ~cannot & ~(long_run & ~opens & repeats_seldom(~long_run & ~cannot)[row])
    r, w = row[charted], v[charted]
    spiked = np.zeros(len(v), bool)
    if len(w):
        spiked[np.flatnonzero(charted)[_chart_all(r, w, n_rows, _ordinary_scatter(r, w, n_rows, metric))]] = True
    reason[long_run & repeats_seldom(~long_run & ~spiked & ~cannot)[row]] = "stuck"
    reason[spiked] = "spike"
    reason[cannot] = "impossible"
    return reason


class _Held:
    """Readings of a batch of (source or piece, readings) sorted by row, time and value, each once."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        readings = batch.column("readings")
        flat = readings.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.asarray(readings.value_lengths()))
        t, v = np.asarray(flat.field("t")), np.asarray(flat.field("v"))
        self.order = np.lexsort((v, t, row))
        self.rows, t, self.values = row[self.order], t[self.order], v[self.order]
        self.fresh = np.ones(len(row), bool)
        self.fresh[1:] = (self.rows[1:] != self.rows[:-1]) | (t[1:] != t[:-1]) | (self.values[1:] != self.values[:-1])
        self.seq = np.asarray(flat.field("seq"))[self.order]
        self.row, self.v = self.rows[self.fresh], self.values[self.fresh]
        self.metric = np.array(batch.column("metric_name").to_pylist(), dtype=object)
        own = flat.field("own") if "own" in {f.name for f in flat.type} else None
        self.owns = np.ones(len(row), bool) if own is None else own.to_numpy(zero_copy_only=False)[self.order]
        self.own = self.owns[self.fresh]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """What holds for distinct readings, for every delivery."""
        return x[np.cumsum(self.fresh) - 1] if len(self.rows) else x


def _flag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All stages at once for sources held whole."""
    for batch in batches:
        h = _Held(batch)
        reason = h.spread(implausible(h.row, h.v, h.metric))
        hit = reason != ""
        keys = [batch.column(c).take(pa.array(h.rows[hit])) for c in SOURCE]
        out = [*keys, pa.array(h.seq[hit], pa.int64()), pa.array(h.values[hit], pa.float64())]
        yield pa.RecordBatch.from_arrays([*out, pa.array(reason[hit].astype(str), pa.string())], names=[*SOURCE, "seq", "value", "reason"])


def _facts(batch: pa.RecordBatch, columns: dict[str, tuple[np.ndarray, pa.DataType]], at: np.ndarray) -> pa.RecordBatch:
    keys = [batch.column(c).take(pa.array(at)) for c in SOURCE]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(x, k) for x, k in columns.values())], names=[*SOURCE, *columns])


def _count_values(batch: pa.RecordBatch, h: _Held, rest: np.ndarray, opens: np.ndarray, begun: np.ndarray) -> pa.RecordBatch:
    """For each value of a piece: readings outside long runs, repeats among them, and long runs begun."""
    use = h.own & (rest | begun)
    f = pd.DataFrame({"row": h.row[use], "v": h.v[use], "n_rest": rest[use], "n_repeats": (rest & ~opens)[use], "n_begun": begun[use]})
    g = f.groupby(["row", "v"], as_index=False).sum()
    columns = {"v": (g["v"].to_numpy(float), pa.float64())}
    columns |= {c: (g[c].to_numpy(np.int64), pa.int64()) for c in ("n_rest", "n_repeats", "n_begun")}
    return _facts(batch, columns, g["row"].to_numpy(np.int64))


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = _Held(batch)
        cannot, opens, long_run = _runs(h.row, h.v, h.metric)
        yield _count_values(batch, h, ~long_run & ~cannot, opens, long_run & opens)


def _charted(batch: pa.RecordBatch, h: _Held) -> tuple[np.ndarray, ...]:
    cannot, opens, long_run = _runs(h.row, h.v, h.metric)
    seldom = batch.column("seldom").to_numpy(zero_copy_only=False).astype(bool)
    return cannot, opens, long_run, np.flatnonzero(~cannot & ~(long_run & ~opens & seldom[h.row]))


def _count_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms of the steps and values of a piece, and its least step (in ``least``)."""
    for batch in batches:
        h = _Held(batch)
        charted = _charted(batch, h)[3]
        row, v, own = h.row[charted], h.v[charted], h.own[charted]
        mine = np.flatnonzero(own[1:] & (row[1:] == row[:-1])) + 1
        step = np.abs(v[mine] - v[mine - 1])
        f = pd.DataFrame({"row": np.concatenate([row[mine], row[own]]), "step": np.repeat([True, False], [len(mine), own.sum()]), "bin": np.concatenate([_binned(step), _binned(v[own])]), "least": np.concatenate([np.where(step > 0, step, np.inf), np.full(own.sum(), np.inf)])})
        g = f.groupby(["row", "step", "bin"], as_index=False).agg(n=("least", "size"), least=("least", "min"))
        columns = {"step": (g["step"].to_numpy(bool), pa.bool_()), "bin": (g["bin"].to_numpy(np.int64), pa.int64()), "n": (g["n"].to_numpy(np.int64), pa.int64()), "least": (g["least"].to_numpy(float), pa.float64())}
        yield _facts(batch, columns, g["row"].to_numpy(np.int64))


def _scale_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scale of one source from its merged histograms, which have a bounded number of bins."""
    pdf = pdf.sort_values("bin")
    steps, values = ((pdf.loc[pdf["step"] == k, "bin"].to_numpy(), pdf.loc[pdf["step"] == k, "n"].to_numpy()) for k in (True, False))
    quantum = float(pdf["least"].min())
    scale = _scale_of(steps, values, quantum if np.isfinite(quantum) else 0.0, pdf["metric_name"].iloc[0])
    return pdf.iloc[:1][SOURCE].assign(scale=scale)


def _suspicious(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own readings of a piece that are impossible, a spike or in a long run, and counts without spikes.

    A row with a ``seq`` is a reading; one without is a value with its counts.
    """
    for batch in batches:
        h = _Held(batch)
        cannot, opens, long_run, charted = _charted(batch, h)
        scale = batch.column("scale").to_numpy(zero_copy_only=False).astype(float)
        spiked = np.zeros(len(h.v), bool)
        if len(charted):
            row, v = h.row[charted], h.v[charted]
            spiked[charted[_chart_all(row, v, batch.num_rows, scale)]] = True
        reason = np.where(cannot, "impossible", np.where(spiked, "spike", np.where(long_run, "stuck", ""))).astype(object)
        every = h.spread(reason)
        hit = (every != "") & h.owns
        at = h.rows[hit]
        none = pa.nulls(len(at), pa.int64())
        keys = [batch.column(c).take(pa.array(at)) for c in SOURCE]
        flags = [*keys, pa.array(h.seq[hit], pa.int64()), pa.array(h.values[hit], pa.float64()), pa.array(every[hit].astype(str), pa.string()), none, none]
        names = [*SOURCE, "seq", "value", "reason", "n_rest", "n_repeats"]
        yield pa.RecordBatch.from_arrays(flags, names=names)
        counts = _count_values(batch, h, ~long_run & ~spiked & ~cannot, opens, np.zeros(len(h.v), bool))
        n = counts.num_rows
        cells = [*(counts.column(c) for c in SOURCE), pa.nulls(n, pa.int64()), counts.column("v"), pa.nulls(n, pa.string()), counts.column("n_rest"), counts.column("n_repeats")]
        yield pa.RecordBatch.from_arrays(cells, names=names)


def _repeat_facts(counts: DataFrame, constant: DataFrame | None) -> DataFrame:
    """Whether the values of each source seldom repeat, from counts for each of its values."""
    by_value = counts.groupBy(*SOURCE, "v").agg(*(F.sum(c).alias(c) for c in counts.columns if c.startswith("n_")))
    begun = [F.max(F.col("n_begun") >= 2).alias("constant")] if constant is None else []
    f = by_value.groupBy(*SOURCE).agg(F.sum("n_rest").alias("n"), F.sum("n_repeats").alias("r"), F.count_if(F.col("n_rest") > 0).alias("k"), *begun)
    if constant is not None:
        f = _join(f, constant.select(*SOURCE, "constant"))
    seldom = ~F.col("constant") & (F.col("n") >= LEAST_REST) & (F.col("r") <= REPEATS * F.col("n")) & (F.col("k") >= DISTINCT * F.col("n"))
    return f.select(*SOURCE, "constant", seldom.alias("seldom"))


def _join(left: DataFrame, right: DataFrame, how: str = "inner", keys: list[str] = SOURCE) -> DataFrame:
    """Join in which a NULL key equals NULL."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    cols = ["a.*"] if how in ("left_semi", "left_anti") else ["a.*", *(f"b.`{c}`" for c in right.columns if c not in keys)]
    return left.alias("a").join(right.alias("b"), same, how).select(*cols)


def _pieces(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Readings of long sources gathered by piece, with those charted before and after it (not ``own``).

    Pieces are runs of time cells, cut by rank: a cell belongs to the piece its first reading falls in.
    """
    cell = F.expr(f"t div {CELL_MS}").alias("cell")
    rows = _join(rows, bounded_broadcast(long), "left_semi").select("*", cell)
    cells = running_totals(rows.groupBy(*SOURCE, "cell").agg(F.count_distinct("t", "v").alias("n")), SOURCE, "cell", ["n"])
    cells = cells.withColumn("begin", F.col("n_before")).withColumn("end", F.col("begin") + F.col("n")).withColumn("piece", F.expr(f"begin div {CHUNK}"))
    whole = Window.partitionBy(*SOURCE, "piece")
    cells = cells.withColumn("first", F.min("begin").over(whole)).withColumn("last", F.max("end").over(whole))
    # A cell is also charted for the pieces whose first reading is within BEFORE, or last within AFTER, of it.
    ends = cells.select(*SOURCE, "piece", "first", "last").distinct()
    near = F.expr(f"explode(sequence(greatest(0L, (begin - {AFTER}) div {CHUNK} - 1), (end + {BEFORE}) div {CHUNK} + 1))")
    to = cells.select(*SOURCE, "cell", "begin", "end", F.col("piece").alias("home"), near.alias("piece"))
    to = _join(to, ends, keys=[*SOURCE, "piece"])
    to = to.filter((F.col("end") > F.col("first") - BEFORE) & (F.col("begin") < F.col("last") + AFTER))
    to = to.select(*SOURCE, "cell", "piece", (F.col("piece") == F.col("home")).alias("own"))
    placed = _join(rows, to, keys=[*SOURCE, "cell"])
    return placed.groupBy(*SOURCE, "piece").agg(F.collect_list(F.struct("t", "v", "seq", "own")).alias("readings")).select(*SOURCE, "readings")


def _long_sources(rows: DataFrame, long: DataFrame) -> DataFrame:
    """The stages of :func:`implausible` piece by piece, with facts of whole sources between them."""
    pieces = cut_lineage(_pieces(rows, long))
    source = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in SOURCE)
    counts = pieces.mapInArrow(_count_runs, f"{source}, v double, n_rest bigint, n_repeats bigint, n_begun bigint")
    first = cut_lineage(_repeat_facts(counts, None))
    known = _join(pieces, bounded_broadcast(first.select(*SOURCE, "seldom")))
    steps = known.mapInArrow(_count_steps, f"{source}, step boolean, bin bigint, n bigint, least double")
    steps = steps.groupBy(*SOURCE, "step", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    scales = cut_lineage(steps.groupBy(*SOURCE).applyInPandas(_scale_frame, f"{source}, scale double"))
    ready = _join(known, bounded_broadcast(scales), "left").fillna(1.0, ["scale"])
    found = cut_lineage(ready.mapInArrow(_suspicious, f"{source}, seq bigint, value double, reason string, n_rest bigint, n_repeats bigint"))
    counts = found.filter("reason is null").select(*SOURCE, F.col("value").alias("v"), "n_rest", "n_repeats")
    seldom = _repeat_facts(counts, first).select(*SOURCE, "seldom")
    flags = _join(found.filter("reason is not null"), bounded_broadcast(seldom), "left")
    return flags.filter((F.col("reason") != "stuck") | F.coalesce("seldom", F.lit(False))).select(*SOURCE, "seq", "value", "reason")


def implausible_readings(raw: DataFrame) -> DataFrame:
    """The readings of ``raw_metrics`` that spike, stick or cannot be, with the reason.

    Columns: incident_id, service_id, metric_name, seq, value, reason (``impossible``, ``spike`` or
    ``stuck``, in this order of precedence). Only usable readings take part: service, finite time
    and finite number. Deliveries of one source, time and value are one reading and all are
    reported. Readings of one time are ordered by value. A spike needs a reading before it and the
    level resumed after it, so the first and last readings of a source are none. A source of under
    six readings has no spikes to speak of and no stuck runs. Sources of more than ``CHUNK`` rows
    are judged in pieces, by the facts of the whole source. Empty tables give no rows; other columns
    are ignored.
    """
    given = raw.filter("service_id is not null")
    metric = F.col("metric_name").cast("string").alias("metric_name")
    rows = given.select("incident_id", norm_name("service_id").alias("service_id"), metric, epoch_ms("ts").alias("t"), usable_number("value_str").alias("v"), F.col("seq").cast("bigint").alias("seq")).filter("t is not null and v is not null")
    # Rows are counted by name as it is spelled, which needs no parsing.
    spelled = given.groupBy("incident_id", "service_id", metric).agg(F.count(F.lit(1)).alias("_n")).withColumn("service_id", norm_name("service_id"))
    long = spelled.groupBy(*SOURCE).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > CHUNK).select(*SOURCE)
    split = not long.isEmpty()
    long = cut_lineage(long) if split else long
    whole = _join(rows, bounded_broadcast(long), "left_anti") if split else rows
    held = whole.groupBy(*SOURCE).agg(F.collect_list(F.struct("t", "v", "seq")).alias("readings")).select(*SOURCE, "readings")
    source = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema if f.name in SOURCE)
    out = held.mapInArrow(_flag_batches, f"{source}, seq bigint, value double, reason string")
    return out.unionByName(_long_sources(rows, long)) if split else out
