"""Overlapping and gapped intervals merged into continuous periods and the gaps between them.

Method: a mergeable aggregate that holds sorted disjoint intervals. Every task folds its rows into one
list for each (key, time block) before anything is shuffled; partial lists are merged two by two, each
by one linear pass over both, up a reduction tree with as many levels as their number asks for, to one
list for each (key, time block); lists are joined across blocks through one summary row for each block,
so no task ever holds a whole key. Periods are read off the lists and gaps off their complements.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import epoch_ms, norm_label, norm_name, norm_token
from tidegauge.plans.runtime import cut_lineage

#: Width of a time block in ms; a list of one block holds at most that many disjoint intervals.
BLOCK_MS = 6 * 3600 * 1000
#: Rows that a task folds at a time, and partial lists that meet in one group of a level of the tree.
FOLD_ROWS, FAN = 200_000, 16
_SPANS = "spans array<struct<s:bigint,e:bigint>>"


def _coalesce(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of intervals in order of row and start: which begin a disjoint interval, and the ends of these."""
    if not len(row):
        return np.zeros(0, bool), end
    reach = pd.Series(end).groupby(row, sort=False).cummax().to_numpy()
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    return opens, reach[np.append(np.flatnonzero(opens)[1:], len(row)) - 1]


def merge_lists(row: np.ndarray, part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the lists of each row into one: row, start and end of its disjoint intervals in order.

    The input is a concatenation of sorted lists of disjoint intervals by row and part (0, 1, ..).
    Lists are merged two by two; the place of an interval is its own in its list plus that of its
    start in the other, so no list is sorted again. Intervals that overlap or touch become one.
    """
    low = int(start.min()) if len(start) else 0
    width = (int(start.max()) - low + 1) if len(start) else 1
    while len(part) and part.max() > 0:
        pair = part // 2
        group = row * (int(pair.max()) + 1) + pair
        key = group * width + (start - low)
        a, b = np.flatnonzero(part % 2 == 0), np.flatnonzero(part % 2 == 1)
        order = np.empty(len(row), np.int64)
        order[np.arange(len(a)) + np.searchsorted(key[b], key[a], "left")] = a
        order[np.arange(len(b)) + np.searchsorted(key[a], key[b], "right")] = b
        row, part, start, end, group = row[order], pair[order], start[order], end[order], group[order]
        opens, end = _coalesce(group, start, end)
        row, part, start = row[opens], part[opens], start[opens]
    return row, start, end


def _lists(rows: int, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.ListArray:
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["s", "e"]))


def _fold_rows(keys: Sequence[str]):
    """One sorted disjoint list for each (key, block) of up to ``FOLD_ROWS`` rows of a task, numbered by ``_leaf``."""

    def fold(batches: list[pa.RecordBatch], leaf: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        code = np.zeros(table.num_rows, np.int64)
        for k in (*keys, "_block"):
            column = table.column(k).combine_chunks()
            each = column if isinstance(column, pa.Array) else column.chunk(0)
            index = np.asarray(pc.dictionary_encode(each, null_encoding="encode").indices).astype(np.int64)
            code = np.unique(code * (int(index.max()) + 1) + index, return_inverse=True)[1]
        start, end = np.asarray(table.column("_s")), np.asarray(table.column("_e"))
        order = np.lexsort((start, code))
        code, start = code[order], start[order]
        opens, end = _coalesce(code, start, end[order])
        code, start, at = code[opens], start[opens], order[opens]
        rows = int(code[-1]) + 1
        first = table.take(pa.array(at[np.searchsorted(code, np.arange(rows))])).combine_chunks()
        columns = [first.column(k).chunk(0) for k in (*keys, "_block")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(rows, leaf)), _lists(rows, code, start, end)], names=[*keys, "_block", "_leaf", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, flushed = [], 0, 0
        task = TaskContext.get()
        for batch in batches:
            held += [batch] if batch.num_rows else []
            n += batch.num_rows
            if n >= FOLD_ROWS:
                yield fold(held, task.partitionId() + (flushed << 32))
                held, n, flushed = [], 0, flushed + 1
        if n:
            yield fold(held, task.partitionId() + (flushed << 32))

    return run


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = batch.column("lists")
        spans = parts.flatten()
        row_of = np.repeat(np.arange(batch.num_rows), np.asarray(parts.value_lengths()))
        ordinal = np.arange(len(row_of)) - np.searchsorted(row_of, row_of)
        size = np.asarray(spans.value_lengths())
        flat = spans.flatten()
        row, start, end = merge_lists(np.repeat(row_of, size), np.repeat(ordinal, size), np.asarray(flat.field("s")), np.asarray(flat.field("e")))
        names = [n for n in batch.schema.names if n != "lists"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _lists(batch.num_rows, row, start, end)], names=[*names, "spans"])


def _interval_lists(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each (key, block) with its disjoint intervals, by way of partial lists of each task."""
    src = df.select(*keys, F.floor(F.col("_s") / BLOCK_MS).alias("_block"), "_s", "_e")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name not in ("_s", "_e"))
    lists = cut_lineage(src.mapInArrow(_fold_rows(list(keys)), f"{kinds}, _leaf bigint, {_SPANS}"))
    most = lists.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    level = max(1, math.ceil(math.log(most, FAN)))
    leaf = F.pmod(F.xxhash64("_leaf"), F.lit(FAN ** (level - 1)))
    while level:
        level -= 1
        group = [*keys, "_block", leaf.alias("_leaf")]
        lists = lists.groupBy(*group).agg(F.collect_list("spans").alias("lists")).mapInArrow(_merge_batches, f"{kinds}, _leaf bigint, {_SPANS}")
        leaf = F.pmod("_leaf", F.lit(FAN ** max(0, level - 1)))
    return lists.drop("_leaf")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, *, max_gap_ms: int | None = None) -> DataFrame:
    """Continuous periods and gaps of the intervals of each key.

    ``start`` and ``end`` are BIGINT columns in ms, end exclusive; intervals that touch belong
    together. Returns the key columns, ``kind`` (``period`` or ``gap``), ``start_ms``, ``end_ms``.
    A gap longer than ``max_gap_ms`` is left out. Rows with a NULL bound or an end that is not
    after the start hold no interval and are dropped; NULL is a key like any other; repeated rows
    change nothing; an empty table gives no rows; other columns are ignored.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    src = df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)), F.col(f"`{start}`").alias("_s"), F.col(f"`{end}`").alias("_e")).filter("_e > _s")
    lists = _interval_lists(src, names)

    def same(a: str, b: str) -> object:
        cond = F.col(f"{a}._block") == F.col(f"{b}._block")
        for n in names:
            cond &= F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
        return cond

    before = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    reach = lists.select(*names, "_block", F.element_at("spans", -1)["e"].alias("_reach")).withColumn("_carry", F.max("_reach").over(before)).withColumn("_total", F.max("_reach").over(Window.partitionBy(*names)))
    carried = lists.alias("a").join(reach.alias("b"), same("a", "b")).select(*(f"a.{n}" for n in names), "a._block", "spans", "_carry", "_total")
    # A list is disjoint and sorted, so what an earlier block reaches into is a run at its head.
    head = F.when(F.col("_carry").isNull(), F.lit(0)).otherwise(F.size(F.filter("spans", lambda x: x["s"] <= F.col("_carry"))))
    carried = carried.withColumn("_head", head).withColumn("_own", F.expr("slice(spans, _head + 1, greatest(size(spans) - _head, 0))")).withColumn("_absorbed", F.expr("if(_head > 0, spans[_head - 1].e, null)"))
    after = Window.partitionBy(*names).orderBy("_block")
    bounds = carried.filter("size(_own) > 0").select(
        *names, "_block", "_total", F.col("_own")[0]["s"].alias("_first"), F.greatest("_carry", "_absorbed").alias("_closed")
    ).select(*names, "_block", F.lead("_first").over(after).alias("_next"), F.coalesce(F.lead("_closed").over(after), F.col("_total")).alias("_last_end"))
    periods = carried.filter("size(_own) > 0").alias("a").join(bounds.alias("b"), same("a", "b")).select(
        *(F.col(f"a.{n}").alias(n) for n in names),
        F.posexplode(F.expr("transform(_own, (x, i) -> struct(x.s as s, if(i = size(_own) - 1, _last_end, x.e) as e, if(i = size(_own) - 1, _next, _own[i + 1].s) as n))")).alias("_i", "x"),
    )
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("x.e").alias("start_ms"), F.col("x.n").alias("end_ms")),
    )
    out = periods.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), F.explode(both).alias("_p")).select(*(F.col(f"`{k}`") for k in keys), "_p.kind", "_p.start_ms", "_p.end_ms").filter("end_ms is not null")
    return out if max_gap_ms is None else out.filter((F.col("kind") == "period") | (F.col("end_ms") - F.col("start_ms") <= max_gap_ms))


def valid_interventions(df: DataFrame) -> DataFrame:
    """The valid record of each ``record_id``: the one with the latest ``ingested_at``.

    Records without an id cannot replace one another and all stay. Of equal ``ingested_at`` the
    greatest row counts, so the result is the same however rows arrive. Returns record_id,
    destination_service and interface as they compare, status, applied_ms, ended_ms.
    """

    rows = df.select(
        "record_id", "ingested_at", norm_name("destination_service").alias("destination_service"), norm_token("interface").alias("interface"), norm_label("status").alias("status"),
        epoch_ms("t_applied").alias("applied_ms"), F.coalesce(epoch_ms("t_rolled_back"), epoch_ms(F.col("t_applied") + F.col("lease_s"))).alias("ended_ms"),
    )
    cols = ["ingested_at", "applied_ms", "ended_ms", "destination_service", "interface", "status"]
    named = rows.filter("record_id is not null").groupBy("record_id").agg(F.max(F.struct(*cols)).alias("r")).select("record_id", *(f"r.{c}" for c in cols))
    return named.unionByName(rows.filter("record_id is null")).select("record_id", "destination_service", "interface", "status", "applied_ms", "ended_ms")


def intervention_periods(df: DataFrame, max_gap_ms: int | None = None) -> DataFrame:
    """Periods and gaps of the counting interventions of each destination service and interface."""
    counting = valid_interventions(df).filter(~F.coalesce("status", F.lit("")).isin("PENDING", "FAILED") & F.col("interface").isNotNull() & F.col("destination_service").isNotNull())
    return merge_intervals(counting, ["destination_service", "interface"], "applied_ms", "ended_ms", max_gap_ms=max_gap_ms)
