"""Percentiles of very large numeric columns by distributed multi-select.

Method: values are kept as sorted lists for each (day, group, chunk). In a round every list
proposes the median of what is left of its range for each sought percentile; the weighted median
of the proposals, taken up a tree, becomes the pivot, all lists count below, equal and above it, and
the ranges that are ruled out are discarded. One pass does both: while it counts around a pivot it
proposes the medians of the two ranges the pivot leaves. Lists are written again without what is
ruled out whenever that is half of them. Where at most ``GATHER`` values are left for a search they
are sorted and the rank is read off, so results are exact: the stated rank error is 0, whether lists
come from one run or from days computed apart. The searches of all groups stay in Spark; only their
number comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import finite, norm_name
from tidegauge.plans.runtime import bounded_broadcast, cut_lineage

#: Sought percentiles in thousandths.
PERMILLE = (500, 900, 950, 990, 999)
#: Values in a sorted list, values left at which a search ends by sorting them, and leaves of the tree of proposals.
LIST_ROWS, GATHER, LEAVES = 50_000, 1_000, 64
GROUP = ["method_id", "stage_name"]
_SEARCH = "struct<q:int,lo:double,hi:double,rank:bigint,left:bigint,pivot:double>"


def day_lists(stage_log: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """Sorted lists of the wall times that count, for each day and group, apart from other days.

    Each record_no counts once (of several deliveries the one with the latest ingested_at, then the
    greatest row); rows without a record_no each count. NULL, NaN, infinite and negative times do
    not. A record with no method, or one that is not in ``methods``, belongs to the whole only:
    its group is NULL. Columns: day, method_id, stage_name, chunk, values (ascending).
    """
    key = [F.to_date("recorded_at").alias("day"), F.trim("method_id").alias("method_id"), norm_name("stage_name").alias("stage_name")]
    rows = stage_log.select("record_no", "ingested_at", *key, finite("wall_time_s").alias("v"))
    cols = ["ingested_at", "day", *GROUP, "v"]
    once = rows.filter("record_no is not null").groupBy("record_no").agg(F.max(F.struct(*cols)).alias("r")).select("record_no", *(f"r.{c}" for c in cols))
    # Rows without a number are told apart by their place in the table.
    once = once.unionByName(rows.filter("record_no is null").withColumn("record_no", F.monotonically_increasing_id()))
    once = once.filter("v >= 0")
    # Deliveries of a (day, group) are at least its records: enough chunks for lists of about LIST_ROWS.
    sizes = stage_log.select(*key).groupBy("day", *GROUP).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("chunks")).filter("chunks > 1")
    once = _null_safe(once, bounded_broadcast(sizes), ["day", *GROUP])
    chunk = F.coalesce(F.pmod(F.xxhash64("record_no", "v"), F.col("chunks")), F.lit(0)).alias("chunk")
    if methods is not None:
        known = methods.select(F.trim("method_id").alias("method_id")).filter("method_id is not null").distinct().withColumn("known", F.lit(True))
        once = once.join(bounded_broadcast(known), "method_id", "left")
        grouped = F.coalesce("known", F.lit(False)) & F.col("stage_name").isNotNull()
    else:
        grouped = F.col("method_id").isNotNull() & F.col("stage_name").isNotNull()
    once = once.select("day", F.when(grouped, F.col("method_id")).alias("method_id"), F.when(grouped, F.col("stage_name")).alias("stage_name"), chunk, "v")
    return once.groupBy("day", *GROUP, "chunk").agg(F.sort_array(F.collect_list("v")).alias("values"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a NULL key equals NULL."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    return left.alias("a").join(right.alias("b"), same, "left").select("a.*", *(f"b.{c}" for c in right.columns if c not in keys))


class _Lists:
    """Sorted lists of a batch with the searches of their group (``own``) and of all values (``whole``)."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        lists = batch.column("values")
        self.flat = np.asarray(lists.flatten())
        self.at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        self.groups = list(zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True))
        self.own, self.whole = batch.column("own").to_pylist(), batch.column("whole").to_pylist()

    def searches(self) -> Iterator[tuple[int, tuple, np.ndarray, list[dict]]]:
        for i, g in enumerate(self.groups):
            values = self.flat[self.at[i] : self.at[i + 1]]
            yield i, g, values, self.own[i] or []
            yield i, ("", ""), values, self.whole[i] or []


def _range_of(values: np.ndarray, s: dict) -> tuple[int, int]:
    """First and last position of the values strictly inside the range of a search."""
    return int(np.searchsorted(values, s["lo"], "right")), int(np.searchsorted(values, s["hi"], "left"))


def _median(values: np.ndarray, a: int, b: int) -> float | None:
    return float(values[(a + b - 1) // 2]) if b > a else None


def _weighted_middle(proposals: list[tuple[float | None, int]]) -> tuple[float | None, int]:
    """Weighted median of proposals, with the weight of all."""
    given = sorted((m, w) for m, w in proposals if w)
    total = sum(w for _, w in given)
    upto = 0
    for m, w in given:
        upto += w
        if upto * 2 >= total:
            return m, total
    return None, 0


def _count_and_propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count around each pivot and propose for both sides of it; the lists of a batch propose together."""
    names = [*GROUP, "q", "less", "equal", "more", "left", "n_left", "right", "n_right"]
    whole, real = pa.int64(), pa.float64()
    kinds = [pa.string(), pa.string(), pa.int32(), whole, whole, whole, real, whole, real, whole]
    for batch in batches:
        out: dict[tuple, list] = {}
        for _, key, values, searches in _Lists(batch).searches():
            for s in searches:
                a, b = _range_of(values, s)
                if s["pivot"] is None:
                    part = (0, 0, b - a, (None, 0), (_median(values, a, b), b - a))
                else:
                    c, d = int(np.searchsorted(values, s["pivot"], "left")), int(np.searchsorted(values, s["pivot"], "right"))
                    c, d = min(max(c, a), b), min(max(d, a), b)
                    part = (c - a, d - c, b - d, (_median(values, a, c), c - a), (_median(values, d, b), b - d))
                out.setdefault((*key, s["q"]), []).append(part)
        rows = []
        for k, parts in out.items():
            less, equal, more, left, right = zip(*parts, strict=True)
            rows.append((*k, sum(less), sum(equal), sum(more), *_weighted_middle(left), *_weighted_middle(right)))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)


def _in_question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values left to each search, for searches that end by sorting them."""
    names, kinds = [*GROUP, "q", "vs"], [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64())]
    for batch in batches:
        rows = []
        for _, key, values, searches in _Lists(batch).searches():
            for s in searches:
                a, b = _range_of(values, s)
                if b > a:
                    rows.append((*key, s["q"], values[a:b].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)


def _without_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists with the values that some search has not ruled out."""
    for batch in batches:
        lists = _Lists(batch)
        keep = np.zeros(len(lists.flat), bool)
        for i, _, values, searches in lists.searches():
            for s in searches:
                a, b = _range_of(values, s)
                keep[lists.at[i] + a : lists.at[i] + b] = True
        upto = np.concatenate([[0], np.cumsum(keep)])[lists.at].astype(np.int32)
        trimmed = pa.ListArray.from_arrays(pa.array(upto), pa.array(lists.flat[keep], pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in GROUP), trimmed], names=[*GROUP, "values"])


def _weighted_median(value: str, weight: str) -> Column:
    """Weighted median of the proposals of a group of rows, of which there are few."""
    given = F.array_sort(F.collect_list(F.when(F.col(weight) > 0, F.struct(F.col(value).alias("m"), F.col(weight).alias("w")))))

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["c"] * 2 >= acc["t"], acc).otherwise(F.struct((acc["c"] + x["w"]).alias("c"), acc["t"].alias("t"), x["m"].alias("m")))

    start = F.struct(F.lit(0).cast("bigint").alias("c"), F.sum(weight).alias("t"), F.lit(None).cast("double").alias("m"))
    return F.aggregate(given, start, step, lambda acc: acc["m"])


def _totals(parts: DataFrame) -> DataFrame:
    """Counts of each search and the weighted medians of its proposals, by way of at most ``LEAVES`` leaves."""
    key = [*GROUP, "q"]
    sums = [F.sum(c).alias(c) for c in ("less", "equal", "more", "n_left", "n_right")]
    medians = [_weighted_median("left", "n_left").alias("left"), _weighted_median("right", "n_right").alias("right")]
    leaves = parts.withColumn("leaf", F.pmod(F.spark_partition_id(), F.lit(LEAVES))).groupBy(*key, "leaf").agg(*sums, *medians)
    return leaves.groupBy(*key).agg(*sums, *medians).select(*key, "less", "equal", "more", F.col("left").alias("below"), F.col("right").alias("above"))


def _with_searches(lists: DataFrame, searches: DataFrame, few: bool) -> DataFrame:
    """Lists with the searches of their group and those over all; lists of no search are left out."""
    s = F.collect_list(F.struct("q", "lo", "hi", "rank", "left", "pivot").cast(_SEARCH))
    grouped = searches.groupBy(*GROUP).agg(s.alias("own"))
    whole = searches.filter("method_id = ''").agg(s.alias("whole"))  # one row
    own = grouped.filter("method_id <> ''")
    joined = lists.select(*GROUP, "values").join(F.broadcast(own) if few else own, GROUP, "left").crossJoin(F.broadcast(whole))
    return joined.filter("size(values) > 0 and (own is not null or size(whole) > 0)")


def _next(searches: DataFrame, totals: DataFrame) -> DataFrame:
    """Each search narrowed by the counts around its pivot, with the next pivot or its value."""
    s = searches.join(totals, [*GROUP, "q"])
    first = F.col("pivot").isNull()
    low = ~first & (F.col("rank") <= F.col("less"))
    hit = ~first & ~low & (F.col("rank") <= F.col("less") + F.col("equal"))
    high = ~first & ~low & ~hit
    return s.select(
        *GROUP, "q",
        F.when(high, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
        F.when(low, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
        F.when(high, F.col("rank") - F.col("less") - F.col("equal")).otherwise(F.col("rank")).alias("rank"),
        F.when(low, F.col("less")).when(high, F.col("more")).otherwise(F.col("left")).alias("left"),
        F.when(low, F.col("below")).otherwise(F.col("above")).alias("pivot"),
        F.when(hit, F.col("pivot")).alias("value"),
    )


def select_ranks(lists: DataFrame, counts: DataFrame, permille: tuple[int, ...] = PERMILLE) -> DataFrame:
    """The value of rank ceil(n * p / 1000) of each group and permille, by multi-select.

    ``lists``: method_id, stage_name, values; ``counts``: method_id, stage_name, n, with ("", "")
    for all values. Returns method_id, stage_name, q, value.
    """
    inf = F.lit(float("inf"))
    q = F.explode(F.array(*(F.lit(p) for p in permille))).alias("q")
    searches = counts.filter("n > 0").select(*GROUP, "n", q).select(*GROUP, "q", (-inf).alias("lo"), inf.alias("hi"), F.expr("(q * n + 999) div 1000").alias("rank"), F.col("n").alias("left"), F.lit(None).cast("double").alias("pivot"), F.lit(None).cast("double").alias("value"))
    searches = cut_lineage(searches)
    few = bounded_broadcast(counts) is not counts
    kinds = "method_id string, stage_name string, q int, less bigint, equal bigint, more bigint, left double, n_left bigint, right double, n_right bigint"
    open_, short = F.col("value").isNull() & (F.col("left") > GATHER), F.col("value").isNull() & (F.col("left") <= GATHER)
    found, waiting = searches.filter("value is not null").select(*GROUP, "q", "value"), searches.filter(short)
    active = searches.filter(open_)
    left = active.agg(F.count(F.lit(1)), F.coalesce(F.sum("left"), F.lit(0))).first()
    held = None
    while left[0]:
        parts = _with_searches(lists, active, few).mapInArrow(_count_and_propose, kinds)
        step = cut_lineage(_next(active, _totals(parts)))
        found = found.unionByName(step.filter("value is not null").select(*GROUP, "q", "value"))
        waiting = waiting.unionByName(step.filter(short))
        active = step.filter(open_)
        left = active.agg(F.count(F.lit(1)), F.coalesce(F.sum("left"), F.lit(0))).first()
        if held is None:
            held = lists.agg(F.coalesce(F.sum(F.size("values")), F.lit(0))).first()[0]
        if left[0] and left[1] * 2 <= held:
            rest = _with_searches(lists, active.unionByName(waiting), few)
            lists = cut_lineage(rest.mapInArrow(_without_ruled_out, "method_id string, stage_name string, values array<double>"))
            held = left[1]
    # At most GATHER values of each search.
    rest = _with_searches(lists, waiting, few).mapInArrow(_in_question, "method_id string, stage_name string, q int, vs array<double>")
    rest = rest.groupBy(*GROUP, "q").agg(F.sort_array(F.flatten(F.collect_list("vs"))).alias("vs"))
    rest = rest.join(waiting.select(*GROUP, "q", "rank"), [*GROUP, "q"]).select(*GROUP, "q", F.element_at("vs", F.col("rank").cast("int")).alias("value"))
    return found.unionByName(rest)


def percentiles(lists: DataFrame, permille: tuple[int, ...] = PERMILLE) -> DataFrame:
    """Percentiles of each group and over all from sorted lists, of one run or joined from days.

    Columns: scope (``group`` or ``all``), method_id, stage_name (NULL over all), n, a column for
    each permille (p50, p90, p95, p99, p999) and rank_error, the bound on the distance in ranks
    between a result and the true percentile, which is 0. The percentile is the value of rank
    ceil(n * p). No values give one row over all with n = 0 and NULL percentiles.
    """
    lists = cut_lineage(lists.select(*GROUP, "values"))
    each = lists.groupBy(*GROUP).agg(F.sum(F.size("values")).alias("n"))
    total = each.agg(F.lit("").alias("method_id"), F.lit("").alias("stage_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    counts = cut_lineage(each.filter("method_id is not null").unionByName(total))
    values = select_ranks(lists, counts, permille)
    names = {p: "p" + f"{p / 10:g}".replace(".", "") for p in permille}
    wide = values.groupBy(*GROUP).agg(*(F.max(F.when(F.col("q") == p, F.col("value"))).alias(c) for p, c in names.items()))
    out = counts.join(wide, GROUP, "left")
    whole = F.col("method_id") == ""
    return out.select(F.when(whole, "all").otherwise("group").alias("scope"), *(F.when(~whole, F.col(c)).alias(c) for c in GROUP), "n", *names.values(), F.lit(0).cast("bigint").alias("rank_error"))
