"""Pair records of one entity with the record of another table that is nearest in time.

Method: an x-fast trie for each entity. Times are cut to fixed-width bit strings and one hash
table for each prefix length holds the prefixes that occur, with the least and greatest leaf
below. A binary search over prefix lengths finds the longest known prefix of a query; from there
the predecessor and successor follow, and the nearer one within the tolerance is taken. A trie
covers one time block of one entity with the tolerance on either side and holds each time once, so
it is bounded by the width of a block and a hot entity is spread over its blocks. The tries of all
blocks of a batch share their tables: the block is the head of every prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import epoch_ms, norm_label, norm_name, norm_token

#: Bits of a block: a trie covers 2**17 ms, about two minutes, plus the tolerance on either side.
BLOCK_BITS = 17


class XFastTrie:
    """Prefix tables over distinct non-negative integers below ``2**bits``, of many groups at once.

    ``keys`` are ``group << bits | integer``. A table is made when a search first asks for it.
    """

    def __init__(self, keys: np.ndarray, bits: int) -> None:
        self.keys, self.bits = np.unique(keys), bits
        self._tables: dict[int, tuple[pd.Index, np.ndarray, np.ndarray]] = {}

    def table(self, length: int) -> tuple[pd.Index, np.ndarray, np.ndarray]:
        """Known prefixes of a length (and group), with the first and last leaf below each."""
        if length not in self._tables:
            prefix = self.keys >> (self.bits - length)
            first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)])
            last = np.append(first[1:], len(prefix))[: len(first)] - 1
            self._tables[length] = (pd.Index(prefix[first]), first, last)
        return self._tables[length]

    def neighbours(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` of the greatest key <= q and the least key >= q of its group; -1 where none."""
        before, after = np.full(len(q), -1), np.full(len(q), -1)
        at = np.flatnonzero(self.table(0)[0].get_indexer(q >> self.bits) >= 0) if len(self.keys) else np.array([], int)
        if not len(at):
            return before, after
        q = q[at]
        lo, hi = np.zeros(len(q), int), np.full(len(q), self.bits)
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            for length in np.unique(mid[open_]):
                some = np.flatnonzero(open_ & (mid == length))
                known = self.table(length)[0].get_indexer(q[some] >> (self.bits - length)) >= 0
                lo[some[known]] = length
                hi[some[~known]] = length - 1
        down, up = np.full(len(q), -1), np.full(len(q), -1)
        for length in np.unique(lo):
            some = np.flatnonzero(lo == length)
            table, first, last = self.table(length)
            node = table.get_indexer(q[some] >> (self.bits - length))
            if length == self.bits:
                down[some] = up[some] = first[node]
                continue
            # The branch of q is empty, so all leaves below the node lie on one side of it.
            right = (q[some] >> (self.bits - length - 1)) & 1 == 1
            down[some] = np.where(right, last[node], first[node] - 1)
            up[some] = np.where(right, last[node] + 1, first[node])
        up[up >= len(self.keys)] = -1
        for side, out in ((down, before), (up, after)):
            own = (side >= 0) & (self.keys[side] >> self.bits == q >> self.bits)
            out[at[own]] = side[own]
        return before, after


def _nearest_batches(tolerance_ms: int):
    bits = (2**BLOCK_BITS + 2 * tolerance_ms).bit_length()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights = batch.column("lefts"), batch.column("rights")
            base = (np.asarray(batch.column("block")) << BLOCK_BITS) - tolerance_ms
            group = np.arange(batch.num_rows)
            row = np.repeat(group, np.asarray(lefts.value_lengths()))
            t = np.asarray(lefts.flatten())
            right_row = np.repeat(group, np.asarray(rights.value_lengths()))
            flat = rights.flatten()
            u = np.asarray(flat.field("t"))
            keys = right_row << bits | (u - base[right_row])
            order = np.argsort(keys)
            trie = XFastTrie(keys, bits)
            q = row << bits | (t - base[row])
            before, after = trie.neighbours(q)
            far = np.iinfo(np.int64).max
            down = np.where(before >= 0, q - trie.keys[before], far)
            up = np.where(after >= 0, trie.keys[after] - q, far)
            gap = np.minimum(down, up)
            near = np.flatnonzero(gap <= tolerance_ms)
            take = pa.array(order[np.where(down <= up, before, after)[near]])
            out = [batch.column("entity").take(pa.array(row[near])), pa.array(t[near]), flat.field("ids").take(take), pa.array(gap[near])]
            yield pa.RecordBatch.from_arrays(out, names=["entity", "t", "right", "distance_ms"])

    return pair


def nearest_in_time(left: DataFrame, right: DataFrame, *, entity: str, left_time: str, right_time: str, left_id: list[str], right_id: list[str], tolerance_ms: int) -> DataFrame:
    """Pair each left row with the right row of its entity that is nearest in time.

    Times are BIGINT columns in ms. Returns the id columns of both sides and ``distance_ms``.
    A left row without a right row of its entity within ``tolerance_ms`` is left out; at equal
    distance the earlier wins, at equal time the least id (NULL first). NULL entities and NULL times
    match nothing. Several left rows may share a right row; repeated rows give repeated pairs. Empty
    tables give no rows; other columns are ignored, also where both sides name them alike.
    """

    def side(df: DataFrame, time: str, ids: list[str], name: str) -> DataFrame:
        row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(ids))).alias(name)
        rows = df.select(F.col(f"`{entity}`").cast("string").alias("entity"), F.col(f"`{time}`").alias("t"), row)
        return rows.filter("entity is not null and t is not null")

    a, b = side(left, left_time, left_id, "left"), side(right, right_time, right_id, "ids")
    block = ["entity", "block"]
    lefts = a.select("entity", "t", F.expr(f"shiftright(t, {BLOCK_BITS})").alias("block")).distinct()
    lefts = lefts.groupBy(*block).agg(F.collect_list("t").alias("lefts"))
    # Of rows of one time the least id counts. A time also belongs to a neighbouring block within the tolerance.
    times = b.groupBy("entity", "t").agg(F.min("ids").alias("ids"))
    blocks = F.expr(f"sequence(shiftright(t - {tolerance_ms}, {BLOCK_BITS}), shiftright(t + {tolerance_ms}, {BLOCK_BITS}))")
    rights = times.select("entity", F.explode(blocks).alias("block"), F.struct("t", "ids").alias("r"))
    rights = rights.groupBy(*block).agg(F.collect_list("r").alias("rights"))
    schema = f"entity string, t bigint, right {b.schema['ids'].dataType.simpleString()}, distance_ms bigint"
    found = lefts.join(rights, block).mapInArrow(_nearest_batches(tolerance_ms), schema)
    pairs = a.join(found, ["entity", "t"])
    ids = [F.col(f"left.c{i}").alias(c) for i, c in enumerate(left_id)] + [F.col(f"right.c{i}").alias(c) for i, c in enumerate(right_id)]
    return pairs.select(*ids, "distance_ms")


def valid_records(interventions: DataFrame) -> DataFrame:
    """record_id, destination_service and t_applied in ms of the valid record of each id."""
    rows = interventions.select("record_id", "ingested_at", epoch_ms("t_applied").alias("applied_ms"), norm_name("destination_service").alias("destination_service"), norm_token("interface").alias("interface"), norm_label("status").alias("status")).filter("record_id is not null")
    best = rows.groupBy("record_id").agg(F.max(F.struct("ingested_at", "applied_ms", "destination_service", "interface", "status")).alias("r"))
    return best.select("record_id", "r.destination_service", "r.applied_ms")


def stream_windows(aligned: DataFrame, metric: str = "lat_p99") -> DataFrame:
    """Windows of the streams of a metric whose value is neither NULL nor NaN, one row each."""
    rows = aligned.filter(F.lower(F.trim("metric_name")) == metric).select(norm_name("service_id").alias("destination_service"), "incident_id", F.explode(F.arrays_zip("window_ids", "t_starts", "values")).alias("w"))
    rows = rows.filter(F.col("w.values").isNotNull() & ~F.isnan("w.values"))
    return rows.select("destination_service", "incident_id", F.col("w.window_ids").alias("window_id"), epoch_ms(F.col("w.t_starts")).alias("start_ms")).distinct()


def nearest_windows(interventions: DataFrame, aligned: DataFrame, *, tolerance_s: float = 15.0) -> DataFrame:
    """Each valid intervention with the nearest window of its service, within the tolerance.

    Records without an id, service or time, and windows without a value, take part in no pair.
    """
    return nearest_in_time(valid_records(interventions), stream_windows(aligned), entity="destination_service", left_time="applied_ms", right_time="start_ms", left_id=["record_id"], right_id=["incident_id", "window_id"], tolerance_ms=round(tolerance_s * 1000))
