"""A graph that every worker can hold: its edges as arrays, and searches over them that write nothing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Edges up to which a graph is held by the driver and every worker: 4 bytes each, and the names.
HELD_EDGES = 2_000_000
#: Words of 64 sources that a search has for all edges at once, and reachable pairs of a task.
SEARCH_WORDS, TASK_PAIRS = 4_000_000, 2_000_000


class HeldGraph:
    """Nodes are numbered in the order of their names; the edges of a node lead to ascending numbers."""

    def __init__(self, src: pa.Array, dst: pa.Array) -> None:
        names = pc.unique(pa.chunked_array([src, dst]))
        self.names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(x, self.names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
        n = len(self.names)
        pairs = np.unique(a[a != b] * n + b[a != b])
        self.starts = np.searchsorted(pairs, np.arange(n + 1) * n)
        self.ends = (pairs % max(n, 1)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.names)

    @property
    def block(self) -> int:
        """Sources searched together."""
        return 64 * max(1, min(16, SEARCH_WORDS // max(1, len(self.ends))))

    @cached_property
    def _into(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with a way in, the sources of all edges by where they lead, and the first of each of these nodes."""
        sources = np.repeat(np.arange(len(self)), np.diff(self.starts))
        order = np.argsort(self.ends, kind="stable")
        nodes, first = np.unique(self.ends[order], return_index=True)
        return nodes, sources[order], first

    def within(self, sources: np.ndarray) -> Iterator[np.ndarray]:
        """Bits of the sources (columns) that reach each node (rows) in at most 1, 2, ... edges, until all are there.

        A source has its own bit from the start. The array is changed by the next step.
        """
        place = np.arange(len(sources))
        seen = np.zeros((len(self), -(-len(sources) // 64)), np.uint64)
        seen[sources, place // 64] = np.uint64(1) << (place % 64).astype(np.uint64)
        nodes, back, first = self._into
        while len(nodes):
            old = seen[nodes]
            new = np.bitwise_or.reduceat(seen[back], first, axis=0) | old
            if np.array_equal(new, old):
                return
            seen[nodes] = new
            yield seen

    def reach_counts(self, sources: np.ndarray) -> np.ndarray:
        """How many other nodes each source reaches."""
        last = None
        for last in self.within(sources):  # noqa: B007
            pass
        if last is None:
            return np.zeros(len(sources), np.int64)
        return np.unpackbits(last.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[: len(sources)] - 1

    def depths(self, src: np.ndarray, dst: np.ndarray, most: int) -> np.ndarray:
        """Edges of the shortest way between the nodes of each pair (which differ), 0 without one of at most ``most``."""
        out = np.zeros(len(src), np.int64)
        sources, at = np.unique(src, return_inverse=True)
        order = np.argsort(at, kind="stable")
        for lo in range(0, len(sources), self.block):
            left = order[slice(*np.searchsorted(at, [lo, lo + self.block], sorter=order))]
            for depth, seen in enumerate(self.within(sources[lo : lo + self.block]), 1):
                bit = at[left] - lo
                hit = (seen[dst[left], bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1) > 0
                out[left[hit]] = depth
                left = left[~hit]
                if depth == most or not len(left):
                    break
        return out

    def paths(self, source: int) -> pa.RecordBatch | None:
        """All nodes that are reached from ``source`` with the least shortest path: src, dst, depth, path.

        Nodes are visited in the order of their paths, so the first way that leads to a node is the least one.
        """
        new, place = np.ones(len(self), bool), np.zeros(len(self), np.int64)
        new[source] = False
        front, path = np.array([source]), self.names.take([source])
        nodes, depths, paths = [], [], []
        while True:
            n = self.starts[front + 1] - self.starts[front]
            parent = np.repeat(np.arange(len(front)), n)
            to = self.ends[np.arange(n.sum()) + np.repeat(self.starts[front] - np.cumsum(n) + n, n)]
            keep = new[to]
            to, parent = to[keep], parent[keep]
            turn = np.arange(len(to))
            place[to[::-1]] = turn[::-1]
            keep = place[to] == turn
            front, parent = to[keep], parent[keep]
            if not len(front):
                break
            new[front] = False
            path = pc.binary_join_element_wise(path.take(pa.array(parent)), self.names.take(pa.array(front)), ">")
            nodes.append(front)
            depths.append(np.full(len(front), len(nodes), np.int32))
            paths.append(path)
        if not nodes:
            return None
        to = np.concatenate(nodes)
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(np.full(len(to), source))), self.names.take(pa.array(to)), pa.array(np.concatenate(depths)), pa.concat_arrays(paths)], names=["src", "dst", "depth", "path"])


def held_graph(edges: DataFrame) -> HeldGraph | None:
    """The graph of ``edges`` (src, dst; written already, as they are read twice), or None beyond ``HELD_EDGES``."""
    if edges.limit(HELD_EDGES + 1).count() > HELD_EDGES:
        return None
    rows = edges.select("src", "dst").filter("src <> dst").toArrow()
    return HeldGraph(*(rows[c].combine_chunks().cast(pa.string()) for c in ("src", "dst")))


def _tasks(spark: SparkSession, wanted: int) -> int:
    return max(1, wanted, spark.sparkContext.defaultParallelism)


def all_paths(spark: SparkSession, graph: HeldGraph) -> DataFrame:
    """Reachable pairs with the least shortest path, nodes joined by ``>``: src, dst, depth, path.

    Each source is searched by itself and its rows leave the worker at once: nothing is shuffled or kept.
    """
    shared = spark.sparkContext.broadcast(graph)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column(0).to_pylist():
                if (rows := shared.value.paths(source)) is not None:
                    yield rows

    tasks = _tasks(spark, min(max(1, len(graph)), len(graph) ** 2 // TASK_PAIRS))
    return spark.range(0, len(graph), 1, tasks).mapInArrow(search, "src string, dst string, depth int, path string")


def all_reach_counts(spark: SparkSession, graph: HeldGraph) -> np.ndarray:
    """How many other nodes each node reaches."""
    shared, n, block = spark.sparkContext.broadcast(graph), len(graph), graph.block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                sources = np.arange(i * block, min(n, (i + 1) * block))
                yield pa.RecordBatch.from_arrays([pa.array(sources), pa.array(shared.value.reach_counts(sources))], names=["node", "n"])

    blocks = -(-n // block)
    rows = spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(count, "node bigint, n bigint").toArrow()
    out = np.zeros(n, np.int64)
    out[rows["node"].to_numpy()] = rows["n"].to_numpy()
    return out
