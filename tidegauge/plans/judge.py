"""Every comparison method on one scenario after the other, many scenarios in a batch of arrays.

The same series, deviations, ranking, costs and choices as ``simulate.oracle_series``, ``detect``,
``select`` and ``methods`` make by joins; ``Trials.joined`` and a test hold both together.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import norm_name
from tidegauge.operators.detect import THETA
from tidegauge.operators.held import HeldGraph
from tidegauge.operators.methods import TOP
from tidegauge.operators.select import DEFAULT_IMPACT, DEFAULT_ROLLBACK, PROBE_SECONDS, WEIGHT

#: Steps of the oracle metrics, of these before the injection, and their width.
STEPS, BEFORE, STEP_MS = 18, 6, 10_000
#: Scenarios judged at once, and services whose noise is drawn at once.
SCENARIOS, DRAWN = 20_000, 4096
_NAMES = [f"{k}/{side}".encode() for k in range(STEPS) for side in "ab"]
RESULT = "method string, fault_id string, truth string, confounded boolean, not_identifiable boolean, top_candidates array<struct<service:string,score:double>>, abstained boolean, latency_s double, total_ed_s double"


def per_scenario(scenarios: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each scenario with what judging it needs; names are normalized.

    fault_id, seed, root and services of its series, called (where each edge of its path leads), src and
    dst (its own graph, over all deliveries of the row), truth, confounded.
    """
    spark = scenarios.sparkSession
    rows = scenarios.filter("fault_id is not null").select("fault_id", "injected_at_t", norm_name("root_cause_service").alias("root"), "seed", "affected_services", "causal_path", F.coalesce("confounded", F.lit(False)).alias("confounded"))
    rows = rows.withColumn("services", F.transform("affected_services", norm_name)).drop("affected_services")
    # Small in bytes and large in work: a fixed number of partitions, which is never coalesced.
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, -(-scenarios.count() // SCENARIOS)))
    once = F.max(F.when(F.col("injected_at_t").isNotNull(), F.struct(F.col("injected_at_t").alias("t"), "root", F.col("seed").alias("s"), "services", "causal_path")))
    held = rows.repartition(tasks, "fault_id").groupBy("fault_id").agg(once.alias("r"), F.max(F.struct("root", "confounded")).alias("f"), F.flatten(F.collect_list("causal_path")).alias("_all"))
    held = held.filter("r is not null and r.services is not null")
    services = F.array_distinct(F.filter(F.array_append("r.services", F.col("r.root")), lambda x: x.isNotNull()))
    return held.select("fault_id", (F.lit(seed) + F.coalesce("r.s", F.lit(0))).cast("string").alias("seed"), F.col("r.root").alias("root"), services.alias("services"), F.transform("r.causal_path", lambda e: norm_name(e[1])).alias("called"), F.transform("_all", lambda e: norm_name(e[0])).alias("src"), F.transform("_all", lambda e: norm_name(e[1])).alias("dst"), F.col("f.root").alias("truth"), F.col("f.confounded").alias("confounded"))


def judged(scenarios: DataFrame, graph: HeldGraph, reached: np.ndarray) -> DataFrame:
    """A row for each method and scenario, see ``Trials.results``. ``reached``: nodes that each node of the call graph reaches."""
    shared = scenarios.sparkSession.sparkContext.broadcast((graph, np.minimum(1.0, reached / max(1, len(graph)))))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= SCENARIOS:
                yield from _judge(pa.Table.from_batches(held), *shared.value)
                held, n = [], 0
        if n:
            yield from _judge(pa.Table.from_batches(held), *shared.value)

    return per_scenario(scenarios).mapInArrow(fold, RESULT)


def noise_of(names: list[bytes]) -> np.ndarray:
    """Standard normal numbers of each name and step: ``normal_draw`` of the name followed by the step."""
    out = np.empty((len(names), STEPS))
    for lo in range(0, len(names), DRAWN):
        raw = b"".join([md5(name + step).digest() for name in names[lo : lo + DRAWN] for step in _NAMES])
        whole = np.zeros((len(raw) // 16, 8), np.uint8)
        whole[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 16)[:, :6]
        u = ((whole.view(">u8").astype(float) + 0.5) / 16.0**12).reshape(-1, STEPS, 2)
        out[lo : lo + DRAWN] = np.sqrt(-2.0 * np.log(u[:, :, 0])) * np.cos(2.0 * np.pi * u[:, :, 1])
    return out


def chosen(p: np.ndarray, gain: np.ndarray, seconds: np.ndarray, denied: np.ndarray, theta: float = 0.5, budget: float = 600.0) -> tuple[np.ndarray, np.ndarray]:
    """How many candidates ``select._choose`` takes of each row, and their seconds together; rows are filled up with denied ones."""

    def entropy(q: np.ndarray) -> np.ndarray:
        some = q > 1e-12
        return -np.where(some, q * np.log(np.where(some, q, 1.0)), 0.0).sum(axis=1)

    def shares(q: np.ndarray) -> np.ndarray:
        total = q.sum(axis=1, keepdims=True)
        return np.divide(q, total, out=q.copy(), where=total > 0)

    p = shares(p)
    left, n, h = np.full(len(p), budget), np.zeros(len(p), np.int64), entropy(p)
    for i in range(p.shape[1]):
        take = np.flatnonzero(~denied[:, i] & (seconds[:, i] <= left) & (h >= theta))
        if not len(take):
            continue
        sharpening, own = np.minimum(0.4, gain[take, i]), p[take, i]
        new = p[take] * np.maximum(0.0, 1 - sharpening * own)[:, None]
        new[:, i] = np.minimum(1.0, own + sharpening * (1 - own))
        p[take] = shares(new)
        h[take] = entropy(p[take])
        left[take] -= seconds[take, i]
        n[take] += 1
    return n, budget - left


def _candidates(src: list, dst: list, found: list[tuple]) -> tuple[list[int], bool]:
    """Rows of the diverging services that R2 and R3 hold for in the scenario's own graph. ``found``: (step, service, row)."""
    out: dict[str, set] = {}
    for a, b in zip(src, dst, strict=True):
        if a is not None and b is not None and a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
    at = {name: t for t, name, _ in found}
    down, earlier_reached, up = set(), dict.fromkeys(at, 0), set()
    for name, t in at.items():
        if not out.get(name):
            continue
        seen, todo = {name}, [name]
        while todo:
            for x in out[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        for x in seen & at.keys():
            if x != name:
                down.add(name)
                earlier_reached[name] += at[x] < t
                if t >= at[x]:
                    up.add(x)
    first, known = min(at.values()), [t for name, t in at.items() if name in out]
    kept = []
    for t, name, row in found:
        r2 = t == first or earlier_reached[name] >= sum(x < t for x in known)
        if r2 and (name in down or (name in up and not out[name])):
            kept.append(row)
    return kept


def _judge(table: pa.Table, graph: HeldGraph, blast_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    column = {c: table[c].combine_chunks() for c in table.column_names}
    n_scenarios = table.num_rows
    lengths = pc.list_value_length(column["services"]).to_numpy(zero_copy_only=False).astype(np.int64)
    scen, flat = np.repeat(np.arange(n_scenarios), lengths), pc.list_flatten(column["services"])
    if not len(flat):
        return
    names = pc.unique(flat)
    names = names.take(pc.sort_indices(names))

    def ids(values: pa.Array, of: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(values, of), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    service = ids(flat, names)
    node = ids(names, graph.names)[service]
    n_rows, n_names = len(service), len(names)

    # Series: what oracle_series gives, a row for each service and a column for each step.
    faults, flat_names = column["fault_id"].to_pylist(), flat.to_pylist()
    heads = [f"{s}:{f}:" for s, f in zip(column["seed"].to_pylist(), faults, strict=True)]
    noise = noise_of([f"{heads[c]}{name}:".encode() for c, name in zip(scen.tolist(), flat_names, strict=True)])
    called = column["called"]
    per = pc.fill_null(pc.list_value_length(called), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    to, where = ids(pc.list_flatten(called), names), np.repeat(np.arange(n_scenarios), per)
    place = np.arange(len(to)) - np.repeat(np.cumsum(per) - per, per)
    keys, inverse = np.unique(where * n_names + np.where(to < 0, 0, to), return_inverse=True)
    last = np.full(len(keys) + 1, -1)
    np.maximum.at(last, inverse, np.where(to < 0, -1, place))
    own = scen * n_names + service
    at = np.searchsorted(keys, own)
    at = np.where((at < len(keys)) & (np.append(keys, -1)[at] == own), at, len(keys))
    delay = np.where(last[at] >= 0, last[at] + 1, STEPS)
    after = np.arange(STEPS) - BEFORE
    root = (after >= 0)[None, :] & (service == ids(column["root"], names)[scen])[:, None]
    hit = (after >= 0)[None, :] & (after[None, :] >= delay[:, None])
    value = np.where(root, 50.0, np.where(hit, 40.0, 0.0)) + np.where(root | hit, 5.0, 10.0) * noise

    # Deviations from the steps before the injection, and the first lasting ones.
    base = value[:, :BEFORE]
    z = np.abs(value - base.mean(axis=1, keepdims=True)) / (base.std(axis=1, ddof=1, keepdims=True) + 1e-9)
    over = z > THETA
    top_z, mean_z, hot = z.max(axis=1), z.mean(axis=1), np.flatnonzero(over.any(axis=1))
    two = over[:, :-1] & over[:, 1:]
    star, found = two.argmax(axis=1), np.flatnonzero(two.any(axis=1))

    def best(rows: np.ndarray, score: np.ndarray, most: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """The best rows of each scenario by score, then name."""
        order = np.lexsort((service[rows], -score, scen[rows]))
        rows, score = rows[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(scen[rows], scen[rows]) < most
        return rows[keep], score[keep]

    def result(method: str, rows: np.ndarray, score: np.ndarray, latency: np.ndarray | None = None, spent: np.ndarray | None = None) -> pa.RecordBatch:
        n = np.bincount(scen[rows], minlength=n_scenarios)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        parts = pa.StructArray.from_arrays([names.take(pa.array(service[rows])), pa.array(score.astype(float))], names=["service", "score"])
        none = n == 0
        latency = pa.array(np.zeros(n_scenarios) if latency is None else latency, mask=none if latency is not None else np.ones(n_scenarios, bool))
        arrays = [pa.array([method] * n_scenarios), column["fault_id"], column["truth"], column["confounded"], pa.array(np.zeros(n_scenarios, bool)), pa.ListArray.from_arrays(pa.array(offsets), parts), pa.array(none), latency, pa.array(np.zeros(n_scenarios) if spent is None else spent)]
        rows_out = pa.RecordBatch.from_arrays(arrays, names=["method", "fault_id", "truth", "confounded", "not_identifiable", "top_candidates", "abstained", "latency_s", "total_ed_s"])
        return rows_out.filter(pa.array(lengths > 0))

    # OBS: the ranking of divergences in each scenario's own graph.
    src, dst = column["src"].to_pylist(), column["dst"].to_pylist()
    sure: list[int] = []
    bounds = np.searchsorted(scen[found], np.arange(n_scenarios + 1))
    for c in np.unique(scen[found]).tolist():
        rows = found[bounds[c] : bounds[c + 1]].tolist()
        sure += _candidates(src[c], dst[c], [(int(star[r]), flat_names[r], r) for r in rows])
    certain = np.array(sure, np.int64)
    rest = found[~np.isin(scen[found], scen[certain])]
    rest, _ = best(rest, mean_z[rest], 3)
    kept = np.concatenate([certain, rest])
    earliest = np.full(n_scenarios, STEPS)
    np.minimum.at(earliest, scen[found], star[found])
    yield result("OBS", *best(kept, mean_z[kept]), earliest * STEP_MS / 1000.0)

    # SIEVE: own score plus what is reached through the call graph.
    begin = np.cumsum(lengths) - lengths
    per = lengths[scen[hot]]
    a = np.repeat(hot, per)
    b = np.arange(len(a)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(begin[scen[hot]], per)
    keep = (a != b) & (node[a] >= 0) & (node[b] >= 0)
    a, b = a[keep], b[keep]
    depth = graph.depths(node[a], node[b], 5)
    gain = np.bincount(a, np.where(depth > 0, 0.5 ** (depth * (depth + 1) / 2) * top_z[b], 0.0), n_rows)
    yield result("SIEVE", *best(hot, top_z[hot] + gain[hot]))
    yield result("THRESHOLD", *best(hot, -(over[hot].argmax(axis=1) * float(STEP_MS))))

    # RANDOM and ONE_SHOT: belief, the cost of probes, and choices in two orders.
    of = scen[hot]
    p = top_z[hot] / np.bincount(of, top_z[hot], n_scenarios)[of]
    count = np.bincount(of, minlength=n_scenarios)[of]
    uncertain = np.bincount(of, -p * np.log(p), n_scenarios)[of]
    most = np.log(np.maximum(count, 2))
    eig = np.where(count > 1, np.minimum(np.maximum(uncertain * p, 0.0), most) / most, 0.0)
    blast = np.where(node[hot] >= 0, np.append(blast_of, 0.0)[node[hot]], 0.0)
    confidence = 1.0 - 0.5 * blast - 0.5 * DEFAULT_IMPACT
    utility = eig / (1.0 + WEIGHT * (blast + DEFAULT_IMPACT + DEFAULT_ROLLBACK + (1.0 - confidence)))
    denied = (confidence < 0.3) & ~((blast < 0.1) & (DEFAULT_IMPACT < 0.01))
    digests = np.array([md5(f"42:{faults[c]}:{flat_names[r]}".encode()).hexdigest() for c, r in zip(of.tolist(), hot.tolist(), strict=True)], "S32")
    for method, order in (("RANDOM", np.lexsort((digests, of))), ("ONE_SHOT", np.lexsort((service[hot], -utility, of)))):
        scenario, spot = of[order], np.arange(len(order)) - np.searchsorted(of[order], of[order])
        shape = (n_scenarios, int(count.max()) if len(count) else 0)
        cells = [np.full(shape, fill) for fill in (0.0, 0.0, PROBE_SECONDS["LATENCY"], True)]
        for cell, values in zip(cells, (p, eig, np.full(len(p), PROBE_SECONDS["LATENCY"]), denied), strict=True):
            cell[scenario, spot] = values[order]
        n, spent = chosen(*cells)
        taken = n[of] > 0
        yield result(method, *best(hot[taken], p[taken]), None, spent)

    every = np.arange(n_rows)
    yield result("ORACLE", *best(every, (service == ids(column["truth"], names)[scen]).astype(float)))
    yield result("SAGE_CHAOS", every[:0], np.zeros(0))
