"""Constraint-based causal discovery and identifiability of effects.

The cluster computes sufficient statistics; the search itself works on a matrix of at most
``MAX_VARIABLES`` square, for one incident at a time in a Python worker.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, MAX_VARIABLES = 0.05, 15
#: Marks at the ends of an edge.
TAIL, ARROW, CIRCLE = -1, 1, 2


class TooManyVariables(ValueError):
    """More variables than the search is meant for."""


def moments(series: DataFrame, key: list[str]) -> DataFrame:
    """Counts, sums and products of each pair of variables over common times.

    ``series``: key, time, variable, value. Columns: key, a, b (a <= b), n, sa, sb, saa, sbb, sab.
    Pairs meet on (key, time); a key has at most ``MAX_VARIABLES`` variables in each time.
    """
    row = series.filter("value is not null").groupBy(*key, "time").agg(F.array_sort(F.collect_list(F.struct("variable", "value"))).alias("_v"))
    pairs = row.select(*key, F.explode(F.expr("flatten(transform(_v, (x, i) -> transform(slice(_v, i + 1, size(_v)), y -> struct(x.variable as a, y.variable as b, x.value as x, y.value as y))))")).alias("p")).select(*key, "p.*")
    return pairs.groupBy(*key, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sa"), F.sum("y").alias("sb"), F.sum(F.col("x") * F.col("x")).alias("saa"), F.sum(F.col("y") * F.col("y")).alias("sbb"), F.sum(F.col("x") * F.col("y")).alias("sab"))


def correlations(stats: DataFrame) -> DataFrame:
    """Pearson correlation of each pair from its moments; NULL where a side does not vary."""
    n = F.col("n").cast("double")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    both = va * vb
    r = (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(F.when(both > 0, both))
    return stats.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def fisher_z(corr: np.ndarray, n: int, i: int, j: int, given: tuple[int, ...]) -> float:
    """p-value of independence of i and j given others, from the inverse of the sub-matrix."""
    sub = corr[np.ix_([i, j, *given], [i, j, *given])]
    inv = np.linalg.pinv(sub)
    d = math.sqrt(max(inv[0, 0] * inv[1, 1], 1e-300))
    r = min(max(-inv[0, 1] / d, -0.9999999), 0.9999999)
    dof = n - len(given) - 3
    return math.erfc(math.sqrt(dof) * abs(math.atanh(r)) / math.sqrt(2)) if dof > 0 else 1.0


class Search:
    """FCI on a correlation matrix: skeleton, colliders, possible-d-sep, orientation rules R1 to R10.

    ``mark[i, j]`` is the mark at j of the edge between i and j, 0 where there is none.
    """

    def __init__(self, corr: np.ndarray, n: int, alpha: float = ALPHA) -> None:
        self.corr, self.n, self.alpha, self.k = corr, n, alpha, len(corr)
        if self.k > MAX_VARIABLES:
            raise TooManyVariables(f"{self.k} variables, at most {MAX_VARIABLES}")
        self.mark = np.where(np.eye(self.k, dtype=bool), 0, CIRCLE)
        self.separators: dict[frozenset[int], tuple[int, ...]] = {}

    def run(self) -> np.ndarray:
        if self.k >= 2:
            self._thin(lambda i, j: [v for v in self._near(i) if v != j])
            self._colliders()
            self._thin(lambda i, j: [v for v in self._possible_separators(i) if v != j], deep=True)
            self.mark[self.mark != 0] = CIRCLE
            self._colliders()
            while self._rules():
                pass
            while self._selected():
                while self._rules():
                    pass
        return self.mark

    def _near(self, i: int) -> list[int]:
        return [j for j in range(self.k) if self.mark[i, j]]

    def _cut(self, i: int, j: int, s: tuple[int, ...]) -> None:
        self.mark[i, j] = self.mark[j, i] = 0
        self.separators[frozenset((i, j))] = s

    def _thin(self, pool_of, deep: bool = False) -> None:
        for size in range(0 if not deep else 1, self.k - 1):
            any_left = False
            for i in range(self.k):
                for j in self._near(i):
                    pool = pool_of(i, j)
                    if len(pool) < size:
                        continue
                    any_left = True
                    for s in combinations(pool, size):
                        if fisher_z(self.corr, self.n, i, j, s) > self.alpha:
                            self._cut(i, j, s)
                            break
            if not any_left:
                return

    def _possible_separators(self, i: int) -> list[int]:
        # Nodes on ways from i whose every inner node is a collider or in a triangle.
        seen: set[tuple[int, int]] = set()
        front = [(i, j) for j in self._near(i)]
        out = set()
        while front:
            a, b = front.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            out.add(b)
            for c in self._near(b):
                if c not in (a, i) and (self.mark[a, c] or (self.mark[a, b] == ARROW and self.mark[c, b] == ARROW)):
                    front.append((b, c))
        return sorted(out - {i})

    def _colliders(self) -> None:
        for b in range(self.k):
            for a, c in combinations(self._near(b), 2):
                if not self.mark[a, c] and b not in self.separators.get(frozenset((a, c)), (b,)):
                    self.mark[a, b] = self.mark[c, b] = ARROW

    def _set(self, i: int, j: int, m: int) -> bool:
        if self.mark[i, j] == CIRCLE:
            self.mark[i, j] = m
            return True
        return False

    def _rules(self) -> bool:
        m, k, changed = self.mark, self.k, False
        for a in range(k):
            for b in self._near(a):
                for c in self._near(b):
                    if c == a:
                        continue
                    if not m[a, c]:
                        # R1: a *-> b o-* c with a, c apart: b -> c.
                        if m[a, b] == ARROW and m[c, b] == CIRCLE:
                            changed |= self._set(c, b, TAIL) | self._set(b, c, ARROW)
                    else:
                        # R2: a -> b *-> c or a *-> b -> c, and a *-o c: a *-> c.
                        if m[b, c] == ARROW and m[a, b] == ARROW and (m[b, a] == TAIL or m[c, b] == TAIL):
                            changed |= self._set(a, c, ARROW)
                        # R8: a -> b -> c or a -o b -> c, and a o-> c: a -> c.
                        if m[b, a] == TAIL and m[a, b] in (ARROW, CIRCLE) and m[c, b] == TAIL and m[b, c] == ARROW and m[a, c] == ARROW:
                            changed |= self._set(c, a, TAIL)
        for b in range(k):
            # R3: a *-> b <-* c, a *-o d o-* c, a and c apart, d *-o b: d *-> b.
            for a, c in combinations(self._near(b), 2):
                if m[a, b] == ARROW and m[c, b] == ARROW and not m[a, c]:
                    for d in self._near(b):
                        if d not in (a, c) and m[a, d] == CIRCLE and m[c, d] == CIRCLE:
                            changed |= self._set(d, b, ARROW)
        return changed | self._discriminate() | self._uncovered()

    def _circle_ways(self, a: int, b: int) -> list[list[int]]:
        """Uncovered ways of o-o edges from a to b that close a cycle without chords at a and b."""
        m, out, front = self.mark, [], [[a]]
        while front:
            way = front.pop()
            at = way[-1]
            for v in self._near(at):
                if v in way or m[v, at] != CIRCLE or m[at, v] != CIRCLE or (len(way) > 1 and m[way[-2], v]):
                    continue
                if v != b:
                    front.append([*way, v])
                elif len(way) > 2 and not m[a, at] and not m[way[1], b]:
                    out.append([*way, v])
        return out

    def _selected(self) -> bool:
        """Rules on selection: R5 undirected cycles, R6 and R7 tails behind them."""
        m, changed = self.mark, False
        for a, b in combinations(range(self.k), 2):
            if m[a, b] == CIRCLE and m[b, a] == CIRCLE:
                for way in self._circle_ways(a, b):
                    for x, y in [*zip(way, way[1:], strict=False), (a, b)]:
                        m[x, y] = m[y, x] = TAIL
                    changed = True
                    break
        for b in range(self.k):
            for a in self._near(b):
                for c in self._near(b):
                    if c == a or m[c, b] != CIRCLE:
                        continue
                    # R6: a - b o-* c: b -* c. R7: a -o b o-* c with a, c apart: b -* c.
                    if m[b, a] == TAIL and (m[a, b] == TAIL or (m[a, b] == CIRCLE and not m[a, c])):
                        changed |= self._set(c, b, TAIL)
        return changed

    def _open_ways(self, a: int, c: int) -> list[list[int]]:
        """Uncovered ways from a to c on which no mark forbids the direction from a to c."""
        m, out, front = self.mark, [], [[a]]
        while front:
            way = front.pop()
            for v in self._near(way[-1]):
                if v in way or m[v, way[-1]] == ARROW or m[way[-1], v] == TAIL or (len(way) > 1 and m[way[-2], v]):
                    continue
                if v == c:
                    out.append([*way, v])
                else:
                    front.append([*way, v])
        return out

    def _uncovered(self) -> bool:
        m, changed = self.mark, False
        for a in range(self.k):
            for c in self._near(a):
                if m[a, c] != ARROW or m[c, a] != CIRCLE:
                    continue
                # R9: an open way a, b, .. c with b and c apart: a -> c.
                if any(len(w) > 3 and not m[w[1], c] for w in self._open_ways(a, c)):
                    changed |= self._set(c, a, TAIL)
                    continue
                # R10: b -> c <- d and open ways from a to b and to d that begin apart: a -> c.
                into = [b for b in self._near(c) if b != a and m[b, c] == ARROW and m[c, b] == TAIL]
                starts = {b: {w[1] for w in self._open_ways(a, b)} for b in into}
                if any(x != y and not m[x, y] for b, d in combinations(into, 2) for x in starts[b] for y in starts[d]):
                    changed |= self._set(c, a, TAIL)
        return changed

    def _discriminate(self) -> bool:
        # R4: a path v .. a, b, c whose inner nodes are colliders and parents of c decides b.
        m, changed = self.mark, False
        for b in range(self.k):
            for c in self._near(b):
                if m[c, b] != CIRCLE:
                    continue
                for a in self._near(b):
                    if a == c or m[b, a] != ARROW or m[a, c] != ARROW or m[c, a] != TAIL:
                        continue
                    front, seen = [a], {a, b, c}
                    while front:
                        x = front.pop()
                        for v in self._near(x):
                            if v in seen or m[v, x] != ARROW:
                                continue
                            seen.add(v)
                            if not m[v, c]:
                                if b in self.separators.get(frozenset((v, c)), ()):
                                    changed |= self._set(c, b, TAIL) | self._set(b, c, ARROW)
                                else:
                                    changed |= self._set(c, b, ARROW) | self._set(b, c, ARROW)
                                    m[a, b] = ARROW if m[a, b] == CIRCLE else m[a, b]
                                front = []
                                break
                            if m[x, v] == ARROW and m[v, c] == ARROW and m[c, v] == TAIL:
                                front.append(v)
        return changed


def edge_type(mark_i: int, mark_j: int) -> tuple[str, bool]:
    """Kind of the edge with these marks at i and at j, and whether it leads from j to i."""
    kinds = {
        (TAIL, ARROW): ("DIRECTED", False),
        (ARROW, TAIL): ("DIRECTED", True),
        (ARROW, ARROW): ("BIDIRECTED", False),
        (CIRCLE, ARROW): ("PARTIALLY_DIRECTED", False),
        (ARROW, CIRCLE): ("PARTIALLY_DIRECTED", True),
        (CIRCLE, CIRCLE): ("UNDIRECTED", False),
        (TAIL, TAIL): ("TAIL_TAIL", False),
        (CIRCLE, TAIL): ("PARTIALLY_DIRECTED", False),
        (TAIL, CIRCLE): ("PARTIALLY_DIRECTED", True),
    }
    return kinds[mark_i, mark_j]


def _search_key(key: list[str], alpha: float):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {v: i for i, v in enumerate(names)}
        out = []
        if len(names) > MAX_VARIABLES:
            out.append((*(pdf[k].iloc[0] for k in key), None, None, "TOO_MANY_VARIABLES", None))
        elif len(names) >= 2:
            corr = np.eye(len(names))
            for r in pdf.itertuples():
                if r.r == r.r and r.r is not None:
                    corr[at[r.a], at[r.b]] = corr[at[r.b], at[r.a]] = r.r if r.a != r.b else 1.0
            mark = Search(corr, int(pdf["n"].min()), alpha).run()
            for i, j in combinations(range(len(names)), 2):
                if mark[i, j]:
                    kind, turned = edge_type(mark[j, i], mark[i, j])
                    a, b = (j, i) if turned else (i, j)
                    out.append((*(pdf[k].iloc[0] for k in key), names[a], names[b], kind, 0.5))
        return pd.DataFrame(out, columns=[*key, "src", "dst", "edge_type", "confidence"])

    return search


def discover(series: DataFrame, key: list[str], *, alpha: float = ALPHA) -> DataFrame:
    """Edges of the partial ancestral graph of each key: src, dst, edge_type, confidence.

    A key of fewer than two variables has none; one of more than ``MAX_VARIABLES`` has a single row of
    type TOO_MANY_VARIABLES without ends: prune it first. A worker holds one key's k x k
    correlations, never its readings.
    """
    stats = correlations(moments(series, key))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name in key)
    return stats.select(*key, "a", "b", "n", "r").groupBy(*key).applyInPandas(_search_key(key, alpha), f"{kinds}, src string, dst string, edge_type string, confidence double")


def pag_from_paths(scenarios: DataFrame) -> DataFrame:
    """Oracle graph of each scenario: its path DIRECTED, a confounded one's first edge BIDIRECTED too."""
    from tidegauge.functions import norm_name

    rows = scenarios.dropDuplicates(["fault_id"]).select("fault_id", "confounded", F.posexplode("causal_path").alias("i", "e")).select("fault_id", "confounded", "i", norm_name(F.col("e")[0]).alias("src"), norm_name(F.col("e")[1]).alias("dst")).filter("src is not null and dst is not null")
    directed = rows.select("fault_id", "src", "dst", F.lit("DIRECTED").alias("edge_type"))
    hidden = rows.filter("confounded and i = 0").select("fault_id", "src", "dst", F.lit("BIDIRECTED").alias("edge_type"))
    return directed.unionByName(hidden).distinct()


def identify(pag: DataFrame, pairs: DataFrame, key: list[str], hops: int | None = None) -> DataFrame:
    """Whether the effect of src on dst is identifiable, and how, for many pairs at once.

    Order of checks: both observed; backdoor (no bidirected edge at the source; CONDITIONALLY with
    an ambiguous edge at either end); front door; with a bidirected edge at the source and a
    directed way, an instrument or the need to intervene; else NOT_IDENTIFIABLE.
    """
    from tidegauge.operators.graph import closure

    ask = pairs.select(*key, "src", "dst").distinct()
    nodes = pag.select(*key, F.explode(F.array("src", "dst")).alias("node")).distinct()

    def touching(kinds: list[str], name: str) -> DataFrame:
        return pag.filter(F.col("edge_type").isin(kinds)).select(*key, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn(name, F.lit(True))

    def mark(df: DataFrame, other: DataFrame, end: str, name: str) -> DataFrame:
        return df.join(other.withColumnRenamed("node", end).withColumnRenamed(other.columns[-1], name), [*key, end], "left")

    seen = nodes.withColumn("_seen", F.lit(True))
    rows = mark(mark(ask, seen, "src", "_src_seen"), seen, "dst", "_dst_seen")
    rows = mark(rows, touching(["BIDIRECTED"], "_b"), "src", "_hidden")
    vague = touching(["PARTIALLY_DIRECTED", "UNDIRECTED"], "_v")
    rows = mark(mark(rows, vague, "src", "_vague_src"), vague, "dst", "_vague_dst")
    sure = pag.filter("edge_type = 'DIRECTED'").select(*key, "src", "dst").distinct()
    loose = pag.filter("edge_type in ('DIRECTED', 'PARTIALLY_DIRECTED')").select(*key, "src", "dst").distinct()
    way = closure(loose, key, hops, paths=False).select(*key, "src", "dst").withColumn("_way", F.lit(True))
    direct = sure.withColumn("_direct", F.lit(True))
    middle = sure.withColumnRenamed("dst", "_m").join(sure.withColumnRenamed("src", "_m"), [*key, "_m"]).groupBy(*key, "src", "dst").agg(F.array_join(F.array_sort(F.collect_set("_m")), ",").alias("mediators"))
    parents = sure.groupBy(*key, F.col("dst").alias("src")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("parents"))
    # A parent that is also a descendant cannot be adjusted for; the empty set is taken then.
    turned = sure.select(*key, F.col("src").alias("_p"), F.col("dst").alias("src")).join(way.select(*key, "src", F.col("dst").alias("_p")), [*key, "src", "_p"], "left_semi").select(*key, "src").distinct()
    parents = parents.join(turned, [*key, "src"], "left_anti")
    hidden_pairs = pag.filter("edge_type = 'BIDIRECTED'")
    either = hidden_pairs.select(*key, "src", "dst").unionByName(hidden_pairs.select(*key, F.col("dst").alias("src"), F.col("src").alias("dst")))
    instrument = sure.withColumnRenamed("src", "_iv").withColumnRenamed("dst", "src").join(ask, [*key, "src"]).join(either.withColumnRenamed("src", "_iv"), [*key, "_iv", "dst"], "left_anti").groupBy(*key, "src", "dst").agg(F.min("_iv").alias("instrument"))
    rows = rows.join(way, [*key, "src", "dst"], "left").join(direct, [*key, "src", "dst"], "left").join(middle, [*key, "src", "dst"], "left").join(parents, [*key, "src"], "left").join(instrument, [*key, "src", "dst"], "left")
    known = F.col("_src_seen") & F.col("_dst_seen")
    vague_end = F.coalesce("_vague_src", F.lit(False)) | F.coalesce("_vague_dst", F.lit(False))
    hidden = F.coalesce("_hidden", F.lit(False))
    front = F.col("mediators").isNotNull() & F.col("_direct").isNull()
    status: Column = (
        F.when(~F.coalesce(known, F.lit(False)), "NOT_IDENTIFIABLE")
        .when(~hidden & vague_end, "CONDITIONALLY_IDENTIFIABLE")
        .when(~hidden, "IDENTIFIABLE")
        .when(front, "IDENTIFIABLE")
        .when(F.col("_way").isNull(), "NOT_IDENTIFIABLE")
        .when(F.col("instrument").isNotNull(), "CONDITIONALLY_IDENTIFIABLE")
        .otherwise("REQUIRES_INTERVENTION")
    )
    method = F.when(~F.coalesce(known, F.lit(False)), "NONE").when(~hidden, "BACKDOOR").when(front, "FRONTDOOR").when(F.col("_way").isNotNull() & F.col("instrument").isNotNull(), "INSTRUMENT").otherwise("NONE")
    return rows.select(*key, "src", "dst", status.alias("status"), method.alias("method"), F.when(method == "BACKDOOR", F.coalesce("parents", F.lit(""))).alias("adjustment"), F.when(method == "FRONTDOOR", F.col("mediators")).alias("mediators"), F.when(method == "INSTRUMENT", F.col("instrument")).alias("instrument"))


def backdoor_effect(rows: DataFrame, x: str, y: str, z: list[str]) -> DataFrame:
    """Mean of y under do(x) by stratifying: sum over z of E[y | x, z] P(z). An extension."""
    share = rows.groupBy(*z).agg(F.count(F.lit(1)).alias("_nz"))
    total = share.agg(F.sum("_nz").alias("_n"))
    cells = rows.groupBy(x, *z).agg(F.avg(y).alias("_y")).join(share, z).crossJoin(F.broadcast(total))
    return cells.groupBy(x).agg((F.sum(F.col("_y") * F.col("_nz")) / F.max("_n")).alias("effect"), (F.sum("_nz") / F.max("_n")).alias("support"))
