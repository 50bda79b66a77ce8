"""Service graphs: slices in time, reachability, shortest paths, anomaly subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import norm_name
from tidegauge.plans.runtime import cut_lineage


def path_edges(scenarios: DataFrame) -> DataFrame:
    """fault_id, src, dst of each causal path; rows delivered again and repeated edges count once."""
    e = scenarios.select("fault_id", F.explode("causal_path").alias("e")).select("fault_id", norm_name(F.col("e")[0]).alias("src"), norm_name(F.col("e")[1]).alias("dst"))
    return e.filter("src is not null and dst is not null and src <> dst").distinct()


def closure(edges: DataFrame, key: list[str], hops: int | None = None, sources: DataFrame | None = None, *, paths: bool = True) -> DataFrame:
    """Reachable pairs with the shortest path, the least of equal ones; within ``hops`` edges if given.

    With ``sources`` (``key``, src) only the pairs that begin at one of them; without ``paths`` no paths.
    Frontier joins: each round extends only the pairs first reached in the round before, until there
    are none, so cycles end. Columns: ``key``, src, dst, depth, path (nodes).
    """
    step = edges.select(*key, F.col("src").alias("_mid"), F.col("dst").alias("_to")).distinct()
    begin = edges if sources is None else edges.join(sources, [*key, "src"], "left_semi")
    ends, way = [*key, "src", "dst"], [F.array("src", "dst").alias("path")] if paths else []
    reached = begin.filter("src <> dst").select(*ends).distinct().select(*ends, F.lit(1).alias("depth"), *way)
    reached = front = cut_lineage(reached) if hops is None or hops > 1 else reached
    depth = 1
    while hops is None or depth < hops:
        depth += 1
        longer = [F.concat("path", F.array("_to")).alias("path")] if paths else []
        nxt = front.withColumnRenamed("dst", "_mid").join(step, [*key, "_mid"]).filter("src <> _to").select(*key, "src", F.col("_to").alias("dst"), *longer)
        nxt = nxt.groupBy(*ends).agg(F.min("path").alias("path")) if paths else nxt.distinct()
        nxt = nxt.select(*ends, F.lit(depth).alias("depth"), *(["path"] if paths else []))
        front = cut_lineage(nxt.join(reached.select(*ends), ends, "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def simple_paths(edges: DataFrame, key: list[str], pairs: DataFrame) -> DataFrame:
    """All ways without a repeated node between each pair (``key``, src, dst): ``key``, src, dst, path.

    Their number grows exponentially with the graph: meant for small graphs, such as one scenario's own.
    """
    step = edges.select(*key, F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct()
    front = cut_lineage(pairs.select(*key, "src", "dst").distinct().filter("src <> dst").select("*", F.col("src").alias("_at"), F.array("src").alias("path")))
    found = front.filter("false").select(*key, "src", "dst", "path")
    while not front.isEmpty():
        nxt = front.join(step, [*key, "_at"]).filter(~F.array_contains("path", F.col("_to")))
        nxt = cut_lineage(nxt.select(*key, "src", "dst", F.col("_to").alias("_at"), F.concat("path", F.array("_to")).alias("path")))
        found = found.unionByName(nxt.filter("_at = dst").select(*key, "src", "dst", "path"))
        front = nxt.filter("_at <> dst")
    return found


def directed_part(pag: DataFrame, key: list[str]) -> DataFrame:
    """Edges of a partial ancestral graph that lead somewhere: DIRECTED and PARTIALLY_DIRECTED, each once."""
    return pag.filter(F.col("edge_type").isin("DIRECTED", "PARTIALLY_DIRECTED")).select(*key, "src", "dst").distinct()


def pair_lookup(pag: DataFrame, key: list[str], pairs: DataFrame) -> DataFrame:
    """What a partial ancestral graph says of each pair (``key``, a, b), whichever way its edges are kept.

    Columns: has_edge, edge_types (sorted, as src>dst:TYPE) and hidden_cause (a bidirected edge).
    """
    both = pag.select(*key, F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "edge_type")
    both = both.unionByName(pag.select(*key, F.col("dst").alias("a"), F.col("src").alias("b"), "src", "dst", "edge_type")).distinct()
    kinds = both.groupBy(*key, "a", "b").agg(F.array_join(F.array_sort(F.collect_set(F.concat("src", F.lit(">"), "dst", F.lit(":"), "edge_type"))), ",").alias("edge_types"), F.max((F.col("edge_type") == "BIDIRECTED").cast("int")).alias("_h"))
    rows = pairs.select(*key, "a", "b").distinct().join(kinds, [*key, "a", "b"], "left")
    return rows.select(*key, "a", "b", F.col("edge_types").isNotNull().alias("has_edge"), "edge_types", (F.coalesce("_h", F.lit(0)) == 1).alias("hidden_cause"))


def node_degrees(edges: DataFrame, key: list[str]) -> DataFrame:
    """In- and out-degree of each node; a leaf has no way out."""
    ends = edges.select(*key, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(*key, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy(*key, "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumn("is_leaf", F.col("out_degree") == 0)


def skeleton(edges: DataFrame, key: list[str]) -> DataFrame:
    """Undirected edges: each pair once, the lesser name first."""
    return edges.select(*key, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def topological_depth(edges: DataFrame, key: list[str]) -> DataFrame:
    """Longest way from a root; edges always lead to a greater depth. NULL on or behind a cycle.

    Ways grow edge by edge until none is left. A way of as many edges as its key has nodes went round
    a cycle, and every node on or behind one ends such a way.
    """
    edges = cut_lineage(edges.select(*key, "src", "dst").distinct())
    step = edges.select(*key, F.col("src").alias("node"), F.col("dst").alias("_to"))
    nodes = edges.select(*key, F.col("src").alias("node")).unionByName(edges.select(*key, F.col("dst").alias("node"))).distinct()
    size = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    front = cut_lineage((nodes.join(size, key) if key else nodes.crossJoin(size)).withColumn("depth", F.lit(0)))
    deepest, depth = front, 0
    while True:
        depth += 1
        front = cut_lineage(front.filter(F.col("depth") < F.col("_n")).select(*key, "node", "_n").join(step, [*key, "node"]).select(*key, F.col("_to").alias("node"), "_n").distinct().withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        deepest = deepest.unionByName(front)
    return deepest.groupBy(*key, "node").agg(F.max("depth").alias("_d"), F.max("_n").alias("_n")).select(*key, "node", F.when(F.col("_d") < F.col("_n"), F.col("_d")).alias("depth"))


def time_sliced(windows: DataFrame, edges: DataFrame, max_lag: int = 1) -> DataFrame:
    """Edges between observed (service, window): calls up to ``max_lag`` windows ahead, and each
    service to itself; where both exist the call stands.

    ``windows``: incident_id, service_id, window_id that were observed; ``edges``: src, dst. Lags
    are bounded, so each lag is an equi-join.
    """
    lags = F.explode(F.sequence(F.lit(1), F.lit(max_lag)))
    ahead = windows.select("incident_id", F.col("service_id").alias("src"), F.col("window_id").alias("src_window"), lags.alias("lag")).withColumn("dst_window", F.col("src_window") + F.col("lag"))
    there = windows.select("incident_id", F.col("service_id").alias("dst"), F.col("window_id").alias("dst_window"))
    calls = ahead.join(edges.select("src", "dst").distinct(), "src").join(there, ["incident_id", "dst", "dst_window"]).withColumn("edge_type", F.lit("CALL_GRAPH"))
    own = ahead.withColumn("dst", F.col("src")).join(there, ["incident_id", "dst", "dst_window"]).withColumn("edge_type", F.lit("AUTOREGRESSIVE"))
    cols = ["incident_id", "src", "src_window", "dst", "dst_window", "lag"]
    return calls.select(*cols, "edge_type").unionByName(own.select(*cols, "edge_type")).groupBy(*cols).agg(F.max("edge_type").alias("edge_type"))


def collapse(sliced: DataFrame) -> DataFrame:
    """Distinct service edges of a time-sliced graph without those from a service to itself."""
    return sliced.filter("src <> dst").select("incident_id", "src", "dst").distinct()


def forward_violations(sliced: DataFrame) -> DataFrame:
    """Edges that do not lead forward in time; without any the sliced graph has no cycle."""
    return sliced.groupBy("incident_id").agg(F.count_if(F.col("dst_window") <= F.col("src_window")).alias("n_backward"), F.count(F.lit(1)).alias("n_edges"))


def anomaly_subgraph(scores: DataFrame, edges: DataFrame, bidirected: DataFrame | None = None, *, threshold: float = 3.0, keep: int = 15) -> DataFrame:
    """Anomalous services, their parents, and partners by hidden common causes, the best ``keep``.

    ``scores``: incident_id, service_id, score. Partners are added in a single hop. The order is
    score, then name, both descending; a service without a score counts as 0. An incident that had
    to drop services is boundary_limited.
    """
    seeds = scores.filter(F.col("score") > threshold).select("incident_id", "service_id")
    parents = seeds.join(edges.select(F.col("src").alias("_p"), F.col("dst").alias("service_id")).distinct(), "service_id").select("incident_id", F.col("_p").alias("service_id"))
    found = seeds.unionByName(parents).distinct()
    if bidirected is not None:
        both = bidirected.select(F.col("a").alias("service_id"), F.col("b").alias("_q")).unionByName(bidirected.select(F.col("b").alias("service_id"), F.col("a").alias("_q")))
        found = found.unionByName(found.join(both, "service_id").select("incident_id", F.col("_q").alias("service_id"))).distinct()
    ranked = found.join(scores, ["incident_id", "service_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("incident_id").orderBy(F.desc("score"), F.desc("service_id"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("boundary_limited", F.count(F.lit(1)).over(Window.partitionBy("incident_id")) > keep)
    return ranked.filter(F.col("rank") <= keep).select("incident_id", "service_id", "score", "rank", "boundary_limited")


def blast_radius(reach: DataFrame, key: list[str], n_services: int) -> DataFrame:
    """Share of the services that a service reaches, at most 1."""
    return reach.groupBy(*key, F.col("src").alias("service_id")).agg(F.least(F.lit(1.0), F.countDistinct("dst") / F.lit(float(max(n_services, 1)))).alias("blast_radius"))


def propagation_scores(scores: DataFrame, reach: DataFrame, decay: float = 0.5, max_depth: int = 5) -> DataFrame:
    """Own score plus the scores reached, weighted decay^(d(d+1)/2) at depth d.

    On a tree this is the depth-first sum; where several ways lead to a service its shortest
    counts once. ``reach`` is a closure over all incidents (src, dst, depth).
    """
    far = reach.filter(F.col("depth") <= max_depth).select(F.col("src").alias("service_id"), "dst", (F.pow(F.lit(decay), F.col("depth") * (F.col("depth") + 1) / 2)).alias("w"))
    child = scores.select("incident_id", F.col("service_id").alias("dst"), F.col("score").alias("_s"))
    gain = scores.select("incident_id", "service_id").join(far, "service_id").join(child, ["incident_id", "dst"]).groupBy("incident_id", "service_id").agg(F.sum(F.col("w") * F.col("_s")).alias("_gain"))
    return scores.join(gain, ["incident_id", "service_id"], "left").select("incident_id", "service_id", "score", (F.col("score") + F.coalesce("_gain", F.lit(0.0))).alias("propagated"))
