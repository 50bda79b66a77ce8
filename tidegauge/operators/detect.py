"""Anomaly scores and the ranking of services by earliest lasting divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import epoch_ms
from tidegauge.operators.graph import closure, node_degrees
from tidegauge.plans.runtime import cut_lineage

THETA, PERSIST = 3.0, 2
KEY = ["incident_id", "service_id"]


def deviations(series: DataFrame, baselines: DataFrame) -> DataFrame:
    """|z| of each value against its source's baseline; without one, against its own values.

    ``series``: incident_id, service_id, t_start_ms, delta_ms, value; ``baselines``: incident_id,
    service_id, mean, std.
    """
    rows = series.filter("value is not null").join(baselines.select(*KEY, "mean", "std"), KEY, "left")
    own = Window.partitionBy(*KEY)
    mean = F.coalesce("mean", F.avg("value").over(own))
    std = F.coalesce("std", F.stddev_samp("value").over(own) + 1e-9)
    return rows.withColumn("_m", mean).withColumn("_sd", std).withColumn("z", F.abs(F.col("value") - F.col("_m")) / F.when(F.col("_sd") > 0, F.col("_sd"))).drop("mean", "std", "_m", "_sd")


def anomaly_scores(dev: DataFrame) -> DataFrame:
    """Largest and mean |z| of each service."""
    return dev.groupBy(*KEY).agg(F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.count(F.lit(1)).alias("n"))


def over_threshold(scores: DataFrame, theta: float = THETA) -> DataFrame:
    """Services whose score is strictly over the threshold."""
    return scores.filter(F.col("max_z") > theta)


def persistent_divergence(dev: DataFrame, theta: float = THETA, persist: int = PERSIST) -> DataFrame:
    """R1: start of the first run of at least ``persist`` (and 2) successive windows over theta.

    A run goes on where the next window starts within a tenth of a width of its due time.
    Columns: incident_id, service_id, t_star_ms, run_length, score.
    """
    order = Window.partitionBy(*KEY).orderBy("t_start_ms")
    hot = dev.filter(F.col("z") > theta).withColumn("_prev", F.lag("t_start_ms").over(order))
    step = F.col("t_start_ms") - F.col("_prev") - F.col("delta_ms")
    hot = hot.withColumn("_run", F.sum(F.when(F.col("_prev").isNull() | (F.abs(step) >= 0.1 * F.col("delta_ms")), 1).otherwise(0)).over(order))
    runs = hot.groupBy(*KEY, "_run").agg(F.min("t_start_ms").alias("t_star_ms"), F.count(F.lit(1)).alias("run_length")).filter(F.col("run_length") >= max(2, persist))
    first = runs.groupBy(*KEY).agg(F.min(F.struct("t_star_ms", "run_length")).alias("r")).select(*KEY, "r.*")
    return first.join(anomaly_scores(dev).select(*KEY, F.col("max_z").alias("score")), KEY)


def precedence(diverging: DataFrame, delta_ms: int) -> DataFrame:
    """R2: nobody else diverged before; ties are those within half a width."""
    incident = Window.partitionBy("incident_id")
    # Whole incidents are small here: a service has one row in each.
    near = Window.partitionBy("incident_id").orderBy("t_star_ms").rangeBetween(-(delta_ms // 2), delta_ms // 2)
    return diverging.withColumn("_first", F.min("t_star_ms").over(incident)).withColumn("r2", F.col("_first") >= F.col("t_star_ms") - 0.01 * delta_ms).withColumn("n_ties", F.count(F.lit(1)).over(near) - 1).drop("_first")


def in_incident(events: DataFrame, time: str, incidents: DataFrame) -> DataFrame:
    """Events with the incident whose time they fall in; others are left out.

    ``time`` is in ms. Incidents meet events by block of about 35 minutes, so no event meets all incidents.
    """
    span = incidents.select("incident_id", epoch_ms("t_start").alias("_from"), epoch_ms("t_end").alias("_to")).filter("_from < _to")
    span = span.withColumn("_block", F.explode(F.expr("sequence(shiftright(_from, 21), shiftright(_to, 21))")))
    rows = events.withColumn("_block", F.shiftright(time, 21))
    return rows.join(span, "_block").filter((F.col(time) >= F.col("_from")) & (F.col(time) < F.col("_to"))).drop("_block", "_from", "_to")


def probe_samples(series: DataFrame, probes: DataFrame, edges: DataFrame) -> DataFrame:
    """Values of the services called by a probed one before its first probe (base) and during probes (post).

    ``series``: incident_id, service_id, t_start_ms, delta_ms, value; ``probes``: incident_id, service_id,
    applied_ms, ended_ms; ``edges``: src, dst. A window is during a probe if it overlaps it; later windows
    outside probes are on neither side. Columns: incident_id, src, dst, idx, side, value.
    """
    spans = probes.filter("ended_ms > applied_ms").select("incident_id", F.col("service_id").alias("src"), "applied_ms", "ended_ms").distinct()
    spans = spans.groupBy("incident_id", "src").agg(F.min("applied_ms").alias("_first"), F.collect_set(F.struct("applied_ms", "ended_ms")).alias("_spans"))
    called = spans.join(edges.select("src", "dst").distinct(), "src")
    rows = called.join(series.filter("value is not null").withColumnRenamed("service_id", "dst"), ["incident_id", "dst"])
    during = F.exists("_spans", lambda x: (F.col("t_start_ms") < x["ended_ms"]) & (F.col("t_start_ms") + F.col("delta_ms") > x["applied_ms"]))
    side = F.when(during, "post").when(F.col("t_start_ms") + F.col("delta_ms") <= F.col("_first"), "base")
    return rows.select("incident_id", "src", "dst", F.col("t_start_ms").alias("idx"), side.alias("side"), "value").filter("side is not null")


def rank_divergence(dev: DataFrame, edges: DataFrame, evidence: DataFrame | None = None, *, theta: float = THETA, persist: int = PERSIST, delta_ms: int = 10_000, hops: int | None = None, bidirected: DataFrame | None = None) -> DataFrame:
    """Earliest-divergence ranking of the services of each incident by rules R1 to R4.

    R1 lasting divergence; R2 none earlier, or all earlier ones in the graph are reached from it;
    R3 another diverging service is reached from it, or it is a leaf that an upstream service
    diverging no earlier reaches; R4 an edge on its shortest path has evidence. All four are
    DEFINITIVE, the first three CANDIDATE, else NONE. ``edges``: src, dst; ``evidence``: src, dst
    (over its threshold); ``bidirected``: a, b. Edges, evidence and pairs that belong to an incident
    have its incident_id too; a graph of its own for each incident is what keeps reachability small. Ways are
    followed from diverging services only.
    """
    # A few rows an incident, read five times below.
    found = cut_lineage(precedence(persistent_divergence(dev, theta, persist), delta_ms))
    key = [c for c in ("incident_id",) if c in edges.columns]
    reach = closure(edges, key, hops, found.select(*key, F.col("service_id").alias("src")).distinct()).select(*key, "src", "dst", "depth", "path")
    nodes = node_degrees(edges, key)
    a = found.select("incident_id", F.col("service_id").alias("src"), F.col("t_star_ms").alias("_ta"))
    b = found.select("incident_id", F.col("service_id").alias("dst"), F.col("t_star_ms").alias("_tb"))
    pairs = a.join(reach, [*key, "src"]).join(b, ["incident_id", "dst"])
    down = pairs.groupBy("incident_id", F.col("src").alias("service_id")).agg(F.min(F.struct("_tb", "dst", "path")).alias("_d"), F.count_if(F.col("_tb") < F.col("_ta") - 0.01 * delta_ms).alias("_earlier_reached")).select("incident_id", "service_id", F.col("_d.path").alias("_down"), "_earlier_reached")
    up = pairs.filter(F.col("_ta") >= F.col("_tb") - 10).groupBy("incident_id", F.col("dst").alias("service_id")).agg(F.min(F.struct("_ta", "src", "path")).alias("_u")).select("incident_id", "service_id", F.col("_u.path").alias("_up"))
    known = found.join(nodes.select(*key, F.col("node").alias("service_id"), "is_leaf"), [*key, "service_id"], "left")
    graph = Window.partitionBy("incident_id").orderBy("t_star_ms").rangeBetween(Window.unboundedPreceding, -(max(1, delta_ms // 100) + 1))
    known = known.withColumn("_earlier", F.count_if(F.col("is_leaf").isNotNull()).over(graph))
    rows = known.join(down, KEY, "left").join(up, KEY, "left")
    rows = rows.withColumn("r2", F.col("r2") | (F.coalesce("_earlier_reached", F.lit(0)) >= F.col("_earlier")))
    leaf = F.coalesce("is_leaf", F.lit(False)) & F.col("_up").isNotNull()
    rows = rows.withColumn("r3", F.col("_down").isNotNull() | leaf).withColumn("path", F.coalesce("_down", F.when(leaf, F.col("_up"))))
    if evidence is not None:
        hops_of = rows.filter("path is not null").select(*KEY, F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as src, path[i] as dst))")).alias("e")).select(*KEY, "e.src", "e.dst")
        on = [c for c in ("incident_id", "src", "dst") if c in evidence.columns]
        shown = hops_of.join(evidence.select(*on).distinct(), on).select(*KEY).distinct().withColumn("r4", F.lit(True))
        rows = rows.join(shown, KEY, "left").withColumn("r4", F.coalesce("r4", F.lit(False)))
    else:
        rows = rows.withColumn("r4", F.lit(False))
    tier = F.when(F.col("r2") & F.col("r3") & F.col("r4"), "DEFINITIVE").when(F.col("r2") & F.col("r3"), "CANDIDATE").otherwise("NONE")
    rows = rows.withColumn("confidence", tier).withColumn("boundary_limited", F.col("is_leaf").isNull())
    if bidirected is not None:
        own = [c for c in ("incident_id",) if c in bidirected.columns]
        ends = bidirected.select(*own, F.explode(F.array("a", "b")).alias("service_id")).distinct()
        rows = rows.join(ends.withColumn("_hidden", F.lit(True)), [*own, "service_id"], "left")
    else:
        rows = rows.withColumn("_hidden", F.lit(None).cast("boolean"))
    rows = rows.withColumn("identifiability", F.when(F.col("_hidden"), "NOT_IDENTIFIABLE").otherwise("IDENTIFIABLE"))
    place = F.when(F.col("confidence") == "DEFINITIVE", 0).when(F.col("confidence") == "CANDIDATE", 1).otherwise(2)
    order = Window.partitionBy("incident_id").orderBy(place, "t_star_ms", F.desc("score"), "service_id")
    return rows.select(*KEY, "t_star_ms", "run_length", "score", "n_ties", "r2", "r3", "r4", "confidence", "boundary_limited", "identifiability", F.row_number().over(order).alias("rank"), F.array_join("path", ">").alias("path"))


def detection_latency(ranked: DataFrame, incidents: DataFrame) -> DataFrame:
    """Seconds from the start of an incident to its earliest divergence."""
    start = incidents.select("incident_id", F.round(F.col("t_start") * 1000).cast("bigint").alias("_start"))
    return ranked.groupBy("incident_id").agg(F.min("t_star_ms").alias("_t")).join(start, "incident_id").select("incident_id", ((F.col("_t") - F.col("_start")) / 1000.0).alias("latency_s"))
