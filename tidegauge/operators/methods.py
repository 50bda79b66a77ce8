"""Comparison methods: each ranks the services of an incident or abstains.

Every method returns method, incident_id, top_candidates (service, score; best first), abstained,
abstention_reason, latency_s and total_ed_s, one row for each incident.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.align import first_half_baseline
from tidegauge.operators.detect import detection_latency
from tidegauge.operators.graph import propagation_scores
from tidegauge.plans.runtime import cut_lineage

TOP = 5


def _ranked(rows: DataFrame, order: list[Column], top: int = TOP) -> DataFrame:
    """The best services of each incident as one array; a window limit, not a gathered group."""
    best = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(*order))).filter(F.col("_rank") <= top)
    return best.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("_rank", F.col("service_id").alias("service"), "score"))).alias("_c")).select("incident_id", F.transform("_c", lambda c: F.struct(c["service"].alias("service"), c["score"].alias("score"))).alias("top_candidates"))


def _output(name: str, incidents: DataFrame, best: DataFrame, reason: str, latency: DataFrame | None = None, spent: DataFrame | None = None) -> DataFrame:
    rows = incidents.select("incident_id").distinct().join(best, "incident_id", "left")
    if latency is not None:
        rows = rows.join(latency, "incident_id", "left")
    if spent is not None:
        rows = rows.join(spent, "incident_id", "left")
    none = F.col("top_candidates").isNull()
    empty = F.array().cast("array<struct<service:string,score:double>>")
    return rows.select(F.lit(name).alias("method"), "incident_id", F.coalesce("top_candidates", empty).alias("top_candidates"), none.alias("abstained"), F.when(none, reason).alias("abstention_reason"), F.when(~none, F.col("latency_s") if latency is not None else F.lit(None).cast("double")).alias("latency_s"), F.coalesce(F.col("total_ed_s") if spent is not None else F.lit(0.0), F.lit(0.0)).alias("total_ed_s"))


def observational(incidents: DataFrame, ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates of the divergence ranking by mean |z|; without any, the three most anomalous."""
    with_score = ranked.join(scores.select("incident_id", "service_id", F.col("mean_z").alias("_mz")), ["incident_id", "service_id"]).withColumn("score", F.col("_mz"))
    sure = with_score.filter("confidence in ('CANDIDATE', 'DEFINITIVE')")
    fallback = with_score.join(sure.select("incident_id").distinct(), "incident_id", "left_anti")
    fallback = fallback.withColumn("_k", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("score"), "service_id"))).filter("_k <= 3").drop("_k")
    best = _ranked(sure.unionByName(fallback), [F.desc("score"), F.col("service_id")])
    return _output("OBS", incidents, best, "NO_DIVERGENCE", detection_latency(ranked, incidents))


def propagated(incidents: DataFrame, scores: DataFrame, reach: DataFrame, theta: float = 3.0) -> DataFrame:
    """Anomalous services by their score and what reaches them through the call graph."""
    seeds = scores.select("incident_id", "service_id", F.col("max_z").alias("score"))
    rows = propagation_scores(seeds, reach).filter(F.col("score") > theta).select("incident_id", "service_id", F.col("propagated").alias("score"))
    return _output("SIEVE", incidents, _ranked(rows, [F.desc("score"), F.col("service_id")]), "NO_ANOMALY")


def probing(name: str, incidents: DataFrame, posterior: DataFrame, costs: DataFrame, selected: DataFrame) -> DataFrame:
    """Services by initial belief, with the time the selected probes take; none selected abstains."""
    selected = selected.filter("service_id is not null")
    spent = selected.join(costs.select("incident_id", "service_id", "seconds"), ["incident_id", "service_id"]).groupBy("incident_id").agg(F.sum("seconds").alias("total_ed_s"))
    rows = posterior.join(selected.select("incident_id").distinct(), "incident_id", "left_semi").select("incident_id", "service_id", F.col("p").alias("score"))
    return _output(name, incidents, _ranked(rows, [F.desc("score"), F.col("service_id")]), "NO_SELECTION", None, spent)


def oracle(incidents: DataFrame, truth: DataFrame, services: DataFrame) -> DataFrame:
    """The true service with score 1, then the others with 0. ``truth``: incident_id, root."""
    rows = truth.join(services, "incident_id").select("incident_id", "service_id", F.when(F.col("service_id") == F.col("root"), 1.0).otherwise(0.0).alias("score"))
    return _output("ORACLE", incidents, _ranked(rows, [F.desc("score"), F.col("service_id")]), "NO_TRUTH")


def unavailable(incidents: DataFrame, name: str = "SAGE_CHAOS") -> DataFrame:
    """A method that is not available always abstains."""
    none = incidents.select("incident_id").limit(0).withColumn("top_candidates", F.lit(None).cast("array<struct<service:string,score:double>>"))
    return _output(name, incidents, none, "NOT_IMPLEMENTED")


def earliest_alert(incidents: DataFrame, dev: DataFrame, theta: float = 3.0) -> DataFrame:
    """Services by the time they first went over the threshold, persistent or not."""
    first = dev.filter(F.col("z") > theta).groupBy("incident_id", "service_id").agg(F.min("t_start_ms").alias("_t"))
    rows = first.select("incident_id", "service_id", (-F.col("_t")).cast("double").alias("score"))
    return _output("THRESHOLD", incidents, _ranked(rows, [F.desc("score"), F.col("service_id")]), "NO_ANOMALY")


def ochiai(events: DataFrame) -> DataFrame:
    """Ochiai suspiciousness of each service: n_af / sqrt(n_f (n_af + n_as)). ``events``: service_id, anomalous, failed."""
    rows = events.groupBy("service_id").agg(F.count_if(F.col("anomalous") & F.col("failed")).alias("n_af"), F.count_if(F.col("anomalous") & ~F.col("failed")).alias("n_as"), F.count_if("failed").alias("n_f"))
    below = F.sqrt(F.col("n_f") * (F.col("n_af") + F.col("n_as")).cast("double"))
    return rows.withColumn("score", F.coalesce(F.col("n_af") / F.when(below > 0, below), F.lit(0.0)))


#: Trees of an isolation forest, rows of each, and rows of the sample they are drawn from.
TREES, TREE_ROWS, FOREST_ROWS = 100, 256, 20_000


class IsolationForest:
    """Random splits that set a row apart: the fewer a row needs, the more isolated it is."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.deepest = max(1, int(np.ceil(np.log2(max(self.rows, 2)))))
        # A tree is arrays of (feature, cut, left child, length): a leaf has feature -1 and its mean path length.
        self.trees = [self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees)] if len(x) else []

    @staticmethod
    def mean_length(n: int) -> float:
        """Mean length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, child, length = [], [], [], []
        open_ = [(x, 0)]
        at = 0
        while at < len(open_):
            part, depth = open_[at]
            at += 1
            spread = np.ptp(part, axis=0) if len(part) else np.zeros(x.shape[1])
            usable = np.flatnonzero(spread > 0)
            if depth >= self.deepest or len(part) < 2 or not len(usable):
                feature.append(-1)
                cut.append(0.0)
                child.append(-1)
                length.append(depth + self.mean_length(len(part)))
                continue
            f = int(rng.choice(usable))
            c = rng.uniform(part[:, f].min(), part[:, f].max())
            feature.append(f)
            cut.append(c)
            child.append(len(open_))
            length.append(0.0)
            open_ += [(part[part[:, f] <= c], depth + 1), (part[part[:, f] > c], depth + 1)]
        return np.array(feature), np.array(cut), np.array(child), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^-(mean length / expected length): near 1 for isolated rows, under 0.5 for ordinary ones."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, child, length in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.deepest):
                inner = feature[node] >= 0
                f = np.where(inner, feature[node], 0)
                node = np.where(inner, child[node] + (x[np.arange(len(x)), f] > cut[node]), node)
            total += length[node]
        return 2.0 ** -(total / len(self.trees) / max(self.mean_length(self.rows), 1e-9))


def isolation_forest(incidents: DataFrame, aligned: DataFrame, metrics: list[str]) -> DataFrame:
    """Services of each incident by their most isolated window.

    A window is the deviations of its metrics from the baseline of their source, within [-10, 10], 0
    where there is none. The forest is fitted on at most ``FOREST_ROWS`` windows of the first halves,
    drawn by hash; every window is scored.
    """
    z = aligned.join(first_half_baseline(aligned).select("incident_id", "service_id", "metric_name", "mean", "std"), ["incident_id", "service_id", "metric_name"], "left")
    off = (F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))
    z = z.select("incident_id", "service_id", "window_id", "metric_name", F.least(F.greatest(off, F.lit(-10.0)), F.lit(10.0)).alias("z"))
    cells = [F.coalesce(F.max(F.when(F.col("metric_name") == m, F.col("z"))), F.lit(0.0)).alias(m) for m in metrics]
    rows = cut_lineage(z.groupBy("incident_id", "service_id", "window_id").agg(*cells))
    half = rows.groupBy("incident_id").agg((F.max("window_id") / 2).alias("_half"))
    drawn = rows.join(half, "incident_id").filter(F.col("window_id") < F.col("_half"))
    drawn = drawn.orderBy(F.xxhash64("incident_id", "service_id", "window_id"), "service_id").limit(FOREST_ROWS).select(*metrics).toPandas()
    shared = rows.sparkSession.sparkContext.broadcast(IsolationForest(drawn.to_numpy(float)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["incident_id", "service_id"]].assign(score=shared.value.score(pdf[metrics].to_numpy(float)))

    scored = rows.mapInPandas(score, "incident_id bigint, service_id string, score double").groupBy("incident_id", "service_id").agg(F.max("score").alias("score"))
    return _output("ISOLATION", incidents, _ranked(scored, [F.desc("score"), F.col("service_id")]), "NO_DATA")


def page_rank(edges: DataFrame, weights: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """Personalized PageRank against the direction of calls, restarting at anomalous services.

    ``edges``: src, dst; ``weights``: service_id, weight. Services without a way out restart. Rounds
    go on until all scores together change by no more than ``tolerance``; the error is then at most
    ``tolerance`` * damping / (1 - damping).
    """
    total = weights.agg(F.sum("weight").alias("_t"))
    base = weights.crossJoin(F.broadcast(total)).select("service_id", F.when(F.col("_t") > 0, F.col("weight") / F.col("_t")).otherwise(0.0).alias("base"))
    base = cut_lineage(base)
    back = edges.select(F.col("dst").alias("service_id"), F.col("src").alias("_to")).distinct()
    degree = back.groupBy("service_id").agg(F.count(F.lit(1)).alias("_deg"))
    back = cut_lineage(back.join(degree, "service_id"))
    ends = cut_lineage(base.select("service_id").join(back.select("service_id").distinct(), "service_id", "left_anti").withColumn("_end", F.lit(True)))
    rank = base.select("service_id", "base", F.col("base").alias("score"))
    for _ in range(rounds):
        shared = rank.join(back, "service_id").groupBy(F.col("_to").alias("service_id")).agg(F.sum(F.col("score") / F.col("_deg")).alias("_in"))
        lost = rank.join(ends, "service_id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("_lost"))
        new = (1 - damping) * F.col("base") + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") * F.col("base"))
        rows = rank.join(shared, "service_id", "left").crossJoin(F.broadcast(lost))
        rank = cut_lineage(rows.select("service_id", "base", new.alias("score"), F.abs(new - F.col("score")).alias("_change")))
        if (rank.agg(F.sum("_change")).first()[0] or 0.0) <= tolerance:
            break
        rank = rank.drop("_change")
    return rank.select("service_id", "score")
