"""Cost of probing candidates, greedy selection under a budget, and belief updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds a probe of each kind takes; others take 30.
PROBE_SECONDS = {"LATENCY": 30.0, "PACKET_LOSS": 30.0, "ERROR_RATE": 20.0, "RESOURCE": 60.0}
WEIGHT, DEFAULT_IMPACT, DEFAULT_ROLLBACK = 0.25, 0.01, 0.1


def entropy(weights: DataFrame, key: list[str], column: str = "p") -> DataFrame:
    """Shannon entropy in nats of the normalized positive weights of each key; 0 without any."""
    total = F.sum(column).over(Window.partitionBy(*key))
    share = F.when(total > 0, F.col(column) / F.when(total > 0, total))
    return weights.withColumn("_p", share).groupBy(*key).agg(F.coalesce(-F.sum(F.when(F.col("_p") > 1e-12, F.col("_p") * F.ln(F.when(F.col("_p") > 1e-12, F.col("_p"))))), F.lit(0.0)).alias("entropy"))


def initial_posterior(scores: DataFrame, key: list[str], floor: float = 0.0) -> DataFrame:
    """Scores divided by their sum; all 0 where the sum is 0. ``floor`` lifts each score first."""
    s = F.greatest(F.col("score"), F.lit(floor))
    total = F.sum(s).over(Window.partitionBy(*key))
    return scores.withColumn("p", F.when(total > 0, s / F.when(total > 0, total)).otherwise(0.0))


def probe_costs(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Cost factors, utility and authorization of each candidate.

    ``candidates``: key, service_id, kind, p, blast_radius and optionally impact and
    rollback_cost (NULL takes the default). The expected gain is entropy x p, at most ln of the
    candidates, relative to that maximum.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = candidates.join(entropy(candidates, key), key)
    top = F.when(n > 1, F.ln(n.cast("double")))
    gain = F.coalesce(F.least(F.greatest(F.col("entropy") * F.col("p"), F.lit(0.0)), top) / top, F.lit(0.0))
    seconds = F.coalesce(*(F.when(F.upper("kind") == k, F.lit(v)) for k, v in PROBE_SECONDS.items()), F.lit(30.0))
    rows = rows.withColumn("impact", F.coalesce("impact", F.lit(DEFAULT_IMPACT))).withColumn("rollback_cost", F.coalesce("rollback_cost", F.lit(DEFAULT_ROLLBACK))).withColumn("eig", gain).withColumn("seconds", seconds)
    rows = rows.withColumn("confidence", 1.0 - 0.5 * F.col("blast_radius") - 0.5 * F.col("impact"))
    cost = WEIGHT * (F.col("blast_radius") + F.col("impact") + F.col("rollback_cost") + (1.0 - F.col("confidence")))
    rows = rows.withColumn("cost", cost).withColumn("utility", F.col("eig") / (1.0 + F.col("cost")))
    return rows.withColumn("authorization", authorization(F.col("blast_radius"), F.col("impact"), F.col("confidence")))


def authorization(blast: Column, impact: Column, confidence: Column) -> Column:
    """AUTONOMOUS for small blast and impact, DENIED for low confidence, else SUPERVISED."""
    return F.when((blast < 0.1) & (impact < 0.01), "AUTONOMOUS").when(confidence < 0.3, "DENIED").otherwise("SUPERVISED")


def expected_entropy_after(costs: DataFrame, key: list[str]) -> DataFrame:
    """Entropy that is expected to be left after probing each candidate, in closed form.

    The candidate's share p grows by s (1 - p) with s = 0.3 of its relative gain, the others shrink by
    the factor 1 - s p, and all are normalized. Sums over a key replace a pass over its candidates.
    """
    part = Window.partitionBy(*key)
    total = F.sum("p").over(part)
    rows = costs.withColumn("_p", F.when(total > 0, F.col("p") / F.when(total > 0, total)).otherwise(0.0))
    plogp = F.when(F.col("_p") > 1e-12, F.col("_p") * F.ln(F.when(F.col("_p") > 1e-12, F.col("_p")))).otherwise(0.0)
    rows = rows.withColumn("_plogp", plogp).withColumn("_all", F.sum("_plogp").over(part)).withColumn("_s", 0.3 * F.col("eig"))
    rows = rows.withColumn("_x", F.least(F.lit(1.0), F.col("_p") + F.col("_s") * (1 - F.col("_p")))).withColumn("_c", 1 - F.col("_s") * F.col("_p"))
    rows = rows.withColumn("_t", F.col("_x") + F.col("_c") * (1 - F.col("_p")))
    own = F.when(F.col("_x") > 0, F.col("_x") / F.col("_t") * F.ln(F.when(F.col("_x") > 0, F.col("_x") / F.col("_t")))).otherwise(0.0)
    rest = F.col("_c") / F.col("_t") * (F.col("_all") - F.col("_plogp") + (1 - F.col("_p")) * F.ln(F.col("_c") / F.col("_t")))
    after = F.when(F.sum("_p").over(part) > 0, -own - rest).otherwise(0.0)
    return rows.select(*key, "service_id", F.greatest(after, F.lit(0.0)).alias("entropy_after"))


def _entropy_of(p: np.ndarray) -> float:
    total = p.sum()
    q = p / total if total > 0 else np.zeros(0)
    q = q[q > 1e-12]
    return float(-(q * np.log(q)).sum())


def _choose(theta: float, budget: float, p: np.ndarray, gain: np.ndarray, seconds: np.ndarray, denied: np.ndarray) -> tuple[list[tuple], str]:
    """Places chosen in the given order, each with its step, the time left and the entropy after it; and why it ended."""
    p = p / p.sum() if p.sum() > 0 else p
    eligible = ~denied & (seconds <= budget)
    left, out, h = budget, [], _entropy_of(p)
    if not eligible.any():
        return [(None, 0, left, h)], "NO_ELIGIBLE"
    for i in np.flatnonzero(eligible):
        if h < theta:
            break
        if seconds[i] > left:
            continue
        left -= seconds[i]
        sharpening, p_x = min(0.4, gain[i]), p[i]
        new = p * max(0.0, 1 - sharpening * p_x)
        new[i] = min(1.0, p_x + sharpening * (1 - p_x))
        p = new / new.sum() if new.sum() > 0 else new
        h = _entropy_of(p)
        out.append((i, len(out) + 1, left, h))
    reason = "ENTROPY_CONVERGED" if h < theta else "BUDGET_EXHAUSTED" if out else "NO_ELIGIBLE"
    return out or [(None, 0, left, h)], reason


def _selection(costs: DataFrame, key: list[str], theta: float, budget: float, order: list[Column]) -> DataFrame:
    """Choices of each key, whose candidates come as arrays in ``order``; many keys in a batch."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                chosen, reason = _choose(theta, budget, *(np.asarray(getattr(r, c), float) for c in ("ps", "gains", "times")), np.asarray(r.denied, bool))
                own = tuple(getattr(r, k) for k in key)
                rows += [(*own, None if i is None else r.services[i], step, left, h, reason) for i, step, left, h in chosen]
            yield pd.DataFrame(rows, columns=[*key, "service_id", "step", "budget_left", "entropy_after", "stop_reason"])

    places = [c.alias(f"_{i}") for i, c in enumerate(order)]
    one = F.struct(*places, "service_id", "p", F.col("eig").alias("gain"), "seconds", (F.col("authorization") == "DENIED").alias("denied"))
    held = costs.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("c"))
    parts = {"services": "service_id", "ps": "p", "gains": "gain", "times": "seconds", "denied": "denied"}
    held = held.select(*key, *(F.col(f"c.{field}").alias(name) for name, field in parts.items()))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in costs.schema if f.name in key)
    return held.mapInPandas(fold, f"{kinds}, service_id string, step int, budget_left double, entropy_after double, stop_reason string")


def greedy_selection(costs: DataFrame, key: list[str], *, theta: float = 0.5, budget: float = 600.0) -> DataFrame:
    """Candidates chosen in order of utility while the entropy is at least ``theta`` and time is left.

    A probe moves its service's share p to p + s (1 - p) with s its relative gain, at most 0.4, the
    others to p_i (1 - s p), and all are normalized. Utilities stay fixed, so the order does; a
    candidate too long for what is left is skipped. Each row has the reason why the key's selection
    ended (ENTROPY_CONVERGED, BUDGET_EXHAUSTED, NO_ELIGIBLE); a key of which nothing is chosen has one
    row of step 0 without a service. A key holds the candidates of one incident, which are bounded by
    its services.
    """
    return _selection(costs, key, theta, budget, [-F.col("utility"), F.col("service_id")])


def random_selection(costs: DataFrame, key: list[str], *, seed: int = 42, theta: float = 0.5, budget: float = 600.0) -> DataFrame:
    """Like :func:`greedy_selection` in the order of a digest instead of utility."""
    drawn = costs.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), *key, "service_id")))
    return _selection(drawn, key, theta, budget, [F.col("_draw")])


def distinct_services(selected: DataFrame, key: list[str]) -> DataFrame:
    """Whether a selection names each service once."""
    return selected.filter("service_id is not null").groupBy(*key).agg((F.count(F.lit(1)) == F.countDistinct("service_id")).alias("all_distinct"), F.count(F.lit(1)).alias("n_selected"))


def update_posterior(prior: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Beliefs after all evidence of a key in one pass.

    ``prior``: key, service_id, p; ``evidence``: key, target, c. Each piece multiplies by 3c^2 for
    its target and 3(1-c)^2 for others (c within 1e-6 of 0 and 1, likelihood at least 1e-12), so
    the product is a sum of logarithms and one normalization suffices. A key without evidence
    keeps its prior.
    """
    c = F.least(F.greatest(F.col("c"), F.lit(1e-6)), F.lit(1 - 1e-6))
    facts = evidence.select(*key, "target", F.ln(F.greatest(3 * c * c, F.lit(1e-12))).alias("_hit"), F.ln(F.greatest(3 * (1 - c) * (1 - c), F.lit(1e-12))).alias("_miss"))
    every = facts.groupBy(*key).agg(F.sum("_miss").alias("_all"))
    own = facts.groupBy(*key, F.col("target").alias("service_id")).agg(F.sum(F.col("_hit") - F.col("_miss")).alias("_own"))
    rows = prior.join(every, key, "left").join(own, [*key, "service_id"], "left")
    log = F.ln(F.greatest(F.col("p"), F.lit(1e-300))) + F.coalesce("_all", F.lit(0.0)) + F.coalesce("_own", F.lit(0.0))
    rows = rows.withColumn("_log", F.when(F.col("p") > 0, log))
    part = Window.partitionBy(*key)
    rows = rows.withColumn("_w", F.coalesce(F.exp(F.col("_log") - F.max("_log").over(part)), F.lit(0.0)))
    total = F.sum("_w").over(part)
    return rows.select(*key, "service_id", F.when(total > 0, F.col("_w") / F.when(total > 0, total)).otherwise(0.0).alias("p"))


def update_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Confidence of edges after all evidence of each run, piece by piece in order of ``seq``.

    ``edges``: run_id, src, dst, confidence (NULL counts as 0.5); ``evidence``: run_id, source,
    target, exceeds and optionally seq (else pieces go by source, target). An edge that exceeds grows
    by a fifth and its rivals into the same target shrink by a tenth; one that does not shrinks by a
    tenth; all stay within [0.05, 0.95] after each piece. An edge that is not known yet is created by
    the first evidence on it. A run's pieces are bounded by its probes.
    """
    known = edges.select("run_id", "src", "dst", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    new = evidence.select("run_id", F.col("source").alias("src"), F.col("target").alias("dst")).filter("src is not null and dst is not null").distinct()
    known = known.unionByName(new.join(known, ["run_id", "src", "dst"], "left_anti").withColumn("confidence", F.lit(None).cast("double")))
    seq = F.col("seq") if "seq" in evidence.columns else F.lit(0)
    into = evidence.groupBy("run_id", F.col("target").alias("dst")).agg(F.array_sort(F.collect_list(F.struct(seq.alias("seq"), "source", "exceeds"))).alias("_e"))

    def step(c: Column, e: Column) -> Column:
        mine = e["source"] == F.col("src")
        now = F.when(mine, F.coalesce(c, F.lit(0.5))).otherwise(c)
        grown = F.when(mine & e["exceeds"], now * 1.2).when(mine | e["exceeds"], now * 0.9).otherwise(now)
        return F.when(now.isNotNull(), F.least(F.greatest(grown, F.lit(0.05)), F.lit(0.95)))

    rows = known.join(into, ["run_id", "dst"], "left")
    folded = F.aggregate(F.coalesce("_e", F.array().cast(into.schema["_e"].dataType)), F.col("confidence"), step)
    return rows.select("run_id", "src", "dst", F.least(F.greatest(folded, F.lit(0.05)), F.lit(0.95)).alias("confidence"))


def update_structure(edges: DataFrame, evidence: DataFrame, reach: DataFrame, remove_under: float = 0.3) -> DataFrame:
    """Edges after adding exceeding pairs that no path joins and dropping weak ones without support."""
    gone = evidence.filter("not exceeds").select("run_id", F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(True).alias("_gone"))
    kept = edges.join(gone, ["run_id", "src", "dst"], "left").filter(F.col("_gone").isNull() | (F.coalesce("confidence", F.lit(0.5)) >= remove_under)).select("run_id", "src", "dst", "confidence")
    new = evidence.filter("exceeds and source <> target").select("run_id", F.col("source").alias("src"), F.col("target").alias("dst")).distinct().join(reach.select("run_id", "src", "dst"), ["run_id", "src", "dst"], "left_anti")
    return kept.unionByName(new.withColumn("confidence", F.lit(0.5)))


def stopping_reason(budget_left: Column, abort: Column, mass: Column, h: Column, n_positive: Column, theta: float = 0.5) -> Column:
    """First reason to stop: budget, abort, no belief left, certainty; NULL to go on."""
    return F.when(budget_left <= 0, "BUDGET_EXHAUSTED").when(abort, "ABORT").when(mass <= 0, "NO_CANDIDATES").when((h < theta) & (n_positive >= 2), "ENTROPY_CONVERGED")
