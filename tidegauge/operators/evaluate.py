"""Evaluation: attribution metrics, run times, paired tests, corrections and report tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.special import binomial_sf, normal_cdf, normal_quantile, signed_rank_sf, t_sf
from tidegauge.plans.runtime import running_totals


def _share(cond, of=None):
    n = F.count_if(of) if of is not None else F.count(F.lit(1))
    hits = F.count_if(cond & of) if of is not None else F.count_if(cond)
    return F.when(n > 0, hits / F.when(n > 0, n)).otherwise(0.0)


def precision_at(results: DataFrame, k: int) -> DataFrame:
    """Whether the true service is among the first k candidates; an abstention is not."""
    hit = F.array_contains(F.transform(F.slice("top_candidates", 1, k), lambda c: c["service"]), F.col("truth"))
    return results.withColumn(f"hit_{k}", F.coalesce(hit, F.lit(False)) & ~F.col("abstained"))


def attribution_metrics(results: DataFrame) -> DataFrame:
    """Accuracy, coverage and abstention of each method.

    ``results``: method, fault_id, truth, confounded, not_identifiable, top_candidates
    (service, score), abstained, latency_s, total_ed_s. Empty denominators give 0.
    """
    rows = precision_at(precision_at(results, 1), 3)
    hard = F.col("confounded") | F.col("not_identifiable")
    made = ~F.col("abstained")
    return rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"),
        _share(F.col("hit_1")).alias("raw_p1"),
        _share(F.col("hit_3")).alias("raw_p3"),
        _share(F.col("hit_1"), made).alias("conditional_p1"),
        _share(made).alias("coverage"),
        _share(F.col("abstained")).alias("abstention_rate"),
        _share(made & ~F.col("hit_1")).alias("false_rate"),
        _share(F.col("abstained"), hard).alias("correct_abstention"),
        F.avg(F.when(made, F.col("latency_s"))).alias("mean_latency_s"),
        F.median(F.when(made, F.col("latency_s"))).alias("median_latency_s"),
        F.sum("total_ed_s").alias("total_ed_s"),
    )


def tier_summary(ranked: DataFrame) -> DataFrame:
    """Counts of confidence tiers and rates of the four rules over ranked divergences."""
    def rate(c: str):
        return F.avg(F.col(c).cast("double"))

    return ranked.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("confidence") == t).alias(f"n_{t.lower()}") for t in ("DEFINITIVE", "CANDIDATE", "NONE")), *(rate(r).alias(f"rate_{r}") for r in ("r2", "r3", "r4")))


def grouped_percentiles(df: DataFrame, key: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """Exact percentiles of each key, interpolated linearly, whatever the size of a key: ``key`` and ``names``.

    NULL and NaN values do not count; a key without others has no row. Keys must not be NULL.
    """
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.groupBy(*key).agg(F.sum("_n").alias("_all"))
    rows = running_totals(counts, key, "_v", ["_n"]).join(whole, key)

    def at(place: Column) -> Column:
        here = (F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(here, F.col("_v")))

    out = []
    for name, q in names.items():
        place = (F.col("_all") - 1) * F.lit(q)
        lo, hi = at(F.floor(place)), at(F.ceil(place))
        out.append((lo + (hi - lo) * F.max(place - F.floor(place))).alias(name))
    return rows.groupBy(*key).agg(*out)


def runtime_metrics(log: DataFrame) -> DataFrame:
    """Pipeline times of each method from its stage log, once for each record_no, and its slowest stage."""
    cols = ["ingested_at", "run_id", "method_id", "stage_name", "wall_time_s", "memory_mb"]
    once = log.filter("record_no is not null").groupBy("record_no").agg(F.max(F.struct(*cols)).alias("r")).select("r.*")
    once = once.unionByName(log.filter("record_no is null").select(*cols))  # rows without a number each count
    once = once.filter("method_id is not null and wall_time_s >= 0 and not isnan(wall_time_s)").withColumn("stage_name", F.lower(F.trim("stage_name")))
    runs = once.groupBy("method_id", "run_id").agg(F.sum("wall_time_s").alias("total_s"), F.max("memory_mb").alias("peak_mb"))
    total = runs.groupBy("method_id").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("total_s").alias("mean_s"), F.max("total_s").alias("max_s"), F.max("peak_mb").alias("max_peak_mb"))
    stages = once.groupBy("method_id", "stage_name").agg(F.avg("wall_time_s").alias("_mean"))
    worst = stages.groupBy("method_id").agg(F.max(F.struct("_mean", "stage_name"))["stage_name"].alias("bottleneck_stage"))
    middle = grouped_percentiles(runs, ["method_id"], "total_s", {"median_s": 0.5, "p95_s": 0.95})
    out = total.join(middle, "method_id").join(worst, "method_id")
    return out.select("method_id", "n_runs", "mean_s", "median_s", "p95_s", "max_s", "max_peak_mb", "bottleneck_stage")


def cost_metrics(results: DataFrame, budget: float = 600.0) -> DataFrame:
    """Time spent on probing by each method."""
    return results.groupBy("method").agg(F.avg("total_ed_s").alias("mean_ed_s"), F.median("total_ed_s").alias("median_ed_s"), F.sum("total_ed_s").alias("sum_ed_s"), F.max("total_ed_s").alias("max_ed_s"), (F.avg("total_ed_s") / budget).alias("mean_budget_share"))


def bootstrap_mean(scores: DataFrame, key: list[str], replicates: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over resamples. ``scores``: key, idx, score.

    A worker holds the scores of one key, 8 bytes each; the replicates of a large key are spread over tasks.
    """
    from tidegauge.operators.diverge import draws, percentile_interval, replicate_blocks, spread

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.xs)
                means = [x[(draws(seed, reps, len(x)) % np.uint64(len(x))).astype(np.int64)].mean(axis=1) for reps in replicate_blocks(replicates, len(x), r.part, r.parts)]
                out.append((*(getattr(r, k) for k in key), np.concatenate(means)))
            yield pd.DataFrame(out, columns=[*key, "_w"])

    held = scores.filter("score is not null").groupBy(*key).agg(F.sort_array(F.collect_list(F.col("score").cast("double"))).alias("xs"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema if f.name in key)
    parts = spread(held, replicates, F.size("xs")).mapInPandas(resample, f"{kinds}, _w array<double>")
    return percentile_interval(parts, key, level, "low", "high")


def cliffs_delta(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Cliff's delta of x over y from ranks: one sort, no pairing of all with all.

    ``pairs``: key, x, y. Magnitude by the usual bounds .147, .33, .474.
    """
    both = pairs.select(*key, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("x").alias("v")), F.struct(F.lit(0).alias("side"), F.col("y").alias("v")))).alias("s")).select(*key, "s.*").filter("v is not null")
    ties = both.groupBy(*key, "v").agg(F.sum("side").alias("_nx"), F.count(F.lit(1)).alias("_n")).withColumn("_ny", F.col("_n") - F.col("_nx"))
    ranked = running_totals(ties, key, "v", ["_ny"]).withColumnRenamed("_ny_before", "_below")
    more = F.sum(F.col("_nx") * F.col("_below"))
    equal = F.sum(F.col("_nx") * (F.col("_n") - F.col("_nx")))
    nx, ny = F.sum("_nx"), F.sum(F.col("_n") - F.col("_nx"))
    out = ranked.groupBy(*key).agg(((2 * more + equal) / (nx * ny) - 1).alias("delta"), nx.alias("n_x"), ny.alias("n_y"))
    size = F.abs("delta")
    return out.withColumn("magnitude", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large"))


def signed_ranks(pairs: DataFrame, key: list[str]) -> DataFrame:
    """W+ of the one-sided signed-rank test with average ranks; zero differences are dropped.

    Also the normal approximation's z with tie correction and continuity.
    """
    d = pairs.select(*key, (F.col("x") - F.col("y")).alias("_d")).filter("_d is not null and _d <> 0")
    ties = d.groupBy(*key, F.abs("_d").alias("_a")).agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("_d") > 0).alias("_pos"))
    rows = running_totals(ties, key, "_a", ["_t"]).withColumn("_rank", F.col("_t_before") + (F.col("_t") + 1) / 2)
    out = rows.groupBy(*key).agg(F.sum("_t").alias("n"), F.sum(F.col("_rank") * F.col("_pos")).alias("w_plus"), F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    mean = F.col("n") * (F.col("n") + 1) / 4
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("_ties") / 48
    return out.select(*key, "n", "w_plus", F.when(var > 0, (F.col("w_plus") - mean - 0.5) / F.sqrt(F.when(var > 0, var))).alias("z"), (F.col("_ties") > 0).alias("tied"))


def wilcoxon_greater(w_plus: float, n: int, z: float | None, tied: bool) -> float:
    """p-value of x > y: exact for up to 50 untied differences, else normal; 0.5 without any."""
    if not n:
        return 0.5
    return signed_rank_sf(w_plus, n) if n <= 50 and not tied else 1.0 - normal_cdf(z or 0.0)


def equivalence(mean: float, sd: float, n: int, margin: float) -> float:
    """p-value of two one-sided t-tests that the mean difference is within the margin."""
    if sd == 0:
        return 0.0 if abs(mean) < margin else 1.0
    se = sd / n**0.5
    return max(t_sf((mean + margin) / se, n - 1), 1.0 - t_sf((mean - margin) / se, n - 1))


def binomial_greater(k: int, n: int, p0: float = 0.7) -> float:
    return binomial_sf(k, n, p0)


def paired(x: DataFrame, y: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Values of two sides of each key paired by place in order, cut to the shorter side: key, place, x, y."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order, value))
    a = x.select(*key, place.alias("place"), F.col(value).alias("x"))
    return a.join(y.select(*key, place.alias("place"), F.col(value).alias("y")), [*key, "place"])


def _p_column(f, *columns: str):
    """A p-value for each row of a small table of statistics, computed in the worker."""
    return F.pandas_udf(lambda *xs: pd.Series([f(*row) for row in zip(*xs, strict=True)], dtype=float), "double")(*columns)


def wilcoxon_pvalues(ranks: DataFrame) -> DataFrame:
    """``ranks`` of :func:`signed_ranks` with the one-sided p-value ``p``."""

    def p_of(w: float, n: int, z: float, tied: bool) -> float:
        return wilcoxon_greater(w, int(n), None if z is None or z != z else z, bool(tied))

    return ranks.withColumn("p", _p_column(p_of, "w_plus", "n", "z", "tied"))


def binomial_pvalues(counts: DataFrame, p0: float = 0.7) -> DataFrame:
    """``counts`` (k successes of n) with P(X >= k) as ``p``."""
    return counts.withColumn("p", _p_column(lambda k, n: binomial_greater(int(k), int(n), p0), "k", "n"))


def equivalence_tests(pairs: DataFrame, key: list[str], margin: float) -> DataFrame:
    """Two one-sided tests of the mean difference of x and y against a margin; ``equivalent`` under 0.05."""
    d = pairs.select(*key, (F.col("x") - F.col("y")).alias("d")).filter("d is not null and not isnan(d)")
    s = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd")).filter("n >= 2")
    p = _p_column(lambda m, sd, n: equivalence(m, sd, int(n), margin), "mean", "sd", "n")
    return s.withColumn("p", p).withColumn("equivalent", F.col("p") < 0.05)


def cliffs_interval(pairs: DataFrame, key: list[str], replicates: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of Cliff's delta over resamples of both sides, each drawn for itself.

    A worker holds the values of one key, 8 bytes each; the replicates of a large key are spread over tasks.
    """
    from tidegauge.operators.diverge import draws, percentile_interval, replicate_blocks, spread

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x, y = np.asarray(r.xs), np.asarray(r.ys)
                under, upto = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
                deltas = []
                for reps in replicate_blocks(replicates, len(x) + len(y), r.part, r.parts):
                    i = (draws(seed + 1, reps, len(x)) % np.uint64(len(x))).astype(np.int64)
                    j = (draws(seed + 2, reps, len(y)) % np.uint64(len(y))).astype(np.int64)
                    for a, b in zip(i, j, strict=True):
                        # How many of the drawn y lie under and not over each x, from how often each y was drawn.
                        c = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=len(y)))])
                        deltas.append(float((c[under[a]] - (len(y) - c[upto[a]])).sum()) / (len(x) * len(y)))
                out.append((*(getattr(r, k) for k in key), np.array(deltas)))
            yield pd.DataFrame(out, columns=[*key, "_w"])

    sides = [F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.col(c).cast("double")))).alias(n) for c, n in (("x", "xs"), ("y", "ys"))]
    held = pairs.groupBy(*key).agg(*sides).filter("size(xs) > 0 and size(ys) > 0")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema if f.name in key)
    parts = spread(held, replicates, F.size("xs") + F.size("ys")).mapInPandas(resample, f"{kinds}, _w array<double>")
    return percentile_interval(parts, key, level, "low", "high")


def holm(pvalues: DataFrame, family: list[str], alpha: float = 0.05) -> DataFrame:
    """Threshold alpha / (m - rank + 1) of each p-value of a family."""
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    rank = F.row_number().over(Window.partitionBy(*family).orderBy("p", "hypothesis"))
    return pvalues.withColumn("threshold", alpha / (m - rank + 1)).withColumn("rejected", F.col("p") <= F.col("threshold"))


def benjamini_hochberg(pvalues: DataFrame, family: list[str]) -> DataFrame:
    """Adjusted p-values of a family: running minimum of m p / rank from the largest down, at most 1."""
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    rows = pvalues.withColumn("_rank", F.row_number().over(Window.partitionBy(*family).orderBy("p", "hypothesis"))).withColumn("_m", m)
    down = Window.partitionBy(*family).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col("p") * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def power_of(n: int, effect: float = 0.3, alpha: float = 0.05) -> float:
    """Power of the signed-rank test by its normal approximation."""
    return normal_cdf(effect * (3 * n) ** 0.5 - normal_quantile(1 - alpha))


def required_n(effect: float = 0.3, alpha: float = 0.05, power: float = 0.8) -> int:
    """Least n with the wanted power."""
    n = 1
    while power_of(n, effect, alpha) < power:
        n += 1
    return n


def type_by_split(scenarios: DataFrame) -> DataFrame:
    """Scenarios by fault type and split, with a TOTAL row; each fault_id counts once."""
    from tidegauge.functions import norm_label

    rows = scenarios.select("fault_id", norm_label("fault_type").alias("fault_type"), norm_label("split").alias("split")).distinct().filter("fault_type is not null")
    counts = [F.count_if(F.col("split") == s).alias(s.lower()) for s in ("DEVELOPMENT", "VALIDATION", "HELD_OUT_TEST")]
    return rows.rollup("fault_type").agg(*counts, F.count(F.lit(1)).alias("total")).withColumn("fault_type", F.coalesce("fault_type", F.lit("TOTAL")))


def latency_cdf(results: DataFrame) -> DataFrame:
    """Cumulative share of the latencies of each method, one row for each value."""
    rows = results.filter("not abstained and latency_s is not null").groupBy("method", "latency_s").agg(F.count(F.lit(1)).alias("_n"))
    whole = rows.groupBy("method").agg(F.sum("_n").alias("_all"))
    upto = running_totals(rows, ["method"], "latency_s", ["_n"]).join(F.broadcast(whole), "method")  # one row a method
    return upto.select("method", "latency_s", ((F.col("_n_before") + F.col("_n")) / F.col("_all")).alias("share"))


def repeatability(runs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Spread of a measure over repeated runs."""
    v = F.col(value)
    rows = runs.filter(v.isNotNull() & ~F.isnan(v))
    spread = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    quarters = grouped_percentiles(rows, key, value, {"_q1": 0.25, "median": 0.5, "_q3": 0.75})
    return spread.join(quarters, key).select(*key, "n", "mean", "median", "sd", (F.col("_q3") - F.col("_q1")).alias("iqr"))


def report_rows(methods: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    """A text cell with three decimals for each method and column; PENDING without results, --- without a value."""
    rows = methods.select("method").join(metrics.withColumn("_has", F.lit(True)), "method", "left")
    return rows.select("method", *(F.when(F.col("_has").isNull(), "PENDING").when(F.col(c).isNull(), "---").otherwise(F.format_string("%.3f", F.col(c).cast("double"))).alias(c) for c in columns))
