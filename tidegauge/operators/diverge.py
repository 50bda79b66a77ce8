"""How far two samples differ: Wasserstein distance, total variation, resampled inference."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05


def wasserstein(samples: DataFrame, key: list[str]) -> DataFrame:
    """W1 between the sides ``base`` and ``post`` of each key, as the area between their CDFs.

    Holds for any sample sizes. A key that lacks a side has no row. ``samples``: key, side, value.
    """
    rows = samples.filter("value is not null and not isnan(value)").groupBy(*key, "value").agg(F.count_if(F.col("side") == "base").alias("_a"), F.count_if(F.col("side") == "post").alias("_b"))
    order = Window.partitionBy(*key).orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    rows = rows.select(*key, "value", F.lead("value").over(order).alias("_next"), F.sum("_a").over(upto).alias("_ca"), F.sum("_b").over(upto).alias("_cb"), F.sum("_a").over(whole).alias("n_base"), F.sum("_b").over(whole).alias("n_post"))
    rows = rows.filter("n_base > 0 and n_post > 0")
    gap = F.abs(F.col("_ca") / F.col("n_base") - F.col("_cb") / F.col("n_post")) * (F.col("_next") - F.col("value"))
    return rows.groupBy(*key, "n_base", "n_post").agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("w1"))


def total_variation(samples: DataFrame, key: list[str], bins: int = 100) -> DataFrame:
    """Half the distance between the histograms of both sides over their common range."""
    rows = samples.filter("value is not null and not isnan(value)")
    ends = rows.groupBy(*key).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count_if(F.col("side") == "base").alias("_na"), F.count_if(F.col("side") == "post").alias("_nb")).filter("_na > 0 and _nb > 0")
    spread = F.col("_hi") - F.col("_lo")
    cell = F.when(spread > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / F.when(spread > 0, spread) * bins), F.lit(bins - 1))).otherwise(0)
    shares = rows.join(ends, key).groupBy(*key, cell.alias("_bin")).agg(F.abs(F.count_if(F.col("side") == "base") / F.max("_na") - F.count_if(F.col("side") == "post") / F.max("_nb")).alias("_d"))
    return shares.groupBy(*key).agg((F.sum("_d") / 2).alias("tv"))


def iqr_threshold(samples: DataFrame, key: list[str], part: float = 0.1) -> DataFrame:
    """A tenth of the interquartile range of the base side."""
    base = samples.filter("side = 'base' and value is not null and not isnan(value)")
    return base.groupBy(*key).agg((part * (F.percentile("value", 0.75) - F.percentile("value", 0.25))).alias("theta"))


def grade(n_base: str = "n_base", n_post: str = "n_post"):
    """INSUFFICIENT under 20 of the smaller side, CANDIDATE under 50, else RELIABLE."""
    n = F.least(F.col(n_base), F.col(n_post))
    return F.when(n < 20, "INSUFFICIENT").when(n < 50, "CANDIDATE").otherwise("RELIABLE")


#: Cells of the replicate matrices that a worker holds at once, and tasks that the replicates of a key are spread over at most.
CELLS, TASKS = 1_000_000, 12


_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def draws(seed: int, replicates: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each (replicate, place) that depends on these and the seed only.

    The finalizer of splitmix64 over a linear form, so SQL can draw the same.
    """
    with np.errstate(over="ignore"):
        x = np.uint64(seed) * _ODD[0] + replicates.astype(np.uint64)[:, None] * _ODD[1] + np.arange(n, dtype=np.uint64)[None, :] * _ODD[2]
        x = (x ^ (x >> np.uint64(30))) * _ODD[1]
        x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def replicate_blocks(replicates: int, n: int, part: int = 0, parts: int = 1) -> Iterator[np.ndarray]:
    """Numbers of the replicates of each block of at most ``CELLS`` cells of a part."""
    rows = max(1, CELLS // n)
    for block in range(part, math.ceil(replicates / rows), parts):
        yield np.arange(block * rows, min(replicates, (block + 1) * rows))


def spread(df: DataFrame, replicates: int, size: Column) -> DataFrame:
    """Each row once for each task (part of parts) that takes a share of its replicates."""
    blocks = F.ceil(F.lit(replicates) / F.greatest(F.lit(1), F.floor(F.lit(CELLS) / size)))
    parts = df.withColumn("_size", size).withColumn("parts", F.least(F.lit(TASKS), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Small in bytes and large in work: a fixed number of partitions, which is never coalesced.
    return parts.repartition(tasks, *(c for c in df.columns if c not in ("xs", "ys")), "part").sortWithinPartitions("_size").drop("_size")


def percentile_interval(parts: DataFrame, key: list[str], level: float, low: str, high: str) -> DataFrame:
    """Percentiles of the replicates in the arrays ``_w`` of all parts of a key, interpolated linearly."""
    rows = parts.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("_w"))).alias("_w"))

    def at(q: float) -> Column:
        place = (F.size("_w") - 1) * F.lit(q)
        lo, hi = F.get("_w", F.floor(place).cast("int")), F.get("_w", F.ceil(place).cast("int"))
        return lo + (hi - lo) * (place - F.floor(place))

    return rows.select(*key, at((1 - level) / 2).alias(low), at((1 + level) / 2).alias(high))


def _sides(samples: DataFrame, key: list[str]) -> DataFrame:
    """Sorted values of both sides of each key that has both: 8 bytes a value, held by one worker."""
    rows = samples.filter("value is not null and not isnan(value)")
    both = rows.groupBy(*key).agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("value").cast("double")))).alias(name) for side, name in (("base", "xs"), ("post", "ys"))))
    return both.filter("size(xs) > 0 and size(ys) > 0")


def _kinds(df: DataFrame, key: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in key)


def _area(ca: np.ndarray, cb: np.ndarray, na: int, nb: int, width: np.ndarray) -> np.ndarray:
    """W1 of each row of running counts over sorted values that are ``width`` apart."""
    return np.abs(ca / na - cb / nb) @ width


def permutation_test(samples: DataFrame, key: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """Share of label permutations with at least the observed W1: (hits + 1) / (replicates + 1).

    A worker holds the sorted values of one key and permutes labels in blocks of ``CELLS``; the
    replicates of a large key are spread over tasks. Keys of equal sizes share their permutations.
    """

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, label = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.xs), np.asarray(r.ys)
                na, nb, n = len(a), len(b), len(a) + len(b)
                v = np.concatenate([a, b])
                order = np.argsort(v, kind="stable")
                width = np.diff(v[order])
                upto = np.arange(1, n)
                ca = np.cumsum(order < na)[:-1]
                seen = float(_area(ca, upto - ca, na, nb, width))
                least, hits, drawn = seen - 1e-9 * max(1.0, seen), 0, 0
                whole = r.parts == 1 and replicates * n <= CELLS
                for reps in replicate_blocks(replicates, n, r.part, r.parts):
                    if not whole or last != (na, nb):
                        # The places with the least numbers are labelled base.
                        label = np.zeros((len(reps), n), np.int8)
                        np.put_along_axis(label, np.argpartition(draws(seed, reps, n), na - 1, axis=1)[:, :na], 1, axis=1)
                        last = (na, nb) if whole else None
                    c = np.cumsum(label[:, order[:-1]], axis=1, dtype=np.int32)
                    hits += int((_area(c, upto - c, na, nb, width) >= least).sum())
                    drawn += len(reps)
                out.append((*(getattr(r, k) for k in key), hits, drawn))
            yield pd.DataFrame(out, columns=[*key, "_hits", "_drawn"])

    both = _sides(samples, key)
    parts = spread(both, replicates, F.size("xs") + F.size("ys")).mapInPandas(test, f"{_kinds(both, key)}, _hits bigint, _drawn bigint")
    return parts.groupBy(*key).agg(((F.sum("_hits") + 1) / (F.sum("_drawn") + 1)).alias("p_value"))


def bootstrap_interval(samples: DataFrame, key: list[str], replicates: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of W1 over resamples of both sides, each drawn for itself."""

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def upto(side: int, reps: np.ndarray, n: int) -> np.ndarray:
            # How often the first 0, 1, .. n values of a side were drawn.
            rows = len(reps)
            taken = (draws(seed + side, reps, n) % np.uint64(n)).astype(np.int64) + np.arange(rows)[:, None] * n
            counts = np.bincount(taken.ravel(), minlength=rows * n).reshape(rows, n)
            return np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.xs), np.asarray(r.ys)
                v = np.sort(np.concatenate([a, b]))
                ia, ib = np.searchsorted(a, v[:-1], "right"), np.searchsorted(b, v[:-1], "right")
                w = [_area(upto(1, reps, len(a))[:, ia], upto(2, reps, len(b))[:, ib], len(a), len(b), np.diff(v)) for reps in replicate_blocks(replicates, len(v), r.part, r.parts)]
                out.append((*(getattr(r, k) for k in key), np.concatenate(w)))
            yield pd.DataFrame(out, columns=[*key, "_w"])

    both = _sides(samples, key)
    parts = spread(both, replicates, F.size("xs") + F.size("ys")).mapInPandas(resample, f"{_kinds(both, key)}, _w array<double>")
    return percentile_interval(parts, key, level, "w1_low", "w1_high")


def divergence(samples: DataFrame, key: list[str], *, replicates: int = 0, resamples: int | None = None, seed: int = 42) -> DataFrame:
    """W1, threshold, grade and, with ``replicates``, p-value and interval of each key.

    ``replicates`` are permutations; the interval takes ``resamples``, or as many. An INSUFFICIENT key keeps its threshold and has no metric; ``exceeds`` is W1 > threshold.
    """
    rows = wasserstein(samples, key).join(iqr_threshold(samples, key), key).join(total_variation(samples, key), key).withColumn("grade", grade())
    names = ["w1", "tv"]
    if replicates:
        rows = rows.join(permutation_test(samples, key, replicates, seed), key, "left").join(bootstrap_interval(samples, key, resamples or replicates, seed), key, "left")
        names += ["p_value", "w1_low", "w1_high"]
    ok = F.col("grade") != "INSUFFICIENT"
    rows = rows.select(*key, "n_base", "n_post", "grade", "theta", *(F.when(ok, F.col(n)).alias(n) for n in names))
    least = F.least("n_base", "n_post")
    rows = rows.withColumn("exceeds", F.col("w1") > F.col("theta")).withColumn("note", F.when((least >= 20) & (least < 30), "wide interval").when((least >= 30) & (least < 50), "directional only"))
    return rows.withColumn("significant", F.col("p_value") < ALPHA) if replicates else rows


def evaluate_divergence(samples: DataFrame, key: list[str], *, replicates: int = 0, seed: int = 42) -> DataFrame:
    """W1, total variation and threshold without a floor of sample size, for evaluation.

    A key that lacks a side has 0 for both distances, does not exceed and, with ``replicates``, has
    p-value 1 and an interval of 0. ``exceeds`` is W1 > threshold.
    """
    keys = samples.select(*key).distinct()
    rows = keys.join(wasserstein(samples, key), key, "left").join(iqr_threshold(samples, key), key, "left").join(total_variation(samples, key), key, "left")
    zeros = {"n_base": 0, "n_post": 0, "w1": 0.0, "theta": 0.0, "tv": 0.0}
    rows = rows.fillna(zeros).withColumn("exceeds", (F.col("n_base") > 0) & (F.col("w1") > F.col("theta")))
    if replicates:
        rows = rows.join(permutation_test(samples, key, replicates, seed), key, "left").join(bootstrap_interval(samples, key, replicates, seed), key, "left")
        rows = rows.fillna({"p_value": 1.0, "w1_low": 0.0, "w1_high": 0.0})
    return rows


def type_one_rate(tests: DataFrame) -> DataFrame:
    """Share of null trials that reject, and whether it is within three standard errors of alpha."""
    bound = ALPHA + 3 * math.sqrt(ALPHA * (1 - ALPHA))
    out = tests.agg(F.count(F.lit(1)).alias("n_trials"), F.avg((F.col("p_value") < ALPHA).cast("double")).alias("rejection_rate"))
    return out.withColumn("gate", F.when(F.col("rejection_rate") <= ALPHA + (bound - ALPHA) / F.sqrt("n_trials"), "PASS").otherwise("FAIL"))


def monotone(shifts: DataFrame) -> DataFrame:
    """Whether W1 never falls as the shift grows. ``shifts``: case, shift, w1."""
    order = Window.partitionBy("case").orderBy("shift")
    return shifts.withColumn("_up", F.col("w1") >= F.coalesce(F.lag("w1").over(order), F.col("w1"))).groupBy("case").agg(F.every("_up").alias("monotone"), F.count(F.lit(1)).alias("n"))
