"""Mix sources to target shares of a total size, each document repeated at most so often.

Method: iterative proportional fitting. Documents fall into cells of source, language and topic;
the weights of the cells (expected copies of each of their documents) are raked to the token
marginals of source, language and topic until they agree, the source last, so the shares of the
sources hold exactly in expectation. Documents are then sampled with these calibrated weights:
the whole part is certain, the rest is drawn systematically along each source ordered by size.
Large documents are drawn first and the weights of smaller ones recalibrated to what is then left
of the goal, so the drawn tokens end within about one small document of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import norm_label
from tidegauge.llm.tokenize import TOKENIZERS, encode_corpus
from tidegauge.plans.runtime import bounded_broadcast, cut_lineage

#: Share of the tokens from which a topic or language is raked to its own marginal; the smaller ones are raked as
#: one, so a mix has at most 1 / LEAST_SHARE of each whatever the corpus.
LEAST_SHARE = 0.0005
#: Raking ends when no weight changes by more than this part of itself, or after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 500
#: Documents of a sampling bucket on average; a bucket is ordered by one task.
BUCKET_ROWS = 50_000
#: Documents are drawn in strata of falling size, parted at these size classes (512, 256 and 90 tokens).
STRATA = (72, 64, 52)
#: Class of all small topics or languages.
OTHER = "\x00other"
#: Whole units of a fractional copy; sums of integers do not depend on their order.
UNIT = 1_000_000_000


def _sources(c: str):
    return F.lower(norm_label(c))


def mix_targets_of(targets: DataFrame) -> DataFrame:
    """Targets with sources as they compare; of repeated (mix, source) the greatest row counts.

    Rows without a mix, source, share, size or repeats, or with negative ones, set no target.
    """
    t = targets.select("mix_id", _sources("source").alias("source"), "size_ratio", "target_share", F.col("max_repeats").cast("bigint").alias("max_repeats"))
    t = t.filter("mix_id is not null and source is not null and size_ratio >= 0 and target_share >= 0 and max_repeats >= 0 and not isnan(size_ratio) and not isnan(target_share)")
    return t.groupBy("mix_id", "source").agg(F.max(F.struct("size_ratio", "target_share", "max_repeats")).alias("r")).select("mix_id", "source", "r.*")


def rake(cells: pd.DataFrame, rounds: int = ROUNDS) -> tuple[pd.Series, float]:
    """Weights of the cells of one mix (columns source, lang, topic, tokens, goal, max_repeats), and what is left.

    ``goal`` is the token total the cell's source shall give, already within its reach. Language
    and topic are raked to the marginals of the documents at hand; the source comes last. The
    residual is the largest distance of a language or topic from its marginal, as a share of the mix:
    0 where all marginals can be met, more where caps or missing cells forbid it.
    """
    t = cells["tokens"].to_numpy(float)
    cap = cells["max_repeats"].to_numpy(float)
    goal = cells.groupby("source")["goal"].first()
    total = float(goal.sum())
    src, names = pd.factorize(cells["source"])
    goals = goal.reindex(names).to_numpy(float)
    by_source = np.bincount(src, t, len(names))
    w = np.minimum((goals / np.maximum(by_source, 1.0))[src], cap)
    sides = []
    for c in ("lang", "topic"):
        code, values = pd.factorize(cells[c])
        share = np.bincount(code, t, len(values))
        sides.append((code, len(values), share / max(share.sum(), 1.0) * total))

    def to_sources(w: np.ndarray) -> np.ndarray:
        # Scale within each source; cells at their cap stay there and the others make up for them.
        free = np.ones(len(w), bool)
        for _ in range(64):
            fixed = np.bincount(src, np.where(free, 0.0, w * t), len(names))
            loose = np.bincount(src, np.where(free, w * t, 0.0), len(names))
            factor = np.where(loose > 0, (goals - fixed) / np.where(loose > 0, loose, 1.0), 1.0)
            w = np.where(free, w * factor[src], w)
            over = free & (w > cap)
            if not over.any():
                break
            w = np.where(over, cap, w)
            free &= ~over
        return np.clip(w, 0.0, cap)

    for _ in range(rounds):
        last = w
        for code, k, want in sides:
            have = np.bincount(code, w * t, k)
            w = np.minimum(w * np.where(have > 0, want / np.where(have > 0, have, 1.0), 1.0)[code], cap)
            w = np.where((w <= 0) & (goals[src] > 0), 1e-9, w)
        w = to_sources(w)
        if np.all(np.abs(w - last) <= TOLERANCE * np.maximum(last, 1e-9)):
            break
    off = [np.abs(np.bincount(code, w * t, k) - want).max(initial=0.0) for code, k, want in sides]
    return pd.Series(w, index=cells.index), float(max(off)) / max(total, 1.0)


def _rake_mix(pdf: pd.DataFrame) -> pd.DataFrame:
    weight, residual = rake(pdf)
    return pd.DataFrame({"mix_id": pdf["mix_id"], "source": pdf["source"], "lang": pdf["lang"], "topic": pdf["topic"], "weight": weight, "residual": residual})


def _classes(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with the values of a column that hold less than ``LEAST_SHARE`` of the tokens as one class."""
    have = docs.groupBy(column).agg(F.sum("n_tokens").alias("_n"))
    least = F.ceil(F.coalesce(F.sum("_n"), F.lit(0)) * LEAST_SHARE).cast("bigint")
    bound = have.agg(least.alias("_least"))
    own = have.crossJoin(F.broadcast(bound)).filter("_n >= _least and _n > 0").select(column, F.lit(True).alias("_own"))
    return docs.join(F.broadcast(own), column, "left").withColumn(column, F.when(F.col("_own"), F.col(column)).otherwise(OTHER)).drop("_own")


class Mixture:
    """The documents drawn for each mix and the report on them."""

    def __init__(self, documents: DataFrame, targets: DataFrame, *, tokenizers: str = TOKENIZERS, seed: int = 7) -> None:
        """Documents without a source take no part; NULL languages and topics are classes of their own.

        A NULL or empty text has no tokens and is never drawn. Repeated rows are documents of
        their own. Empty tables give an empty mix.
        """
        topic = F.lower(F.regexp_replace(F.coalesce("agenda_item", F.lit("")), r"^\s*\d+\s*", ""))
        docs = documents.select("doc_id", "text", _sources("source").alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), topic.alias("topic")).filter("source is not null")
        docs = cut_lineage(encode_corpus(docs, keep=["doc_id", "source", "lang", "topic"], tokenizers=tokenizers, lengths=True))
        self.docs = _classes(_classes(docs, "lang"), "topic")
        self.targets = mix_targets_of(targets)
        self.seed = seed
        # Small tables, read by several jobs below: cells first, then what follows from them.
        self.cells = cut_lineage(self.docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")))
        total = self.cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
        have = self.cells.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum("n_docs").alias("n_docs"))
        size = F.col("size_ratio") * F.col("all_tokens")
        goals = self.targets.crossJoin(F.broadcast(total)).join(have, "source", "left").select(
            "mix_id", "source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
            size.alias("mix_tokens"), (F.col("target_share") * size).alias("target_tokens"),
        ).withColumn("goal", F.least("target_tokens", (F.col("max_repeats") * F.col("available_tokens")).cast("double")))
        self.goals = cut_lineage(goals)
        self.copies = self._draw()

    def _draw(self) -> DataFrame:
        key, cell = ["mix_id", "source"], ["source", "lang", "topic"]
        goals = bounded_broadcast(self.goals.select(*key, "goal", "max_repeats"))
        cells = self.cells.select(*cell, "tokens").join(goals, "source").filter("tokens > 0")
        # A mix has at most (its sources) x (languages and topics with a share of their own) cells.
        weights = cells.groupBy("mix_id").applyInPandas(_rake_mix, "mix_id int, source string, lang string, topic string, weight double, residual double")
        self.weights = cut_lineage(weights)
        rows = self.docs.filter("n_tokens > 0").join(bounded_broadcast(self.weights.drop("residual")), cell).join(goals, key)
        klass = F.floor(F.log2(F.col("n_tokens").cast("double")) * 8)
        stratum = sum((F.when(klass < c, 1).otherwise(0) for c in STRATA), F.lit(0))
        rows = cut_lineage(rows.select("mix_id", "doc_id", "source", "n_tokens", "weight", "goal", "max_repeats", F.xxhash64("doc_id", F.lit(self.seed), "mix_id").alias("h"), klass.alias("klass"), stratum.alias("stratum")))
        # One row for each mix, source and size class.
        totals = cut_lineage(rows.groupBy(*key, "klass", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") * F.col("n_tokens")).alias("tokens")))
        salts = bounded_broadcast(totals.select(*key, "klass", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("bigint").alias("salts")))
        rows = rows.join(salts, [*key, "klass"]).withColumn("salt", F.pmod("h", "salts"))
        expected = totals.groupBy(*key, "stratum").agg(F.sum("tokens").alias("tokens"))
        drawn = None
        for k in range(len(STRATA) + 1):
            part = rows.filter(F.col("stratum") == k)
            if drawn is not None:
                # What the larger documents drew too much or too little is made up for by the smaller.
                have = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("have"))
                own = expected.filter(F.col("stratum") == k).select("mix_id", "source", F.col("tokens").alias("own"))
                rest = expected.filter(F.col("stratum") > k).groupBy("mix_id", "source").agg(F.sum("tokens").alias("rest"))
                need = F.col("goal") - F.coalesce("have", F.lit(0)) - F.coalesce("rest", F.lit(0.0))
                factor = own.join(have, ["mix_id", "source"], "left").join(rest, ["mix_id", "source"], "left")
                part = part.join(bounded_broadcast(cut_lineage(factor)), ["mix_id", "source"]).withColumn("weight", F.when(F.col("own") > 0, F.least(F.greatest(F.col("weight") * need / F.col("own"), F.lit(0.0)), F.col("max_repeats").cast("double"))).otherwise(F.col("weight")))
            one = cut_lineage(self._sample(part.select("mix_id", "doc_id", "source", "n_tokens", "weight", "h", "klass", "salt")))
            drawn = one if drawn is None else drawn.unionByName(one)
        return drawn

    def _sample(self, rows: DataFrame) -> DataFrame:
        """Whole copies for certain, the rest by one systematic draw along each source."""
        rows = rows.withColumn("sure", F.floor("weight")).withColumn("part", F.round((F.col("weight") - F.floor("weight")) * UNIT).cast("bigint"))
        # Buckets from large to small documents: classes of about 9 per cent, the large ones salted.
        bucket = ["mix_id", "source", "klass", "salt"]
        start = F.pmod(F.xxhash64("mix_id", "source", F.lit(self.seed)), F.lit(UNIT))
        before = Window.partitionBy("mix_id", "source").orderBy(F.desc("klass"), "salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = rows.groupBy(*bucket).agg(F.sum("part").alias("parts")).select(*bucket, (F.coalesce(F.sum("parts").over(before), F.lit(0)) + start).alias("offset"))
        inside = Window.partitionBy(*bucket).orderBy(F.desc("n_tokens"), "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.join(bounded_broadcast(cut_lineage(offsets)), bucket).withColumn("upto", F.col("offset") + F.sum("part").over(inside))
        copies = F.expr(f"sure + (upto div {UNIT}) - ((upto - part) div {UNIT})")
        return rows.select("mix_id", "doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")

    def report(self) -> DataFrame:
        """Actual tokens and shares of each mix and source, listed sources without documents included.

        ``reachable`` tells whether the target is within what the source has and may repeat;
        ``share_of_size`` is relative to the size asked for and ``share_of_mix`` to the size drawn;
        ``residual`` is how far the raked languages or topics of the mix stay from their marginals.
        """
        drawn = self.copies.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
        residual = self.weights.groupBy("mix_id").agg(F.max("residual").alias("residual"))
        rows = self.goals.join(drawn, ["mix_id", "source"], "left").join(residual, "mix_id", "left")
        actual = F.coalesce("actual_tokens", F.lit(0))
        whole = F.sum(actual).over(Window.partitionBy("mix_id"))
        return rows.select(
            "mix_id", "source", "target_share", "max_repeats", "n_docs", "available_tokens", F.round("target_tokens", 1).alias("target_tokens"), actual.alias("actual_tokens"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            (F.col("goal") >= F.col("target_tokens")).alias("reachable"), F.round(F.when(F.col("mix_tokens") > 0, actual / F.col("mix_tokens")), 6).alias("share_of_size"), F.round(F.when(whole > 0, actual / whole), 6).alias("share_of_mix"), F.round("residual", 6).alias("residual"),
        )
