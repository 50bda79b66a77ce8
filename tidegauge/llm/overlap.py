"""The same or almost the same records in different splits.

Method: similarity-hash bit fingerprints. A path is a set of directed edges; every edge turns one
bit of a fixed-width fingerprint (an odd sketch), so adding or dropping an edge changes at most
one bit and replacing one at most two. Two fingerprints within Hamming radius 2 agree in at least
four of six segments, so joining on each choice of four segments across the splits loses no
pair. Candidates within the radius are verified on the edge sets themselves.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import norm_label, norm_name

#: 64-bit words of a fingerprint, segments it is cut into, and the Hamming radius of the join.
WORDS, SEGMENTS, RADIUS = 6, 6, 2
TRAINING = "DEVELOPMENT"


def fingerprint(edges: Column) -> Column:
    """Array of ``WORDS`` 64-bit words; each edge flips one bit of one word."""

    def word(k: Column) -> Column:
        def flip(acc: Column, e: Column) -> Column:
            h = F.xxhash64(e)
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))
            return F.when(F.pmod(F.shiftrightunsigned(h, 6), F.lit(WORDS)) == k, acc.bitwiseXOR(bit)).otherwise(acc)

        return F.aggregate(edges, F.lit(0).cast("bigint"), flip)

    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)


def scenario_classes(scenarios: DataFrame) -> DataFrame:
    """Scenarios with root, type, split and a non-empty path, with their edge sets as they compare.

    One row for each fault_id: of rows delivered again the greatest counts. Edges lacking an end
    are no edges; a path without any other is empty. Columns: fault_id, root, fault, split,
    source_set, edges (sorted distinct ``src>dst``).
    """
    edge = F.expr("filter(causal_path, e -> size(e) >= 2 and e[0] is not null and e[1] is not null)")
    named = F.array_sort(F.array_distinct(F.transform(edge, lambda e: F.concat(norm_name(e[0]), F.lit(">"), norm_name(e[1])))))
    rows = scenarios.select("fault_id", norm_name("root_cause_service").alias("root"), norm_label("fault_type").alias("fault"), norm_label("split").alias("split"), norm_name("source_set").alias("source_set"), named.alias("edges"))
    rows = rows.filter("fault_id is not null").groupBy("fault_id").agg(F.max(F.struct("root", "fault", "split", "source_set", "edges")).alias("r")).select("fault_id", "r.*")
    return rows.filter("root is not null and fault is not null and split is not null and size(edges) > 0")


def _segment_keys(words: Column) -> Column:
    """A row for each choice of segments that must agree: its number and the hash of their bits."""
    keep = SEGMENTS - RADIUS
    return F.array(*(F.struct(F.lit(i).alias("choice"), F.xxhash64(*(words[k] for k in c)).alias("code")) for i, c in enumerate(combinations(range(SEGMENTS), keep))))


def class_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (training class, other class) of edge sets that are equal or differ by one edge.

    Works on distinct (root, fault, edges), so copies meet once. Columns: root, fault, edges_a
    (training), edges_b (evaluation), changed (edges on one side only).
    """
    def side(training: bool) -> DataFrame:
        own = classes.filter((F.col("split") == TRAINING) == F.lit(training)).select("root", "fault", "edges").distinct()
        return own.withColumn("words", fingerprint(F.col("edges")))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select("root", "fault", F.col("edges").alias(f"edges_{name}"), F.col("words").alias(f"words_{name}"), F.explode(_segment_keys(F.col("words"))).alias("s")).select("root", "fault", "s.choice", "s.code", f"edges_{name}", f"words_{name}")

    hamming = sum((F.bit_count(F.col("words_a")[k].bitwiseXOR(F.col("words_b")[k])) for k in range(WORDS)), F.lit(0))
    near = keyed(side(True), "a").join(keyed(side(False), "b"), ["root", "fault", "choice", "code"]).filter(hamming <= RADIUS)
    only_a, only_b = F.size(F.array_except("edges_a", "edges_b")), F.size(F.array_except("edges_b", "edges_a"))
    return near.filter((only_a <= 1) & (only_b <= 1)).select("root", "fault", "edges_a", "edges_b", (only_a + only_b).alias("changed")).distinct()


def cross_split_overlaps(scenarios: DataFrame) -> DataFrame:
    """One row for each pair of a training scenario and an equal or almost equal one of another split.

    Columns: training_id, other_id, split and source_set of the other, training_source_set, kind
    (``exact``, ``near``). Scenarios with a NULL root, type or split, or a NULL or empty path, are
    in no pair; an empty table gives no rows; other columns are ignored.
    """
    classes = scenario_classes(scenarios)
    pairs = class_pairs(classes)
    key = ["root", "fault"]
    train = classes.filter(F.col("split") == TRAINING).select(*key, F.col("edges").alias("edges_a"), F.col("fault_id").alias("training_id"), F.col("source_set").alias("training_source_set"))
    other = classes.filter(F.col("split") != TRAINING).select(*key, F.col("edges").alias("edges_b"), F.col("fault_id").alias("other_id"), "split", "source_set")
    full = pairs.join(train, [*key, "edges_a"]).join(other, [*key, "edges_b"])
    return full.select("training_id", "other_id", "split", "source_set", "training_source_set", F.when(F.col("changed") == 0, "exact").otherwise("near").alias("kind"))


def overlap_classes(scenarios: DataFrame) -> DataFrame:
    """One row for each evaluation scenario with its class and number of links, copies not expanded.

    Columns: fault_id, split, source_set, class_id (root, type and edge set), n_exact and n_near
    (training scenarios with an equal and an almost equal path). Scenarios without a link are left out.
    """
    classes = scenario_classes(scenarios)
    key = ["root", "fault"]
    sizes = classes.filter(F.col("split") == TRAINING).groupBy(*key, F.col("edges").alias("edges_a")).agg(F.count(F.lit(1)).alias("n"))
    links = class_pairs(classes).join(sizes, [*key, "edges_a"]).groupBy(*key, F.col("edges_b").alias("edges"))
    links = links.agg(F.coalesce(F.sum(F.when(F.col("changed") == 0, F.col("n"))), F.lit(0)).alias("n_exact"), F.coalesce(F.sum(F.when(F.col("changed") > 0, F.col("n"))), F.lit(0)).alias("n_near"))
    other = classes.filter(F.col("split") != TRAINING).join(links, [*key, "edges"])
    return other.select("fault_id", "split", "source_set", F.sha2(F.concat_ws("|", "root", "fault", F.array_join("edges", ",")), 256).alias("class_id"), "n_exact", "n_near")


def overlap_report(scenarios: DataFrame) -> DataFrame:
    """Overlapping evaluation scenarios and pairs for each split and source set, counted by class."""
    rows = overlap_classes(scenarios)
    return rows.groupBy("split", "source_set").agg(F.count(F.lit(1)).alias("n_overlapping"), F.count_if(F.col("n_exact") > 0).alias("n_exact"), F.sum(F.col("n_exact") + F.col("n_near")).alias("n_pairs"))
