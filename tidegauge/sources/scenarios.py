"""Generated fault scenarios and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.graph import closure
from tidegauge.sources.telemetry import split_of

#: The call graph of the example system.
CALLS = {
    "frontend": ["cart", "product_catalog", "recommendation", "shipping", "currency", "ad", "checkout"],
    "checkout": ["payment", "shipping", "email", "cart", "currency"],
    "cart": ["redis_cart"],
    "recommendation": ["product_catalog"],
}
#: Fixed values by code: fault type, root, (start, targets) of the paths, affected services, recovery time.
KINDS = {
    "NL": ("NETWORK_LATENCY", "frontend", [("frontend", ["checkout", "cart"])], ["frontend", "checkout", "cart"], 360.0),
    "PL": ("PACKET_LOSS", "cart", [("cart", ["redis_cart"])], ["cart", "redis_cart", "frontend"], 420.0),
    "SD": ("SERVICE_DEGRADATION", "payment", [("checkout", ["payment"]), ("frontend", ["checkout"])], ["payment", "checkout", "frontend"], 480.0),
    "RC": ("RESOURCE_CONTENTION", "redis_cart", [("redis_cart", ["cart"])], ["redis_cart", "cart", "checkout", "frontend"], 600.0),
    "QU": ("QUEUEING", "checkout", [("checkout", ["payment", "shipping"])], ["checkout", "payment", "shipping", "email", "frontend"], 540.0),
    "DF": ("DEPENDENCY_FAILURE", "product_catalog", [("recommendation", ["product_catalog"]), ("frontend", ["recommendation"])], ["product_catalog", "recommendation", "frontend"], 300.0),
    "MC": ("MULTI_CAUSE", "payment", [("checkout", ["payment", "shipping"]), ("frontend", ["checkout"])], ["payment", "shipping", "checkout", "frontend"], 600.0),
}
#: Pairs on one host, in turn, and the positions the splits are counted over.
SHARED_HOST = [("cart", "redis_cart"), ("payment", "email"), ("recommendation", "product_catalog"), ("shipping", "currency")]
PLAIN_TOTAL, TRIALS, CONFOUNDED, ONSET, CONFOUNDED_RECOVERY = 24, 3, 48, 60.0, 480.0


def generated_scenarios(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Every kind of fault three times and 48 confounded pairs, split by position: 69 rows.

    The path of a kind is the edges of the shortest ways from each start to its targets, in order, each
    once; a target that cannot be reached adds none.
    """
    calls = [(src, dst) for src, targets in CALLS.items() for dst in targets]
    reach = closure(spark.createDataFrame(calls, "src string, dst string"), []).select("src", "dst", "path")
    ways = [(code, i, src, dst) for code, kind in KINDS.items() for i, (src, dst) in enumerate((src, dst) for src, targets in kind[2] for dst in targets)]
    steps = F.expr("transform(sequence(1, size(path) - 1), i -> array(path[i - 1], path[i]))")
    found = spark.createDataFrame(ways, "code string, i int, src string, dst string").join(reach, ["src", "dst"]).select("code", F.struct("i", steps.alias("steps")).alias("way"))
    paths = found.groupBy("code").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("way")), lambda w: w["steps"]))).alias("causal_path"))
    kinds = spark.createDataFrame([(code, i, k[0], k[1], k[3], k[4]) for i, (code, k) in enumerate(KINDS.items())], "code string, at int, fault_type string, root_cause_service string, affected_services array<string>, expected_recovery_t double")
    plain = kinds.join(paths, "code", "left").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(TRIALS))))
    none = F.array().cast("array<array<string>>")
    plain = plain.select(
        F.format_string("%s_%02d", "code", "trial").alias("fault_id"), "root_cause_service", "fault_type", F.lit(ONSET).alias("injected_at_t"), "expected_recovery_t", F.coalesce("causal_path", none).alias("causal_path"),
        F.lit(False).alias("confounded"), "affected_services", split_of((F.col("trial") - 1) * len(KINDS) + F.col("at"), F.lit(PLAIN_TOTAL)).alias("split"), (F.col("trial") + seed).cast("bigint").alias("seed"),
    )
    pairs = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in SHARED_HOST))
    hidden = spark.range(CONFOUNDED).withColumn("pair", F.element_at(pairs, (F.col("id") % len(SHARED_HOST) + 1).cast("int")))
    hidden = hidden.select(
        F.format_string("CF_%02d", "id").alias("fault_id"), F.col("pair")[0].alias("root_cause_service"), F.lit("CONFOUNDED").alias("fault_type"), F.lit(ONSET).alias("injected_at_t"), F.lit(CONFOUNDED_RECOVERY).alias("expected_recovery_t"), F.array("pair").alias("causal_path"),
        F.lit(True).alias("confounded"), F.concat("pair", F.array(F.lit("checkout"), F.lit("frontend"))).alias("affected_services"), split_of(F.col("id"), F.lit(CONFOUNDED)).alias("split"), (F.col("id") + seed).alias("seed"),
    )
    return plain.unionByName(hidden)


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of result folders with the name of the folder; LIVE if any stage used live telemetry."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    live = F.col("live_telemetry_used") if "live_telemetry_used" in rows.columns else F.lit(False)
    return rows.withColumn("experiment", F.element_at(F.split("_file", "/"), -2)).withColumn("category", F.when(F.coalesce(live, F.lit(False)), "LIVE").otherwise("SYNTHETIC")).drop("_file")


def manifest_check(scenarios: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Splits whose number of distinct scenarios is not the expected one."""
    from tidegauge.functions import norm_label

    have = scenarios.groupBy(norm_label("split").alias("split")).agg(F.countDistinct("fault_id").alias("n"))
    want = scenarios.sparkSession.createDataFrame(sorted(expected.items()), "split string, expected bigint")
    return want.join(have, "split", "left").select("split", "expected", F.coalesce("n", F.lit(0)).alias("n")).filter("n <> expected")
