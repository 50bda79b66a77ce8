"""Telemetry in: range responses, counters, histograms, mock series, scenario files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import finite, norm_label

#: Form of a range response; values are [time, text] pairs.
RESPONSE = "status string, data struct<resultType:string, result:array<struct<metric:map<string,string>, values:array<array<string>>>>>, _corrupt_record string"
SCENARIO = "split string, n_scenarios bigint, scenarios array<struct<fault_id:string, name:string, root_cause_service:string, fault_type:string, injected_at_t:double, expected_recovery_t:double, causal_path:array<array<string>>, confounded:boolean, confounder_description:string, affected_services:array<string>, split:string, ground_truth_locked:boolean, seed:bigint>>"


def valid_responses(raw: DataFrame, body: str = "body") -> DataFrame:
    """Parsed responses whose status is success; malformed ones are dropped."""
    parsed = raw.withColumn("_r", F.from_json(body, RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.filter(F.col("_r.status") == "success").filter(F.col("_r._corrupt_record").isNull())


def rejected_responses(raw: DataFrame, body: str = "body") -> DataFrame:
    """Responses that are no valid success, with the reason."""
    parsed = raw.withColumn("_r", F.from_json(body, RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    reason = F.when(F.col("_r._corrupt_record").isNotNull() | F.col("_r.status").isNull(), "malformed").when(F.col("_r.status") != "success", "status")
    return parsed.withColumn("reason", reason).filter("reason is not null").drop("_r")


def series_of(raw: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """One row for each time of a response: the mean of its series, text and NaN dropped, infinity kept."""
    pairs = valid_responses(raw, body).select(*key, F.explode("_r.data.result").alias("s")).select(*key, F.explode("s.values").alias("v"))
    rows = pairs.select(*key, F.col("v")[0].try_cast("double").alias("time"), F.col("v")[1].try_cast("double").alias("value")).filter("time is not null and value is not null and not isnan(value)")
    return rows.groupBy(*key, "time").agg(F.avg("value").alias("value"))


def counter_rate(counters: DataFrame, key: list[str]) -> DataFrame:
    """Increase per second between successive readings of a counter; a reset counts from zero."""
    order = Window.partitionBy(*key).orderBy("time")
    rows = counters.withColumn("_dt", F.col("time") - F.lag("time").over(order)).withColumn("_dv", F.col("value") - F.lag("value").over(order))
    return rows.filter("_dt > 0").select(*key, "time", (F.when(F.col("_dv") >= 0, F.col("_dv")).otherwise(F.col("value")) / F.col("_dt")).alias("rate"))


def error_ratio(calls: DataFrame, key: list[str]) -> DataFrame:
    """Share of calls whose code is not OK; NULL without calls. ``calls``: key, code, n."""
    total = F.sum("n")
    return calls.groupBy(*key).agg((F.coalesce(F.sum(F.when(F.col("code") != "OK", F.col("n"))), F.lit(0)) / F.when(total > 0, total)).alias("err_rate"))


def histogram_quantile(buckets: DataFrame, key: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets (``le``, ``n``) by linear interpolation inside the bucket.

    The topmost bucket is open; a quantile in it is the highest finite bound.
    """
    order = Window.partitionBy(*key).orderBy("le")
    rows = buckets.withColumn("_lo", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("_below", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("_all", F.max("n").over(Window.partitionBy(*key)))
    want = q * F.col("_all")
    hit = rows.filter((F.col("n") >= want) & (F.col("_all") > 0)).withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (want - F.col("_below")) / F.when(F.col("n") > F.col("_below"), F.col("n") - F.col("_below"))
    return hit.select(*key, F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(F.coalesce(inside, F.col("le"))).alias("quantile"))


def mock_series(spark: SparkSession, services: list[str], window_s: float = 300.0, *, anomaly: str | None = None, magnitude: float = 5.0, seed: int = 42) -> DataFrame:
    """Normal(50, 5) readings ten seconds apart; the last two of ``anomaly`` are raised."""
    n = max(3, int(window_s / 10))
    rows = spark.range(len(services) * n).select(F.element_at(F.array(*(F.lit(s) for s in services)), (F.floor(F.col("id") / n) + 1).cast("int")).alias("service_id"), (F.col("id") % n).alias("k"))
    noise = normal_draw(F.concat_ws(":", F.lit(str(seed)), "service_id", "k"))
    value = F.when((F.col("service_id") == F.lit(anomaly)) & (F.col("k") >= n - 2), 50.0 + 5.0 * magnitude).otherwise(50.0 + 5.0 * noise)
    return rows.select("service_id", (F.col("k") * 10.0).alias("time"), value.alias("value"))


def uniform_draw(name):
    """Uniform number in (0, 1) that depends on its name only."""
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def normal_draw(name):
    """Standard normal number that depends on its name only (Box-Muller)."""
    return F.sqrt(-2.0 * F.ln(uniform_draw(F.concat(name, F.lit("/a"))))) * F.cos(2.0 * F.pi() * uniform_draw(F.concat(name, F.lit("/b"))))


def scenario_files(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """One row for each scenario of files of the form {split, n_scenarios, scenarios}; or one such document a line."""
    return spark.read.schema(SCENARIO).json(path, multiLine=multi_line).select(F.explode("scenarios").alias("s")).select("s.*")


def without_held_out(scenarios: DataFrame, *, token: bool = False) -> DataFrame:
    """Scenarios without the held-out split, unless a token allows it."""
    return scenarios if token else scenarios.filter(F.coalesce(norm_label("split") != "HELD_OUT_TEST", F.lit(True)))


def access_audit(scenarios: DataFrame) -> DataFrame:
    """Rows of each split a reader without a token is refused or given."""
    return scenarios.groupBy(norm_label("split").alias("split")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("access", F.when(F.col("split") == "HELD_OUT_TEST", "REFUSED").otherwise("GIVEN"))


def manifest(df: DataFrame, key: str) -> DataFrame:
    """Digest of each row as JSON, to compare artifacts by."""
    return df.select(F.col(key), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("sha256"))


#: Words that must not be in a provenance record.
SECRETS = ["password", "secret", "token", "api_key", "private_key"]


def secret_scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text names a secret, with the first such word of the list."""
    low = F.lower(F.col(text))
    hit = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in SECRETS))
    return df.select(key, hit.alias("word")).filter("word is not null")


def phrase_scan(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Number of matches of a pattern in each text that has any."""
    return df.select(key, F.regexp_count(text, F.lit(pattern)).alias("n")).filter("n > 0")


def last_wins(df: DataFrame, key: list[str], priority: str) -> DataFrame:
    """Of rows with one key the one with the greatest priority."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max(F.struct(priority, *(c for c in rest if c != priority))).alias("r")).select(*key, *(f"r.{c}" for c in rest))


def gate_runs(runs: DataFrame) -> DataFrame:
    """Runs on live telemetry without synthetic substitution."""
    return runs.filter(F.col("live") & ~F.col("substituted"))


def split_of(index, total):
    """DEVELOPMENT for the first half of the positions, VALIDATION up to three quarters, else HELD_OUT_TEST."""
    return F.when(index < F.floor(total / 2), "DEVELOPMENT").when(index < F.floor(3 * total / 4), "VALIDATION").otherwise("HELD_OUT_TEST")


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write as parquet, json, csv or orc; the folder is replaced."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)


def latex_rows(df: DataFrame) -> DataFrame:
    """Each row as a line of a tabular; doubles with three decimals, --- for NULL."""
    cells = [F.coalesce(F.format_string("%.3f", c) if t == "double" else F.regexp_replace(F.col(c).cast("string"), "_", r"\\_"), F.lit("---")) for c, t in df.dtypes]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))


def clean_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named doubles with NaN and infinity as NULL."""
    return df.withColumns({c: finite(c) for c in columns})
