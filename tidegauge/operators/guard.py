"""Record checks: row rules, intervention verification, lifecycle order and safety gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import epoch_ms, norm_label, norm_name, norm_token
from tidegauge.operators.select import authorization

#: Metric names, and the order of lifecycle phases.
METRICS = ["lat_p99", "lat_p50", "err_rate", "rps", "cpu_pct", "mem_pct"]
PHASES = ["PREPARE", "AUTHORIZE", "APPLY", "VERIFY", "OBSERVE", "ROLLBACK", "FINALIZE"]


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules; a NULL verdict breaks none."""
    broken = F.array_compact(F.array(*(F.when(~cond, F.lit(name)) for name, cond in rules.items())))
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


def reading_rules() -> dict[str, Column]:
    return {
        "service_given": F.col("service_id").isNotNull() & (F.trim("service_id") != ""),
        "metric_known": F.col("metric_name").isin(METRICS),
        "time_positive": F.coalesce(F.col("ts") > 0, F.lit(False)),
        "lag_not_negative": F.col("collection_lag_s") >= 0,
    }


def incident_rules() -> dict[str, Column]:
    return {"ends_after_start": F.col("t_end") > F.col("t_start"), "width_positive": F.col("delta_t_s") > 0}


def precision_check(records: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """Whether the measured effect is within a fifth of the requested one; no measurement passes.

    ``precision_achieved`` is measured over requested. Columns: record_id, measured_ms, relative_error, verdict.
    """
    measured = F.col("precision_achieved") * F.col("latency_ms")
    error = F.abs(measured - F.col("latency_ms")) / F.greatest(F.lit(1.0), F.col("latency_ms"))
    return records.select("record_id", "ingested_at", measured.alias("measured_ms"), error.alias("relative_error"), F.when(error.isNull() | (error < tolerance), "VERIFIED").otherwise("CONFOUNDED").alias("verdict"))


def shaping_command(records: DataFrame) -> DataFrame:
    """The shaping command of a record as text, for the log; nothing is executed."""
    band = F.regexp_extract("tc_handle", r"(\d+)", 1).cast("int")
    ok = band.between(1, 3)
    text = F.format_string("tc qdisc add dev %s parent 1:%d handle %d: netem delay %.1fms %.1fms loss %.1f%%", norm_token("interface"), band, band, "latency_ms", "jitter_ms", "packet_loss_pct")
    return records.select("record_id", "ingested_at", band.alias("band"), F.when(ok & F.col("interface").isNotNull(), text).alias("command"))


def isolation_check(before: DataFrame, after: DataFrame, key: list[str], sigma: float = 2.0) -> DataFrame:
    """Bystanders whose metric moved by more than a tenth of ``sigma`` of its value before."""
    rows = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), key)
    change = F.abs(F.col("after") - F.col("before")) / F.when(F.col("before") > 0, F.col("before"))
    return rows.withColumn("change", change).withColumn("affected", F.coalesce(change > sigma * 0.1, F.lit(False)))


def clean_windows(interventions: DataFrame, margin_ms: int = 60_000) -> DataFrame:
    """Number of other records on the same service that begin within the margin of a record's start.

    Starts are counted over a range window in time, not by pairing records.
    """
    rows = interventions.filter("applied_ms is not null and destination_service is not null")
    near = Window.partitionBy("destination_service").orderBy("applied_ms").rangeBetween(-margin_ms, margin_ms)
    return rows.select("record_id", "destination_service", "applied_ms", (F.count(F.lit(1)).over(near) - 1).alias("n_concurrent")).withColumn("clean", F.col("n_concurrent") == 0)


def lifecycle_violations(events: DataFrame) -> DataFrame:
    """Phases that do not follow their predecessor. ``events``: record_id, seq, phase."""
    place = F.array_position(F.array(*(F.lit(p) for p in PHASES)), F.col("phase"))
    order = Window.partitionBy("record_id").orderBy("seq")
    rows = events.withColumn("_at", place).withColumn("_prev", F.lag("_at").over(order))
    return rows.filter((F.col("_at") == 0) | (F.coalesce("_prev", F.lit(0)) + 1 != F.col("_at"))).select("record_id", "seq", "phase")


def band_of(position: Column) -> Column:
    """Bands 1, 2, 3 in turn."""
    return F.pmod(position, F.lit(3)) + 1


def dispatch(scenarios: DataFrame) -> DataFrame:
    """What an injector does with each scenario; held-out ones are refused."""
    fault = norm_label("fault_type")
    action = F.when(norm_label("split") == "HELD_OUT_TEST", "REFUSED").when(fault.isin("MULTI_CAUSE", "CONFOUNDED"), "ABORTED").when(fault.isin("NETWORK_LATENCY", "PACKET_LOSS"), "NETWORK").when(fault.isNull(), "ABORTED").otherwise(fault)
    return scenarios.select("fault_id", fault.alias("fault"), norm_label("split").alias("split"), action.alias("action"))


def pre_gate(probes: DataFrame, approved: list[str], pattern: str, budget: float = 600.0) -> DataFrame:
    """First hard stop of each probe, soft warnings, decision and level.

    ``probes``: kill, namespace, target, cumulative_s, seconds, mutates, blast_radius, impact,
    confidence, override; a namespace must match ``pattern`` and be approved.
    """
    stop = (
        F.when(F.col("kill"), "KILL_SWITCH")
        .when(~F.col("namespace").rlike(pattern) | ~F.col("namespace").isin(approved), "NAMESPACE")
        .when(F.col("target").isNull(), "TARGET")
        .when(F.col("cumulative_s") + F.col("seconds") > budget, "BUDGET")
        .when(F.col("mutates"), "DATA_MUTATION")
    )
    soft = F.array_compact(F.array(F.when(F.col("blast_radius") >= 0.3, F.lit("BLAST_RADIUS")), F.when(F.col("impact") >= 0.05, F.lit("SLA_IMPACT"))))
    level = F.when(F.col("override"), "AUTONOMOUS").otherwise(authorization(F.col("blast_radius"), F.col("impact"), F.col("confidence")))
    return probes.withColumn("hard_stop", stop).withColumn("warnings", F.concat_ws(",", soft)).withColumn("level", level).withColumn("decision", F.when(stop.isNotNull(), "DENY").otherwise("ALLOW"))


def error_cascade(series: DataFrame, key: list[str], threshold: float = 0.5, seconds: float = 30.0) -> DataFrame:
    """First time the error rate has been over the threshold without a break for longer than ``seconds``."""
    order = Window.partitionBy(*key).orderBy("t_start_ms")
    hot = F.coalesce(F.col("value") > threshold, F.lit(False))
    rows = series.withColumn("_hot", hot).withColumn("_run", F.sum(F.when(hot, 0).otherwise(1)).over(order))
    begun = F.min(F.when(F.col("_hot"), F.col("t_start_ms"))).over(Window.partitionBy(*key, "_run"))
    rows = rows.withColumn("_begun", begun).filter(F.col("_hot") & (F.col("t_start_ms") - F.col("_begun") > seconds * 1000))
    return rows.groupBy(*key).agg(F.min("t_start_ms").alias("cascade_ms"))


def kill_latch(records: DataFrame, key: list[str], attempts: int = 3) -> DataFrame:
    """Records after a failed or too often tried rollback of their key; the latch never opens."""
    bad = (F.col("status") == "FAILED") | (F.col("rollback_attempts") > attempts)
    order = Window.partitionBy(*key).orderBy("ingested_at", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("latched", F.coalesce(F.max(bad.cast("int")).over(order), F.lit(0)) == 1)


#: Failure codes that stand for an abstention.
ABSTENTIONS = ["INSUFFICIENT_EVIDENCE", "NOT_IDENTIFIABLE", "NO_DIVERGENCE", "BOUNDARY_LIMITED"]


def failure_summary(failures: DataFrame) -> DataFrame:
    """First code of each run, and whether all its codes are abstentions."""
    rows = failures.groupBy("run_id").agg(F.min_by("code", "seq").alias("primary_code"), F.collect_set("code").alias("_codes"))
    return rows.select("run_id", "primary_code", (F.size(F.array_except("_codes", F.array(*(F.lit(c) for c in ABSTENTIONS)))) == 0).alias("is_abstention"))


def five_checks(records: DataFrame, margin_ms: int = 60_000) -> DataFrame:
    """The five validity checks of each valid record, and whether all hold.

    ``records``: record_id, destination_service, status, applied_ms, ended_ms, rolled_back,
    latency_ms, precision_achieved, isolation_verified. Precision as in :func:`precision_check`; the
    window is clean if no other record of the service begins within the margin of the start; no
    record of the service overlaps in time; recovery is confirmed by a rollback time and a status
    other than FAILED. A missing isolation flag does not hold. Neighbours are found over windows in
    time, not by pairing records.
    """
    rows = records.filter("applied_ms is not null and destination_service is not null")
    verdict = precision_check(rows.withColumn("ingested_at", F.lit(None))).select("record_id", (F.col("verdict") == "VERIFIED").alias("precision_check"))
    order = Window.partitionBy("destination_service").orderBy("applied_ms", "record_id")
    near = Window.partitionBy("destination_service").orderBy("applied_ms").rangeBetween(-margin_ms, margin_ms)
    end = F.greatest(F.coalesce("ended_ms", "applied_ms"), F.col("applied_ms"))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("applied_ms").over(order)
    rows = rows.withColumn("clean_window", F.count(F.lit(1)).over(near) == 1)
    rows = rows.withColumn("concurrent_event_free", (before.isNull() | (before <= F.col("applied_ms"))) & (after.isNull() | (after >= end)))
    rows = rows.withColumn("recovery_confirmed", F.col("rolled_back") & (F.coalesce("status", F.lit("")) != "FAILED"))
    rows = rows.withColumn("isolation_verified", F.coalesce("isolation_verified", F.lit(False))).join(verdict, "record_id")
    names = ["precision_check", "clean_window", "concurrent_event_free", "recovery_confirmed", "isolation_verified"]
    whole = F.col(names[0])
    for n in names[1:]:
        whole = whole & F.col(n)
    return rows.select("record_id", *names, whole.alias("valid"))


#: Least measure by which a fault counts as injected.
VERIFIED_FROM = {"NETWORK_LATENCY": 0.5, "SERVICE_DEGRADATION": 50.0, "RESOURCE_CONTENTION": 40.0}


def verify_fault(rows: DataFrame) -> DataFrame:
    """Whether an injected fault shows in its measure. ``rows``: any columns with fault, expected, measured.

    Latency counts from half of what was expected (none expected counts as 0), CPU from 50 and memory
    from 40 per cent; drops and queue must be over 0; a dependency must not answer (measured 1). Without
    a measure, or for other faults, it is not confirmed.
    """
    m, fault = F.col("measured"), F.col("fault")
    ok = (
        F.when(fault == "NETWORK_LATENCY", m >= F.coalesce("expected", F.lit(0.0)) * VERIFIED_FROM["NETWORK_LATENCY"])
        .when(fault.isin("PACKET_LOSS", "QUEUEING", "DEPENDENCY_FAILURE"), m > 0)
        .when(fault == "SERVICE_DEGRADATION", m >= VERIFIED_FROM["SERVICE_DEGRADATION"])
        .when(fault == "RESOURCE_CONTENTION", m >= VERIFIED_FROM["RESOURCE_CONTENTION"])
    )
    return rows.withColumn("confirmed", F.coalesce(ok, F.lit(False)))


def valid_latest(interventions: DataFrame) -> DataFrame:
    """The latest delivery of each record with the fields that checks need."""
    cols = ["ingested_at", "destination_service", "source_service", "status", "applied_ms", "rollback_attempts", "latency_ms", "precision_achieved"]
    rows = interventions.filter("record_id is not null").select("record_id", "ingested_at", norm_name("destination_service").alias("destination_service"), norm_name("source_service").alias("source_service"), norm_label("status").alias("status"), epoch_ms("t_applied").alias("applied_ms"), "rollback_attempts", "latency_ms", "precision_achieved")
    return rows.groupBy("record_id").agg(F.max(F.struct(*cols)).alias("r")).select("record_id", "r.*")
