"""Structural models: sampling, the do-operator, and metric series of fault scenarios."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import norm_label, norm_name
from tidegauge.sources.telemetry import normal_draw

#: Fixed values by fault type: latency factor, error rate added, CPU points added at the root.
EFFECTS = {
    "NETWORK_LATENCY": (8.0, 0.05, 5.0),
    "PACKET_LOSS": (5.0, 0.20, 5.0),
    "SERVICE_DEGRADATION": (4.0, 0.10, 45.0),
    "RESOURCE_CONTENTION": (6.0, 0.05, 60.0),
    "QUEUEING": (10.0, 0.15, 30.0),
    "DEPENDENCY_FAILURE": (3.0, 0.50, 20.0),
    "MULTI_CAUSE": (6.0, 0.20, 35.0),
    "CONFOUNDED": (4.0, 0.08, 15.0),
}
OTHER_EFFECT = (3.0, 0.05, 10.0)
#: Nominal latency, error rate and CPU of a service, and Δt.
NOMINAL = (50.0, 0.001, 30.0)
STEP = 10.0


@dataclass(frozen=True)
class Model:
    """Linear structural equations: variable -> ({parent: coefficient}, constant, noise scale)."""

    equations: dict[str, tuple[dict[str, float], float, float]] = field(default_factory=dict)

    def order(self) -> list[str]:
        """Variables with parents first; a cycle or an unknown parent is an error."""
        done: list[str] = []
        left = dict(self.equations)
        while left:
            ready = [v for v, (parents, _, _) in left.items() if all(p in done for p in parents)]
            if not ready:
                raise ValueError(f"cycle or unknown parent among {sorted(left)}")
            done += ready
            for v in ready:
                del left[v]
        return done

    def edges(self) -> list[tuple[str, str]]:
        return [(p, v) for v, (parents, _, _) in self.equations.items() for p in parents]

    def do(self, **values: float) -> Model:
        """The model with these variables set from outside; this one stays as it is."""
        unknown = set(values) - set(self.equations)
        if unknown:
            raise KeyError(f"no such variables: {sorted(unknown)}")
        return Model(self.equations | {v: ({}, float(x), 0.0) for v, x in values.items()})

    def sample(self, spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
        """``n`` draws, one column for each variable; the noise depends on (seed, variable, row) only."""
        df = spark.range(n)
        for v in self.order():
            parents, constant, scale = self.equations[v]
            noise = normal_draw(F.concat_ws(":", F.lit(str(seed)), F.lit(v), "id"))
            value: Column = F.lit(constant) + (scale * noise if scale else F.lit(0.0))
            for p, c in parents.items():
                value = value + c * F.col(p)
            df = df.withColumn(v, value)
        return df


MODELS = {
    "chain": Model({"X": ({}, 0.0, 1.0), "Z": ({"X": 0.8}, 0.0, 0.5), "Y": ({"Z": 0.7}, 0.0, 0.5)}),
    "fork": Model({"Z": ({}, 0.0, 1.0), "X": ({"Z": 0.8}, 0.0, 0.5), "Y": ({"Z": 0.7}, 0.0, 0.5)}),
    "collider": Model({"X": ({}, 0.0, 1.0), "Y": ({}, 0.0, 1.0), "Z": ({"X": 0.7, "Y": 0.7}, 0.0, 0.5)}),
    "mediated": Model({"X": ({}, 0.0, 1.0), "M": ({"X": 0.8}, 0.0, 0.5), "Y": ({"M": 0.6, "X": 0.3}, 0.0, 0.5)}),
    "confounder": Model({"U": ({}, 0.0, 1.0), "X": ({"U": 0.8}, 0.0, 0.5), "Y": ({"U": 0.7}, 0.0, 0.5)}),
    "feedback": Model({"X0": ({}, 0.0, 1.0), "Y0": ({"X0": 0.5}, 0.0, 0.5), "X1": ({"X0": 0.4, "Y0": 0.3}, 0.0, 0.5), "Y1": ({"Y0": 0.4, "X1": 0.5}, 0.0, 0.5)}),
    "diamond": Model({"A": ({}, 0.0, 1.0), "B": ({"A": 0.8}, 0.0, 0.5), "C": ({"A": 0.7}, 0.0, 0.5), "D": ({"B": 0.6, "C": 0.6}, 0.0, 0.5)}),
}


#: Generators of the discovery checks: model and the variables that are seen (U is hidden).
GENERATORS = {
    "chain": (Model({"X": ({}, 0.0, 1.0), "Y": ({"X": 0.8}, 0.0, 0.5), "Z": ({"Y": 0.8}, 0.0, 0.5)}), ["X", "Y", "Z"]),
    "latent": (Model({"U": ({}, 0.0, 1.0), "X": ({"U": 0.8}, 0.0, 0.5), "Y": ({"U": 0.8}, 0.0, 0.5)}), ["X", "Y"]),
    "collider": (Model({"X": ({}, 0.0, 1.0), "Y": ({}, 0.0, 1.0), "Z": ({"X": 0.8, "Y": 0.8}, 0.0, 0.5)}), ["X", "Y", "Z"]),
    "mediated": (Model({"X": ({}, 0.0, 1.0), "M": ({"X": 0.8}, 0.0, 0.5), "Y": ({"M": 0.8}, 0.0, 0.5)}), ["X", "M", "Y"]),
    "ambiguous": (Model({"A": ({}, 0.0, 1.0), "B": ({"A": 0.7}, 0.0, 0.5), "C": ({"A": 0.7}, 0.0, 0.5), "D": ({"B": 0.7, "C": 0.7}, 0.0, 0.5)}), ["A", "B", "C", "D"]),
}


def generated_series(spark: SparkSession, n: int = 500) -> DataFrame:
    """Long rows (model, time, variable, value) of what is seen of every generator."""
    out = None
    for name, (model, seen) in GENERATORS.items():
        rows = model.sample(spark, n).select(F.lit(name).alias("model"), F.col("id").alias("time"), F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in seen))).alias("s")).select("model", "time", "s.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def oracle_series(scenarios: DataFrame, seed: int = 0) -> DataFrame:
    """Metric of each scenario from its root and path alone, three minutes around the injection.

    Before it N(0, 10); after it N(50, 5) at the root, N(40, 5) at a target of the path from as many
    steps after it as its last place in the path (not its distance), N(0, 10) elsewhere. Noise depends on
    (seed, scenario, service, step). Columns: fault_id, service_id, window_id (the step), time, value.
    """
    once = scenarios.filter("fault_id is not null and injected_at_t is not null").groupBy("fault_id").agg(F.max(F.struct(F.col("injected_at_t").alias("t"), norm_name("root_cause_service").alias("root"), F.col("seed").alias("s"), F.transform("affected_services", norm_name).alias("services"), "causal_path")).alias("r")).select("fault_id", "r.*")
    delays = once.select("fault_id", F.posexplode("causal_path").alias("i", "e")).select("fault_id", norm_name(F.col("e")[1]).alias("service_id"), "i").groupBy("fault_id", "service_id").agg(((F.max("i") + 1) * STEP).alias("delay"))
    rows = once.select("fault_id", "t", "root", "s", F.explode(F.array_distinct(F.array_append("services", F.col("root")))).alias("service_id")).filter("service_id is not null")
    rows = rows.join(delays, ["fault_id", "service_id"], "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(17))))
    after = F.col("k") * STEP - 60.0
    noise = normal_draw(F.concat_ws(":", F.lit(seed) + F.coalesce("s", F.lit(0)), "fault_id", "service_id", "k"))
    hit = F.when((after >= 0) & (F.col("service_id") == F.col("root")), 50.0).when((after >= 0) & (after >= F.col("delay")), 40.0)
    return rows.select("fault_id", "service_id", F.col("k").cast("bigint").alias("window_id"), (F.col("t") + after).alias("time"), F.when(hit.isNotNull(), hit + 5.0 * noise).otherwise(10.0 * noise).alias("value"))


def queue_length(arrivals: Column, service: Column) -> Column:
    """Mean number in an M/M/1 system, utilization held within [0.01, 0.99]."""
    rho = F.least(F.greatest(arrivals / service, F.lit(0.01)), F.lit(0.99))
    return rho / (1 - rho)


def _effect(fault: Column, k: int) -> Column:
    return F.coalesce(*(F.when(fault == name, F.lit(v[k])) for name, v in EFFECTS.items()), F.lit(OTHER_EFFECT[k]))


def fault_series(scenarios: DataFrame, depths: DataFrame) -> DataFrame:
    """Deterministic metric series of each scenario: its services over the grid of its time.

    ``depths``: fault_id, service_id, depth below the root in the scenario's own graph (services
    that are not there count as three hops off). The root is hit at onset; others d windows later
    with the latency factor times 0.9^d (at least 1) and 0.8^d of the errors. Confounded scenarios
    hit only the root. Columns: fault_id, service_id, time, lat_p99, err_rate, cpu_pct.
    """
    once = scenarios.select("fault_id", norm_name("root_cause_service").alias("root"), norm_label("fault_type").alias("fault"), "injected_at_t", "expected_recovery_t", "confounded", F.transform("affected_services", norm_name).alias("services")).filter("fault_id is not null and injected_at_t is not null and expected_recovery_t is not null")
    once = once.groupBy("fault_id").agg(F.max(F.struct(*(c for c in once.columns if c != "fault_id"))).alias("r")).select("fault_id", "r.*")
    rows = once.select("*", F.explode("services").alias("service_id")).drop("services").dropDuplicates(["fault_id", "service_id"])
    rows = rows.join(depths, ["fault_id", "service_id"], "left").withColumn("depth", F.when(F.col("service_id") == F.col("root"), 0).otherwise(F.coalesce("depth", F.lit(3))))
    rows = rows.withColumn("_k", F.explode(F.expr(f"sequence(0, cast(ceil((expected_recovery_t + 120.0) / {STEP}) as int) - 1)")))
    onset = F.floor(F.col("injected_at_t") / STEP) + F.col("depth")
    hit = (F.col("_k") >= onset) & (F.col("_k") < F.floor(F.col("expected_recovery_t") / STEP)) & ((F.col("depth") == 0) | ~F.coalesce("confounded", F.lit(False)))
    factor = F.greatest(F.lit(1.0), _effect(F.col("fault"), 0) * F.pow(F.lit(0.9), F.col("depth")))
    errors = F.least(F.lit(1.0), F.lit(NOMINAL[1]) + _effect(F.col("fault"), 1) * F.pow(F.lit(0.8), F.col("depth")))
    cpu = F.least(F.lit(100.0), F.lit(NOMINAL[2]) + F.when(F.col("depth") == 0, _effect(F.col("fault"), 2)).otherwise(0.0))
    return rows.select("fault_id", "service_id", (F.col("_k") * STEP).alias("time"), F.when(hit, F.lit(NOMINAL[0]) * factor).otherwise(NOMINAL[0]).alias("lat_p99"), F.when(hit, errors).otherwise(NOMINAL[1]).alias("err_rate"), F.when(hit, cpu).otherwise(NOMINAL[2]).alias("cpu_pct"))
