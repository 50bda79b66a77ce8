"""Wall time, CPU time and peak memory of the stages of a run, measured on the driver."""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "stage_name string, wall_time_s double, cpu_time_s double, memory_mb double, n_rows bigint, notes string"


class StageLog:
    """Rows of a stage log; a stage that fails is logged too."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    @contextmanager
    def stage(self, name: str, notes: str = "") -> Iterator[dict]:
        facts: dict = {"n_rows": None}
        wall, cpu = time.perf_counter(), time.process_time()
        try:
            yield facts
        except BaseException as e:
            notes = f"failed: {type(e).__name__}"
            raise
        finally:
            memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            self.rows.append((name, time.perf_counter() - wall, time.process_time() - cpu, memory, facts["n_rows"], notes))

    @property
    def total_s(self) -> float:
        return sum(r[1] for r in self.rows)

    @property
    def bottleneck(self) -> str | None:
        return max(self.rows, key=lambda r: r[1])[0] if self.rows else None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)
