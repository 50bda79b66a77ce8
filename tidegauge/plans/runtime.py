"""Reading tables, checked broadcasts and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a narrow dimension is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` as it is.

    The count stops at ``max_rows + 1`` rows. Beyond the bound Spark picks a shuffled join and AQE
    splits its skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by the session; only local sessions may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidegauge-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"


def running_totals(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with ``<column>_before``, the sum of a column over the rows of its key that come before it.

    Rows of a key differ in ``order``. A key of any size is spread over ranges of (key, order): sums run
    inside a range, and what came before it is one row for each key and range.
    """
    rows = df.repartitionByRange(*(F.col(c) for c in (*key, order))).withColumn("_range", F.spark_partition_id())
    rows = cut_lineage(rows)  # ranges are sampled; rows and totals must see the same ones
    inside = Window.partitionBy("_range", *key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range", *key).agg(*(F.sum(c).alias(c) for c in columns))
    totals = totals.select("_range", *key, *(F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(f"_{c}_to") for c in columns))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_range", *key)]
    joined = rows.alias("a").join(bounded_broadcast(totals).alias("b"), same).select("a.*", *(f"b._{c}_to" for c in columns))
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}_to") for c in columns}
    return joined.withColumns(sums).drop("_range", *(f"_{c}_to" for c in columns))
