"""Methods on every scenario, judged row by row."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.select import _choose
from tidegauge.plans import judge, reference, reference_more
from tidegauge.plans.trials import Trials

SMALL, TENTH = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def written(spark):
    """Checkpoints and bytes below the checkpoint folder."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        return 0, 0
    top = folder.get().removeprefix("file:")
    files = [f for f in glob.glob(f"{top}/**/*", recursive=True) if os.path.isfile(f)]
    return len(glob.glob(f"{top}/rdd-*")), sum(map(os.path.getsize, files))


def rounded(df):
    best = F.transform("top_candidates", lambda c: F.struct(c["service"], F.round(c["score"], 6)))
    return df.withColumn("top_candidates", best).withColumn("latency_s", F.round("latency_s", 6))


@pytest.mark.parametrize("query", [reference.e4_cost, reference_more.e16_validation, reference.e18_latency_cdf, reference_more.e20_complete, reference.e1_attribution, reference_more.e5_bootstrap])
def test_trials_write_no_series(spark, query):
    n = spark.read.parquet(f"{TENTH}/scenarios.parquet").count()
    reference.g12_degrees(spark, SMALL)  # there is a checkpoint folder
    _, before = written(spark)
    query(spark, TENTH).collect()
    assert written(spark)[1] - before < 2000 * n


def test_trials_are_those_of_joins(spark):
    trials = Trials(spark, SMALL)
    new, old = rounded(trials.results), rounded(trials.joined)
    assert new.dtypes == old.dtypes and new.count() == 7 * trials.incidents.count() > 0
    assert not new.exceptAll(old).count() and not old.exceptAll(new).count()


def test_choices_of_a_batch():
    rng = np.random.default_rng(3)
    rows = [rng.random(rng.integers(1, 25)) for _ in range(200)]
    cells = [np.full((len(rows), 25), fill) for fill in (0.0, 0.0, 30.0, True)]
    want = []
    for i, p in enumerate(rows):
        own = p, rng.random(len(p)), rng.choice([20.0, 30.0, 60.0, 700.0], len(p)), rng.random(len(p)) < 0.3
        for cell, values in zip(cells, own, strict=True):
            cell[i, : len(p)] = values
        taken, _ = _choose(0.5, 600.0, own[0], own[1], own[2], own[3])
        places = [x[0] for x in taken if x[0] is not None]
        want.append((len(places), own[2][places].sum()))
    n, spent = judge.chosen(*cells)
    assert list(zip(n.tolist(), spent.tolist(), strict=True)) == want
