"""Exact medians by range counts against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotgrid.operators import medians as M


def _columns(rnd, n):
    pick = lambda values: [rnd.choice(values) for _ in range(n)]
    return {
        "normal": [rnd.gauss(0, 1) for _ in range(n)],
        "spread": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(n)],
        "mostly_zero": pick([0.0] * 5 + [1.5]),
        "halves": [float(i % 2) for i in range(n)],
        "constant": [7.25] * n,
        "holes": pick([None, math.nan, math.inf, -math.inf, 3.0, 4.0, 5.5]),
        "nothing": pick([None, math.nan]),
        "near": [1.0 + rnd.randrange(9) * 2**-52 for _ in range(n)],
    }


@pytest.mark.parametrize("n", [0, 1, 2, 5, 700, 701])
@pytest.mark.parametrize("few", [1, 5000])
def test_equal_to_numpy(spark, n, few):
    data = _columns(random.Random(n), n)
    rows = list(zip(*data.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(3)
    got = M.medians(df, list(data), few)
    for c, values in data.items():
        own = [v for v in values if v is not None and math.isfinite(v)]
        assert got[c] == (float(np.median(own)) if own else None), c


def test_each_pass_narrows(spark):
    df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("x"))
    passes = []
    counts = M._counts
    M._counts = lambda c, s: passes.append((s.low, s.high)) or counts(c, s)
    try:
        got = M.medians(df, ["x"], few=50)
    finally:
        M._counts = counts
    assert got["x"] == df.agg(F.percentile("x", 0.5).alias("m")).first()["m"] and len(passes) <= 5


def test_fill(spark):
    df = spark.createDataFrame([(math.nan, None, 1), (2.0, math.inf, 2)], "a double, b double, c int")
    assert [tuple(r) for r in M.fill(df, {"a": 0.5, "b": None}).collect()] == [(0.5, 0.0, 1), (2.0, 0.0, 2)]


@pytest.mark.parametrize("narrow", [0, 99])
def test_ranked_together_and_one_by_one(spark, monkeypatch, narrow):
    monkeypatch.setattr(M, "NARROW", narrow)
    data = _columns(random.Random(8), 501)
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data)).repartition(3)
    own = {c: [v for v in values if v is not None and math.isfinite(v)] for c, values in data.items()}
    assert M.medians(df, list(data), few=1) == {c: float(np.median(v)) if v else None for c, v in own.items()}


def test_jobs_do_not_grow_with_columns(spark):
    """Forty columns a pass, with several passes, took minutes for the some hundred features of a model."""

    def jobs(columns):
        group = f"medians-{columns}"
        spark.sparkContext.setJobGroup(group, group)
        df = spark.range(30_000).select(*[((F.col("id") * (i + 7)) % 29_989).cast("double").alias(f"c{i}") for i in range(columns)])
        M.medians(df, df.columns)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(90) <= jobs(9) + 2
