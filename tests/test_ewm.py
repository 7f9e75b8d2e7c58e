"""Exponentially weighted means over long histories against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hotgrid.operators import features


@pytest.mark.parametrize("days", [1, 7, 256])
def test_twenty_years_equal_pandas(spark, days):
    rnd = np.random.default_rng(3)
    n = {"a": 7305, "b": 2, "c": 1, "d": 513, "e": 0} if days > 1 else {"a": 40, "b": 3}
    values = {k: rnd.poisson(0.7, m) * (rnd.random(m) < 0.5) for k, m in n.items()}
    if days > 1:
        values["a"][0] = 10**6  # an outlier at the start, and years of nothing
        values["a"][3000:5000] = 0
    rows = [(k, i, int(x)) for k, v in values.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "cell string, _t int, crimes long").repartition(3)
    got = features.ewm(df, features.SPANS, days=days).toPandas().sort_values(["cell", "_t"])
    for k, v in values.items():
        own = got[got.cell == k]
        for s in features.SPANS:
            want = pd.Series(v, dtype=float).shift(1).ewm(span=s, adjust=False, min_periods=2).mean().to_numpy()
            assert np.allclose(own[f"ewm_{s}"].to_numpy(float), want, rtol=1e-9, atol=1e-12, equal_nan=True), (k, s)


def test_no_rows_and_one_task_a_stretch(spark):
    df = spark.range(3000).select(F.lit("a").alias("cell"), F.col("id").alias("_t"), (F.col("id") % 3).alias("crimes"))
    assert features.ewm(df.limit(0), (7,)).collect() == []
    plan = features.ewm(df, (7,))._jdf.queryExecution().executedPlan().toString()
    assert "_stretch" in plan
    assert features.ewm(df, (7,)).where("ewm_7 is null").count() == 2


def test_short_histories_are_exact(spark):
    values = [35, 12, 61, 7, 48, 19, 33, 26, 90, 4, 77, 58]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(values)], "cell string, _t int, crimes long")
    got = {r._t: r.ewm_7 for r in features.ewm(df, (7,)).collect()}
    mean, want = float(values[0]), {0: None, 1: None}
    for i, x in enumerate(values[1:], 1):
        want |= {i: mean} if i >= 2 else {}
        mean += 0.25 * (x - mean)
    assert got == want
