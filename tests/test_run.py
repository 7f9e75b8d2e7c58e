"""A stored run is used without a fit, and its tables are those of its models."""

import math

import pytest
from pyspark.ml.classification import GBTClassificationModel

from hotgrid.operators import boosting, rank, run
from hotgrid.plans import queries as Q
from hotgrid.sources import tables


@pytest.fixture(scope="module")
def path(spark, sf):
    return Q._stored(spark, sf)


def test_scoring_fits_nothing_and_repeats(spark, sf, path, monkeypatch):
    def no(*a, **k):
        raise AssertionError("a model was fitted")

    monkeypatch.setattr(boosting, "_stage", no)
    one, two = (sorted(map(tuple, Q.QUERIES["stored_run_predictions"](spark, sf).collect()), key=str) for _ in range(2))
    assert one == two and len(one) == Q.run.latest(Q.frame(spark, sf)).count()
    names = [c.split()[0] for c in rank.FULL_PREDICTIONS.replace("\n", " ").split(", ")]
    table = run.predict(spark, path, run.latest(Q.frame(spark, sf)), Q.V.area_names(spark, sf), Q.MADE, Q.CFG)
    assert len(names) == 61 and table.columns == names
    row = table.first()
    assert all(row[c] is not None for c in names) and 0 < row.hotspot_score < 1
    # a run that is trained again with the same folder keeps its rounds
    run.train(Q.supervised(spark, sf), path, Q.MADE, Q.RUN_PLAN, Q.CFG)


def test_importances_are_those_of_the_models(spark, sf, path):
    got = {(r.model, r.feature): r.share for r in run.importances(spark, path).collect()}
    table = spark.read.parquet(f"{path}/features").collect()
    for name in run.MODELS:
        told = GBTClassificationModel.load(f"{path}/models/{name}").featureImportances.toArray().tolist()
        own = sorted((r for r in table if r.model == name), key=lambda r: r.place)
        told += [0.0] * (len(own) - len(told))  # an ensemble made of trees knows features up to the last that splits
        assert all(math.isclose(got[name, r.feature], t, abs_tol=1e-9) for r, t in zip(own, told, strict=True))


def test_summary_and_curve(spark, sf, path):
    s = Q.QUERIES["stored_run_summary"](spark, sf).collect()
    assert len(s) == 1 and s[0].n_predictions == s[0].n_critical + s[0].n_high + s[0].n_medium + s[0].n_low > 0
    best = {r.model: r.rounds for r in spark.read.parquet(f"{path}/features").select("model", "rounds").distinct().collect()}
    curve = Q.QUERIES["boosting_curve"](spark, sf).collect()
    assert {r.model: r["round"] for r in curve if r.is_best} == best


def test_predictions_are_replaced_or_appended(spark, tmp_path):
    df = spark.createDataFrame([("2001-01-01", "a"), ("2001-01-02", "b")], "d string, cell string").selectExpr("cast(d as date) prediction_date", "cell")
    path = str(tmp_path / "p")
    read = lambda: sorted((str(r.prediction_date), r.cell) for r in spark.read.parquet(path).collect())
    tables.write_predictions(df, path)
    for _ in range(2):
        tables.write_predictions(df.where("cell = 'b'").selectExpr("prediction_date", "'c' cell"), path, "append")
    assert read() == [("2001-01-01", "a"), ("2001-01-02", "c")]
    tables.write_predictions(df.where("cell = 'b'"), path)
    assert read() == [("2001-01-02", "b")]
    with pytest.raises(ValueError):
        tables.write_predictions(df, path, "x")


def test_models_are_fitted_together(spark):
    """Five fits of many small jobs, one after another, were most of a run's time: each waits here for the others to begin."""
    import threading

    from hotgrid.sources.layers import together

    begun = threading.Barrier(len(run.MODELS), timeout=60)
    assert together(spark, {m: lambda m=m: (begun.wait(), m)[1] for m in run.MODELS}) == {m: m for m in run.MODELS}
