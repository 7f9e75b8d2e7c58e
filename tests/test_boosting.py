"""Staged boosting against a plain walk over its rounds."""

import math
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hotgrid.operators import boosting
from hotgrid.operators.boosting import Plan
from hotgrid.sources import layers

SMALL = Plan(rounds=9, patience=3, stage=3, step=0.3, depth=2, least_rows=2)


def slow_ap(scores, labels):
    at, tp, out, p = 0, 0, 0.0, sum(labels)
    for s in sorted(set(scores), reverse=True):
        same = [y for x, y in zip(scores, labels, strict=True) if x == s]
        at, tp = at + len(same), tp + sum(same)
        out += sum(same) * tp / at
    return out / p if p else 0.0


def _rows(spark, n=300):
    rnd = random.Random(1)
    data = []
    for i in range(n):
        x = [rnd.random() for _ in range(4)]
        data.append((Vectors.dense(x), int(x[0] + 0.4 * rnd.random() > 0.8), i % 3 == 0, 1.0 + (i % 2)))
    return spark.createDataFrame(data, ["features", "y", "is_validation", "w"])


def test_curve_of_average_precision(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([0.1, 0.2, 0.25, rnd.random(), 1.0]), int(rnd.random() < 0.3)) for k in range(4) for _ in range(200)] + [(9, 0.5, 0)]
    got = {r.k: r.ap for r in boosting.precision_curve(spark.createDataFrame(rows, "k int, score double, y int"), "k", "score", "y").collect()}
    for k in (0, 1, 2, 3, 9):
        assert math.isclose(got[k], slow_ap([s for q, s, _ in rows if q == k], [y for q, _, y in rows if q == k]), abs_tol=1e-12)


@pytest.mark.parametrize("curve, patience, want", [([0.1, 0.3, 0.2, 0.3, 0.1, 0.9], 3, (2, 5)), ([0.1, 0.3, 0.2, 0.3, 0.4], 3, (5, 5)), ([0.5], 1, (1, 1)), ([0.0, 0.0, 0.0], 2, (1, 3))])
def test_patience(curve, patience, want):
    assert boosting.best_round(curve, patience) == want


def test_stages_are_kept_and_the_best_rounds_are_given_back(spark, tmp_path, monkeypatch):
    rows, path = _rows(spark), str(tmp_path / "run")
    made = []
    stage = boosting._stage
    monkeypatch.setattr(boosting, "_stage", lambda rows, label, weight, plan, first: made.append(first) or stage(rows, label, weight, plan, first))
    one = boosting.boost(rows, path, "y", Plan(**{**SMALL.__dict__, "rounds": 3}), "w")
    assert made == [1] and one.counted == 3 and one.model.getNumTrees == one.best
    two = boosting.boost(rows, path, "y", SMALL, "w")
    assert 1 not in made[1:] and made[1:] == sorted(set(made[1:]))
    again = boosting.boost(rows, path, "y", SMALL, "w")
    assert (again.best, again.counted) == (two.best, two.counted) and len(made) == len(set(made))
    # the whole curve by hand, from the trees of all stages
    held = rows.where("is_validation")
    trees = [t for f in made for t in boosting.GBTRegressionModel.load(f"{path}/stage-{f:05d}-3/trees").trees]
    labels, vectors = zip(*[(r.y, r.features) for r in held.collect()], strict=True)
    curve = []
    for k in range(1, len(trees) + 1):
        margins = [sum(SMALL.step * t.predict(v) for t in trees[:k]) for v in vectors]
        curve.append(slow_ap([1 / (1 + math.exp(-2 * m)) for m in margins], labels))
    table = boosting.curve_table(spark, path, SMALL).orderBy("round").collect()
    assert (two.best, two.counted) == boosting.best_round(curve, SMALL.patience)
    assert [r.round for r in table] == list(range(1, two.counted + 1)) and [r.round for r in table if r.is_best] == [two.best]
    assert all(math.isclose(r.ap, c, abs_tol=1e-9) for r, c in zip(table, curve, strict=False))
    got = two.model.transform(held).select("probability", "features").collect()
    for r in got:
        m = sum(SMALL.step * t.predict(r.features) for t in trees[: two.best])
        assert math.isclose(r.probability[1], 1 / (1 + math.exp(-2 * m)), abs_tol=1e-9)


def test_nodes_of_saved_trees(spark, tmp_path):
    got = boosting.boost(_rows(spark), str(tmp_path / "run"), "y", SMALL, "w")
    got.model.save(str(tmp_path / "model"))
    nodes = boosting.tree_nodes(str(tmp_path / "model"), spark)
    counts = {r.feature: r.n for r in nodes.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    told = [line.split("feature ")[1].split()[0] for t in got.model.trees for line in t.toDebugString.splitlines() if "If (feature" in line]
    assert counts == {int(f): told.count(f) for f in set(told)}
    gains = {r.feature: r.g for r in nodes.groupBy("feature").agg(F.sum(F.col("gain") * F.col("count")).alias("g")).collect()}
    own = got.model.featureImportances.toArray()
    assert all(math.isclose(g / sum(gains.values()), own[f], abs_tol=1e-9) for f, g in gains.items())


def test_no_positive_and_no_validation_rows(spark, tmp_path):
    rows = _rows(spark, 60)
    none = boosting.boost(rows.withColumn("y", F.when(F.col("is_validation"), 0).otherwise(F.col("y"))), str(tmp_path / "a"), "y", SMALL)
    assert (none.best, none.counted) == (1, 4)
    assert boosting.boost(rows.withColumn("is_validation", F.lit(False)), str(tmp_path / "b"), "y", SMALL).best == 1


def test_a_layer_of_overwritten_files_is_made_again(spark, tmp_path):
    source = str(tmp_path / "t")
    spark.range(3).write.parquet(source)
    read = lambda: layers.layer(spark, source, "copy", lambda: spark.read.parquet(source)).count()
    assert read() == 3 and read() == 3
    spark.range(50).write.mode("overwrite").parquet(source)
    assert read() == 50
    spark.range(1).write.mode("append").parquet(source)
    assert read() == 51
