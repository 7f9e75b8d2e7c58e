"""Boosted trees in stages that can be resumed, stopped by average precision on held-back days.

Spark's own boosting stops by its loss only and starts from nothing each time. Here a round is one regression tree on the
loss's gradient. A stage is some rounds: its trees and the average precision after each of them are
written before the next begins, so that a run which ends early goes on with the first stage that is not there, and one with
more rounds than before keeps those that it has. The ensemble that is given back is Spark's own kind, cut to its best rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotgrid.sources.layers import discard, exists, written


#: Rows of a task of a round.
TASK_ROWS = 8192


@dataclass(frozen=True)
class Plan:
    """How many rounds at most, how many without a better average precision end them, and what a round does."""

    rounds: int = 2200
    patience: int = 150
    stage: int = 20
    step: float = 0.05
    depth: int = 5
    least_rows: int = 30
    row_share: float = 0.9
    feature_share: float = 0.6
    seed: int = 42


@dataclass
class Boosted:
    """The ensemble cut to its best rounds, that number, and the rounds that were counted until patience ended."""

    model: GBTClassificationModel
    best: int
    counted: int


def precision_curve(scored: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """(by, ap): exact average precision of each group of ``scored``; rows of equal score count at once.

    ``score`` is a chance. Rows are counted by score first; running sums go over the distinct scores of one of 1,000 ranges, and
    the ranges above are added from a table of totals, so that no task has all scores of a group.
    """
    counted = scored.groupBy(by, score).agg(F.sum(label).cast("double").alias("pos"), F.count("*").alias("n"))
    counted = counted.withColumn("range", F.greatest(F.lit(0), F.least(F.lit(999), F.floor(F.col(score) * 1000))))
    above = Window.partitionBy(by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = counted.groupBy(by, "range").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))  # 1,000 rows a group at most
    totals = totals.select(by, "range", over("rp", above).alias("p_above"), over("rn", above).alias("n_above"))
    down = Window.partitionBy(by, "range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(totals, [by, "range"])
    part = F.col("pos") * (F.col("p_above") + F.sum("pos").over(down)) / (F.col("n_above") + F.sum("n").over(down))
    ranked = ranked.select(by, "pos", part.alias("part"))
    return ranked.groupBy(by).agg(F.when(F.sum("pos") > 0, F.sum("part") / F.sum("pos")).otherwise(0.0).alias("ap"))


def best_round(curve: list[float], patience: int) -> tuple[int, int]:
    """(best, counted) of the rounds' average precision, from 1 on: the first best one before ``patience`` rounds without a better."""
    best, at = -math.inf, 0
    for i, ap in enumerate(curve, 1):
        if ap > best:
            best, at = ap, i
        elif i - at >= patience:
            return at, i
    return at, len(curve)


def _ensemble(spark: SparkSession, trees: list[DecisionTreeRegressionModel], step: float, kind: type):
    """Trees of equal weight as an ensemble of Spark's, a GBTRegressionModel or a GBTClassificationModel."""
    sc = spark.sparkContext
    made, weights = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees)), sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, t in enumerate(trees):
        made[i], weights[i] = t._java_obj, float(step)
    pack = sc._jvm.org.apache.spark.ml.regression if kind is GBTRegressionModel else sc._jvm.org.apache.spark.ml.classification
    return kind(getattr(pack, kind.__name__)(f"boosted_{len(trees)}", made, weights))


def _gradient(label: str) -> Column:
    """What is left of log(1 + exp(-2 y F)), with y of -1 and 1: 4y / (1 + exp(2 y F))."""
    y = F.col(label) * 2 - 1
    return 4 * y / (1 + F.exp(2 * y * F.col("margin")))


def _with_margin(spark: SparkSession, rows: DataFrame, trees: list, step: float) -> DataFrame:
    """``rows`` with ``margin``, raised by the trees."""
    if not trees:
        return rows
    raised = _ensemble(spark, trees, step, GBTRegressionModel).transform(rows)
    return raised.withColumn("margin", F.col("margin") + F.col("prediction")).drop("prediction")


def _stage(rows: DataFrame, label: str, weight: str | None, plan: Plan, first: int) -> list:
    """The trees of the rounds of a stage, the first of which is number ``first``; ``rows`` has the margin so far."""
    spark, trees = rows.sparkSession, []
    for number in range(first, min(first + plan.stage, plan.rounds + 1)):
        now = _with_margin(spark, rows, trees, plan.step).withColumn("left", _gradient(label))
        one = RandomForestRegressor(numTrees=1, bootstrap=False, labelCol="left", maxDepth=plan.depth, minInstancesPerNode=plan.least_rows, subsamplingRate=plan.row_share, featureSubsetStrategy=str(plan.feature_share), seed=plan.seed + number)
        trees.append((one.setWeightCol(weight) if weight else one).fit(now).trees[0])
    return trees


def _after_each(rows: DataFrame, trees: list, step: float, first: int) -> DataFrame:
    """(round, score, label) of each row after each of the trees."""
    margins, so_far = [], F.col("margin")
    for i, tree in enumerate(trees):
        rows = tree.setPredictionCol(f"_t{i}").transform(rows)
        so_far = so_far + step * F.col(f"_t{i}")
        margins.append(F.struct(F.lit(first + i).alias("round"), (1 / (1 + F.exp(-2 * so_far))).alias("score")))
    return rows.select("label", F.explode(F.array(*margins)).alias("r")).select("r.*", "label")


def _stages(path: str, plan: Plan) -> Iterator[tuple[int, str]]:
    """(first round, folder) of the stages that a plan has."""
    return ((first, f"{path}/stage-{first:05d}-{min(plan.stage, plan.rounds + 1 - first)}") for first in range(1, plan.rounds + 1, plan.stage))


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in tasks of some thousand: a round is many short jobs, for which one task is as slow as many small ones."""
    return rows.repartition(max(1, math.ceil(rows.count() / TASK_ROWS)))


def boost(rows: DataFrame, path: str, label: str, plan: Plan = Plan(), weight: str | None = None) -> Boosted:
    """Fit rows with ``features`` (a vector), ``label`` of 0 and 1, ``is_validation`` and perhaps a weight.

    Rows that are no validation are fitted; after each round the average precision of the others is taken, and
    the first best round before ``plan.patience`` rounds without a better one is kept. ``path`` holds the stages: those that are
    there are not fitted again. It must not be used for other rows or another plan but for one of more rounds or
    another patience. Without a positive among the validation rows every round is as good, so one is kept.
    """
    spark = rows.sparkSession
    known = rows.select("features", F.col(label).cast("double").alias("label"), "is_validation", *([F.col(weight).cast("double").alias("weight")] if weight else []), F.lit(0.0).alias("margin"))
    trees: list[DecisionTreeRegressionModel] = []
    curve: list[float] = []
    for first, folder in _stages(path, plan):
        # the curve is written last, so a stage with one is whole
        if not exists(spark, f"{folder}/curve/_SUCCESS"):
            now = written(_with_margin(spark, known, trees, plan.step), "stage")
            fitted = _spread(now.where("not is_validation")).persist()  # a round goes over them some times
            made = _stage(fitted, "label", "weight" if weight else None, plan, first)
            fitted.unpersist()
            _ensemble(spark, made, plan.step, GBTRegressionModel).write().overwrite().save(f"{folder}/trees")
            found = precision_curve(_after_each(now.where("is_validation"), made, plan.step, first), "round", "score", "label")
            found.coalesce(1).write.mode("overwrite").parquet(f"{folder}/curve")
            discard(now)
        trees += GBTRegressionModel.load(f"{folder}/trees").trees
        curve += _read_curve(spark, folder, len(trees) - len(curve), first)
        best, counted = best_round(curve, plan.patience)
        if counted - best >= plan.patience:
            break
    return Boosted(_ensemble(spark, trees[:best], plan.step, GBTClassificationModel), best, counted)


def _read_curve(spark: SparkSession, folder: str, n: int, first: int) -> list[float]:
    found = {r["round"]: r["ap"] for r in spark.read.parquet(f"{folder}/curve").collect()}
    return [found.get(first + i, 0.0) for i in range(n)]  # no rows of validation: nothing is found


def curve_table(spark: SparkSession, path: str, plan: Plan) -> DataFrame:
    """(round, ap, best_so_far, since_best, is_best) of the rounds that a run counted, from its folder."""
    folders = [f for _, f in _stages(path, plan) if exists(spark, f"{f}/curve/_SUCCESS")]
    rounds = spark.read.parquet(*[f"{f}/curve" for f in folders])
    up = Window.partitionBy(F.lit(0)).orderBy("round")  # as many rows as rounds
    best = F.max_by(-F.col("round"), F.struct("ap", -F.col("round"))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    seen = rounds.withColumn("best_so_far", -best).withColumn("since_best", F.col("round") - F.col("best_so_far"))
    over = F.max((F.col("since_best") >= plan.patience).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, -1))
    kept = seen.withColumn("over", F.coalesce(over, F.lit(0))).where("over = 0").drop("over")
    return kept.withColumn("is_best", F.col("round") == F.max("best_so_far").over(Window.partitionBy(F.lit(0))))


def vector(columns: list[str]) -> Column:
    """A vector of the columns, nulls as they are not allowed there: fill them first."""
    return array_to_vector(F.array(*[F.col(c).cast("double") for c in columns]))


def tree_nodes(model_path: str, spark: SparkSession) -> DataFrame:
    """(tree, feature, gain, count) of the inner nodes of a saved ensemble's trees, from its own tables; rows count by their weight.

    The tables' layout is that of Spark ML's persistence: one row a node, with the tree's number.
    """
    nodes = spark.read.parquet(f"{model_path}/data")
    node = F.col("nodeData")
    inner = nodes.where(node["leftChild"] >= 0)
    return inner.select(F.col("treeID").alias("tree"), node["split"]["featureIndex"].alias("feature"), node["gain"].alias("gain"), node["impurityStats"][0].alias("count"))
