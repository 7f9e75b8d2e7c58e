"""A stored run: what was learned and how good it is, as tables and models in one folder, and its use without a fit.

    models/<name>   the ensembles, cut to their best rounds      stages/<name>   their rounds, to go on with
    features        model, feature, its place and its median     splits          first and last day, days, rows, label rates
    thresholds      of each bucket's score and of the blend      metrics         of the validation and the test days
    about           one row: version, target, time, weights
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions.exprs import safe_ratio, version_label
from hotgrid.functions.rules import bucket
from hotgrid.operators import evaluate, learn, rank
from hotgrid.operators.boosting import Boosted, Plan, boost, tree_nodes, vector
from hotgrid.operators.medians import fill, medians
from hotgrid.sources.layers import discard, together, written

TYPES = {"violent_probability": "next_violent", "property_probability": "next_property"}
MODELS = (*learn.BUCKETS, *TYPES)
TARGET = "next_hotspot = next_total >= 2"
#: The shares of a day's cells whose recall and lift are part of the metrics.
SHARES = {0.05: "top05", 0.15: "top15", 0.30: "top30"}


def features_of(model: str, names: list[str]) -> list[str]:
    """A bucket's own features; models of types have those of context and time."""
    kinds = (model,) if model in learn.BUCKETS else ("context", "temporal")
    return [n for n in names if bucket(n) in kinds]


def _type_weight(rows: DataFrame, label: str) -> float:
    n = rows.where("split = 'train'").agg(F.sum(label).alias("pos"), F.count("*").alias("n")).first()
    return float(min(10.0, ((n["n"] - (n["pos"] or 0)) / max(n["pos"] or 0, 1)) ** 0.7))


def split_table(frame: DataFrame) -> DataFrame:
    """(split, first, last, days, n, has_crime_rate, hotspot_rate, violent_rate, property_rate) of the rows with a label."""
    rate = lambda c: F.avg(f"next_{c}").alias(f"{c}_rate")
    rows = frame.where("next_total is not null")
    return rows.groupBy("split").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("days"), F.count("*").alias("n"), *map(rate, ("has_crime", "hotspot", "violent", "property")))


def split_metrics(scored: DataFrame, label: str, threshold: float, splits: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(split, precision, recall, f1, auc, ap, predicted_rate, base_rate, topNN_recall, topNN_lift) of each split."""
    out = None
    for s in splits:
        rows = scored.where(F.col("split") == s)
        top = evaluate.daily_topk(rows, "score", label, tuple(SHARES))
        pick = lambda k, c, n: F.max(F.when(F.abs(F.col("k") - k) < 1e-9, F.col(c))).alias(f"{n}_{c}")
        wide = top.agg(*[pick(k, c, n) for k, n in SHARES.items() for c in ("recall", "lift")])
        one = evaluate.ranker_metrics(rows, "score", label, threshold).crossJoin(wide).withColumn("split", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def train(frame: DataFrame, path: str, made: str, plan: Plan = Plan(), cfg: Config = Config(), label: str = "next_hotspot") -> None:
    """Fit the three models of the blend and the two of types, and store the run in ``path``.

    ``frame`` has features, targets and ``split``. A run that ended early goes on where it was when it is called again with
    the same rows. Medians are those of the training rows and fill what a feature lacks there and later.
    """
    spark, names = frame.sparkSession, learn.select(frame)
    middle = medians(frame.where("split = 'train' and next_total is not null"), names)
    rows = frame.where(F.col(label).isNotNull() & F.col("split").isin("train", "calib"))
    rows = rows.withColumns({"is_validation": F.col("split") == "calib", "weight": evaluate.sample_weight(label)})
    known = written(fill(rows, middle).select(*names, label, *TYPES.values(), "split", "is_validation", "weight"), "known")
    kept = []

    def fit(model: str) -> Boosted:
        own, target = features_of(model, names), TYPES.get(model, label)
        weight = F.col("weight") if model in learn.BUCKETS else F.when(F.col(target) == 1, _type_weight(known, target)).otherwise(1.0)
        fitted = boost(known.select(vector(own).alias("features"), F.col(target).alias("label"), "is_validation", weight.alias("weight")), f"{path}/stages/{model}", "label", plan, "weight")
        fitted.model.write().overwrite().save(f"{path}/models/{model}")
        return fitted

    for model, fitted in together(spark, {model: lambda model=model: fit(model) for model in MODELS}).items():
        kept += [(model, f, i, middle[f], fitted.best, fitted.counted) for i, f in enumerate(features_of(model, names))]
    table = spark.createDataFrame(kept, "model string, feature string, place int, median double, rounds int, counted int")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    split_table(frame).coalesce(1).write.mode("overwrite").parquet(f"{path}/splits")
    discard(known)

    held = written(score(spark, path, frame.where(F.col(label).isNotNull() & F.col("split").isin("calib", "val", "test")), cfg).select("cell", "date", "split", label, "score", *learn.BUCKETS), "held")
    cut = lambda s: evaluate.best_threshold(evaluate.threshold_grid(held.where("split = 'calib'"), s, label)).first()["threshold"]
    cuts = list(together(spark, {s: lambda s=s: cut(s) for s in (*learn.BUCKETS, "score")}).items())
    spark.createDataFrame(cuts, "score string, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/thresholds")
    split_metrics(held, label, dict(cuts)["score"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
    about = {"version": version_label(F.lit(made).cast("timestamp")), "made": F.lit(made), "target": F.lit(TARGET), "rows": F.lit(known_rows(path, spark))} | {f"w_{n}": F.lit(w) for n, w in zip(learn.BUCKETS, cfg.blend, strict=True)}
    spark.range(1).select(*[c.alias(n) for n, c in about.items()]).coalesce(1).write.mode("overwrite").json(f"{path}/about")
    discard(held)


def known_rows(path: str, spark: SparkSession) -> int:
    """Rows that the models were fitted and stopped with."""
    return spark.read.parquet(f"{path}/splits").where("split in ('train', 'calib')").agg(F.sum("n").alias("n")).first()["n"] or 0


def score(spark: SparkSession, path: str, rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``rows`` with each model's chance and the blend ``score``, from the stored run alone."""
    table = spark.read.parquet(f"{path}/features").orderBy("model", "place").collect()  # some hundred rows
    filled = fill(rows.select(*[F.col(f).alias(f"_{f}") for f in {r.feature for r in table}], *rows.columns), {f"_{r.feature}": r["median"] for r in table})
    for model in MODELS:
        filled = filled.withColumn("_features", vector([f"_{r.feature}" for r in table if r.model == model]))
        found = GBTClassificationModel.load(f"{path}/models/{model}").setFeaturesCol("_features").setProbabilityCol("_chance").setRawPredictionCol("").setPredictionCol("")
        filled = found.transform(filled).withColumn(model, vector_to_array("_chance")[1]).drop("_features", "_chance")
    out = filled.select(*rows.columns, *MODELS)
    return out.withColumn("score", sum(F.col(n) * w for n, w in zip(learn.BUCKETS, cfg.blend, strict=True)))


def threshold(spark: SparkSession, path: str) -> float:
    return spark.read.parquet(f"{path}/thresholds").where("score = 'score'").first()["threshold"]


def stamps(metrics: DataFrame) -> DataFrame:
    """One row: the metrics of the validation and the test days under the names of the predictions table, to four places."""
    names = ("auc", "ap", "f1", *[f"{n}_{c}" for n in SHARES.values() for c in ("recall", "lift")])
    pick = lambda s, n: F.round(F.max(F.when(F.col("split") == s, F.col(n))), 4).alias(f"{s}_{n}")
    return metrics.agg(*[pick(s, n) for s in ("val", "test") for n in names])


def latest(rows: DataFrame) -> DataFrame:
    """The rows of the last day."""
    return rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date", "left_semi")


def predict(spark: SparkSession, path: str, rows: DataFrame, areas: DataFrame, made: str, cfg: Config = Config()) -> DataFrame:
    """The predictions table of feature rows (of some days that are not known yet), by the stored run: nothing is fitted."""
    scored = score(spark, path, rows, cfg)
    return rank.full_predictions(scored, threshold(spark, path), made, stamps(spark.read.parquet(f"{path}/metrics")), areas, cfg)


def summary(spark: SparkSession, path: str, predictions: DataFrame) -> DataFrame:
    """One row: the run's metrics, label rates, threshold and version, and how its predictions are spread over the levels."""
    counts = predictions.agg(F.count("*").alias("n_predictions"), *[F.count_if(F.col("risk_level") == k).alias(f"n_{k.lower()}") for k in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])
    rates = spark.read.parquet(f"{path}/splits").groupBy().pivot("split", ["train", "calib", "val", "test"]).agg(F.first("hotspot_rate")).toDF(*[f"{s}_hotspot_rate" for s in ("train", "calib", "val", "test")])
    cut = spark.read.parquet(f"{path}/thresholds").where("score = 'score'").select("threshold")
    out = stamps(spark.read.parquet(f"{path}/metrics"))
    for one in (rates, cut, counts, spark.read.json(f"{path}/about")):
        out = out.crossJoin(F.broadcast(one))
    return out.withColumn("path", F.lit(path))


def importances(spark: SparkSession, path: str) -> DataFrame:
    """(model, feature, gain, splits, share): from the node tables of the stored models.

    gain is the sum, over the nodes that split by a feature, of the gain times the rows there; share is of the model's.
    """
    out = None
    for model in MODELS:
        nodes = tree_nodes(f"{path}/models/{model}", spark).groupBy("feature").agg(F.sum(F.col("gain") * F.col("count")).alias("gain"), F.count("*").alias("splits"))
        one = nodes.withColumnRenamed("feature", "place").withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    total = out.groupBy("model").agg(F.sum("gain").alias("total"))
    named = spark.read.parquet(f"{path}/features").select("model", "feature", "place")
    joined = named.join(out, ["model", "place"], "left").join(F.broadcast(total), "model", "left").na.fill(0, ["gain", "splits", "total"])
    return joined.select("model", "feature", "gain", "splits", safe_ratio(F.col("gain"), F.col("total")).alias("share"))
