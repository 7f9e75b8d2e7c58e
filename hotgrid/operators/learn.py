"""Three boosted-tree models on feature buckets, blended; importances and ablation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions.rules import ABLATION, ABLATION_REST, BLEND, BLEND_REST, FAMILY, FAMILY_REST, GUARDED, bucket, label_column
from hotgrid.operators.evaluate import sample_weight
from hotgrid.sources.layers import together, written

#: Boosting rounds at most, of which early stopping leaves fewer, and the depth of their trees.
ROUNDS, DEPTH = 60, 4
#: Columns that are no features.
NO_FEATURES = frozenset("cell date split is_validation weight".split())
#: Features that each bucket of the blend has at least.
LEAST_FEATURES = 5
BUCKETS = ("temporal", "spatial", "context")


def candidates(df: DataFrame) -> list[str]:
    """The numeric columns that are no keys, targets or guarded."""
    return [n for n, t in df.dtypes if t in ("int", "bigint", "double") and n not in NO_FEATURES | GUARDED and not n.startswith("next_")]


def profile(df: DataFrame) -> DataFrame:
    """(feature, n, lo, hi, kept, bucket, ablation_group, family) of the candidates over supervised training rows: one pass.

    A feature is kept that has a value there, and more than one.
    """
    names = candidates(df)
    rows = df.where("split = 'train' and next_total is not null")
    # a group a column, as some hundred aggregates of one row take longer to plan than to count
    values = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("place", "x"))
    counted = values.groupBy("place").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    known = df.sparkSession.createDataFrame(list(enumerate(names)), "place int, feature string")
    out = known.join(F.broadcast(counted), "place", "left").na.fill(0, ["n"]).select("feature", "n", "lo", "hi").withColumn("kept", F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)))
    kinds = {"bucket": (BLEND, BLEND_REST), "ablation_group": (ABLATION, ABLATION_REST), "family": (FAMILY, FAMILY_REST)}
    return out.withColumns({n: label_column(F.col("feature"), *r) for n, r in kinds.items()})


def select(df: DataFrame, least: int = LEAST_FEATURES) -> list[str]:
    """The kept features of :func:`profile`; raises where a bucket of the blend has too few."""
    kept = {r.feature for r in profile(df).where("kept").select("feature").collect()}
    names = [n for n in candidates(df) if n in kept]
    for b in BUCKETS:
        if sum(bucket(n) == b for n in names) < least:
            raise ValueError(f"fewer than {least} features for {b}")
    return names


def fit(df: DataFrame, features: list[str], label: str, trees: int = ROUNDS, depth: int = DEPTH, weight: str | None = None) -> PipelineModel:
    """Medians of the training rows fill gaps; rows with ``is_validation`` stop the boosting early."""
    numeric = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label), "is_validation", *([weight] if weight else []))
    filled = [f"{f}__f" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")]
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.6", seed=7, validationIndicatorCol="is_validation")
    return Pipeline(stages=[*stages, gbt.setWeightCol(weight) if weight else gbt]).fit(numeric)


def score(df: DataFrame, model: PipelineModel, features: list[str], out: str, keep: list[str]) -> DataFrame:
    numeric = df.withColumns({f: F.col(f).cast("double") for f in features})
    return model.transform(numeric).withColumn(out, vector_to_array("probability")[1]).select(*keep, out)


def group_blend(df: DataFrame, features: list[str], label: str, cfg: Config = Config(), trees: int = ROUNDS) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """One model per bucket, on weighted rows, and the fixed blend of their scores; ``df`` has a column ``split``."""
    rows = df.where(F.col(label).isNotNull() & F.col("split").isin("train", "calib"))
    rows = written(rows.withColumns({"is_validation": F.col("split") == "calib", "weight": sample_weight(label)}).select(*features, label, "is_validation", "weight"), "fit")
    own = {name: [f for f in features if bucket(f) == name] for name in BUCKETS}
    models = together(df.sparkSession, {name: lambda name=name: fit(rows, own[name], label, trees, weight="weight") for name in BUCKETS})
    out = df
    for name in BUCKETS:
        out = score(out, models[name], own[name], name, out.columns)
    blended = sum(F.col(n) * w for n, w in zip(BUCKETS, cfg.blend, strict=True))
    return out.withColumn("score", blended), models


def type_models(df: DataFrame, features: list[str], trees: int = ROUNDS) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """``df`` with the chances that violent or property incidents lead tomorrow; positives weigh min(10, (neg / pos)^0.7)."""
    rows = df.where(F.col("next_total").isNotNull() & F.col("split").isin("train", "calib")).withColumn("is_validation", F.col("split") == "calib")
    rows = written(rows.select(*features, "next_violent", "next_property", "split", "is_validation"), "fit")
    out = df

    def one(label: str) -> PipelineModel:
        n = rows.where("split = 'train'").agg(F.sum(label).alias("pos"), F.count("*").alias("n")).first()
        up = min(10.0, ((n["n"] - n["pos"]) / max(n["pos"] or 0, 1)) ** 0.7)
        weighted = rows.withColumn("weight", F.when(F.col(label) == 1, float(up)).otherwise(1.0))
        return fit(weighted, features, label, trees, weight="weight")

    labels = {"violent_probability": "next_violent", "property_probability": "next_property"}
    models = together(df.sparkSession, {name: lambda label=label: one(label) for name, label in labels.items()})
    for name in labels:
        out = score(out, models[name], features, name, out.columns)
    return out, models


def split_counts(model: PipelineModel, n: int) -> list[int]:
    """How many inner nodes of a model's trees split on each of its n features."""
    found = [0] * n
    for tree in model.stages[-1].trees:
        for line in tree.toDebugString.splitlines():
            if line.strip().startswith("If (feature "):
                found[int(line.strip().split()[2])] += 1
    return found


def importances(spark: SparkSession, models: dict[str, PipelineModel], features: list[str], top: int = 30) -> DataFrame:
    """(bucket, feature, gain, splits, share, rank, in_top, n_top_models, family, family_share, dominates).

    share is of the bucket's gain; in_top the first ``top`` of a bucket by gain, and n_top_models the
    models that have the feature there; a family dominates with over 60 % of a bucket. A row for
    each feature of a model, some hundred.
    """
    rows = []
    for n, m in models.items():
        own = [f for f in features if bucket(f) == n] if n in BUCKETS else features
        rows += [(n, f, float(g), k) for f, g, k in zip(own, m.stages[-1].featureImportances.toArray(), split_counts(m, len(own)), strict=True)]
    df = spark.createDataFrame(rows, "bucket string, feature string, gain double, splits int").withColumn("family", label_column(F.col("feature"), FAMILY, FAMILY_REST))
    whole, kin = Window.partitionBy("bucket"), Window.partitionBy("bucket", "family")
    part = lambda x: F.when(F.sum("gain").over(whole) > 0, x / F.sum("gain").over(whole)).otherwise(0.0)
    df = df.withColumns({"share": part(F.col("gain")), "family_share": part(F.sum("gain").over(kin)), "rank": F.row_number().over(whole.orderBy(F.desc("gain"), "feature"))})
    df = df.withColumns({"in_top": (F.col("rank") <= top) & (F.col("gain") > 0), "dominates": F.col("family_share") > 0.6})
    return df.withColumn("n_top_models", F.sum(F.col("in_top").cast("int")).over(Window.partitionBy("feature")))


#: The six sets of buckets of the ablation.
SCENARIOS = {"spatial_only": "spatial", "context_only": "context", "temporal_only": "temporal", "temporal_spatial": "temporal spatial", "temporal_spatial_context": "temporal spatial context", "full": None}


def scenarios(features: list[str]) -> dict[str, list[str]]:
    return {name: [f for f in features if kind is None or bucket(f) in kind.split()] for name, kind in SCENARIOS.items()}


def ablation(df: DataFrame, features: list[str], label: str, trees: int = ROUNDS) -> DataFrame:
    """Rows of validation and test days with a score of each scenario's model; those with the same features share one fit.

    Positives of the training rows weigh (neg / pos)^0.7.
    """
    rows = written(df.where(F.col(label).isNotNull()).withColumn("is_validation", F.col("split") == "calib"), "fit")
    n = rows.where("split = 'train'").agg(F.sum(label).alias("pos"), F.count("*").alias("n")).first()
    up = ((n["n"] - n["pos"]) / max(n["pos"] or 0, 1)) ** 0.7
    known = rows.where("split in ('train', 'calib')").withColumn("weight", F.when(F.col(label) == 1, float(up)).otherwise(1.0))
    out, sets = rows.where("split in ('val', 'test')"), scenarios(features)
    models = together(df.sparkSession, {own: lambda own=own: fit(known, list(own), label, trees, weight="weight") for own in {tuple(x) for x in sets.values()}})
    for name, own in sets.items():
        out = score(out, models[tuple(own)], own, name, out.columns)
    return out.select("cell", "date", "split", label, *SCENARIOS)


def scenario_metrics(scored: DataFrame, label: str, metrics) -> DataFrame:
    out = None
    for name in SCENARIOS:
        m = metrics(scored.select(F.col(name).alias("score"), label)).withColumn("scenario", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def save(models: dict[str, PipelineModel], path: str, meta: DataFrame) -> None:
    """The models and a table of what they were made with, under one path."""
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/{name}")
    meta.write.mode("overwrite").json(f"{path}/meta")


def load(path: str, names: list[str]) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{path}/{n}") for n in names}
