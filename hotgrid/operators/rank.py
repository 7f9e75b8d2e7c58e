"""Scores to ranked tiers, confidence, dominant type and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions.exprs import category, clip, sunday_week, version_label


def tiers(df: DataFrame, score: str = "score", per: str = "date", cfg: Config = Config()) -> DataFrame:
    """Rank within a day (ties by cell) and the bounded tiers: top 5, 15 and 30 percent."""
    day = Window.partitionBy(per)
    frac = F.col("rank") / F.count("*").over(day)
    a, b, c = cfg.risk_cuts
    df = df.withColumn("rank", F.row_number().over(day.orderBy(F.desc(score), "cell")))
    return df.withColumn("rank_pct", frac).withColumn("risk_level", F.when(F.col("rank_pct") <= a, "CRITICAL").when(F.col("rank_pct") <= b, "HIGH").when(F.col("rank_pct") <= c, "MEDIUM").otherwise("LOW"))


def blended(scores: tuple[str, str, str], cfg: Config = Config()) -> Column:
    return sum(F.col(s) * w for s, w in zip(scores, cfg.blend, strict=True))


def confidence(df: DataFrame, scores: tuple[str, str, str], rank_pct: str = "rank_pct", cfg: Config = Config()) -> DataFrame:
    """Agreement of the three scores, distance of the rank to a tier's edge and to the middle, and their level."""
    a, b, c = map(F.col, scores)
    mean = (a + b + c) / 3
    std = F.sqrt((F.pow(a - mean, 2) + F.pow(b - mean, 2) + F.pow(c - mean, 2)) / 3)
    margin = F.least(*[F.abs(F.col(rank_pct) - x) for x in cfg.risk_cuts]) / 0.05
    agree, edge, extreme = clip(1 - 2 * std, 0, 1), clip(margin, 0, 1), clip(F.abs(0.5 - F.col(rank_pct)) * 2, 0, 1)
    df = df.withColumns({"margin_to_cut": F.least(*[F.abs(F.col(rank_pct) - x) for x in cfg.risk_cuts]), "extremity": extreme, "score_std": std, "score_range": F.greatest(a, b, c) - F.least(a, b, c), "agreement": agree, "rank_margin": edge})
    df = df.withColumn("confidence_score", clip(0.45 * agree + 0.35 * edge + 0.20 * extreme, 0, 1))
    return df.withColumn("confidence_level", F.when(F.col("confidence_score") <= 0.5, "LOW").when(F.col("confidence_score") <= 0.75, "MEDIUM").otherwise("HIGH"))


def dominant(hotspot: Column, violent: Column, prop: Column) -> Column:
    return F.when(~hotspot, "UNKNOWN").when(violent > prop + 0.05, "VIOLENT").when(prop > violent + 0.05, "PROPERTY").otherwise("MIXED")


#: Columns of the predictions table (fixed values: what reads the table expects them).
PREDICTIONS = """prediction_date date, h3_index string, crime_probability double, hotspot_score double, risk_level string, model_version string, created_at timestamp, pred_hotspot int,
violent_probability double, property_probability double, dominant_type string, risk_rank int, risk_rank_pct double, confidence_score double, confidence_level string, temporal_score double,
spatial_score double, context_score double, group_score_std double, group_score_range double, model_agreement double, score_margin_to_cutoff double, group_w_temporal double, group_w_spatial double,
group_w_context double, community_area double, hardship_index double, unemployment_rate double"""


def prediction_table(df: DataFrame, threshold: float, made: str, cfg: Config = Config(), keep: bool = False) -> DataFrame:
    """Scored rows as the predictions table: tomorrow's date, rank, tier, type, confidence and version.

    ``made`` is the run's time. Rows have temporal, spatial, context, score, violent_probability and
    property_probability. With ``keep`` the other columns stay.
    """
    df = confidence(tiers(df, cfg=cfg), ("temporal", "spatial", "context"), cfg=cfg)
    hot = F.col("score") >= threshold
    names = {"h3_index": "cell", "crime_probability": "score", "hotspot_score": "score", "risk_rank": "rank", "risk_rank_pct": "rank_pct", "temporal_score": "temporal", "spatial_score": "spatial", "context_score": "context", "group_score_std": "score_std", "group_score_range": "score_range", "model_agreement": "agreement", "score_margin_to_cutoff": "margin_to_cut", "rank_margin_confidence": "rank_margin", "rank_extremity": "extremity"}
    df = df.withColumns({new: F.col(old) for new, old in names.items()})
    df = df.withColumns({f"group_w_{n}": F.lit(w) for n, w in zip(("temporal", "spatial", "context"), cfg.blend, strict=True)})
    made_at = F.lit(made).cast("timestamp")
    df = df.withColumns({"prediction_date": F.date_add("date", 1), "pred_hotspot": hot.cast("int"), "dominant_type": dominant(hot, F.col("violent_probability"), F.col("property_probability")), "created_at": made_at, "model_version": version_label(made_at)})
    return df if keep else fit_schema(df, PREDICTIONS)


#: Columns of the whole predictions table (fixed values: what reads the table expects them).
FULL_PREDICTIONS = """prediction_date date, h3_index string, crime_probability double, hotspot_score double, risk_level string, model_version string, created_at timestamp, pred_hotspot int,
violent_probability double, property_probability double, dominant_type string, risk_rank int, risk_rank_pct double, confidence_score double, confidence_level string, temporal_score double,
spatial_score double, context_score double, group_score_std double, group_score_range double, model_agreement double, score_margin_to_cutoff double, rank_margin_confidence double, rank_extremity double,
group_w_temporal double, group_w_spatial double, group_w_context double, val_auc double, val_ap double, val_f1 double, test_auc double, test_ap double, test_f1 double,
val_top05_recall double, val_top05_lift double, val_top15_recall double, val_top15_lift double, val_top30_recall double, val_top30_lift double,
test_top05_recall double, test_top05_lift double, test_top15_recall double, test_top15_lift double, test_top30_recall double, test_top30_lift double,
community_area double, community_area_name string, hardship_index double, unemployment_rate double, population_density double, h3_train_percentile double, h3_train_active_rate double,
roll_mean_7 double, roll_mean_30 double, zero_streak double, nbr_r1_mean double, nbr_r1_active_rate double, nbr_r1_active_count double, near_repeat_3d double, arrest_rate_7 double, is_holiday double"""


def full_predictions(df: DataFrame, threshold: float, made: str, stamps: DataFrame, areas: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Scored feature rows as the whole predictions table.

    Beside :func:`prediction_table`: the metrics of the run (``stamps``, one row), and each cell's context, with the name of
    its area from ``areas`` (community_area, community_area_name), or Unknown.
    """
    base = prediction_table(df, threshold, made, cfg, keep=True)
    names = areas.select("community_area", F.col("community_area_name").alias("_area")).dropDuplicates(["community_area"])
    named = base.join(F.broadcast(names), "community_area", "left").withColumn("community_area_name", F.coalesce("_area", F.lit("Unknown")))
    return fit_schema(named.crossJoin(F.broadcast(stamps)), FULL_PREDICTIONS)


def fit_schema(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of ``ddl`` that the frame has, cast to their types, in that order."""
    kinds = [c.split() for c in ddl.replace("\n", " ").split(", ")]
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in kinds if n in df.columns])


def value_counts(df: DataFrame, values: dict[str, tuple[str, ...]]) -> DataFrame:
    """(what, value, n) of each listed value of each column, 0 where none has it: one pass over the rows."""
    listed = F.array(*[F.struct(F.lit(c).alias("what"), F.lit(v).alias("value"), F.count_if(F.col(c) == v).alias("n")) for c, vs in values.items() for v in vs])
    return df.agg(listed.alias("all")).select(F.explode("all").alias("x")).select("x.*")


def export_incidents(gold: DataFrame, as_of: str, days: int = 90, cfg: Config = Config(), seed: str = "7") -> DataFrame:
    """Incidents of the last days, at most so many of each Sunday week, by a repeatable order."""
    rows = gold.where((F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("unique_key").cast("string")))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(sunday_week("date")).orderBy(order))).where(F.col("_at") <= cfg.sample_per_week).drop("_at")
    return rows.withColumn("crime_category", category())


def export_forecast(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """The latest day's predictions with each cell's centroid; facts are averaged before the join."""
    last = predictions.agg(F.max("prediction_date").alias("prediction_date"))
    where = gold.groupBy("cell").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    return predictions.join(F.broadcast(last), "prediction_date").join(where, "cell", "left")


def geojson(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One GeoJSON Feature a row as text (a GeoJSON sequence when written); rows without a place are left out."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    props = F.struct(*[(F.date_format(c, "yyyy-MM-dd") if t == "date" else F.col(c)).alias(c) for c, t in df.dtypes if c in rest])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), props.alias("properties"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(feature).alias("value"))
