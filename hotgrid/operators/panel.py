"""The dense cell-by-day panel and its fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions.exprs import calendar, hour_flags, type_flags
from hotgrid.operators.evaluate import splits
from hotgrid.operators.medians import fill, medians
from hotgrid.sources.layers import written

COUNTS = ("violent", "property", "theft", "battery", "narcotics", "arrests")
CONTEXT = ("temp_max", "temp_min", "precipitation", "wind_speed", "unemployment_rate", "hardship_index", "population_density", "per_capita_income", "dist_nearest_school", "dist_nearest_station", "dist_nearest_park", "dist_nearest_nightlife")
HOURS = ("is_night", "is_morning", "is_afternoon", "is_evening")


def lookback(gold: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Facts of the last days before the table's own last date, with type and hour flags."""
    last = gold.agg(F.max("date").alias("_last"))
    rows = gold.crossJoin(F.broadcast(last)).where(F.col("date") >= F.date_sub("_last", cfg.lookback_days)).drop("_last")
    return rows.where("cell is not null and latitude is not null and longitude is not null").withColumns(type_flags() | hour_flags(F.col("hour_of_day")))


def daily(facts: DataFrame) -> DataFrame:
    """Per cell and day: incidents, sums by type, arrests, shares of day, context means."""
    sums = {"violent": "is_violent", "property": "is_property", "theft": "is_theft", "battery": "is_battery", "narcotics": "is_narcotics"}
    return facts.groupBy("cell", "date").agg(
        F.count("*").alias("crimes"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        F.sum(F.col("arrest").cast("int")).alias("arrests"),
        *[F.avg(c).alias(c) for c in (*HOURS, *CONTEXT)],
    )


def arrest_flag(df: DataFrame) -> Column:
    """1 if most of a row's incidents led to an arrest: the rounded flag if the frame has it, else its rate over a half, else 0.

    A null is 0.
    """
    if "arrest_flag" in df.columns:
        return F.coalesce(F.col("arrest_flag").cast("int"), F.lit(0))
    if "arrest_rate" in df.columns:
        return F.coalesce((F.col("arrest_rate") > 0.5).cast("int"), F.lit(0))
    return F.lit(0)


def with_arrest_flag(facts: DataFrame) -> DataFrame:
    """The facts with their rate of arrests rounded to a flag."""
    return facts.withColumn("arrest_flag", F.round("arrest_rate").cast("int"))


def modal_area(facts: DataFrame) -> DataFrame:
    """The area that most of a cell's incidents are in, ties to the least id."""
    n = facts.groupBy("cell", "community_area").agg(F.count("*").alias("n"))
    return n.groupBy("cell").agg(F.max_by("community_area", F.struct("n", -F.col("community_area"))).alias("community_area"))


def densify(per_day: DataFrame, areas: DataFrame) -> DataFrame:
    """All cells x all days of the range, counts 0 where nothing happened.

    Cells (the grid) and days (the lookback) are both bounded dimensions; the product is
    the panel itself and is made by exploding each cell's days, without a cross join.
    """
    span = per_day.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = areas.crossJoin(F.broadcast(span)).select("cell", "community_area", F.explode(F.sequence("lo", "hi")).alias("date"))
    filled = grid.join(per_day, ["cell", "date"], "left")
    filled = filled.na.fill(0, ["crimes", *COUNTS])
    past = Window.partitionBy("cell").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in (*HOURS, *CONTEXT)} | {"crime_today": (F.col("crimes") > 0).cast("int")})


def panel(gold: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All cells x days with counts, context and calendar; context is carried forward, else a training median.

    ``gold`` may be a part of the facts if it has the last ``lookback_days``.
    """
    facts = lookback(gold, cfg)
    dense = written(densify(daily(facts), modal_area(facts)), "dense")
    in_training = splits(dense, cfg).where("split = 'train'").select("date")
    return fill_medians(dense, dense.join(F.broadcast(in_training), "date", "left_semi")).withColumns(calendar("date"))


def fill_medians(dense: DataFrame, train: DataFrame) -> DataFrame:
    """What a forward fill leaves open gets the exact median of the training rows, which are read some times."""
    found = medians(train, [*HOURS, *CONTEXT])
    return dense.withColumns({c: F.coalesce(c, F.lit(v), F.lit(0.0)) for c, v in found.items()})


def sanitize(df: DataFrame, train: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` whose columns ``names`` are finite: infinities, NaN and nulls become the training rows' median, else 0."""
    return fill(df, medians(train, list(names)))


def holiday_features(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """Days since the last holiday (today counts) and to the next one, bounded by 30.

    Each holiday tells the days that are nearer than the bound how far it is, so days meet holidays by date.
    """
    bound, gap = F.lit(30), F.datediff("date", "holiday")
    told = holidays.select("holiday", F.explode(F.sequence(F.date_sub("holiday", 29), F.date_add("holiday", 29))).alias("date"))
    told = told.groupBy("date").agg(F.min(F.when(gap >= 0, gap)).alias("a"), F.min(F.when(gap < 0, -gap)).alias("b"))
    out = dates.select("date").distinct().join(told, "date", "left")
    since, until = F.coalesce("a", bound), F.coalesce("b", bound)
    return out.select("date", (since == 0).cast("int").alias("is_holiday"), since.alias("days_from_holiday"), until.alias("days_to_holiday"), ((since <= 2) | (until <= 2)).cast("int").alias("holiday_window"))
