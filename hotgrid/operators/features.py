"""Features of the panel and the frame that models are trained on.

The features of a cell alone are columns over one window order, so they are one sort and one stage, and
a query that selects some of them computes only these. Features of areas, of the city and of priors
are small frames; neighbour features are an edge join with partial sums. :func:`training_frame` joins
all of them to the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hotgrid.functions.exprs import clip, safe_ratio

EPS = 1e-3
# Window lengths that are part of the features' names (fixed values).
LAGS = (1, 2, 3, 4, 5, 6, 7, 14, 21, 28)
ROLLS = (3, 5, 7, 14, 21, 30, 45, 60, 90)
SPANS = (7, 14, 30, 60, 90)
TYPES = ("violent", "property", "theft", "battery", "narcotics")
WEATHER = ("temp_max", "temp_min", "precipitation", "wind_speed")
CITY = ("city_total", "city_active", "city_violent", "city_property")
#: The panel's counts under the names that the rules for features know.
RAW_NAMES = {"crimes": "total_crimes", "arrests": "arrest_num"} | {t: f"is_{t}" for t in TYPES}


def own() -> WindowSpec:
    """A cell's days in order."""
    return Window.partitionBy("cell").orderBy("date")


def rolled(x: str, days: int, how: str, over: WindowSpec | None = None, least: int = 2) -> Column:
    """An aggregate of the rows before this one, null until ``least`` of them have a value."""
    frame = (over or own()).rowsBetween(-days, -1)
    f = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "max": F.max}[how]
    return F.when(F.count(x).over(frame) >= least, f(x).over(frame))


def zero(x: str | Column) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0))


def _flag(x: Column) -> Column:
    """1 or 0; what is unknown is 0."""
    return F.coalesce(x.cast("int"), F.lit(0))


#: Days that the exponentially weighted means are summed over at once.
EWM_DAYS = 256


def ewm(df: DataFrame, spans: tuple[int, ...], key: str = "cell", at: str = "_t", value: str = "crimes", days: int = EWM_DAYS) -> DataFrame:
    """``df`` with ``ewm_<span>``: the exponentially weighted mean of the values before a row, null for the first two rows.

    ``at`` numbers a key's rows from 0 on without a gap. Rows are summed in stretches of ``days``, a key's stretches in different
    tasks, so that powers of the decay stay in range for any length. A stretch's end is what it adds to the end of the
    one before, and only these ends, one row a stretch, are gone through in order. Inside a stretch values are added in
    their order, without negative powers, so means of short histories are exact where doubles can be.
    """
    n, place = F.lit(days), F.col(at) % days
    decay = {s: 1.0 - 2.0 / (s + 1) for s in spans}
    share = lambda s: F.col(value) * F.when(F.col(at) == 0, 1.0).otherwise(1.0 - decay[s])
    df = df.withColumn("_stretch", F.floor(F.col(at) / days))
    ends = df.groupBy(key, "_stretch").agg(*[F.sum(share(s) * F.pow(F.lit(decay[s]), n - 1 - place)).alias(f"_{s}") for s in spans])
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda s: F.aggregate(F.collect_list(f"_{s}").over(before), F.lit(0.0), lambda acc, x: acc * decay[s] ** days + x).alias(f"_{s}")
    start = ends.select(key, "_stretch", *[carried(s) for s in spans])
    here = Window.partitionBy(key, "_stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)

    def mean(s: int) -> Column:
        own = F.aggregate(F.collect_list(share(s)).over(here), F.lit(0.0), lambda acc, x: acc * decay[s] + x)
        return F.when(F.col(at) >= 2, F.pow(F.lit(decay[s]), place) * F.col(f"_{s}") + own)

    return df.join(start, [key, "_stretch"]).withColumns({f"ewm_{s}": mean(s) for s in spans}).drop("_stretch", *[f"_{s}" for s in spans])


def own_ewm(panel: DataFrame) -> DataFrame:
    """The panel, whose days have no gap, with its exponentially weighted means."""
    first = panel.groupBy("cell").agg(F.min("date").alias("_first"))  # a row a cell
    return ewm(panel.join(first, "cell").withColumn("_t", F.datediff("date", "_first")), SPANS).drop("_t", "_first")


def _windows() -> dict[str, Column]:
    lag = lambda c, k=1: F.lag(c, k).over(own())
    past = own().rowsBetween(Window.unboundedPreceding, 0)
    last_active = F.max(F.when(F.col("crimes") > 0, F.col("date"))).over(past)
    out = {f"lag_{k}": lag("crimes", k) for k in LAGS} | {f"{t}_lag_{k}": lag(t, k) for t in TYPES for k in (1, 2, 3, 7, 14)}
    out |= {f"roll_{how}_{w}": rolled("crimes", w, how) for w in ROLLS for how in ("mean", "sum", "std", "max")}
    out |= {f"active_rate_{w}": rolled("crime_today", w, "mean") for w in (7, 14, 30, 60)}
    out |= {f"{t}_roll_sum_{w}": rolled(t, w, "sum") for w in (7, 14, 30) for t in TYPES}
    for v in WEATHER:
        out |= {f"{v}_lag1": lag(v), f"{v}_lag7": lag(v, 7), f"{v}_roll7": rolled(v, 7, "mean"), f"{v}_diff1": F.col(v) - lag(v)}
    out |= {f"had_crime_{k}d": _flag(lag("crimes", k) > 0) for k in (1, 2, 3)}
    out |= {f"arrest_roll_{w}": rolled("arrests", w, "sum") for w in (7, 30)}
    return out | {
        "prev_crime": lag("crime_today"),
        "near_repeat_5d": zero(F.sum("crime_today").over(own().rowsBetween(-5, -1))),
        # a quiet day counts the days since the last active one, or since the panel began
        "zero_streak": F.when(F.col("crimes") > 0, 0).otherwise(F.coalesce(F.datediff("date", last_active), F.col("_t") + 1)).cast("long"),
        "same_dow_roll8": rolled("crimes", 8, "mean", Window.partitionBy("cell", "dayofweek").orderBy("date")),
    }


def _derived() -> dict[str, Column]:
    c = F.col
    m, s, l1 = (lambda w: c(f"roll_mean_{w}")), (lambda w: c(f"roll_std_{w}")), c("lag_1")
    out = {"zero_today": (c("crimes") == 0).cast("int")}
    out |= {f"{t}_ratio_day": safe_ratio(c(t).cast("double"), c("crimes").cast("double"), 1) for t in ("violent", "property", "theft", "narcotics")}
    out |= {f"burst_{a}_{b}": safe_ratio(m(a), m(b), 10) for a, b in ((3, 30), (7, 30), (14, 60))}
    out |= {f"crime_z_{w}": safe_ratio(c("crimes") - zero(m(w)), zero(s(w)), 10) for w in (30, 90)}
    out |= {f"shock_lag1_vs_roll{w}": safe_ratio(l1, m(w) + EPS, 20) for w in (7, 30)}
    out |= {f"shock_3_{w}": safe_ratio(m(3), m(w) + EPS, 10) for w in (14, 60)}
    out |= {f"roll{a}_minus_roll{b}": zero(m(a)) - zero(m(b)) for a, b in ((3, 30), (7, 60))}
    out |= {f"{t}_roll_ratio_{w}": safe_ratio(c(f"{t}_roll_sum_{w}").cast("double"), c(f"roll_sum_{w}").cast("double"), 1) for w in (7, 14, 30) for t in TYPES}
    out |= {f"arrest_rate_{w}": safe_ratio(c(f"arrest_roll_{w}").cast("double"), c(f"roll_sum_{w}") + EPS, 1) for w in (7, 30)}
    return out | {
        "local_spike_z_30": safe_ratio(zero(l1) - zero(m(30)), zero(s(30)) + EPS, 10),
        "local_sudden_activation_3d": ((zero(l1) > 0) & (zero("lag_2") <= 0) & (zero("lag_3") <= 0)).cast("int"),
        "local_recent_decay": 0.55 * zero(l1) + 0.30 * zero("lag_2") + 0.15 * zero("lag_3"),
        "active_recent_vs_long": safe_ratio(c("active_rate_7"), c("active_rate_60") + EPS, 10),
        "near_repeat_3d": c("had_crime_1d") + c("had_crime_2d") + c("had_crime_3d"),
        "property_lead_violent": c("property_lag_1") * (c("violent_lag_1") == 0).cast("int"),
        "narcotics_before_violent": _flag(c("narcotics_lag_1") > 0),
        "violent_x_property_lag1": c("violent_lag_1") * c("property_lag_1"),
        "trend_slope_7_14": safe_ratio(m(7) - m(14), m(14) + EPS, 5),
        "trend_slope_14_30": safe_ratio(m(14) - m(30), m(30) + EPS, 5),
        "same_dow_vs_overall": safe_ratio(c("same_dow_roll8"), m(30) + EPS, 5),
        # an active day after three or more quiet ones
        "reactivation": ((c("crimes") > 0) & (zero(F.lag("zero_streak", 1).over(own())) >= 3)).cast("int"),
    }


def _second_derived() -> dict[str, Column]:
    c = F.col
    return {
        "deterrence_signal": c("arrest_rate_7") * (1 - clip(c("burst_7_30"), 0.0, 1.0)),
        "trend_direction": F.signum("trend_slope_7_14"),
        "crime_acceleration": c("trend_slope_7_14") - c("trend_slope_14_30"),
    }


def own_features(panel: DataFrame) -> DataFrame:
    """The panel with all features of a cell's own history."""
    return own_ewm(own_windows(panel))


def own_windows(panel: DataFrame) -> DataFrame:
    """The panel with the features that need its rows alone, in one order; take the columns that are needed."""
    df = panel.withColumn("_t", F.row_number().over(own()) - 1)
    return df.withColumns(_windows()).withColumns(_derived()).withColumns(_second_derived()).drop("_t")


def community(panel: DataFrame) -> DataFrame:
    """Features of (area, day): few rows, joined to the panel on (area, date)."""
    per_day = panel.groupBy("community_area", "date").agg(F.sum("crimes").alias("comm_total"), F.sum("crime_today").alias("comm_active"), F.sum("violent").alias("comm_violent"), F.sum("property").alias("comm_property"), F.sum("arrests").alias("comm_arrests"), F.count_distinct("cell").alias("n_h3_in_comm"))
    over = Window.partitionBy("community_area").orderBy("date")
    rolls = {f"comm_roll_{how}_{w}": rolled("comm_total", w, how, over) for w in (7, 14, 30, 60) for how in ("mean", "sum")}
    df = per_day.withColumns(rolls)
    return df.withColumns({"comm_burst_7_30": safe_ratio(F.col("comm_roll_mean_7"), F.col("comm_roll_mean_30"), 10), "comm_active_rate": safe_ratio(F.col("comm_active").cast("double"), F.col("n_h3_in_comm").cast("double"), 1)})


def city(panel: DataFrame) -> DataFrame:
    """Features of the day: at most one row a day of the lookback, so one partition is enough."""
    sums = (("city_total", "crimes"), ("city_active", "crime_today"), ("city_violent", "violent"), ("city_property", "property"), ("city_arrests", "arrests"))
    per_day = panel.groupBy("date").agg(*[F.sum(c).alias(n) for n, c in sums])
    over = Window.partitionBy(F.lit(0)).orderBy("date")
    cols = {}
    for c in CITY:
        cols[f"{c}_lag1"] = F.lag(c, 1).over(over)
        cols |= {f"{c}_roll_mean_{w}": rolled(c, w, "mean", over) for w in (7, 14, 30)}
    df = per_day.withColumns(cols)
    return df.withColumn("city_burst_7_30", safe_ratio(F.col("city_total_roll_mean_7"), F.col("city_total_roll_mean_30"), 10))


def neighbours(panel: DataFrame, edges: DataFrame) -> DataFrame:
    """Yesterday's statistics of the rings around each cell; cells without neighbours get 0.

    Edges are at most 18 a cell, so they are small next to the panel and bounded by the grid; the panel's
    two columns are joined to them and aggregated by (cell, date) with partial sums before the shuffle.
    """
    small = panel.select(F.col("cell").alias("nbr"), "date", "crimes", "crime_today")
    seen = edges.join(small, "nbr")
    one, two = F.col("ring") == 1, F.col("ring") == 2
    x = lambda c, ring: F.when(ring, F.col(c))
    day = seen.groupBy("cell", "date").agg(
        F.avg(x("crimes", one)).alias("mean"), F.sum(x("crimes", one)).alias("sum"), F.max(x("crimes", one)).alias("max"), F.stddev_pop(x("crimes", one)).alias("std"),
        F.avg(x("crime_today", one)).alias("active_rate"), F.sum(x("crime_today", one)).alias("active_count"), F.count(x("crimes", one)).alias("n1"),
        F.avg(x("crimes", two)).alias("r2_mean"), F.count(x("crimes", two)).alias("n2"),
    )
    df = panel.select("cell", "date").join(day, ["cell", "date"], "left")
    stats = ("mean", "sum", "max", "std", "active_rate", "active_count")
    lag = lambda c: zero(F.lag(c, 1).over(own()))
    df = df.withColumns({f"nbr_r1_{s}": lag(s) for s in stats} | {"nbr_r2_mean": lag("r2_mean"), "nbr_r1_neighbor_count": zero("n1"), "nbr_r2_neighbor_count": zero("n2")})
    week = own().rowsBetween(-6, 0)
    seven = lambda c: F.when(F.count(c).over(week) >= 2, F.avg(c).over(week)).otherwise(0.0)
    rate, c = F.col("nbr_r1_active_rate"), F.col
    df = df.withColumns({"nbr_r1_roll7": seven("nbr_r1_mean"), "nbr_r1_active_roll7": seven("nbr_r1_active_rate"), "nbr_r1_any_active": (c("nbr_r1_active_count") > 0).cast("int")})
    df = df.withColumns(
        {
            "nbr_r1_new_activation": ((rate > 0) & (lag("nbr_r1_active_rate") <= 0)).cast("int"),
            "nbr_r1_active_accel": rate - lag("nbr_r1_active_rate"),
            "nbr_r1_burst_1_7": safe_ratio(c("nbr_r1_mean"), c("nbr_r1_roll7") + EPS, 10),
            "nbr_r1_vs_r2": safe_ratio(c("nbr_r1_mean"), c("nbr_r2_mean") + EPS, 10),
            "nbr_contagion": (rate > 0.5).cast("int"),
            "nbr_r1_active_burst": safe_ratio(rate, c("nbr_r1_active_roll7") + EPS, 10),
            "nbr_dispersion_signal": safe_ratio(c("nbr_r1_std"), c("nbr_r1_mean") + EPS, 10),
            "nbr_r1_spike_vs_roll7": safe_ratio(c("nbr_r1_mean") - c("nbr_r1_roll7"), c("nbr_r1_std") + EPS, 10),
            "nbr_hot_count_per_neighbor": safe_ratio(c("nbr_r1_active_count").cast("double"), c("nbr_r1_neighbor_count").cast("double"), 1),
        }
    )
    return df.drop(*stats, "n1", "n2", "r2_mean")


def spillover() -> dict[str, Column]:
    """A cell's own state against its ring's; columns over own and neighbour features."""
    c, cold = F.col, (zero("lag_1") <= 0).cast("int")
    return {
        "h3_vs_nbr_r1": safe_ratio(c("roll_mean_7"), c("nbr_r1_mean") + EPS, 20),
        "h3_above_nbr": _flag(c("lag_1") > c("nbr_r1_mean")),
        "h3_nbr_joint_activity": zero("active_rate_7") * c("nbr_r1_active_rate"),
        "nbr_r1_hot_count_x_local_cold": c("nbr_r1_active_count") * cold,
        "nbr_max_vs_local_lag1": safe_ratio(c("nbr_r1_max").cast("double"), zero("lag_1") + EPS, 20),
        "local_nbr_double_burst": clip(zero("burst_3_30"), 0.0, 10.0) * clip(c("nbr_r1_burst_1_7"), 0.0, 10.0),
        "nbr_any_active_x_local_cold": c("nbr_r1_any_active") * cold,
        "nbr_spike_x_local_sudden": (c("nbr_r1_spike_vs_roll7") > 1.0).cast("int") * c("local_sudden_activation_3d"),
    }


def average_rank(x: str, over) -> Column:
    """Percentile rank with average ties: (rank + (ties - 1) / 2) / n."""
    everything = over.orderBy(x)
    n, ties = F.count(x).over(over), F.count(x).over(everything.rangeBetween(0, 0))
    return F.when(F.col(x).isNotNull(), (F.rank().over(everything) + (ties - 1) / 2) / n)


def priors(panel: DataFrame, train: DataFrame) -> DataFrame:
    """Per cell, from training rows only: mean, spread, sum, most, active share and rank, of the cell and of its area.

    One row a cell of the grid: the ranking's single partition is as small as the grid.
    """
    stats = lambda prefix: [f(x).alias(f"{prefix}_{n}") for n, f, x in (("mean", F.avg, "crimes"), ("std", F.stddev_samp, "crimes"), ("sum", F.sum, "crimes"), ("max", F.max, "crimes"))]
    one = Window.partitionBy(F.lit(0))
    per_cell = train.groupBy("cell").agg(*stats("h3_train"), F.avg("crime_today").alias("h3_train_active_rate"))
    per_cell = per_cell.withColumn("h3_train_percentile", average_rank("h3_train_mean", one))
    area = train.groupBy("community_area").agg(*stats("comm_train"))
    area = area.withColumn("comm_train_percentile", average_rank("comm_train_mean", one))
    cells = panel.groupBy("cell").agg(F.first("community_area").alias("community_area"))
    out = cells.join(per_cell, "cell", "left").join(F.broadcast(area), "community_area", "left")
    out = out.na.fill(0).withColumn("h3_train_pct", F.col("h3_train_percentile"))
    return out.withColumn("h3_vs_comm_prior", safe_ratio(F.col("h3_train_mean"), F.col("comm_train_mean") + EPS, 20))


def people() -> Column:
    return F.greatest(F.coalesce("population_density", F.lit(0.0)), F.lit(1.0))


def city_rate(train: DataFrame) -> DataFrame:
    """One row: incidents per inhabitant over the training rows."""
    return train.agg((F.sum("crimes") / F.greatest(F.sum(people()), F.lit(1.0))).alias("city_rate"))


def relations() -> dict[str, Column]:
    """Columns over the joined frame: densities, hardship, the cell against its city, area and prior."""
    c, mean7 = F.col, F.col("roll_mean_7")
    hard, jobless = zero("hardship_index"), zero("unemployment_rate")
    return {
        "crime_per_1000pop": safe_ratio(c("crimes") * 1000.0, people(), 50),
        "crime_roll7_per_1000pop": safe_ratio(mean7 * 1000.0, people(), 50),
        "crime_vs_density_expected": c("crimes") - people() * c("city_rate"),
        "h3_city_share_7": safe_ratio(mean7, c("city_total_roll_mean_7") + EPS, 1),
        "h3_city_share_30": safe_ratio(c("roll_mean_30"), c("city_total_roll_mean_30") + EPS, 1),
        "hardship_x_roll7": hard * zero(mean7),
        "hardship_x_active_rate": hard * zero("active_rate_7"),
        "hardship_x_nbr_r1": hard * zero("nbr_r1_mean"),
        "unemployment_x_reactivation": jobless * c("reactivation"),
        "unemployment_x_zero_streak": jobless * (c("zero_streak") > 7).cast("int"),
        "h3_recent_vs_comm": safe_ratio(mean7, c("comm_roll_mean_7") + EPS, 20),
        "high_prior_x_weekend": c("h3_train_percentile") * c("is_weekend"),
        "high_prior_x_friday": c("h3_train_percentile") * c("is_friday"),
        "high_prior_x_holiday": c("h3_train_percentile") * c("is_holiday"),
        "active_rate_vs_train": safe_ratio(c("active_rate_7"), c("h3_train_active_rate") + EPS, 10),
    }


def training_frame(panel: DataFrame, train: DataFrame, edges: DataFrame, days: DataFrame) -> DataFrame:
    """The panel with all features: its own, its neighbours', its area's, the city's, the holidays' and the priors'.

    ``days`` has the features of dates. Everything beside neighbours and own features is bounded by the
    city's areas, cells and days of the lookback, and is broadcast.
    """
    df = own_features(panel).join(neighbours(panel, edges), ["cell", "date"])
    area = community(panel).drop("comm_total", "comm_active", "comm_violent", "comm_property", "comm_arrests")
    df = df.join(F.broadcast(area), ["community_area", "date"], "left")
    df = df.join(F.broadcast(city(panel).drop(*CITY, "city_arrests")), "date", "left").join(F.broadcast(days), "date", "left")
    df = df.join(F.broadcast(priors(panel, train).drop("community_area")), "cell", "left").crossJoin(F.broadcast(city_rate(train)))
    return df.withColumns(spillover()).withColumns(relations()).drop("city_rate")


def targets(panel: DataFrame) -> DataFrame:
    """Tomorrow's label and its forms; null on the last day, not 0."""
    nxt = {f"next_{n}": F.lead(c, 1).over(own()) for n, c in (("total", "crimes"), ("violent_n", "violent"), ("property_n", "property"))}
    df = panel.withColumns(nxt)
    t = F.col("next_total")
    label = lambda cond: F.when(t.isNotNull(), cond.cast("int"))
    return df.select(
        "cell", "date", "next_total", label(t >= 1).alias("next_has_crime"), label(t >= 2).alias("next_hotspot"),
        F.when(t.isNotNull(), F.when(t >= 2, 2).when(t == 1, 1).otherwise(0)).alias("next_topk_group"), F.lit(None).cast("double").alias("next_rank_pct"),
        label(F.col("next_violent_n") > F.col("next_property_n")).alias("next_violent"), label(F.col("next_property_n") > F.col("next_violent_n")).alias("next_property"),
    )
