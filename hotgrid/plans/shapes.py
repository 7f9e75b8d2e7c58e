"""Output columns of the queries: one list that both the DataFrame and the SQL are cast to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.functions.rules import GUARDED
from hotgrid.operators import features as X
from hotgrid.operators import panel as P

SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
KEY = "cell string, date date"


def cols(kind: str, *names: str) -> str:
    return ", ".join(f"{n} {kind}" for n in names)


def six(x: Column) -> Column:
    """A double to 6 places as the SQL's engine rounds it: its millionfold to a whole number, halves away from zero.

    ``round(x, 6)`` rounds the decimal text instead, which differs where a half has no exact double; what has no finite millionfold stays.
    """
    whole = F.round(x * 1e6)
    return F.when(F.abs(whole) < float("inf"), whole / 1e6).otherwise(x)


def shape(df: DataFrame, ddl: str) -> DataFrame:
    """Columns and types as listed; doubles to 6 places, and no negative zero."""
    out = []
    for name, kind in (c.split() for c in ddl.split(", ")):
        c = F.col(name).cast(kind)
        out.append((six(c) + 0.0 if kind == "double" else c).alias(name))
    return df.select(*out)


def exact(df: DataFrame, ddl: str) -> DataFrame:
    """Columns and types as listed, values as they are."""
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in ddl.split(", "))])


def shaped(sql: str, ddl: str) -> str:
    out = []
    for name, kind in (c.split() for c in ddl.split(", ")):
        c = f'CAST("{name}" AS {SQL_TYPES[kind]})'
        out.append(f"{f'round({c}, 6) + 0.0' if kind == 'double' else c} AS \"{name}\"")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS q"


def _own(*parts: str) -> str:
    return ", ".join([KEY, *parts])


LAG = cols("long", *[f"lag_{k}" for k in X.LAGS], *[f"{t}_lag_{k}" for t in X.TYPES for k in (1, 2, 3, 7, 14)]) + ", " + cols("int", "prev_crime")
ROLL = cols("double", *[f"roll_{how}_{w}" for w in X.ROLLS for how in ("mean", "sum", "std", "max")], *[f"active_rate_{w}" for w in (7, 14, 30, 60)])
EWM = cols("double", *[f"ewm_{w}" for w in X.SPANS])
STREAK = "zero_streak long, reactivation int"
DAILY = cols("int", "crime_today", "zero_today") + ", " + cols("double", *[f"{t}_ratio_day" for t in ("violent", "property", "theft", "narcotics")])
BURST = cols("double", "burst_3_30", "burst_7_30", "burst_14_60", "crime_z_30", "crime_z_90", "shock_lag1_vs_roll7", "shock_lag1_vs_roll30", "shock_3_14", "shock_3_60", "roll3_minus_roll30", "roll7_minus_roll60", "local_spike_z_30", "local_recent_decay", "active_recent_vs_long") + ", local_sudden_activation_3d int"
TREND = cols("double", "trend_slope_7_14", "trend_slope_14_30", "trend_direction", "crime_acceleration")
MIX = ", ".join(cols("long", f"{t}_roll_sum_{w}") + ", " + cols("double", f"{t}_roll_ratio_{w}") for w in (7, 14, 30) for t in X.TYPES)
WEATHER = cols("double", *[f"{v}_{k}" for v in X.WEATHER for k in ("lag1", "lag7", "roll7", "diff1")])
REPEAT = cols("int", "had_crime_1d", "had_crime_2d", "had_crime_3d", "near_repeat_3d") + ", near_repeat_5d long, property_lead_violent long, narcotics_before_violent int, violent_x_property_lag1 long"
DETER = "arrest_roll_7 long, arrest_roll_30 long, arrest_rate_7 double, arrest_rate_30 double, deterrence_signal double"
WEEKDAY = "same_dow_roll8 double, same_dow_vs_overall double"
COMM_ROLLS = cols("double", *[f"comm_roll_{how}_{w}" for w in (7, 14, 30, 60) for how in ("mean", "sum")], "comm_burst_7_30", "comm_active_rate")
COMM_COLS = ", ".join(["community_area int, date date", cols("long", "comm_total", "comm_active", "comm_violent", "comm_property", "comm_arrests", "n_h3_in_comm"), COMM_ROLLS])
CITY = X.CITY
CITY_ROLLS = ", ".join([*[cols("long", f"{c}_lag1") + ", " + cols("double", *[f"{c}_roll_mean_{w}" for w in (7, 14, 30)]) for c in CITY], cols("double", "city_burst_7_30")])
CITY_COLS = ", ".join(["date date", cols("long", *CITY, "city_arrests"), CITY_ROLLS])
NBR = ", ".join([cols("double", "nbr_r1_mean", "nbr_r1_sum", "nbr_r1_max", "nbr_r1_std", "nbr_r1_active_rate", "nbr_r1_active_count", "nbr_r2_mean", "nbr_r1_roll7", "nbr_r1_active_roll7"), cols("int", "nbr_r1_any_active", "nbr_r1_new_activation", "nbr_contagion"), cols("long", "nbr_r1_neighbor_count", "nbr_r2_neighbor_count"), cols("double", "nbr_r1_active_accel", "nbr_r1_burst_1_7", "nbr_r1_vs_r2", "nbr_r1_active_burst", "nbr_dispersion_signal", "nbr_r1_spike_vs_roll7", "nbr_hot_count_per_neighbor")])
SPILL = cols("double", "h3_vs_nbr_r1", "h3_nbr_joint_activity", "nbr_r1_hot_count_x_local_cold", "nbr_max_vs_local_lag1", "local_nbr_double_burst") + ", " + cols("int", "h3_above_nbr", "nbr_any_active_x_local_cold", "nbr_spike_x_local_sudden")
PRIOR = cols("double", "h3_train_mean", "h3_train_std", "h3_train_sum", "h3_train_max", "h3_train_active_rate", "h3_train_percentile", "h3_train_pct", "comm_train_mean", "comm_train_std", "comm_train_sum", "comm_train_max", "comm_train_percentile", "h3_vs_comm_prior")
RELATION = cols("double", "crime_per_1000pop", "crime_roll7_per_1000pop", "crime_vs_density_expected", "h3_city_share_7", "h3_city_share_30", "hardship_x_roll7", "hardship_x_active_rate", "hardship_x_nbr_r1", "unemployment_x_reactivation", "unemployment_x_zero_streak", "h3_recent_vs_comm", "high_prior_x_weekend", "high_prior_x_friday", "high_prior_x_holiday", "active_rate_vs_train")
HOLIDAY = cols("int", "is_holiday", "days_from_holiday", "days_to_holiday", "holiday_window")
COUNTS = ("crimes", "violent", "property", "theft", "battery", "narcotics", "arrests")
BASE = cols("double", *P.HOURS, *P.CONTEXT) + ", " + cols("int", "dayofweek", "month", "dayofyear", "is_weekend", "is_monday", "is_friday") + ", " + cols("double", "dow_sin", "dow_cos", "month_sin", "month_cos", "doy_sin", "doy_cos")
PRIOR_COLS = "cell string, community_area int, " + PRIOR
PANEL_COLS = _own("community_area int", cols("long", *COUNTS), "crime_today int", BASE)
FRAME_COLS = _own("community_area int", cols("long", *[X.RAW_NAMES[c] for c in COUNTS]), BASE, LAG, ROLL, EWM, STREAK, DAILY, BURST, TREND, MIX, WEATHER, REPEAT, DETER, WEEKDAY, "n_h3_in_comm long", COMM_ROLLS, CITY_ROLLS, NBR, SPILL, PRIOR, RELATION, HOLIDAY)
#: The numeric columns of the frame that are no keys and not guarded.
CANDIDATES = tuple(n for n, t in (c.split() for c in FRAME_COLS.split(", ")) if t in ("int", "long", "double") and n not in GUARDED)
