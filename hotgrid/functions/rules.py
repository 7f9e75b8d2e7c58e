"""Rules from a feature's name to its bucket in the blend, its group in the ablation and its family.

A rule has a label and parts of names; the first rule one of whose parts is in the name decides. A part
that begins with ^ has to be the name's beginning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = tuple[tuple[str, str], ...]

# The labels and parts of names below decide results and are not this engine's own.
BLEND: Rules = (
    ("spatial", "h3_train comm_train h3_vs_comm_prior active_rate_vs_train h3_city_share h3_train_pct"),
    ("spatial", "nbr_r1_roll nbr_r2 nbr_r1_active_roll nbr_r1_burst nbr_r1_vs_r2 nbr_r1_neighbor_count nbr_r2_neighbor_count h3_nbr_joint h3_vs_nbr_r1"),
    ("spatial", "city_total_roll city_active_roll city_violent_roll city_property_roll city_burst comm_roll comm_burst comm_active_rate comm_train n_h3_in_comm"),
    ("context", "hardship_index unemployment_rate population_density per_capita_income"),
    ("context", "dist_nearest"),
    ("context", "is_night is_evening is_morning is_afternoon"),
    ("context", "total_crimes is_violent is_property is_theft is_battery is_narcotics arrest_num crime_today zero_today violent_ratio_day property_ratio_day theft_ratio_day narcotics_ratio_day"),
    ("context", "h3_recent_vs_comm h3_vs_comm"),
    (
        "context",
        "nbr_hot_count_per_neighbor nbr_dispersion_signal nbr_max_vs_local_lag1 nbr_any_active_x_local_cold nbr_spike_x_local h3_above_nbr nbr_r1_mean nbr_r1_sum nbr_r1_max nbr_r1_std "
        "nbr_r1_active_rate nbr_r1_active_count nbr_r1_any_active nbr_contagion nbr_r1_new_activation nbr_r1_hot_count_x_local_cold nbr_r1_active_accel nbr_r1_spike_vs_roll7 local_nbr_double_burst",
    ),
    ("context", "hardship_x_ unemployment_x_ high_prior_x_ violent_x_property property_lead_violent narcotics_before near_repeat reactivation had_crime prev_crime deterrence arrest_rate arrest_roll"),
)
BLEND_REST = "temporal"
ABLATION: Rules = (
    ("spatial_prior", "h3_train comm_train h3_vs_comm_prior h3_nbr_joint h3_vs_city active_rate_vs_train h3_city_share h3_train_pct"),
    ("spatial_spillover", "nbr_r contagion spillover nbr_hot_count nbr_dispersion nbr_max_vs nbr_any_active nbr_spike_x h3_above_nbr"),
    (
        "criminology",
        "hardship_x_ unemployment_x_ high_prior_x_ local_nbr_double_burst nbr_spike_x_ violent_x_property near_repeat arrest_rate arrest_num arrest_roll deterrence reactivation had_crime prev_crime "
        "property_lead_violent narcotics_before",
    ),
    ("community_city", "comm_ city_ h3_city h3_recent_vs_comm n_h3_in_comm"),
    (
        "temporal_rolling",
        "roll_ lag_ ewm_ active_rate burst streak trend_ volatility crime_z yoy_ same_dow shock spike activation recent_decay sudden roll3_minus roll7_minus active_recent_vs_long crime_per_1000pop "
        "crime_roll7_per_1000pop crime_vs_density_expected crime_acceleration crime_today zero_today zero_streak violent_ratio_day property_ratio_day theft_ratio_day narcotics_ratio_day total_crimes "
        "is_violent is_property is_theft is_battery is_narcotics violent_roll property_roll theft_roll battery_roll narcotics_roll",
    ),
    ("socioeconomic", "hardship unemployment per_capita population income"),
    ("weather", "temp_ prcp wind precipitation weather rain_ heat_"),
    (
        "calendar",
        "holiday is_weekend dow_ month_ doy_ season dayofyear dayofweek is_monday is_friday summer_flag days_from_holiday days_to_holiday holiday_window is_night is_evening is_morning is_afternoon",
    ),
    ("poi", "dist_nearest"),
)
ABLATION_REST = "other"
FAMILY: Rules = (
    ("Spatial prior / prior-relative", "h3_train comm_train prior active_rate_vs_train"),
    ("Similarity graph", "^sim_ sim_cluster cluster_train h3_vs_sim"),
    ("Parent H3 multi-resolution", "parent_r h3_vs_parent h3_share_parent"),
    ("H3 neighbor spillover", "nbr_ _nbr_ contagion"),
    ("Temporal / momentum", "roll lag ewm burst shock spike streak trend same_dow recent activation decay"),
    ("Criminology behavior", "near_repeat reactivation arrest deterrence violent property theft battery narcotics crime_type_entropy dominant_type"),
    ("Calendar / holiday", "holiday weekend friday monday dow_ month_ doy_"),
    ("Weather", "temp precip wind"),
    ("POI interaction", "dist_nearest near_school near_station near_park near_nightlife nightlife"),
    ("Socioeconomic / density", "hardship unemployment population income density per_1000pop"),
    ("City/community context", "city_ comm_ h3_city_share h3_recent_vs_comm"),
    ("Time-of-day profile", "night evening morning afternoon"),
)
FAMILY_REST = "Other"
#: Columns that the selection leaves out: redundant or too direct forms of others (fixed values).
GUARDED = frozenset(
    """h3_train_sum h3_train_max h3_train_pct comm_train_sum comm_train_max h3_train_mean h3_train_std comm_train_mean comm_train_std
    roll_sum_60 roll_sum_90 community_area latitude longitude day_of_week month median_income per_capita_income""".split()
)


def label(name: str, rules: Rules, rest: str) -> str:
    fits = lambda part: name.startswith(part[1:]) if part[0] == "^" else part in name
    return next((kind for kind, parts in rules if any(map(fits, parts.split()))), rest)


def label_column(name: Column, rules: Rules, rest: str) -> Column:
    """The same as a column."""
    out = F.lit(rest)
    for kind, parts in reversed(rules):
        tests = [name.startswith(p[1:]) if p[0] == "^" else name.contains(p) for p in parts.split()]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        out = F.when(hit, kind).otherwise(out)
    return out


def bucket(name: str) -> str:
    return label(name, BLEND, BLEND_REST)
