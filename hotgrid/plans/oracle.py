"""The same queries as SQL for an independent engine, from the test tables up."""

from __future__ import annotations

import math
import re

from hotgrid.functions import exprs as E
from hotgrid.functions import rules as R
from hotgrid.operators import features as X
from hotgrid.operators import panel as P
from hotgrid.plans import queries as Q
from hotgrid.plans import shapes as S
from hotgrid.sources import fixtures as V

CFG = Q.CFG


def num(x: float) -> str:
    """A double literal (a plain one would be a decimal)."""
    return f"CAST('{x!r}' AS DOUBLE)"


def pick(words, at: str) -> str:
    return f"list_extract([{', '.join(repr(w) for w in words)}], CAST({at} AS INTEGER))"


def coordinate(key: str, step: int, base: float, scale: float) -> str:
    return f"{num(base)} + (({key} * {step}) % 1000) * {num(scale)}"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    cos = f"sin(radians({lat1})) * sin(radians({lat2})) + cos(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2}) - radians({lon1}))"
    return f"6371.0 * acos(greatest(-1.0, least(1.0, {cos})))"


def cell(lat: str, lon: str) -> str:
    x = f"(({lon} - {num(CFG.grid_lon)}) * {num(111.320 * math.cos(math.radians(CFG.grid_lat)))})"
    y = f"(({lat} - {num(CFG.grid_lat)}) * {num(110.574)})"
    q, r = f"(({x} * {num(math.sqrt(3) / 3)} - {y} / 3) / {num(CFG.edge_km)})", f"(({y} * {num(2 / 3)}) / {num(CFG.edge_km)})"
    return f"""(SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END || '_' || CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END
      FROM (SELECT CAST(rq0 AS BIGINT) AS rq, CAST(rr0 AS BIGINT) AS rr, CAST(rs0 AS BIGINT) AS rs, abs(rq0 - q) AS dq, abs(rr0 - r) AS dr, abs(rs0 - s) AS ds
      FROM (SELECT q, r, s, floor(q + 0.5) AS rq0, floor(r + 0.5) AS rr0, floor(s + 0.5) AS rs0 FROM (SELECT {q} AS q, {r} AS r, -{q} - {r} AS s))))"""


def ratio(n: str, d: str, bound: float | None = None, default: str = "0.0") -> str:
    x = f"CASE WHEN abs({d}) > 1e-12 THEN CAST({n} AS DOUBLE) / ({d}) ELSE {default} END"
    return x if bound is None else f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(-{bound}.0, least({bound}.0, {x})) END"


OWN = "PARTITION BY cell ORDER BY date"


def roll(x: str, w: int, how: str, over: str = OWN) -> str:
    f = {"mean": "avg", "sum": "sum", "std": "stddev_samp", "max": "max"}[how]
    frame = f"OVER ({over} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"(CASE WHEN count({x}) {frame} >= 2 THEN {f}({x}) {frame} END)"


def lag(x: str, k: int, over: str = OWN) -> str:
    return f"(lag({x}, {k}) OVER ({over}))"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_VIOLENT, _PROPERTY = quoted(E.VIOLENT), quoted(E.PROPERTY)
_CARRIED = (*P.HOURS, *P.CONTEXT)
_COUNTS = ("crimes", "violent", "property", "theft", "battery", "narcotics", "arrests")
_DAYNUM = "(date_diff('day', DATE '1995-01-01', date))"
_AREA = ("population", "income", "labor_force", "unemployed", "poverty_denom", "poverty_count")
_SECOND = "CAST(epoch(incident_ts) AS BIGINT)"


def _percent(p: str, w: str) -> str:
    return f"CASE WHEN {w} > 0 THEN round_even({p} / {w} * 100, 2) END"


#: Named parts, each using only parts above it.
PARTS: dict[str, str] = {
    "incidents": f"""SELECT l_orderkey * 10 + l_linenumber AS unique_key, 'HZ' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS case_number,
      l_shipdate + to_seconds((l_orderkey * 7919 + l_linenumber * 3571) % 86400) AS incident_ts, {pick(V.TYPES, 'l_partkey % 12 + 1')} AS primary_type,
      l_returnflag = 'R' AS arrest, l_linestatus = 'F' AS domestic, s_nationkey + 1 AS community_area,
      {coordinate('l_suppkey', 377, 41.60, 0.00046)} AS latitude, {coordinate('l_suppkey', 531, -87.98, 0.0005)} AS longitude
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "deduped": """SELECT * FROM incidents QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY case_number, incident_ts, primary_type, arrest, domestic, community_area, latitude, longitude) = 1""",
    "clean": f"""SELECT *, {cell('latitude', 'longitude')} AS cell FROM deduped WHERE latitude BETWEEN {num(CFG.box.lat_min)} AND {num(CFG.box.lat_max)}
      AND longitude BETWEEN {num(CFG.box.lon_min)} AND {num(CFG.box.lon_max)} AND incident_ts >= TIMESTAMP '{CFG.first_year}-01-01' AND incident_ts <= TIMESTAMP '{Q.AS_OF}'""",
    "cells": "SELECT cell, count(*) AS n, avg(latitude) AS lat, avg(longitude) AS lon FROM clean GROUP BY cell",
    "offsets": "SELECT * FROM (VALUES (1,1,0),(1,1,-1),(1,0,-1),(1,-1,0),(1,-1,1),(1,0,1),(2,2,0),(2,2,-1),(2,2,-2),(2,1,-2),(2,0,-2),(2,-1,-1),(2,-2,0),(2,-2,1),(2,-2,2),(2,-1,2),(2,0,2),(2,1,1)) AS o(ring, dq, dr)",
    "edges": """SELECT * FROM (SELECT cell, CAST(CAST(split_part(cell, '_', 1) AS BIGINT) + dq AS VARCHAR) || '_' || CAST(CAST(split_part(cell, '_', 2) AS BIGINT) + dr AS VARCHAR) AS nbr, ring
      FROM cells, offsets) WHERE nbr IN (SELECT cell FROM cells)""",
    "rolled": f"""SELECT *, count(*) OVER (PARTITION BY cell ORDER BY s RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS crime_density_7d,
      count(*) OVER (PARTITION BY cell ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) AS crime_density_30d,
      coalesce(avg(CAST(arrest AS INTEGER)) OVER (PARTITION BY cell ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING), 0.0) AS arrest_rate
      FROM (SELECT *, {_SECOND} AS s FROM clean)""",
    "st": f"SELECT 'ST' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS station_id, {num(41.66)} + n_nationkey * {num(0.07)} AS st_lat, {num(-87.90)} + n_nationkey * {num(0.08)} AS st_lon, n_nationkey AS st_no FROM nation",
    "nearest": f"SELECT cell, station_id, d AS km FROM (SELECT cell, station_id, {km('lat', 'lon', 'st_lat', 'st_lon')} AS d FROM cells, st) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY d, station_id) = 1",
    "weather_long": f"""SELECT date, station_id, datatype, (({_DAYNUM} * 37 + st_no * 11 + ti * 101) % 1000) / 10.0 AS value
      FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), st, (SELECT * FROM (VALUES (0,'TMAX'),(1,'TMIN'),(2,'PRCP'),(3,'AWND'),(4,'SNWD')) AS k(ti, datatype)) WHERE {_DAYNUM} % 17 <> 0""",
    "weather": "SELECT date, station_id, " + ", ".join(f"coalesce(min(value) FILTER (datatype = '{k}'), 0.0) AS {v}" for k, v in (("TMAX", "temp_max"), ("TMIN", "temp_min"), ("PRCP", "precipitation"), ("AWND", "wind_speed"), ("SNWD", "snow_depth"))) + " FROM weather_long GROUP BY date, station_id",
    "poi_cells": f"""SELECT {cell('la', 'lo')} AS cell, poi_type FROM (SELECT {coordinate('c_custkey', 613, 41.60, 0.00046)} AS la, {coordinate('c_custkey', 287, -87.98, 0.0005)} AS lo,
      {pick(V.POI_TYPES, 'c_custkey % 5 + 1')} AS poi_type FROM customer)""",
    "presence": """SELECT c.cell, coalesce(min(CASE WHEN poi_type = 'school' THEN 0.2 END), 1.5) AS dist_nearest_school, coalesce(min(CASE WHEN poi_type = 'transit_station' THEN 0.2 END), 2.0) AS dist_nearest_station,
      coalesce(min(CASE WHEN poi_type = 'park' THEN 0.2 END), 1.2) AS dist_nearest_park, coalesce(min(CASE WHEN poi_type = 'nightlife' THEN 0.2 END), 2.5) AS dist_nearest_nightlife
      FROM cells c LEFT JOIN poi_cells p ON c.cell = p.cell GROUP BY c.cell""",
    "areas": f"""SELECT p_partkey % 25 + 1 AS community_area, {', '.join(f'sum({e}) AS {n}' for n, e in zip(_AREA, ('CAST(p_size * 100 AS DOUBLE)', 'p_retailprice * 40', 'CAST(p_size * 60 AS DOUBLE)', 'CAST(p_size * (p_partkey % 9) AS DOUBLE)', 'CAST(p_size * 95 AS DOUBLE)', 'CAST(p_size * (p_partkey % 23) AS DOUBLE)'), strict=True))}
      FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1""",
    "socio": f"""SELECT community_area, coalesce(upper(trim(n_name)), '') AS community_area_name, CASE WHEN population > 0 THEN round_even(income / population, 2) END AS per_capita_income,
      {_percent('unemployed', 'labor_force')} AS unemployment_rate, CAST(round_even(poverty_count / nullif(poverty_denom, 0) * 100, 0) AS INTEGER) AS hardship_index, population AS population_density
      FROM areas LEFT JOIN nation ON community_area = n_nationkey + 1""",
    "gold": """SELECT r.*, CAST(incident_ts AS DATE) AS date, hour(incident_ts) AS hour_of_day, isodow(incident_ts) - 1 AS day_of_week, month(incident_ts) AS month,
      coalesce(w.temp_max, 0) AS temp_max, coalesce(w.temp_min, 0) AS temp_min, coalesce(w.precipitation, 0) AS precipitation, coalesce(w.wind_speed, 0) AS wind_speed, dist_nearest_school, dist_nearest_station, dist_nearest_park, dist_nearest_nightlife,
      coalesce(unemployment_rate, 0) AS unemployment_rate, coalesce(hardship_index, 0) AS hardship_index, coalesce(population_density, 0) AS population_density, coalesce(per_capita_income, 0) AS per_capita_income
      FROM rolled r JOIN nearest n ON r.cell = n.cell JOIN presence p ON r.cell = p.cell LEFT JOIN weather w ON w.date = CAST(incident_ts AS DATE) AND w.station_id = n.station_id LEFT JOIN socio s ON s.community_area = r.community_area""",
    "facts": f"""SELECT *, CAST(primary_type IN ({_VIOLENT}) AS INTEGER) AS is_violent, CAST(primary_type IN ({_PROPERTY}) AS INTEGER) AS is_property, CAST(primary_type = 'THEFT' AS INTEGER) AS is_theft, CAST(primary_type = 'BATTERY' AS INTEGER) AS is_battery,
      CAST(regexp_matches(primary_type, 'NARCOTIC|DRUG') AS INTEGER) AS is_narcotics, CAST(hour_of_day IN (22, 23, 0, 1, 2, 3, 4, 5) AS INTEGER) AS f_night, CAST(hour_of_day BETWEEN 6 AND 11 AS INTEGER) AS f_morning,
      CAST(hour_of_day BETWEEN 12 AND 17 AS INTEGER) AS f_afternoon, CAST(hour_of_day BETWEEN 18 AND 21 AS INTEGER) AS f_evening FROM gold WHERE date >= (SELECT max(date) FROM gold) - {CFG.lookback_days}""",
    "per_day": """SELECT cell, date, count(*) AS crimes, sum(is_violent) AS violent, sum(is_property) AS property, sum(is_theft) AS theft, sum(is_battery) AS battery, sum(is_narcotics) AS narcotics, sum(CAST(arrest AS INTEGER)) AS arrests,
      avg(f_night) AS is_night, avg(f_morning) AS is_morning, avg(f_afternoon) AS is_afternoon, avg(f_evening) AS is_evening, """ + ", ".join(f"avg({c}) AS {c}" for c in P.CONTEXT) + " FROM facts GROUP BY cell, date",
    "modal": "SELECT cell, community_area FROM (SELECT cell, community_area, count(*) AS n FROM facts GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, community_area) = 1",
    "grid": "SELECT cell, community_area, CAST(d AS DATE) AS date FROM modal, (SELECT unnest(generate_series((SELECT min(date) FROM per_day), (SELECT max(date) FROM per_day), INTERVAL 1 DAY)) AS d)",
    "panel0": "SELECT g.cell, g.date, g.community_area, " + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTS) + ", "
    + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY g.cell ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in _CARRIED)
    + " FROM grid g LEFT JOIN per_day p ON g.cell = p.cell AND g.date = p.date",
    "splits": f"""SELECT date, CASE WHEN i <= {CFG.warm_up_days} THEN 'warm_up' WHEN back <= 14 THEN 'test' WHEN back <= 21 THEN 'val' WHEN back <= 42 THEN 'calib' WHEN back <= 262 THEN 'train' ELSE 'unused' END AS split
      FROM (SELECT date, row_number() OVER (ORDER BY date) AS i, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM panel0))""",
    "medians": "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _CARRIED) + " FROM panel0 WHERE date IN (SELECT date FROM splits WHERE split = 'train')",
    "panel": "SELECT cell, date, community_area, " + ", ".join(_COUNTS) + ", CAST(crimes > 0 AS INTEGER) AS crime_today, isodow(date) - 1 AS dayofweek, month(date) AS month, dayofyear(date) AS dayofyear, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(isodow(date) = 1 AS INTEGER) AS is_monday, CAST(isodow(date) = 5 AS INTEGER) AS is_friday, " + ", ".join(f"coalesce({c}, m_{c}, 0.0) AS {c}" for c in _CARRIED) + " FROM panel0, medians",
    "train": "SELECT * FROM panel WHERE date IN (SELECT date FROM splits WHERE split = 'train')",
    "targets": f"""SELECT cell, date, t AS next_total, CASE WHEN t IS NOT NULL THEN CAST(t >= 1 AS INTEGER) END AS next_has_crime, CASE WHEN t IS NOT NULL THEN CAST(t >= 2 AS INTEGER) END AS next_hotspot,
      CASE WHEN t IS NULL THEN NULL WHEN t >= 2 THEN 2 ELSE t END AS next_topk_group, NULL AS next_rank_pct, CASE WHEN t IS NOT NULL THEN CAST(v > p AS INTEGER) END AS next_violent, CASE WHEN t IS NOT NULL THEN CAST(p > v AS INTEGER) END AS next_property
      FROM (SELECT cell, date, lead(crimes) OVER ({OWN}) AS t, lead(violent) OVER ({OWN}) AS v, lead(property) OVER ({OWN}) AS p FROM panel)""",
    "scored": "SELECT *, round(temporal * 0.4e0 + spatial * 0.4e0 + context * 0.2e0, 9) AS score FROM (SELECT t.*, " + ", ".join(f"((no * {a} + {_DAYNUM} * {b}) % 10007) / 10007.0e0 AS {n}" for n, (a, b) in (Q.SCORES | Q.TYPE_SCORES).items()) + " FROM targets t JOIN (SELECT cell, row_number() OVER (ORDER BY cell) AS no FROM cells WHERE cell IN (SELECT cell FROM panel)) USING (cell))",
    "tiers": "SELECT *, CASE WHEN rank_pct <= 0.05 THEN 'CRITICAL' WHEN rank_pct <= 0.15 THEN 'HIGH' WHEN rank_pct <= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM (SELECT *, rank / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) AS rank_pct FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, cell) AS rank FROM scored))",
    "predictions": """SELECT *, CASE WHEN confidence_score <= 0.5 THEN 'LOW' WHEN confidence_score <= 0.75 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence_level FROM (SELECT *, date + 1 AS prediction_date, greatest(temporal, spatial, context) - least(temporal, spatial, context) AS score_range,
      greatest(0, least(1, 0.45 * agreement + 0.35 * greatest(0, least(1, least(abs(rank_pct - 0.05), abs(rank_pct - 0.15), abs(rank_pct - 0.30)) / 0.05)) + 0.20 * abs(0.5 - rank_pct) * 2)) AS confidence_score,
      least(abs(rank_pct - 0.05), abs(rank_pct - 0.15), abs(rank_pct - 0.30)) AS margin_to_cut,
      CASE WHEN score < 0.5 THEN 'UNKNOWN' WHEN violent_probability > property_probability + 0.05 THEN 'VIOLENT' WHEN property_probability > violent_probability + 0.05 THEN 'PROPERTY' ELSE 'MIXED' END AS dominant_type
      FROM (SELECT *, greatest(0, least(1, 1 - 2 * score_std)) AS agreement FROM (SELECT *, sqrt((pow(temporal - m, 2) + pow(spatial - m, 2) + pow(context - m, 2)) / 3) AS score_std FROM (SELECT *, (temporal + spatial + context) / 3 AS m FROM tiers))))""",
    "forecast": "SELECT p.*, lat AS latitude, lon AS longitude FROM predictions p LEFT JOIN cells USING (cell) WHERE prediction_date = (SELECT max(prediction_date) FROM predictions)",
    "grid60": "SELECT CAST(i AS INTEGER) AS step, round(0.05e0 + 0.01e0 * (i - 1), 2) AS threshold FROM range(1, 61) AS t(i)",
    "thresholds": """SELECT threshold, tp, predicted, f1, f1 AS plain, f1 - 0.35 * greatest(0.0, predicted / CAST(n AS DOUBLE) - least(0.95, 2.2 * p / CAST(n AS DOUBLE))) AS objective FROM (SELECT threshold, tp, predicted, n, p, CASE WHEN predicted + p > 0 THEN 2.0 * tp / (predicted + p) ELSE 0.0 END AS f1
      FROM (SELECT threshold, count(*) AS n, sum(next_hotspot) AS p, sum(CASE WHEN score >= threshold - 1e-8 THEN next_hotspot ELSE 0 END) AS tp, count(*) FILTER (score >= threshold - 1e-8) AS predicted FROM grid60, (SELECT * FROM scored WHERE next_hotspot IS NOT NULL) GROUP BY threshold))""",
    "s1": "SELECT score, sum(next_hotspot) AS pos, count(*) AS n FROM scored WHERE next_hotspot IS NOT NULL GROUP BY score",
    "top": "SELECT k, date, sum(next_hotspot) AS tp, count(*) AS taken, max(pos) AS pos, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, cell) AS rk, count(*) OVER (PARTITION BY date) AS n, sum(next_hotspot) OVER (PARTITION BY date) AS pos FROM scored WHERE next_hotspot IS NOT NULL), (SELECT unnest([0.05e0, 0.1e0, 0.15e0, 0.25e0, 0.3e0]) AS k) WHERE rk <= greatest(1, ceil(round(k * n, 9))) GROUP BY k, date",
    "comm_day": "SELECT community_area, date, sum(crimes) AS comm_total, sum(crime_today) AS comm_active, sum(violent) AS comm_violent, sum(property) AS comm_property, sum(arrests) AS comm_arrests, count(DISTINCT cell) AS n_h3_in_comm FROM panel GROUP BY ALL",
    "city_day": "SELECT date, sum(crimes) AS city_total, sum(crime_today) AS city_active, sum(violent) AS city_violent, sum(property) AS city_property, sum(arrests) AS city_arrests FROM panel GROUP BY date",
    "nbr_day": """SELECT e.cell, date, avg(crimes) FILTER (ring = 1) AS m, sum(crimes) FILTER (ring = 1) AS s, max(crimes) FILTER (ring = 1) AS x, stddev_pop(crimes) FILTER (ring = 1) AS d, avg(crime_today) FILTER (ring = 1) AS ar, sum(crime_today) FILTER (ring = 1) AS ac, count(*) FILTER (ring = 1) AS nc,
      avg(crimes) FILTER (ring = 2) AS m2, count(*) FILTER (ring = 2) AS nc2 FROM pedges e JOIN panel p ON p.cell = e.nbr GROUP BY e.cell, date""",
}
PARTS = {k: v for k, v in PARTS.items() if k != "nbr_day"} | {"pedges": "SELECT * FROM edges WHERE cell IN (SELECT cell FROM modal) AND nbr IN (SELECT cell FROM modal)", "nbr_day": PARTS["nbr_day"]}


def full(sql: str) -> str:
    """Put the named parts that a statement uses in front of it."""
    used, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for k in PARTS:
            if k not in used and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{k}\b", text):
                used.add(k)
                todo.append(PARTS[k])
    if not used:
        return sql
    order = [k for k in PARTS if k in used]
    # materialized parts are computed once however often they are used
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({PARTS[k]})" for k in order) + " " + sql


def _select(exprs: dict[str, str], frm: str = "panel", keys: str = "cell, date") -> str:
    return f"SELECT {keys}, " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {frm}"


_L0 = lambda c: f"coalesce({c}, 0)"
_CLIP10 = lambda c: f"greatest(0, least(10, {c}))"
_WINDOWS = (
    {f"lag_{k}": lag("crimes", k) for k in X.LAGS}
    | {f"{t}_lag_{k}": lag(t, k) for t in X.TYPES for k in (1, 2, 3, 7, 14)}
    | {"prev_crime": lag("crime_today", 1)}
    | {f"roll_{how}_{w}": roll("crimes", w, how) for w in X.ROLLS for how in ("mean", "sum", "std", "max")}
    | {f"active_rate_{w}": roll("crime_today", w, "mean") for w in (7, 14, 30, 60)}
    | {f"{t}_roll_sum_{w}": roll(t, w, "sum") for w in (7, 14, 30) for t in X.TYPES}
    | {k: e for v in X.WEATHER for k, e in ((f"{v}_lag1", lag(v, 1)), (f"{v}_lag7", lag(v, 7)), (f"{v}_roll7", roll(v, 7, "mean")), (f"{v}_diff1", f"{v} - {lag(v, 1)}"))}
    | {f"had_crime_{k}d": f"CAST({_L0(lag('crimes', k))} > 0 AS INTEGER)" for k in (1, 2, 3)}
    | {"near_repeat_5d": _L0(f"sum(crime_today) OVER ({OWN} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")}
    | {f"arrest_roll_{w}": roll("arrests", w, "sum") for w in (7, 30)}
    | {"same_dow_roll8": roll("crimes", 8, "mean", "PARTITION BY cell, dayofweek ORDER BY date")}
)
_DERIVED = (
    {"zero_today": "CAST(crimes = 0 AS INTEGER)"}
    | {f"{t}_ratio_day": ratio(t, "crimes", 1) for t in ("violent", "property", "theft", "narcotics")}
    | {f"burst_{a}_{b}": ratio(f"roll_mean_{a}", f"roll_mean_{b}", 10) for a, b in ((3, 30), (7, 30), (14, 60))}
    | {f"crime_z_{w}": ratio(f"(crimes - coalesce(roll_mean_{w}, 0))", f"coalesce(roll_std_{w}, 0)", 10) for w in (30, 90)}
    | {f"shock_lag1_vs_roll{w}": ratio("lag_1", f"(roll_mean_{w} + 0.001)", 20) for w in (7, 30)}
    | {f"shock_3_{w}": ratio("roll_mean_3", f"(roll_mean_{w} + 0.001)", 10) for w in (14, 60)}
    | {"roll3_minus_roll30": f"{_L0('roll_mean_3')} - {_L0('roll_mean_30')}", "roll7_minus_roll60": f"{_L0('roll_mean_7')} - {_L0('roll_mean_60')}"}
    | {f"{t}_roll_ratio_{w}": ratio(f"{t}_roll_sum_{w}", f"roll_sum_{w}", 1) for w in (7, 14, 30) for t in X.TYPES}
    | {f"arrest_rate_{w}": ratio(f"arrest_roll_{w}", f"(roll_sum_{w} + 0.001)", 1) for w in (7, 30)}
    | {
        "local_spike_z_30": ratio(f"({_L0('lag_1')} - {_L0('roll_mean_30')})", f"({_L0('roll_std_30')} + 0.001)", 10),
        "local_sudden_activation_3d": f"CAST({_L0('lag_1')} > 0 AND {_L0('lag_2')} <= 0 AND {_L0('lag_3')} <= 0 AS INTEGER)",
        "local_recent_decay": f"0.55e0 * {_L0('lag_1')} + 0.30e0 * {_L0('lag_2')} + 0.15e0 * {_L0('lag_3')}",
        "active_recent_vs_long": ratio("active_rate_7", "(active_rate_60 + 0.001)", 10),
        "near_repeat_3d": "had_crime_1d + had_crime_2d + had_crime_3d",
        "property_lead_violent": "property_lag_1 * CAST(violent_lag_1 = 0 AS INTEGER)",
        "narcotics_before_violent": f"CAST({_L0('narcotics_lag_1')} > 0 AS INTEGER)",
        "violent_x_property_lag1": "violent_lag_1 * property_lag_1",
        "trend_slope_7_14": ratio("(roll_mean_7 - roll_mean_14)", "(roll_mean_14 + 0.001)", 5),
        "trend_slope_14_30": ratio("(roll_mean_14 - roll_mean_30)", "(roll_mean_30 + 0.001)", 5),
        "same_dow_vs_overall": ratio("same_dow_roll8", "(roll_mean_30 + 0.001)", 5),
    }
)
_LAST = {"deterrence_signal": "arrest_rate_7 * (1 - greatest(0, least(1, burst_7_30)))", "trend_direction": "sign(trend_slope_7_14)", "crime_acceleration": "trend_slope_7_14 - trend_slope_14_30"}
_listed = lambda xs: ", ".join(f"{e} AS {n}" for n, e in xs.items())
_EWM = "WITH RECURSIVE d AS (SELECT cell, date, crimes, row_number() OVER (PARTITION BY cell ORDER BY date) - 1 AS t FROM panel), e AS (SELECT cell, t, " + ", ".join(f"CAST(crimes AS DOUBLE) AS y{s}" for s in X.SPANS) + " FROM d WHERE t = 0 UNION ALL SELECT d.cell, d.t, " + ", ".join(f"e.y{s} + {num(2.0 / (s + 1))} * (d.crimes - e.y{s})" for s in X.SPANS) + " FROM e JOIN d ON d.cell = e.cell AND d.t = e.t + 1) SELECT d.cell, d.date, " + ", ".join(f"CASE WHEN d.t >= 2 THEN e.y{s} END AS ewm_{s}" for s in X.SPANS) + " FROM d LEFT JOIN e ON e.cell = d.cell AND e.t = d.t - 1"
_STREAK = f"""SELECT cell, date, zero_streak, CAST(crimes > 0 AND coalesce(lag(zero_streak) OVER ({OWN}), 0) >= 3 AS INTEGER) AS reactivation FROM (SELECT *, CASE WHEN crimes > 0 THEN 0 ELSE row_number() OVER (PARTITION BY cell, island ORDER BY date) - CAST(island > 0 AS INTEGER) END AS zero_streak
      FROM (SELECT *, sum(CAST(crimes > 0 AS INTEGER)) OVER ({OWN} ROWS UNBOUNDED PRECEDING) AS island FROM panel))"""
_COMM = "PARTITION BY community_area ORDER BY date"
_COMMS = {f"comm_roll_{how}_{w}": roll("comm_total", w, how, _COMM) for w in (7, 14, 30, 60) for how in ("mean", "sum")} | {"comm_burst_7_30": ratio(roll("comm_total", 7, "mean", _COMM), roll("comm_total", 30, "mean", _COMM), 10), "comm_active_rate": ratio("comm_active", "n_h3_in_comm", 1)}
_CITY = {k: e for c in S.CITY for k, e in ((f"{c}_lag1", lag(c, 1, "ORDER BY date")), *[(f"{c}_roll_mean_{w}", roll(c, w, "mean", "ORDER BY date")) for w in (7, 14, 30)])} | {"city_burst_7_30": ratio(roll("city_total", 7, "mean", "ORDER BY date"), roll("city_total", 30, "mean", "ORDER BY date"), 10)}
_SEVEN = lambda c: f"CASE WHEN count(*) OVER w7 >= 2 THEN avg({c}) OVER w7 ELSE 0.0 END"
_BEFORE = f"coalesce(lag(nbr_r1_active_rate) OVER ({OWN}), 0)"
_NBR = f"""SELECT *, CAST(nbr_r1_active_rate > 0 AND {_BEFORE} <= 0 AS INTEGER) AS nbr_r1_new_activation, nbr_r1_active_rate - {_BEFORE} AS nbr_r1_active_accel,
  {ratio('nbr_r1_mean', '(nbr_r1_roll7 + 0.001)', 10)} AS nbr_r1_burst_1_7, {ratio('nbr_r1_mean', '(nbr_r2_mean + 0.001)', 10)} AS nbr_r1_vs_r2, CAST(nbr_r1_active_rate > 0.5 AS INTEGER) AS nbr_contagion,
  {ratio('nbr_r1_active_rate', '(nbr_r1_active_roll7 + 0.001)', 10)} AS nbr_r1_active_burst, {ratio('nbr_r1_std', '(nbr_r1_mean + 0.001)', 10)} AS nbr_dispersion_signal,
  {ratio('(nbr_r1_mean - nbr_r1_roll7)', '(nbr_r1_std + 0.001)', 10)} AS nbr_r1_spike_vs_roll7, {ratio('nbr_r1_active_count', 'nbr_r1_neighbor_count', 1)} AS nbr_hot_count_per_neighbor
  FROM (SELECT *, {_SEVEN('nbr_r1_mean')} AS nbr_r1_roll7, {_SEVEN('nbr_r1_active_rate')} AS nbr_r1_active_roll7, CAST(nbr_r1_active_count > 0 AS INTEGER) AS nbr_r1_any_active
  FROM (SELECT p.cell, p.date, {', '.join(f'coalesce(lag({a}) OVER (PARTITION BY p.cell ORDER BY p.date), 0) AS {b}' for a, b in (('m', 'nbr_r1_mean'), ('s', 'nbr_r1_sum'), ('x', 'nbr_r1_max'), ('d', 'nbr_r1_std'), ('ar', 'nbr_r1_active_rate'), ('ac', 'nbr_r1_active_count'), ('m2', 'nbr_r2_mean')))}, coalesce(nc, 0) AS nbr_r1_neighbor_count, coalesce(nc2, 0) AS nbr_r2_neighbor_count
  FROM panel p LEFT JOIN nbr_day n ON n.cell = p.cell AND n.date = p.date) WINDOW w7 AS ({OWN} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
_STATS = lambda p: f"avg(crimes) AS {p}_mean, stddev_samp(crimes) AS {p}_std, sum(crimes) AS {p}_sum, max(crimes) AS {p}_max"
_PCT = lambda p: f"(rank() OVER (ORDER BY {p}_mean) + (count(*) OVER (PARTITION BY {p}_mean) - 1) / 2.0) / count(*) OVER () AS {p}_percentile"
_FILLED = [f"{p}_{n}" for p in ("h3_train", "comm_train") for n in ("mean", "std", "sum", "max", "percentile")] + ["h3_train_active_rate"]
_PRIORS = f"""SELECT *, h3_train_percentile AS h3_train_pct, {ratio('h3_train_mean', '(comm_train_mean + 0.001)', 20)} AS h3_vs_comm_prior FROM (SELECT c.cell, c.community_area, {', '.join(f'coalesce({x}, 0) AS {x}' for x in _FILLED)}
  FROM modal c LEFT JOIN (SELECT *, {_PCT('h3_train')} FROM (SELECT cell, {_STATS('h3_train')}, avg(crime_today) AS h3_train_active_rate FROM train GROUP BY cell)) USING (cell)
  LEFT JOIN (SELECT *, {_PCT('comm_train')} FROM (SELECT community_area, {_STATS('comm_train')} FROM train GROUP BY community_area)) USING (community_area))"""
_PEOPLE = "greatest(coalesce(population_density, 0), 1.0)"
_COLD = f"CAST({_L0('lag_1')} <= 0 AS INTEGER)"
_SPILL = {
    "h3_vs_nbr_r1": ratio("roll_mean_7", "(nbr_r1_mean + 0.001)", 20), "h3_above_nbr": "coalesce(CAST(lag_1 > nbr_r1_mean AS INTEGER), 0)", "h3_nbr_joint_activity": f"{_L0('active_rate_7')} * nbr_r1_active_rate",
    "nbr_r1_hot_count_x_local_cold": f"nbr_r1_active_count * {_COLD}", "nbr_max_vs_local_lag1": ratio("nbr_r1_max", f"({_L0('lag_1')} + 0.001)", 20), "local_nbr_double_burst": f"{_CLIP10(_L0('burst_3_30'))} * {_CLIP10('nbr_r1_burst_1_7')}",
    "nbr_any_active_x_local_cold": f"nbr_r1_any_active * {_COLD}", "nbr_spike_x_local_sudden": "CAST(nbr_r1_spike_vs_roll7 > 1.0 AS INTEGER) * local_sudden_activation_3d",
}
_RELATION = {
    "crime_per_1000pop": ratio("crimes * 1000.0", _PEOPLE, 50), "crime_roll7_per_1000pop": ratio("roll_mean_7 * 1000.0", _PEOPLE, 50), "crime_vs_density_expected": f"crimes - {_PEOPLE} * city_rate",
    "h3_city_share_7": ratio("roll_mean_7", "(city_total_roll_mean_7 + 0.001)", 1), "h3_city_share_30": ratio("roll_mean_30", "(city_total_roll_mean_30 + 0.001)", 1),
    "hardship_x_roll7": f"{_L0('hardship_index')} * {_L0('roll_mean_7')}", "hardship_x_active_rate": f"{_L0('hardship_index')} * {_L0('active_rate_7')}", "hardship_x_nbr_r1": f"{_L0('hardship_index')} * {_L0('nbr_r1_mean')}",
    "unemployment_x_reactivation": f"{_L0('unemployment_rate')} * reactivation", "unemployment_x_zero_streak": f"{_L0('unemployment_rate')} * CAST(zero_streak > 7 AS INTEGER)",
    "h3_recent_vs_comm": ratio("roll_mean_7", "(comm_roll_mean_7 + 0.001)", 20), "high_prior_x_weekend": "h3_train_percentile * is_weekend", "high_prior_x_friday": "h3_train_percentile * is_friday",
    "high_prior_x_holiday": "h3_train_percentile * is_holiday", "active_rate_vs_train": ratio("active_rate_7", "(h3_train_active_rate + 0.001)", 10),
}
_CYCLE = {f"{n}_{f}": f"{f}({x} * {num(2 * math.pi / p)})" for n, x, p in (("dow", "dayofweek", 7), ("month", "month", 12), ("doy", "dayofyear", 366)) for f in ("sin", "cos")}
_HOLIDAYS = "(SELECT make_date(y, m, d) AS holiday FROM range(1995, 2002) AS t(y), (VALUES (1, 1), (5, 30), (7, 4), (11, 24), (12, 25)) AS md(m, d))"
_HOLIDAY = f"""SELECT *, CAST(days_from_holiday <= 2 OR days_to_holiday <= 2 AS INTEGER) AS holiday_window FROM (SELECT date, CAST(coalesce(a, 365) = 0 AS INTEGER) AS is_holiday, least(coalesce(a, 365), 30) AS days_from_holiday, least(coalesce(b, 365), 30) AS days_to_holiday
      FROM (SELECT date, min(g) FILTER (g >= 0) AS a, min(-g) FILTER (g < 0) AS b FROM (SELECT date, date_diff('day', holiday, date) AS g FROM (SELECT DISTINCT CAST(incident_ts AS DATE) AS date FROM incidents), {_HOLIDAYS}) WHERE abs(g) <= 365 OR g IS NULL GROUP BY date))"""
_PANEL_HOLIDAY = _HOLIDAY.replace("SELECT DISTINCT CAST(incident_ts AS DATE) AS date FROM incidents", "SELECT DISTINCT date FROM panel")
_CALENDAR = f"SELECT *, {_listed(_CYCLE)} FROM panel"
PARTS |= {
    "calendar": _CALENDAR,
    "windows": f"SELECT *, {_listed(_WINDOWS)} FROM calendar",
    "own": f"SELECT *, {_listed(_LAST)} FROM (SELECT *, {_listed(_DERIVED)} FROM windows)",
    "ewms": _EWM,
    "streaks": _STREAK,
    "comms": f"SELECT *, {_listed(_COMMS)} FROM comm_day",
    "cities": f"SELECT *, {_listed(_CITY)} FROM city_day",
    "nbrs": _NBR,
    "priors": _PRIORS,
    "rate": f"SELECT sum(crimes) / greatest(sum({_PEOPLE}), 1.0) AS city_rate FROM train",
    "panel_holidays": _PANEL_HOLIDAY,
    "joined": """SELECT * FROM own JOIN ewms USING (cell, date) JOIN streaks USING (cell, date) JOIN nbrs USING (cell, date) LEFT JOIN (SELECT * EXCLUDE (comm_total, comm_active, comm_violent, comm_property, comm_arrests) FROM comms) USING (community_area, date)
      LEFT JOIN (SELECT * EXCLUDE (city_total, city_active, city_violent, city_property, city_arrests) FROM cities) USING (date) LEFT JOIN panel_holidays USING (date) LEFT JOIN (SELECT * EXCLUDE (community_area) FROM priors) USING (cell), rate""",
    "framed": f"SELECT *, {_listed(_SPILL | _RELATION)} FROM joined",
    "frame": "SELECT * RENAME (" + ", ".join(f"{a} AS {b}" for a, b in X.RAW_NAMES.items()) + ") FROM framed",
    "supervised": "SELECT * FROM frame JOIN targets USING (cell, date) JOIN splits USING (date)",
    "errors": " UNION ALL ".join(f"SELECT '{n}' AS scenario, cell, date, {n} AS score, CASE WHEN next_hotspot = 1 AND {n} < 0.5 THEN 'FN' WHEN next_hotspot = 0 AND {n} >= 0.5 THEN 'FP' END AS error FROM scored WHERE next_hotspot IS NOT NULL" for n in Q.SCORES),
    "metrics": """SELECT tp / predicted AS precision, tp / p AS recall, 2 * tp / (predicted + p) AS f1, (ranks - p * (p + 1) / 2) / (p * (n - p)) AS auc, ap / p AS ap, predicted / n AS predicted_rate, p / n AS base_rate
      FROM (SELECT CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n) AS DOUBLE) AS n, sum(pos * (below + (n + 1) / 2.0)) AS ranks, sum(pos * tpc / CAST(upto AS DOUBLE)) AS ap, CAST(sum(pos) FILTER (score >= 0.5) AS DOUBLE) AS tp, CAST(sum(n) FILTER (score >= 0.5) AS DOUBLE) AS predicted
      FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (ORDER BY score DESC) AS tpc, sum(n) OVER (ORDER BY score DESC) AS upto FROM s1))""",
    "exported": f"SELECT *, CASE WHEN primary_type IN ({_VIOLENT}) THEN 'VIOLENT' WHEN primary_type IN ({_PROPERTY}) THEN 'PROPERTY' ELSE 'OTHER' END AS crime_category FROM gold WHERE date >= DATE '2001-11-04' - 365 QUALIFY row_number() OVER (PARTITION BY date - CAST(dayofweek(date) AS INTEGER) ORDER BY md5('7:' || unique_key)) <= {CFG.sample_per_week}",
    "shapes": f"""SELECT lat, lon, CASE c_custkey % 6 WHEN 0 THEN 'transit_station' WHEN 1 THEN 'school' WHEN 2 THEN 'park' WHEN 3 THEN 'nightlife' WHEN 4 THEN 'nightlife' END AS poi_type FROM (SELECT c_custkey, {coordinate('c_custkey', 613, 41.60, 0.00046)} AS lat, {coordinate('c_custkey', 287, -87.98, 0.0005)} AS lon FROM customer)""",
}
_features = lambda ddl, frm="own": f"SELECT {', '.join(c.split()[0] for c in (S.KEY + ', ' + ddl).split(', '))} FROM {frm}"


def _rule(rules: R.Rules, rest: str) -> str:
    test = lambda p: f"starts_with(feature, '{p[1:]}')" if p[0] == "^" else f"contains(feature, '{p}')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(test, parts.split()))} THEN '{kind}'" for kind, parts in rules) + f" ELSE '{rest}' END"


_CANDIDATES = [n for n, t in (c.split() for c in S.FRAME_COLS.split(", ")) if t in ("int", "long", "double") and n not in R.GUARDED]

#: Metrics of the validation and the test days, and the whole predictions table.
_SHARES = {0.05: "top05", 0.15: "top15", 0.30: "top30"}
_CONTEXT = ("hardship_index", "unemployment_rate", "population_density", "h3_train_percentile", "h3_train_active_rate", "roll_mean_7", "roll_mean_30", "zero_streak", "nbr_r1_mean", "nbr_r1_active_rate", "nbr_r1_active_count", "near_repeat_3d", "arrest_rate_7", "is_holiday")
_STAMPS = ("auc", "ap", "f1", *[f"{n}_{c}" for n in _SHARES.values() for c in ("recall", "lift")])
PARTS |= {
    "held": "SELECT scored.*, split FROM scored JOIN splits USING (date) WHERE split IN ('val', 'test') AND next_hotspot IS NOT NULL",
    "held_counts": """SELECT *, sum(n) OVER (PARTITION BY split ORDER BY score) - n AS below, sum(pos) OVER (PARTITION BY split ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY split ORDER BY score DESC) AS seen
      FROM (SELECT split, score, sum(next_hotspot) AS pos, count(*) AS n FROM held GROUP BY ALL)""",
    "held_sums": """SELECT split, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n) AS DOUBLE) AS n, sum(pos * (below + (n + 1) / 2.0)) AS ranks, sum(pos * tp / CAST(seen AS DOUBLE)) AS parts,
      CAST(coalesce(sum(pos) FILTER (score >= 0.5), 0) AS DOUBLE) AS hit, CAST(coalesce(sum(n) FILTER (score >= 0.5), 0) AS DOUBLE) AS predicted FROM held_counts GROUP BY split""",
    "held_days": """SELECT split, k, avg(tp / CAST(greatest(1, pos) AS DOUBLE)) AS recall, avg(CASE WHEN pos > 0 THEN (tp / CAST(taken AS DOUBLE)) / (pos / CAST(n AS DOUBLE)) ELSE 0.0 END) AS lift
      FROM (SELECT split, k, date, sum(next_hotspot) AS tp, count(*) AS taken, max(pos) AS pos, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, cell) AS rk,
      count(*) OVER (PARTITION BY date) AS n, sum(next_hotspot) OVER (PARTITION BY date) AS pos FROM held), (SELECT unnest([0.05e0, 0.15e0, 0.3e0]) AS k) WHERE rk <= greatest(1, ceil(round(k * n, 9))) GROUP BY ALL) GROUP BY ALL""",
    "held_top": "SELECT split, " + ", ".join(f"max({c}) FILTER (k = {k!r}e0) AS {n}_{c}" for k, n in _SHARES.items() for c in ("recall", "lift")) + " FROM held_days GROUP BY split",
    "by_split": f"""SELECT split, {ratio("hit", "predicted")} AS precision, {ratio("hit", "p")} AS recall, {ratio("2 * hit", "(predicted + p)")} AS f1, {ratio("(ranks - p * (p + 1) / 2)", "(p * (n - p))")} AS auc, {ratio("parts", "p")} AS ap, held_top.* EXCLUDE (split)
      FROM held_sums JOIN held_top USING (split)""",
    "stamped": "SELECT " + ", ".join(f"round(max({n}) FILTER (split = '{k}'), 4) AS {k}_{n}" for k in ("val", "test") for n in _STAMPS) + " FROM by_split",
    "full_table": f"""SELECT p.prediction_date, p.cell AS h3_index, round(p.score * 1e9) AS chance_ppb, round(p.score * 1e9) AS score_ppb, risk_level, '{Q.MADE[:10]}.groupblend' AS model_version, CAST(epoch(TIMESTAMP '{Q.MADE}') AS BIGINT) AS made_sec,
      CAST(p.score >= 0.5 AS INTEGER) AS pred_hotspot, violent_probability, property_probability, dominant_type, rank AS risk_rank, rank_pct AS risk_rank_pct, confidence_score, confidence_level,
      temporal AS temporal_score, spatial AS spatial_score, context AS context_score, score_std AS group_score_std, score_range AS group_score_range, agreement AS model_agreement, margin_to_cut AS score_margin_to_cutoff,
      greatest(0, least(1, margin_to_cut / 0.05)) AS rank_margin_confidence, abs(0.5 - rank_pct) * 2 AS rank_extremity, 0.4 AS group_w_temporal, 0.4 AS group_w_spatial, 0.2 AS group_w_context, stamped.*,
      f.community_area, coalesce(n_name, 'Unknown') AS community_area_name, {", ".join(_CONTEXT)}
      FROM predictions p JOIN frame f ON p.cell = f.cell AND p.date = f.date LEFT JOIN nation ON f.community_area = n_nationkey + 1, stamped""",
}

#: The features that have a value, and more than one, in the training rows.
_KEPT = f"SELECT feature FROM (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CANDIDATES)} FROM supervised WHERE split = 'train' AND next_total IS NOT NULL) UNPIVOT (value FOR feature IN ({', '.join(_CANDIDATES)})) GROUP BY feature HAVING min(value) < max(value)"


def _medians(names, where: str) -> str:
    """(feature, median) of many columns."""
    listed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in names)
    return f"SELECT feature, quantile_cont(value, 0.5) AS median FROM (SELECT {listed} FROM supervised WHERE {where}) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(names)})) GROUP BY feature"

_PROFILED = {"crimes": 1, "violent": 1, "property": 1, "arrests": 1, "crime_today": 1, "temp_max": 1, "unemployment_rate": 1, "is_weekend": 1, "month": 1}
_WEIGHT = "least(12.0, pow(CASE WHEN p > 0 THEN q / CAST(p AS DOUBLE) ELSE 1.0 END, 0.7)) * 1.25"

STATEMENTS: dict[str, str] = {
    "clean_incidents": f"SELECT *, {_SECOND} AS incident_sec, {km('latitude', 'longitude', num(CFG.center_lat), num(CFG.center_lon))} AS distance_to_center_km FROM clean",
    "distance_to_center": f"SELECT unique_key, {km('latitude', 'longitude', num(CFG.center_lat), num(CFG.center_lon))} AS distance_km FROM deduped",
    "dual_format_parse": """SELECT unique_key, CAST(epoch(ts) AS BIGINT) AS parsed_sec, year(ts) AS part_year, month(ts) AS part_month, day(ts) AS part_day FROM (SELECT unique_key, coalesce(try_strptime(date, '%Y-%m-%d %H:%M:%S+00:00'), try_strptime(date, '%m/%d/%Y %I:%M:%S %p')) AS ts
      FROM (SELECT unique_key, CASE WHEN unique_key % 97 = 0 THEN 'not a date' WHEN unique_key % 2 = 0 THEN strftime(incident_ts, '%Y-%m-%d %H:%M:%S') || '+00:00' ELSE strftime(incident_ts, '%m/%d/%Y %I:%M:%S %p') END AS date FROM incidents))""",
    "anti_join_new": "SELECT * FROM deduped WHERE unique_key NOT IN (SELECT unique_key FROM incidents WHERE unique_key % 3 = 0)",
    "load_summary": "SELECT d AS date, coalesce(n, 0) AS n_rows, n IS NOT NULL AS loaded FROM (SELECT CAST(unnest(generate_series(DATE '2001-10-01', DATE '2001-11-30', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN (SELECT CAST(incident_ts AS DATE) AS d, count(*) AS n FROM incidents GROUP BY 1) USING (d)",
    "dq_report": "SELECT (SELECT count(*) FROM incidents) AS rows_before, (SELECT count(DISTINCT unique_key) FROM incidents) AS keys_before, count(*) AS rows_after, count(*) FILTER (cell IS NULL) AS null_cells, count(*) > 0 AND count(*) FILTER (cell IS NULL) <= 0.05 * count(*) AS passed FROM clean",
    "hex_cells": "SELECT * FROM cells",
    "hex_edges": "SELECT * FROM edges",
    "rolling_event_time": "SELECT * FROM rolled",
    "nearest_station": "SELECT * FROM nearest",
    "weather_pivot": "SELECT * FROM weather",
    "socio_dim": "SELECT * FROM socio",
    "poi_presence": "SELECT * FROM presence",
    "enriched_fact": "SELECT * FROM gold",
    "daily_panel": "SELECT * FROM calendar",
    "holiday_features": _HOLIDAY,
    **{n: _features(d) for n, d in Q._OWN.items() if n not in ("own_ewm", "zero_streak")},
    "own_ewm": "SELECT * FROM ewms",
    "zero_streak": "SELECT * FROM streaks",
    "community_features": "SELECT * FROM comms",
    "city_features": "SELECT * FROM cities",
    "neighbour_features": "SELECT * FROM nbrs",
    "train_priors": "SELECT * FROM priors",
    "training_frame": "SELECT * FROM frame",
    "spillover_features": "SELECT * FROM frame",
    "relation_features": "SELECT * FROM frame",
    "targets_and_splits": "SELECT t.*, split FROM targets t JOIN splits USING (date)",
    "feature_profile": " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE) AS median, coalesce(min({c}) = max({c}), TRUE) AS \"constant\" FROM train" for c in _PROFILED),
    "label_rates": f"SELECT split, count(*) AS n, sum(next_hotspot) AS n_pos, avg(next_hotspot) AS rate, max(w) AS weight FROM (SELECT * FROM targets JOIN splits USING (date) WHERE next_hotspot IS NOT NULL), (SELECT {_WEIGHT} AS w FROM (SELECT sum(next_hotspot) AS p, sum(1 - next_hotspot) AS q FROM targets JOIN splits USING (date) WHERE split = 'train')) GROUP BY split",
    "target_correlation": "SELECT corr(next_total, next_violent) AS total_violent, corr(next_total, next_property) AS total_property, corr(next_violent, next_property) AS violent_property FROM targets WHERE next_total IS NOT NULL",
    "threshold_grid": "SELECT * FROM thresholds",
    "best_threshold": "SELECT threshold, f1, round(objective, 9) AS objective FROM thresholds ORDER BY round(objective, 9) DESC, threshold LIMIT 1",
    "ranker_metrics": "SELECT * FROM metrics",
    "daily_topk": "SELECT k, avg(tp / CAST(taken AS DOUBLE)) AS precision, avg(tp / CAST(greatest(1, pos) AS DOUBLE)) AS recall, avg(CASE WHEN pos > 0 THEN (tp / CAST(taken AS DOUBLE)) / (pos / CAST(n AS DOUBLE)) ELSE 0.0 END) AS lift, count(*) AS days FROM top GROUP BY k",
    "fn_overlap": """SELECT count(*) FILTER (s = 3) AS missed_by_all, count(*) FILTER (s IN (1, 2)) AS missed_by_some, count(*) FILTER (s > 0 AND b = 0) AS resolved_by_blend FROM (SELECT cell, max(coalesce(CAST(next_hotspot = 1 AND temporal < 0.5 AS INTEGER), 0)) + max(coalesce(CAST(next_hotspot = 1 AND spatial < 0.5 AS INTEGER), 0)) + max(coalesce(CAST(next_hotspot = 1 AND context < 0.5 AS INTEGER), 0)) AS s,
      max(coalesce(CAST(next_hotspot = 1 AND score < 0.5 AS INTEGER), 0)) AS b FROM scored GROUP BY cell)""",
    "risk_tiers": "SELECT *, round(score * 1e9) AS score_ppb FROM tiers",
    "confidence": "SELECT * FROM predictions",
    "export_incidents": "SELECT * FROM exported",
    "export_forecast": "SELECT *, round(score * 1e9) AS score_ppb FROM forecast",
    "geojson_features": """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(round(longitude, 6) AS VARCHAR) || ',' || CAST(round(latitude, 6) AS VARCHAR) || ']},"properties":{"prediction_date":"' || CAST(prediction_date AS VARCHAR) || '","cell":"' || cell || '","risk_level":"' || risk_level || '"}}' AS value FROM forecast""",
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, ts, event_type FROM events) GROUP BY 1, 2",
    "monitoring_counts": " UNION ALL ".join(f"SELECT '{c}' AS what, '{v}' AS value, count(*) FILTER ({c} = '{v}') AS n FROM (SELECT p.* FROM predictions p WHERE prediction_date = (SELECT max(prediction_date) FROM predictions))" for c, vs in Q.LEVELS.items() for v in vs),
    "monitoring_days": "SELECT prediction_date, count(*) AS n, count(*) FILTER (risk_level = 'CRITICAL') AS critical FROM predictions GROUP BY prediction_date",
    "feature_selection": f"SELECT feature, count(value) AS n, min(value) AS lo, max(value) AS hi, coalesce(min(value) < max(value), FALSE) AS kept, {_rule(R.BLEND, R.BLEND_REST)} AS bucket, {_rule(R.ABLATION, R.ABLATION_REST)} AS ablation_group, {_rule(R.FAMILY, R.FAMILY_REST)} AS family FROM (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CANDIDATES)} FROM supervised WHERE split = 'train' AND next_total IS NOT NULL) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(_CANDIDATES)})) GROUP BY feature",
    "sample_weights": "SELECT cell, date, CASE WHEN next_hotspot = 1 THEN greatest(1.0, least(1.75, (CASE WHEN local_sudden_activation_3d > 0 THEN 1.25e0 ELSE 1.0e0 END) * (CASE WHEN h3_train_percentile < 0.75 THEN 1.35e0 ELSE 1.0e0 END) * (CASE WHEN nbr_r1_spike_vs_roll7 > 1 THEN 1.15e0 ELSE 1.0e0 END))) ELSE 1.0 END AS weight FROM supervised WHERE split = 'train' AND next_hotspot IS NOT NULL",
    "split_metrics": "SELECT * FROM by_split",
    "full_predictions": "SELECT * FROM full_table",
    "feature_medians": _medians(_CANDIDATES, "split = 'train'"),
    "stored_run_medians": "SELECT feature, median FROM (" + _medians(_CANDIDATES, "split = 'train' AND next_total IS NOT NULL") + ") JOIN (SELECT feature AS kept_feature FROM (" + _KEPT + ")) ON feature = kept_feature",
    "stored_run_splits": "SELECT split, min(date) AS first, max(date) AS last, count(DISTINCT date) AS days, count(*) AS n, " + ", ".join(f"avg(next_{c}) AS {c}_rate" for c in ("has_crime", "hotspot", "violent", "property")) + " FROM supervised WHERE next_total IS NOT NULL GROUP BY split",
    "sanitized_features": "SELECT cell, date, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM supervised WHERE split = 'train'), 0.0) AS {c}" for c in ("roll_std_30", "temp_max_lag7", "ewm_90")) + " FROM supervised",
    "split_report": f"SELECT *, days >= {CFG.warm_up_days + sum(n for _, n in CFG.split_days)} AS enough, shared_days = 0 AS \"disjoint\" FROM (SELECT (SELECT count(DISTINCT date) FROM supervised) AS days, (SELECT count(*) - count(DISTINCT date) FROM splits) AS shared_days, " + ", ".join(f"avg(h3_train_percentile) FILTER (split = '{k}') AS prior_{k}" for k in ("train", "val", "test")) + " FROM supervised)",
    "type_rates": "SELECT split, count(*) AS n, count(*) FILTER (next_hotspot = 1) AS hotspots, avg(next_violent) FILTER (next_hotspot = 1) AS violent_rate, avg(next_property) FILTER (next_hotspot = 1) AS property_rate FROM targets JOIN splits USING (date) WHERE next_total IS NOT NULL GROUP BY split",
    "model_floor": "SELECT auc, f1, auc >= 0.75 AND f1 >= 0.5 AS passed FROM metrics",
    "error_rows": "SELECT * FROM errors WHERE error IS NOT NULL",
    "plain_threshold": "SELECT threshold, plain AS f1, round(plain, 9) AS objective FROM thresholds ORDER BY round(plain, 9) DESC, threshold LIMIT 1",
    "fixed_risk_levels": "SELECT cell, date, CASE WHEN score < 0.3 THEN 'LOW' WHEN score < 0.6 THEN 'MEDIUM' WHEN score < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS fixed_level FROM scored",
    "prediction_table": f"SELECT prediction_date, cell AS h3_index, round(score * 1e9) AS score_ppb, risk_level, '{Q.MADE[:10]}.groupblend' AS model_version, CAST(epoch(TIMESTAMP '{Q.MADE}') AS BIGINT) AS made_sec, CAST(score >= 0.5 AS INTEGER) AS pred_hotspot, dominant_type, rank AS risk_rank, rank_pct AS risk_rank_pct, confidence_score, confidence_level, score_std AS group_score_std, margin_to_cut AS score_margin_to_cutoff, 0.2 AS group_w_context FROM predictions",
    "incidents_geojson": """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(round(longitude, 6) AS VARCHAR) || ',' || CAST(round(latitude, 6) AS VARCHAR) || ']},"properties":{"unique_key":' || unique_key || ',"date":"' || CAST(date AS VARCHAR) || '","crime_category":"' || crime_category || '"}}' AS value FROM exported""",
    "extract_day": f"SELECT *, {_SECOND} AS incident_sec FROM incidents WHERE CAST(incident_ts AS DATE) = DATE '1998-03-15' ORDER BY unique_key",
    "extract_raw_day": f"SELECT unique_key, case_number, strftime(incident_ts, '%Y-%m-%d %H:%M:%S+00:00') AS date, primary_type, arrest, domestic, community_area, latitude, longitude, " + ", ".join(f"NULL AS {c}" for c in ("block", "iucr", "description", "location_description", "beat", "district", "ward", "fbi_code", "x_coordinate", "y_coordinate", "year", "updated_on", "location")) + " FROM incidents WHERE CAST(incident_ts AS DATE) = (SELECT max(CAST(incident_ts AS DATE)) FROM incidents)",
    "bronze_days": f"SELECT year(incident_ts) AS part_year, month(incident_ts) AS part_month, day(incident_ts) AS part_day, count(*) AS n, CAST(epoch(TIMESTAMP '{Q.MADE}') AS BIGINT) + CASE WHEN day(incident_ts) % 10 = 0 THEN 86400 ELSE 0 END AS ingested_sec FROM incidents GROUP BY 1, 2, 3, 5",
    "loaded_ledger": "SELECT date, 'incidents' AS source, CASE WHEN day(date) % 3 = 0 THEN count(*) ELSE count(*) FILTER (unique_key % 2 = 0) END AS rows FROM (SELECT unique_key, CAST(incident_ts AS DATE) AS date FROM incidents) GROUP BY date HAVING day(date) % 3 = 0 OR count(*) FILTER (unique_key % 2 = 0) > 0",
    "station_files": "SELECT station_id, date, temp_max AS TMAX, temp_min AS TMIN, precipitation AS PRCP, wind_speed AS AWND, snow_depth AS SNWD FROM weather",
    "dimension_files": "SELECT s.*, (n_nationkey + 1) * 1000.5 AS population FROM socio s LEFT JOIN nation ON community_area_name = upper(trim(n_name))",
    "arrest_flags": "SELECT cell, date, sum(CAST(round(arrest_rate) AS INTEGER)) AS flagged, count(*) FILTER (arrest) AS arrests FROM gold GROUP BY cell, date",
    "weather_coverage": "SELECT count(*) AS n_gold, count(*) FILTER (v IS NULL) AS no_weather, count(*) FILTER (v = 0) AS zero_weather, count(*) FILTER (v IS NULL) / CAST(count(*) AS DOUBLE) AS no_weather_share FROM (SELECT w.v FROM clean c JOIN nearest n ON c.cell = n.cell LEFT JOIN (SELECT date, station_id, min(value) AS v FROM weather_long WHERE datatype = 'TMAX' GROUP BY ALL) w ON w.date = CAST(incident_ts AS DATE) AND w.station_id = n.station_id)",
    "geojson_files": """SELECT *, count(*) OVER (PARTITION BY kind) AS written FROM (SELECT 'incidents' AS kind, longitude, latitude, CAST(unique_key AS VARCHAR) AS name, date AS day, crime_category AS what FROM exported
      UNION ALL SELECT 'forecast', longitude, latitude, cell, prediction_date, risk_level FROM forecast WHERE latitude IS NOT NULL AND longitude IS NOT NULL)""",
    "stream_redelivered": "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, ts, event_type FROM events) GROUP BY 1, 2",
    "run_windows": f"SELECT run_date, day(run_date) = 1 AS \"full\", CASE WHEN day(run_date) = 1 THEN DATE '{CFG.first_year}-01-01' ELSE run_date - 26 END AS start, run_date - 5 AS \"end\" FROM (SELECT DISTINCT CAST(incident_ts AS DATE) AS run_date FROM incidents)",
    "year_chunks": "SELECT greatest(lo, make_date(y, 1, 1)) AS chunk_start, least(hi, make_date(y, 12, 31)) AS chunk_end FROM (SELECT lo, hi, unnest(range(year(lo), year(hi) + 1)) AS y FROM (SELECT min(CAST(incident_ts AS DATE)) AS lo, max(CAST(incident_ts AS DATE)) AS hi FROM incidents))",
    "landed_incidents": f"SELECT *, {_SECOND} AS parsed_sec FROM incidents WHERE incident_ts >= TIMESTAMP '1998-03-01' AND incident_ts < TIMESTAMP '1998-05-01' AND day(incident_ts) % 7 <> 0",
    "bronze_window": "SELECT unique_key, CAST(incident_ts AS DATE) AS day FROM incidents WHERE CAST(incident_ts AS DATE) BETWEEN DATE '1998-04-20' - 26 AND DATE '1998-04-20' - 5",
    "gold_write": "SELECT count(DISTINCT date) AS days, count(*) AS \"rows\" FROM gold WHERE date >= DATE '2000-11-04'",
    "nearest_places": f"""SELECT cell, poi_type, min({km('lat', 'lon', 'la', 'lo')}) AS km FROM cells, (SELECT DISTINCT {coordinate('c_custkey', 613, 41.60, 0.00046)} AS la, {coordinate('c_custkey', 287, -87.98, 0.0005)} AS lo,
      {pick(V.POI_TYPES, 'c_custkey % 5 + 1')} AS poi_type FROM customer) GROUP BY ALL""",
    "observed_weather": f"""WITH heard AS (SELECT * FROM weather_long WHERE (dayofyear(date) + CAST(substr(station_id, 3, 3) AS INTEGER)) % 3 <> 0),
      pairs AS (SELECT DISTINCT cell, CAST(incident_ts AS DATE) AS date FROM clean),
      near AS (SELECT cell, date, station_id FROM (SELECT p.cell, p.date, o.station_id, {km('lat', 'lon', 'st_lat', 'st_lon')} AS d FROM pairs p JOIN cells c ON c.cell = p.cell JOIN (SELECT DISTINCT date, station_id FROM heard) o ON o.date = p.date JOIN st ON st.station_id = o.station_id)
      QUALIFY row_number() OVER (PARTITION BY cell, date ORDER BY d, station_id) = 1),
      wide AS (SELECT date, station_id, {", ".join(f"coalesce(min(value) FILTER (datatype = '{k}'), 0.0) AS {v}" for k, v in (("TMAX", "temp_max"), ("TMIN", "temp_min"), ("PRCP", "precipitation"), ("AWND", "wind_speed"), ("SNWD", "snow_depth")))} FROM heard GROUP BY date, station_id)
      SELECT p.cell, p.date, n.station_id, temp_max, temp_min, precipitation, wind_speed, snow_depth FROM pairs p LEFT JOIN near n ON n.cell = p.cell AND n.date = p.date LEFT JOIN wide w ON w.date = n.date AND w.station_id = n.station_id""",
    "sanitized_frame": "SELECT cell, date, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0) AS {c}" for c in _CANDIDATES) + " FROM supervised, (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in _CANDIDATES) + " FROM supervised WHERE split = 'train')",
    "loaded_rows": f"SELECT *, {_SECOND} AS parsed_sec FROM incidents WHERE NOT (unique_key % 101 = 0 OR unique_key % 103 = 0 OR unique_key % 107 = 0 OR unique_key % 109 = 0)",
    "quarantined_rows": """SELECT CAST(unique_key AS VARCHAR) AS unique_key, CASE WHEN unique_key % 103 = 0 THEN 'north' WHEN unique_key % 107 = 0 THEN NULL ELSE CAST(latitude AS VARCHAR) END AS latitude, CASE WHEN unique_key % 101 = 0 THEN 'perhaps' ELSE CAST(arrest AS VARCHAR) END AS arrest,
      array_to_string(list_filter([CASE WHEN unique_key % 107 = 0 AND unique_key % 103 <> 0 THEN 'latitude is missing' END, CASE WHEN unique_key % 101 = 0 THEN 'arrest is no boolean' END, CASE WHEN unique_key % 103 = 0 THEN 'latitude is no double' END,
      CASE WHEN unique_key % 109 = 0 THEN 'date is no timestamp' END], lambda x: x IS NOT NULL), '; ') AS why
      FROM incidents WHERE unique_key % 101 = 0 OR unique_key % 103 = 0 OR unique_key % 107 = 0 OR unique_key % 109 = 0""",
    "load_metrics": "SELECT count(*) AS rows, count(*) FILTER (unique_key % 101 = 0 OR unique_key % 103 = 0 OR unique_key % 107 = 0 OR unique_key % 109 = 0) AS bad, count(*) FILTER (unique_key % 107 = 0 AND unique_key % 103 <> 0) AS no_latitude FROM incidents",
    "bucketed_gold": """SELECT *, coalesce(sum(n) OVER (PARTITION BY cell ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before, sum(n) OVER (PARTITION BY cell) AS area_incidents FROM (SELECT cell, date, count(*) AS n FROM gold GROUP BY ALL)""",
    "incremental_gold": "SELECT * FROM gold",
    "refreshed_months": """SELECT DISTINCT CAST(unnest(generate_series(date_trunc('month', day), date_trunc('month', day + 30), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM (SELECT DISTINCT CAST(incident_ts AS DATE) AS day FROM clean
      WHERE (strftime(incident_ts, '%Y-%m') = '1998-03' AND unique_key % 5 = 0) OR (strftime(incident_ts, '%Y-%m') = '1999-07' AND unique_key % 7 = 0) OR (strftime(incident_ts, '%Y-%m') = '1997-01' AND unique_key % 3 = 0))""",
    "unloaded_days": "SELECT date, count(*) AS n FROM (SELECT CAST(incident_ts AS DATE) AS date FROM incidents) WHERE day(date) % 3 <> 0 GROUP BY date",
    "early_stop": "SELECT count(*) = 0 AS nothing_new FROM (SELECT unique_key FROM incidents WHERE unique_key % 3 = 0) WHERE unique_key NOT IN (SELECT unique_key FROM incidents)",
    "weather_landing": "SELECT date, datatype, value, station_id AS station FROM weather_long",
    "socio_population": "SELECT community_area, community_area_name, (n_nationkey + 1) * 1000.5 AS population FROM socio LEFT JOIN nation ON community_area_name = upper(trim(n_name))",
    "poi_landing": "SELECT DISTINCT (lat + 0.25e0 + (lat - 0.25e0) + lat) / 3 AS latitude, (lon + (lon + 0.5e0) + (lon - 0.5e0)) / 3 AS longitude, poi_type FROM shapes WHERE poi_type IS NOT NULL",
    "station_file_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders",
    "gold_quality": "SELECT *, null_cells / CAST(n_before AS DOUBLE) AS null_share, zero_weather / CAST(n_gold AS DOUBLE) AS zero_weather_share, n_gold > 0 AND null_cells <= 0.05 * n_before AS passed FROM (SELECT (SELECT count(*) FROM clean) AS n_before, (SELECT count(*) FILTER (cell IS NULL) FROM clean) AS null_cells, count(*) AS n_gold, count(*) FILTER (temp_max = 0) AS zero_weather FROM gold)",
    "stream_cell_counts": "SELECT CAST(incident_ts AS DATE) AS date, cell, count(*) AS n FROM clean GROUP BY ALL",
    # a batch drops the days that the watermark before the last batch has passed; at the end all days are out that the last watermark has passed
    "stream_final_counts": """WITH placed AS (SELECT *, CASE WHEN on_time = 1 AND unique_key % 10 = 0 THEN 3 WHEN on_time = 1 AND unique_key % 10 = 1 AND incident_ts >= TIMESTAMP '1996-06-10' THEN 2 ELSE on_time END AS part
      FROM (SELECT *, CASE WHEN incident_ts < TIMESTAMP '1996-07-01' THEN 1 WHEN incident_ts < TIMESTAMP '1999-01-01' THEN 2 ELSE 3 END AS on_time FROM clean)),
    marks AS (SELECT (SELECT max(incident_ts) FROM placed WHERE part < 2) - INTERVAL 30 DAY AS w2, (SELECT max(incident_ts) FROM placed) - INTERVAL 30 DAY AS w_end)
    SELECT CAST(incident_ts AS DATE) AS date, cell, count(*) AS n FROM placed, marks
      WHERE NOT (part = 3 AND date_trunc('day', incident_ts) + INTERVAL 1 DAY <= w2) AND date_trunc('day', incident_ts) + INTERVAL 1 DAY <= w_end GROUP BY ALL""",
    "stream_upsert": "SELECT unique_key, CAST(date_trunc('month', incident_ts) AS DATE) AS month FROM clean",
}

ORACLE: dict[str, str] = {k: full(S.shaped(v, Q.COLUMNS[k])) for k, v in STATEMENTS.items()}
