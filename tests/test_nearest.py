"""Nearest places and stations against all pairs."""

import math
import random

from hotgrid.config import Config
from hotgrid.functions import hexgrid
from hotgrid.operators import gold

CFG = Config()


def _km(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return 6371.0 * math.acos(max(-1.0, min(1.0, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(d))))


def test_rings_are_whole_and_bounds_hold(spark):
    assert len(hexgrid.disk_offsets(-1, 3)) == 37 and len(hexgrid.disk_offsets(2, 3)) == 18 and (0, 0) not in hexgrid.disk_offsets(0, 2)
    rnd = random.Random(1)
    points = [(rnd.uniform(41.6, 42.1), rnd.uniform(-88.0, -87.4)) for _ in range(150)]
    df = spark.createDataFrame(points, "lat double, lon double")
    at = [(r.q, r.r) for r in df.select(*[c.alias(n) for c, n in zip(hexgrid.axial(df.lat, df.lon, CFG), "qr", strict=True)]).collect()]
    for i, a in enumerate(points):
        for j, b in enumerate(points):
            q, r = at[i][0] - at[j][0], at[i][1] - at[j][1]
            assert _km(a, b) >= hexgrid.least_km(max(abs(q), abs(r), abs(q + r)), CFG) - 1e-6


def test_nearest_places_equal_all_pairs(spark):
    rnd = random.Random(2)
    cells = [(f"c{i}", rnd.uniform(41.6, 42.1), rnd.uniform(-88.0, -87.4)) for i in range(60)]
    places = [(rnd.uniform(41.6, 41.7), rnd.uniform(-88.0, -87.9), "park") for _ in range(5)] + [(42.05, -87.45, "school")] + [(rnd.uniform(41.6, 42.1), rnd.uniform(-88.0, -87.4), "nightlife") for _ in range(300)]
    rows = [*places, *places[:3], (None, -87.5, "park"), (41.9, -87.6, None)]
    got = gold.nearest_places(spark.createDataFrame(cells, "cell string, lat double, lon double"), spark.createDataFrame(rows, "latitude double, longitude double, poi_type string"), CFG)
    got = {(r.cell, r.poi_type): r.km for r in got.collect()}
    assert len(got) == 180
    for c, lat, lon in cells:
        for kind in ("park", "school", "nightlife"):
            assert math.isclose(got[c, kind], min(_km((lat, lon), p[:2]) for p in places if p[2] == kind), abs_tol=1e-6)
    empty = spark.createDataFrame([], "latitude double, longitude double, poi_type string")
    assert gold.nearest_places(spark.createDataFrame(cells, "cell string, lat double, lon double"), empty, CFG).collect() == []


def test_silent_stations_are_passed_over(spark):
    cells = spark.createDataFrame([("c", 41.8, -87.7)], "cell string, lat double, lon double")
    stations = spark.createDataFrame([("near", 41.81, -87.7), ("far", 41.9, -87.7), ("twin", 41.9, -87.7)], "station_id string, st_lat double, st_lon double")
    weather = spark.createDataFrame([("d1", "near"), ("d1", "far"), ("d2", "twin"), ("d2", "far"), ("d2", "far"), ("d4", "other")], "date string, station_id string")
    days = spark.createDataFrame([("c", d) for d in ("d1", "d2", "d3", "d4", "d1")], "cell string, date string")
    got = {r.date: r.station_id for r in gold.observing_stations(days, cells, stations, weather).collect()}
    assert got == {"d1": "near", "d2": "far", "d3": None, "d4": None}
