"""Cells by steps, and the report on cleaning in one pass."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions import hexgrid
from hotgrid.operators import silver

NAN, RAW = float("nan"), "unique_key long, case_number string, incident_ts timestamp, primary_type string, arrest boolean, domestic boolean, community_area int, latitude double, longitude double"


def test_cells_by_steps_are_the_same(spark):
    points = [(41.6 + i * 0.0137, -88.0 + (i * 37 % 101) * 0.0061) for i in range(300)]
    points += [(None, -87.7), (41.8, None), (NAN, -87.7), (41.8, NAN), (90.0, 180.0), (90.1, 0.0), (-90.0, -180.0), (0.0, 180.5), (41.83, -87.73)]
    df = hexgrid.with_cell(spark.createDataFrame(points, "latitude double, longitude double"))
    assert df.columns == ["latitude", "longitude", "cell"]
    assert df.where(~F.col("cell").eqNullSafe(hexgrid.cell("latitude", "longitude"))).count() == 0


def test_silver_repeats_no_step(spark):
    plan = silver.silver(spark.createDataFrame([], RAW), "2001-12-31")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"FLOOR\(", plan)) == 3


@pytest.mark.parametrize("empty", [False, True])
def test_one_pass_reports_what_two_do(spark, empty):
    row = lambda k, case="HZ1", ts=dt.datetime(2001, 5, 5), kind="THEFT", lat=41.8, lon=-87.7, area=3: (k, case, ts, kind, True, False, area, lat, lon)
    rows = [row(1), row(1), row(1, "HZ0", lat=10.0), row(2, lat=NAN, case="A"), row(2, case="B"), row(3, lat=NAN), row(4, lon=None), row(None), row(None), row(5, ts=None), row(5), row(6, ts=dt.datetime(1990, 1, 1)), row(7, kind=None), row(8, area=None), row(9, case="A", lat=0.0), row(9, case="A")]
    raw, cfg = spark.createDataFrame([] if empty else rows, RAW), Config()
    got = silver.cleaning_report(raw, "2001-12-31", cfg)
    want = silver.quality_report(raw, silver.silver(raw, "2001-12-31", cfg), cfg)
    assert got.select(want.columns).collect() == want.collect()
