"""Event-time windows as one running sum: equal to counting, and no frame is summed again for each row."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hotgrid.operators import gold


def test_rolling_equals_counting(spark):
    rnd, week, month = random.Random(3), 7 * gold.DAY, 30 * gold.DAY
    edge = 20 * gold.STRETCH
    secs = [edge + d for at in (0, week, month) for d in (-at - 1, -at, -at + 1, at - 1, at, at + 1)] + [edge + rnd.randrange(-200, 200) * gold.DAY // 2 for _ in range(150)]
    rows = [(i, rnd.choice("ab"), dt.datetime.fromtimestamp(s, dt.UTC), rnd.choice([True, False, None])) for i, s in enumerate(secs)]
    df = spark.createDataFrame([*rows, (998, None, rows[0][2], True), (999, "a", None, True)], "unique_key long, cell string, incident_ts timestamp, arrest boolean")
    out = gold.rolling_events(df)
    got = {r.unique_key: (r.crime_density_7d, r.crime_density_30d, r.arrest_rate) for r in out.collect()}
    want = {}
    for i, cell, ts, _ in rows:
        t = int(ts.timestamp())
        seen = [(t - int(x.timestamp()), bool(a)) for _, c, x, a in rows if c == cell and 1 <= t - int(x.timestamp()) <= month]
        want[i] = (sum(gap <= week for gap, _ in seen), len(seen), sum(a for _, a in seen) / len(seen) if seen else 0.0)
    assert got == want
    assert out.columns == [*df.columns, "crime_density_7d", "crime_density_30d", "arrest_rate"]


def test_no_frame_slides(spark):
    """A frame that slides is summed from its start for each row: rows times rows of a frame."""
    df = spark.range(9).select(F.col("id").alias("unique_key"), F.lit("a").alias("cell"), F.timestamp_seconds("id").alias("incident_ts"), F.lit(True).alias("arrest"))
    plan = gold.rolling_events(df)._jdf.queryExecution().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan
