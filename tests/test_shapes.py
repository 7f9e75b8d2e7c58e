"""Doubles of results are rounded as the SQL's engine does it."""

import math

import duckdb

from hotgrid.plans import shapes


def test_halves_are_rounded_as_in_sql(spark):
    values = [k / n for n in (640, 1280, 1920, 3200, 3840) for k in range(1, n)]
    values += [-x for x in values[::7]] + [1e300, 1e308, -1e308, 12345678.1234565, 0.0]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    got = {r.i: r.x for r in shapes.shape(df, "i long, x double").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, x DOUBLE)")
    con.execute("INSERT INTO t SELECT unnest(?), unnest(?)", [list(range(len(values))), values])
    want = dict(con.execute(shapes.shaped("SELECT * FROM t", "i long, x double")).fetchall())
    assert {i: (values[i], x, want[i]) for i, x in got.items() if x != want[i]} == {}


def test_what_is_not_finite_stays(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, None), (4, -0.0)], "i long, x double")
    a, b, c, d = [r.x for r in shapes.shape(df, "i long, x double").orderBy("i").collect()]
    assert math.isnan(a) and b == float("inf") and c is None and math.copysign(1, d) == 1
