"""The registered queries against SQL on the test tables."""

import math

import duckdb
import pytest

from hotgrid.llm import queries


def _value(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else tuple(x) if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(map(_value, r)) for r in got.select(*want.columns).collect()), key=str)
    assert rows == sorted((tuple(map(_value, r)) for r in want.fetchall()), key=str)
