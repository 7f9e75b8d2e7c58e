"""A refreshed gold table equals one made at once, and only the months that a change reaches are made."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hotgrid.operators import incremental

SILVER = "unique_key long, incident_ts timestamp, cell string, arrest boolean"


def _silver(spark, rows):
    return spark.createDataFrame(rows, SILVER)


def _make(dims):
    """Rows with the incidents of their cell in the 30 days before, and a dimension of their cell."""

    def make(rows):
        day = F.datediff(F.to_date("incident_ts"), F.lit("1990-01-01"))
        before = Window.partitionBy("cell").orderBy("day").rangeBetween(-30, -1)
        out = rows.withColumns({"date": F.to_date("incident_ts"), "day": day})
        return out.withColumn("n", F.count("*").over(before)).join(dims, "cell", "left").drop("day")

    return make


def _table(df):
    return sorted((tuple(r) for r in df.select("unique_key", "date", "cell", "arrest", "n", "place").collect()), key=str)


@pytest.fixture
def base():
    rnd = random.Random(1)
    return [(i, dt.datetime(2000, 1, 1) + dt.timedelta(hours=rnd.randrange(24 * 500)), rnd.choice("ab"), rnd.random() < 0.5) for i in range(400)]


def _dims(spark, a="x", b="y"):
    return spark.createDataFrame([("a", a), ("b", b)], "cell string, place string")


def _check(spark, root, rows, dims, sources=()):
    made = incremental.refresh(_silver(spark, rows), root, _make(dims), dims, sources)
    if rows:
        assert _table(spark.read.parquet(f"{root}/gold")) == _table(_make(dims)(_silver(spark, rows)))
    return {str(r.month_start)[:7]: r.why for r in made.collect()}


def test_late_changed_moved_and_removed_rows(spark, tmp_path, base):
    root, dims = str(tmp_path / "g"), _dims(spark)
    whole = _check(spark, root, base, dims)
    assert len(whole) == 17 and set(whole.values()) == {"new"}
    assert _check(spark, root, base, dims) == {}
    late = [*base, (9001, dt.datetime(2000, 3, 31, 5), "a", True)]
    assert _check(spark, root, late, dims) == {"2000-03": "rows", "2000-04": "rows"}
    flipped = [(k, t, c, not a) if k == 9001 else (k, t, c, a) for k, t, c, a in late]
    assert _check(spark, root, flipped, dims) == {"2000-03": "rows", "2000-04": "rows"}
    moved = [(k, dt.datetime(2000, 9, 1), c, a) if k == 9001 else (k, t, c, a) for k, t, c, a in flipped]
    assert _check(spark, root, moved, dims) == {"2000-03": "rows", "2000-04": "rows", "2000-09": "rows", "2000-10": "rows"}
    assert _check(spark, root, base, dims) == {"2000-09": "rows", "2000-10": "rows"}


def test_a_month_that_is_emptied_goes(spark, tmp_path, base):
    root, dims = str(tmp_path / "g"), _dims(spark)
    _check(spark, root, base, dims)
    rest = [r for r in base if r[1].strftime("%Y-%m") != "2000-06"]
    assert _check(spark, root, rest, dims) == {"2000-06": "rows", "2000-07": "rows"}
    incremental.refresh(_silver(spark, []), root, _make(dims), dims)
    from hotgrid.sources.layers import files

    assert files(spark, f"{root}/gold") == [] == files(spark, f"{root}/keys")
    _check(spark, root, base, dims)


def test_dimensions_and_their_files(spark, tmp_path, base):
    root, source = str(tmp_path / "g"), str(tmp_path / "weather")
    spark.range(3).write.parquet(source)
    only_a = [(k, t, "a" if t < dt.datetime(2000, 5, 1) else "b", x) for k, t, _, x in base]
    _check(spark, root, only_a, _dims(spark), (source,))
    got = _check(spark, root, only_a, _dims(spark, a="z"), (source,))
    assert set(got.values()) == {"cells"} and max(got) == "2000-04"
    spark.range(4).write.mode("overwrite").parquet(source)
    assert set(_check(spark, root, only_a, _dims(spark, a="z"), (source,)).values()) == {"sources"}


def test_a_refresh_that_ended_early_is_done_again(spark, tmp_path, base):
    root, dims = str(tmp_path / "g"), _dims(spark)
    _check(spark, root, base, dims)
    late = [*base, (9001, dt.datetime(2000, 3, 31, 5), "a", True)]

    def fails(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.refresh(_silver(spark, late), root, fails, dims)
    assert _check(spark, root, late, dims) == {"2000-03": "rows", "2000-04": "rows"}


def test_the_end_of_january_is_seen_from_february_alone(spark, tmp_path):
    root, dims = str(tmp_path / "g"), _dims(spark)
    rows = [(1, dt.datetime(2001, 1, 30, 7), "a", True), (2, dt.datetime(2001, 2, 20, 9), "a", False)]
    _check(spark, root, rows, dims)
    assert _check(spark, root, [*rows, (3, dt.datetime(2001, 2, 10, 1), "a", True)], dims) == {"2001-02": "rows"}
