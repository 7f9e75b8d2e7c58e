import datetime as dt

from pyspark.sql import functions as F

from hotgrid.operators import gold, panel
from hotgrid.sources import tables


def test_an_extract_has_all_columns_in_the_order_of_keys(spark):
    at = lambda h, d=2: dt.datetime(2000, 1, d, h)
    df = spark.createDataFrame([(3, at(0), 7), (1, at(23), None), (2, at(0, 3), 7), (4, None, 7)], "unique_key long, incident_ts timestamp, beat int")
    rows = tables.extract_day(df, "2000-01-02").collect()
    assert [(r.unique_key, r.date, r.beat, r.location) for r in rows] == [(1, "2000-01-02 23:00:00+00:00", None, None), (3, "2000-01-02 00:00:00+00:00", 7, None)]
    assert len(rows[0]) == 22
    assert tables.extract_day(df, F.lit("1999-01-01").cast("date")).count() == 0


def test_bronze_days_are_replaced_and_stamped(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2000, 1, 1)), (2, dt.datetime(2000, 1, 2)), (3, None)], "unique_key long, parsed_date timestamp")
    path = str(tmp_path / "bronze")
    at = lambda s: F.lit(s).cast("timestamp")
    tables.write_bronze(df, path, at("2020-01-01"))
    tables.write_bronze(df.where("unique_key = 2"), path, at("2020-01-02"))
    got = {(r.unique_key, r.part_day, r.ingestion_time.day) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1, 1), (2, 2, 2), (3, None, 1)}
    tables.write_bronze(df.where("unique_key = 1"), path)
    assert spark.read.parquet(path).where("unique_key = 1").first().ingestion_time.year > 2020


def test_the_ledger_tells_the_last_load(spark, tmp_path):
    day = lambda n: spark.createDataFrame([(dt.date(2000, 1, 1),)] * n, "date date")
    path = str(tmp_path / "ledger")
    for n in (3, 3, 2):
        tables.append_ledger(day(n), path, "a")
    tables.append_ledger(day(5), path, "b")
    assert sorted((r.source, r.rows) for r in tables.read_ledger(spark, path).collect()) == [("a", 2), ("b", 5)]


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    df = spark.range(7).withColumn("x", F.lit(1))
    assert tables.write_table(df, str(tmp_path / "t")) == 7
    assert tables.write_table(df.where("id < 2"), str(tmp_path / "t"), "append") == 2
    assert tables.write_table(df.where("id > 10"), str(tmp_path / "t")) == 0
    features = spark.createDataFrame([('{"type":"Feature","geometry":{"type":"Point","coordinates":[2.5,1.5]},"properties":{"n":"a"}}',)], "value string")
    assert tables.write_geojson(features, str(tmp_path / "g")) == 1
    assert [tuple(r) for r in tables.read_geojson(spark, str(tmp_path / "g"), "n string, m int").collect()] == [(2.5, 1.5, "a", None)]


def test_station_files_keep_what_cannot_be_read_as_null(spark, tmp_path):
    (tmp_path / "s.csv").write_text("station_id,date,TMAX,TMIN,PRCP,AWND,SNWD\nS1,1/2/2000,1.5,,0,2,0\nS2,2000-01-02,x,1,1,1,1\n")
    got = [(r.station_id, r.date, r.TMAX, r.TMIN) for r in tables.read_station_days(spark, str(tmp_path)).collect()]
    assert got == [("S1", dt.date(2000, 1, 2), 1.5, None), ("S2", None, None, 1.0)]


def test_arrest_flags_fall_back(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (0.2,), (None,)], "arrest_rate double")
    of = lambda x: [r.f for r in x.select(panel.arrest_flag(x).alias("f")).collect()]
    assert of(panel.with_arrest_flag(df)) == [1, 1, 0, 0]
    assert of(df) == [0, 1, 0, 0]
    assert of(df.drop("arrest_rate").withColumn("a", F.lit(1))) == [0] * 4


def test_zero_degrees_are_no_gap(spark):
    day = lambda d: dt.datetime(2000, 1, d, 5)
    facts = spark.createDataFrame([("a", day(1)), ("a", day(1)), ("a", day(2)), ("b", day(1)), (None, day(1))], "cell string, incident_ts timestamp")
    dims = spark.createDataFrame([("a", "S")], "cell string, station_id string")
    weather = spark.createDataFrame([(dt.date(2000, 1, 1), "S", "TMAX", 0.0), (dt.date(2000, 1, 2), "S", "TMIN", 1.0)], "date date, station_id string, datatype string, value double")
    assert tuple(gold.weather_coverage(facts, dims, weather).first()) == (4, 2, 2, 0.5)
    assert tuple(gold.weather_coverage(facts.limit(0), dims, weather).first()) == (0, 0, 0, 0.0)


def test_tracts_of_more_than_six_digits_meet_only_themselves(spark, tmp_path):
    """Keys of a million and more were cut to six digits, so that they met the tracts of others."""
    from hotgrid.sources import fixtures

    keys = [100000, 100001, 1000000, 1000010, 7]
    spark.createDataFrame([(k, 10, 20.0) for k in keys], "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    names = spark.createDataFrame([(1, "one")], "community_area int, community_area_name string")
    got = gold.socio_dim(fixtures.tracts(spark, str(tmp_path)), fixtures.crosswalk(spark, str(tmp_path)), names).collect()
    want = {}
    for k in keys:
        if k % 11:
            want[k % 25 + 1] = want.get(k % 25 + 1, 0) + 1000.0
    assert {r.community_area: r.population_density for r in got} == want
