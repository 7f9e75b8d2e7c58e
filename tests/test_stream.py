"""Append mode: late rows, final days and a state that shrinks."""

import datetime as dt

from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.streaming import stream

BOX = (41.8, -87.7)


def _deliver(spark, source, rows):
    df = spark.createDataFrame([(i, dt.datetime(2000, m, d), *BOX) for i, (m, d) in enumerate(rows)], "unique_key long, incident_ts timestamp, latitude double, longitude double")
    df.coalesce(1).write.mode("append").parquet(source)
    return df.schema


def test_late_rows_and_eviction(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _deliver(spark, source, [(1, d) for d in range(1, 21)] * 2)
    _deliver(spark, source, [(1, 19), (3, 1)])  # in time: the watermark is January 10
    schema = _deliver(spark, source, [(1, 2), (3, 2), (2, 28)])  # January 2 was final before the second delivery
    run = lambda: stream.run_append(stream.daily_counts(stream.incidents(spark, source, schema, 1), late="10 days", cfg=Config()), out)
    got, told = run()
    found = {str(r.date): r.n for r in got.collect()}
    assert found == {f"2000-01-{d:02d}": 3 if d == 19 else 2 for d in range(1, 21)}
    assert sum(t["late_rows"] for t in told) == 1 and max(t["state_rows"] for t in told) >= 20 and told[-1]["state_rows"] == 3
    # a later run goes on: nothing is written twice, and what was open becomes final
    _deliver(spark, source, [(6, 1)])
    again = run()[0]
    assert again.count() == 23 and again.groupBy("date", "cell").count().where("count > 1").count() == 0


def test_upsert_takes_the_least_row(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 5, "2000-01-01"), (1, 3, "2000-01-01"), (2, 9, "2000-01-02")], "unique_key long, x int, d string").withColumn("day", F.to_date("d")).drop("d")
    write = stream.upsert(target)
    for _ in range(2):
        write(rows, 0)
    assert sorted((r.unique_key, r.x) for r in spark.read.parquet(target).collect()) == [(1, 3), (2, 9)]


def test_a_delivery_of_many_files_is_one_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda m, d: (1, dt.datetime(2000, m, d), *BOX)
    schema = "unique_key long, incident_ts timestamp, latitude double, longitude double"
    # the second delivery has fewer rows than files
    for rows in ([day(1, d) for d in range(1, 21)] * 9, [day(1, 19), day(3, 1)], [day(1, 2), day(3, 2), day(2, 28)] * 5):
        stream.deliver(spark.createDataFrame(rows, schema), source, 6)
    assert len(stream.data_files(spark, source)) == 18
    got, told = stream.run_append(stream.daily_counts(stream.incidents(spark, source, spark.read.parquet(source).schema, 6), late="10 days", cfg=Config()), out)
    assert [t["rows"] for t in told if t["rows"]] == [180, 2, 15]
    assert {str(r.date): r.n for r in got.collect()} == {f"2000-01-{d:02d}": 10 if d == 19 else 9 for d in range(1, 21)}


def test_counts_read_the_layer_itself(spark, sf):
    from hotgrid.plans import queries
    from hotgrid.sources import layers

    rows = queries.clean(spark, sf)
    assert layers.folder(rows) == layers.folder(queries.clean(spark, sf))
    got = {(r.date, r.cell): r.n for r in queries.QUERIES["stream_cell_counts"](spark, sf).collect()}
    assert got == {(r.date, r.cell): r["count"] for r in rows.groupBy(F.to_date("incident_ts").alias("date"), "cell").count().collect()}
