"""A table in buckets of cells is read without a shuffle, and its writes can be repeated."""

import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hotgrid.sources import tables


def test_no_exchange_and_repeated_writes(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("c"), F.col("id") % 37).alias("cell"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("date"), "id")
    name, path = f"t_{uuid.uuid4().hex[:8]}", str(tmp_path / "t")
    read = lambda: sorted(map(tuple, spark.table(name).select("cell", "date", "id").collect()))
    want = sorted(map(tuple, rows.collect()))
    for _ in range(2):
        tables.write_bucketed(rows, name, path, 4)
        assert read() == want
    for _ in range(2):
        table = tables.write_bucketed(rows.where("date >= '2000-03-01'").withColumn("id", F.col("id") + 10_000), name, path, 4, mode="append")
        assert read() == sorted((c, d, i + (10_000 if str(d) >= "2000-03-01" else 0)) for c, d, i in want)
    before = Window.partitionBy("cell").orderBy("date")
    totals = table.groupBy("cell").agg(F.count("*").alias("n"))
    windowed = table.withColumn("k", F.row_number().over(before)).join(totals.hint("merge"), "cell")
    plan = windowed._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange hashpartitioning" not in plan and windowed.count() == 2000
    with pytest.raises(ValueError):
        tables.write_bucketed(rows, name, path, 4, mode="x")
    spark.sql(f"drop table {name}")
