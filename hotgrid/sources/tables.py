"""Readers with fixed schemas and writers that can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hotgrid.config import IncrementalWindow

RAW = """unique_key long, case_number string, date string, block string, iucr string, primary_type string, description string,
location_description string, arrest boolean, domestic boolean, beat int, district int, ward int, community_area int, fbi_code string,
x_coordinate double, y_coordinate double, year int, updated_on string, latitude double, longitude double, location string"""
WEATHER = "date string, datatype string, value double, station string"
POI = "latitude double, longitude double, poi_type string"
#: Station files: one row a station and day, its date as month/day/year.
STATION_DAYS = "station_id string, date string, TMAX double, TMIN double, PRCP double, AWND double, SNWD double"
SOCIO = "community_area int, community_area_name string, per_capita_income double, unemployment_rate double, hardship_index int, population_density double"
POPULATION = "community_area_name string, population double"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; rows that do not fit the schema are kept with the text in ``_corrupt``."""
    return spark.read.schema(RAW + ", _corrupt string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def read_raw_days(spark: SparkSession, root: str) -> DataFrame:
    """All landed days under ``root``/year/month/day: their CSV files by a glob, with one schema for all."""
    return read_raw(spark, f"{root}/*/*/*/*.csv")


def extract_day(source: DataFrame, day: str | Column, ts: str = "incident_ts") -> DataFrame:
    """All incidents of one day with the raw table's columns, in the order of their keys.

    The filter is on the timestamp itself, so a day that is a literal reaches the scan. ``date`` is the text that the landed files have;
    columns that the source lacks are null.
    """
    start = F.lit(day).cast("timestamp") if isinstance(day, str) else day.cast("timestamp")
    rows = source.where((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 day")))
    have = {c: F.col(c) for c in source.columns} | {"date": F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))}
    kinds = [c.split() for c in RAW.replace("\n", " ").split(", ")]
    return rows.select(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds]).orderBy("unique_key")


def write_bronze(df: DataFrame, path: str, ingested: Column | None = None, date_col: str = "parsed_date") -> None:
    """Rows as they came, by year, month and day, with the time of their loading; days that come again are replaced.

    ``ingested`` is the time of the run, the clock's if it is not given. Rows without a date are in the partition of nulls.
    """
    keys = {"part_year": F.year(date_col), "part_month": F.month(date_col), "part_day": F.dayofmonth(date_col)}
    out = df.withColumns(keys | {"ingestion_time": F.current_timestamp() if ingested is None else ingested})
    # so many tasks as shuffles have: small days would else be merged into few tasks, which write their files one after another
    out.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_station_days(spark: SparkSession, path: str) -> DataFrame:
    """Station files with their dates parsed; a date that does not fit month/day/year is null."""
    return read_csv(spark, path, STATION_DAYS).withColumn("date", F.try_to_date("date", "M/d/yyyy"))


def write_station_days(wide: DataFrame, path: str) -> None:
    """Weather of stations and days as the station files have it: dates without leading zeros."""
    wide.withColumn("date", F.date_format("date", "M/d/yyyy")).write.mode("overwrite").option("header", True).csv(path)


def land_days(df: DataFrame, root: str, ts: str = "incident_ts") -> None:
    """Land incidents as CSV by day: one folder a day, written again as a whole if the day comes again."""
    day = {"year": F.year(ts), "month": F.lpad(F.month(ts).cast("string"), 2, "0"), "day": F.lpad(F.dayofmonth(ts).cast("string"), 2, "0")}
    out = df.withColumns({f"part_{k}": v for k, v in day.items()})
    out.repartition(*[f"part_{k}" for k in day]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").partitionBy(*[f"part_{k}" for k in day]).csv(root)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed API responses: one JSON object a line with an array ``results``."""
    rows = spark.read.schema(f"results array<struct<{', '.join(c.replace(' ', ':', 1) for c in WEATHER.split(', '))}>>").json(path)
    return rows.select(F.explode("results").alias("r")).select(F.to_date(F.substring("r.date", 1, 10)).alias("date"), "r.datatype", "r.value", "r.station")


def read_census_json(spark: SparkSession, path: str) -> DataFrame:
    """A landed header-first array of arrays as (row, name, value); the header names the columns."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<array<string>>").alias("t"))
    cells = rows.select(F.col("t")[0].alias("names"), F.posexplode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("row", "values"))
    return cells.select("row", F.explode(F.arrays_zip("names", "values")).alias("c")).select("row", F.col("c.names").alias("name"), F.col("c.values").alias("value"))


def read_days(spark: SparkSession, path: str, window: IncrementalWindow, date_col: str = "day") -> DataFrame:
    """The days of a window from a table partitioned by day: the filter prunes partitions."""
    return spark.read.parquet(path).where(F.col(date_col).between(F.lit(window.start), F.lit(window.end)))


def loaded_days(spark: SparkSession, table: str, date_col: str = "date") -> DataFrame:
    """Distinct days of a catalog table as a DataFrame; none if the table does not exist."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], f"{date_col} date")
    return spark.table(table).select(date_col).distinct()


def write_days(df: DataFrame, path: str, by: str = "day") -> None:
    """Replace the partitions that the frame has and leave the others: a repeated run changes nothing."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_gold(df: DataFrame, path: str) -> None:
    """Partitioned by month, sorted by cell in each file, so that scans of a cell skip row groups."""
    month = df.withColumn("month_start", F.trunc("date", "month"))
    dealt = month.repartition("month_start", F.pmod(F.xxhash64("cell"), F.lit(8))).sortWithinPartitions("month_start", "cell")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_start").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = 64, by: str = "cell", order: str = "date", mode: str = "overwrite") -> DataFrame:
    """A catalog table, by month and in ``buckets`` of ``by``, sorted in each: what groups or orders by ``by``, or joins by it, needs no shuffle.

    ``overwrite`` makes the table anew; ``append`` puts the frame's months in the place of the table's and leaves the others. Both may be
    repeated. Each bucket of a month is one file.
    """
    spark = df.sparkSession
    if mode not in ("overwrite", "append"):
        raise ValueError(f"no mode {mode}")
    rows = df.withColumn("month_start", F.trunc(order, "month"))
    dealt = rows.repartition(F.pmod(F.hash(by), F.lit(buckets)), "month_start")
    if mode == "overwrite" or not spark.catalog.tableExists(table):
        dealt.write.mode("overwrite").option("path", path).partitionBy("month_start").bucketBy(buckets, by).sortBy(by, order).saveAsTable(table)
    else:
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            dealt.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return spark.table(table)


def write_geojson(features: DataFrame, path: str) -> int:
    """Features, one a line (a GeoJSON sequence), written by all tasks in parallel; the number that were written."""
    seen = Observation("features")
    features.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").text(path)
    return seen.get["rows"]


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(longitude, latitude, and the properties listed) of the features of written files."""
    kinds = "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<" + properties.replace(" ", ":").replace(",:", ",") + ">"
    at = F.col("geometry.coordinates")
    return spark.read.schema(kinds).json(path).select(at[0].alias("longitude"), at[1].alias("latitude"), "properties.*")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write a dimension, whole or as more rows; the number of rows that the call wrote, counted while it does."""
    seen = Observation("table")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return seen.get["rows"]


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The predictions table, by day: replaced as a whole, or (``append``) with the frame's days replaced and others kept."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"no mode {mode}")
    how = "static" if mode == "overwrite" else "dynamic"
    df.repartition("prediction_date").write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("prediction_date").parquet(path)


def days_written(df: DataFrame, date_col: str = "date") -> DataFrame:
    """One row: distinct days and rows of what a run writes."""
    return df.agg(F.count_distinct(date_col).alias("days"), F.count("*").alias("rows"))


def complete_days(days: DataFrame, ledger: DataFrame, date_col: str = "date") -> DataFrame:
    """The days that a ledger lists as loaded; others wait for their files."""
    return days.join(F.broadcast(ledger.select(date_col).distinct()), date_col, "left_semi")


def append_ledger(df: DataFrame, path: str, source: str, date_col: str = "date") -> None:
    """Note each day loaded: date, rows, source and the time of the load. Only rows are added; :func:`read_ledger` tells the last load's."""
    days = df.groupBy(date_col).agg(F.count("*").alias("rows"))
    days.withColumns({"source": F.lit(source), "loaded_at": F.current_timestamp()}).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str, date_col: str = "date") -> DataFrame:
    """(date, source, rows, loaded_at): one row a day and source, however often it was loaded; the last load counts."""
    last = F.max(F.struct("loaded_at", "rows")).alias("_last")
    return spark.read.parquet(path).groupBy(date_col, "source").agg(last).select(date_col, "source", "_last.rows", "_last.loaded_at")
