"""Views that turn the test tables into the inputs of the stages (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotgrid.functions.exprs import padded

TYPES = ("THEFT", "BATTERY", "CRIMINAL DAMAGE", "ASSAULT", "NARCOTICS", "BURGLARY", "ROBBERY", "MOTOR VEHICLE THEFT", "DECEPTIVE PRACTICE", "OTHER OFFENSE", "HOMICIDE", "ARSON")
POI_TYPES = ("school", "transit_station", "park", "nightlife", "other")
WEATHER_TYPES = ("TMAX", "TMIN", "PRCP", "AWND", "SNWD")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coordinate(key: str, step: int, base: float, scale: float):
    return F.lit(base) + (F.col(key) * step) % 1000 * F.lit(scale)


def _pick(words: tuple[str, ...], at) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), at.cast("int"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw incidents; unique_key repeats with other contents, as re-delivered rows do."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("ship"))
    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    seconds = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 3571) % 86400
    return items.join(who, "l_suppkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unique_key"),
        F.concat(F.lit("HZ"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("case_number"),
        F.timestamp_seconds(F.unix_seconds("ship") + seconds).alias("incident_ts"),
        _pick(TYPES, F.col("l_partkey") % 12 + 1).alias("primary_type"),
        (F.col("l_returnflag") == "R").alias("arrest"),
        (F.col("l_linestatus") == "F").alias("domestic"),
        (F.col("s_nationkey") + 1).cast("int").alias("community_area"),
        _coordinate("l_suppkey", 377, 41.60, 0.00046).alias("latitude"),
        _coordinate("l_suppkey", 531, -87.98, 0.0005).alias("longitude"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("ST"), F.lpad(n.cast("string"), 3, "0")).alias("station_id"), (F.lit(41.66) + n * F.lit(0.07)).alias("st_lat"), (F.lit(-87.90) + n * F.lit(0.08)).alias("st_lon"), n.cast("long").alias("st_no")
    )


def weather_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, station_id, datatype, value); every 17th day is missing."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    day = F.datediff("date", F.lit("1995-01-01").cast("date"))
    kinds = F.posexplode(F.array(*map(F.lit, WEATHER_TYPES))).alias("ti", "datatype")
    rows = days.crossJoin(F.broadcast(stations(spark, sf_dir).select("station_id", "st_no"))).select("date", "station_id", "st_no", kinds)
    return rows.where(day % 17 != 0).select("date", "station_id", "datatype", ((day * 37 + F.col("st_no") * 11 + F.col("ti") * 101) % 1000 / F.lit(10.0)).alias("value"))


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _coordinate("c_custkey", 613, 41.60, 0.00046).alias("latitude"), _coordinate("c_custkey", 287, -87.98, 0.0005).alias("longitude"), _pick(POI_TYPES, F.col("c_custkey") % 5 + 1).alias("poi_type")
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged shapes as a map service has them: (tags, vertices), triangles around each customer's place, some twice."""
    key, at = F.col("c_custkey"), F.element_at
    tags = F.array(*[F.create_map(F.lit(k), F.lit(v)) for k, v in (("railway", "station"), ("amenity", "school"), ("leisure", "park"), ("amenity", "bar"), ("amenity", "nightclub"), ("shop", "bakery"))])
    lat, lon = _coordinate("c_custkey", 613, 41.60, 0.00046), _coordinate("c_custkey", 287, -87.98, 0.0005)
    corners = F.array(*[F.struct((lat + F.lit(a)).alias("lat"), (lon + F.lit(b)).alias("lon")) for a, b in ((0.25, 0.0), (-0.25, 0.5), (0.0, -0.5))])
    one = table(spark, sf_dir, "customer").select(key, at(tags, (key % 6 + 1).cast("int")).alias("tags"), corners.alias("vertices"))
    return one.unionByName(one.where("c_custkey % 4 = 0")).drop("c_custkey")


def tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        padded(key.cast("string"), 6).alias("tract"),
        (size * 100).cast("double").alias("population"),
        (F.col("p_retailprice") * 40).alias("income"),
        (size * 60).cast("double").alias("labor_force"),
        (size * (key % 9)).cast("double").alias("unemployed"),
        (size * 95).cast("double").alias("poverty_denom"),
        (size * (key % 23)).cast("double").alias("poverty_count"),
    )


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(key % 11 != 0).select(F.concat(F.lit("17031"), padded(key.cast("string"), 6)).alias("GEOID10"), (key % 25 + 1).cast("int").alias("COMMAREA"))


def area_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("community_area"), F.col("n_name").alias("community_area_name"))


def holidays(spark: SparkSession) -> DataFrame:
    """Five days a year, 1995 to 2001."""
    years = spark.range(1995, 2002).select(F.col("id").cast("int").alias("y"))
    days = F.explode(F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in ((1, 1), (5, 30), (7, 4), (11, 24), (12, 25))]))
    return years.select(days.alias("holiday"))


def raw_dates(incidents: DataFrame) -> DataFrame:
    """(unique_key, date text): two formats and, every 97th key, no date at all."""
    key, ts = F.col("unique_key"), F.col("incident_ts")
    iso, us = F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")), F.date_format(ts, "MM/dd/yyyy hh:mm:ss a")
    return incidents.select(key, F.when(key % 97 == 0, "not a date").when(key % 2 == 0, iso).otherwise(us).alias("date"))
