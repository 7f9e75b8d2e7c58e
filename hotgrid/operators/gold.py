"""Enrichment: event-time rolling statistics, nearest station, places, socio-economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions import hexgrid
from hotgrid.functions.exprs import great_circle_km, padded
from hotgrid.sources.layers import written

DAY = 86400
#: Seconds of the stretches that a cell's history is cut into; as long as the longest frame at least.
STRETCH = 90 * DAY
# Fixed values. Kilometres assumed for a kind of place that a cell does not have, and for one that it has.
POI_DEFAULTS = {"school": 1.5, "transit_station": 2.0, "park": 1.2, "nightlife": 2.5}
POI_PRESENT = 0.2


def rolling_events(df: DataFrame) -> DataFrame:
    """Incidents of the cell in the 7 and 30 days before each, and the share with an arrest.

    Incidents of the same second do not count for each other. Each incident adds to its cell's counts at its second and is
    taken away when a frame has passed it, so a row's counts are the sum of what came before it: one running sum, linear in the rows
    however many a frame holds. A window's partition is a cell and a stretch of days, so that a hot cell is spread over its years;
    an incident that the next stretch still sees adds to that one too.
    """
    sec, week, span = F.unix_timestamp("incident_ts"), 7 * DAY, 30 * DAY
    stretch = lambda at: F.floor(at / STRETCH)
    n = F.coalesce(F.col("arrest").cast("int"), F.lit(0))

    def step(where: Column, at: Column, d7: Column, d30: Column, arrests: Column, own: bool = False) -> Column:
        return F.struct(where.alias("stretch"), at.alias("at"), F.lit(own).alias("own"), d7.alias("d7"), d30.alias("d30"), arrests.alias("arrests"))

    one, none = F.lit(1), F.lit(0)
    still = (stretch(sec + week) > stretch(sec)).cast("int")
    steps = F.array(
        step(stretch(sec), sec, one, one, n, own=True),
        F.when(stretch(sec + span) > stretch(sec), step(stretch(sec) + 1, sec, still, one, n)),
        step(stretch(sec + week), sec + week, -one, none, none),
        step(stretch(sec + span), sec + span, none, -one, -n),
    )
    placed = df.where("cell is not null and incident_ts is not null").withColumn("_step", F.explode(F.array_compact(steps)))
    # only an incident's own step carries its columns
    slim = placed.select("cell", *[F.when(F.col("_step.own"), F.col(c)).alias(c) for c in df.columns if c != "cell"], "_step")
    before = Window.partitionBy("cell", "_step.stretch").orderBy("_step.at").rangeBetween(Window.unboundedPreceding, -1)
    sums = slim.withColumns({f"_{c}": F.coalesce(F.sum(f"_step.{c}").over(before), F.lit(0)) for c in ("d7", "d30", "arrests")})
    rate = F.when(F.col("_d30") > 0, F.col("_arrests") / F.col("_d30")).otherwise(0.0)
    return sums.where("_step.own").select(*df.columns, F.col("_d7").alias("crime_density_7d"), F.col("_d30").alias("crime_density_30d"), rate.alias("arrest_rate"))


def poi_points(features: DataFrame) -> DataFrame:
    """(latitude, longitude, poi_type) of tagged shapes, each once: the kind by its tags, the mean of its vertices.

    ``features`` has ``tags`` (map of texts) and ``vertices`` (array of lat, lon structs). Shapes of no kind
    or without a vertex are left out.
    """
    tag = lambda k: F.col("tags")[k]
    # fixed values: the tags of each kind
    kind = F.when(tag("railway") == "station", "transit_station").when(tag("amenity") == "school", "school").when(tag("leisure") == "park", "park").when(tag("amenity").isin("bar", "nightclub"), "nightlife")
    mean = lambda c: F.when(F.size("vertices") > 0, F.aggregate("vertices", F.lit(0.0), lambda a, v: a + v[c]) / F.size("vertices"))
    points = features.select(mean("lat").alias("latitude"), mean("lon").alias("longitude"), kind.alias("poi_type"))
    return points.na.drop().dropDuplicates(["latitude", "longitude", "poi_type"])


def with_population(socio: DataFrame, population: DataFrame) -> DataFrame:
    """Socio-economics with the population of areas of the same name, however it is written there."""
    key = lambda c: F.upper(F.trim(c))
    people = population.select(key("community_area_name").alias("_name"), "population").groupBy("_name").agg(F.max("population").alias("population"))
    return socio.withColumn("_name", key("community_area_name")).join(F.broadcast(people), "_name", "left").drop("_name")


def quality_report(before: DataFrame, gold: DataFrame, most: float = 0.05) -> DataFrame:
    """One row: enriched rows, share without a cell before the filter, share without weather, verdict."""
    a = before.agg(F.count("*").alias("n_before"), F.count_if(F.col("cell").isNull()).alias("null_cells"))
    b = gold.agg(F.count("*").alias("n_gold"), F.count_if(F.col("temp_max") == 0).alias("zero_weather"))
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    out = a.crossJoin(b).withColumns({"null_share": share("null_cells", "n_before"), "zero_weather_share": share("zero_weather", "n_gold")})
    return out.withColumn("passed", (F.col("n_gold") > 0) & (F.col("null_share") <= most))


def weather_coverage(facts: DataFrame, dims: DataFrame, weather: DataFrame, value: str = "TMAX") -> DataFrame:
    """One row: facts with a cell, those whose station has no ``value`` on their day, those with a true 0, and the share that lacks it.

    Counted before missing values are filled, so a day of 0 degrees is no gap. ``dims`` has each cell's station,
    ``weather`` is in long form.
    """
    seen = weather.where(F.col("datatype") == value).groupBy("date", "station_id").agg(F.min("value").alias("_v"))
    # facts are counted by cell and day first: what meets the weather is bounded by the grid and the calendar
    days = facts.where("cell is not null").groupBy("cell", F.to_date("incident_ts").alias("date")).agg(F.count("*").alias("_n"))
    rows = days.join(dims.select("cell", "station_id"), "cell", "left").join(seen, ["date", "station_id"], "left")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    out = rows.agg(of(F.lit(True)).alias("n_gold"), of(F.col("_v").isNull()).alias("no_weather"), of(F.col("_v") == 0).alias("zero_weather"))
    return out.withColumn("no_weather_share", F.when(F.col("n_gold") > 0, F.col("no_weather") / F.col("n_gold")).otherwise(0.0))


def centroids(df: DataFrame) -> DataFrame:
    return df.where("cell is not null").groupBy("cell").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))


def nearest_station(cells: DataFrame, stations: DataFrame) -> DataFrame:
    """(cell, station_id, km): the nearest station of each cell's centroid, ties by id.

    Cells are few (the grid), stations a small dimension: an aggregate over the pairs, no sort.
    """
    km = great_circle_km("lat", "lon", "st_lat", "st_lon")
    pairs = cells.crossJoin(F.broadcast(stations)).select("cell", F.struct(km.alias("km"), "station_id").alias("s"))
    return pairs.groupBy("cell").agg(F.min("s").alias("s")).select("cell", "s.station_id", "s.km")


def weather_wide(long: DataFrame) -> DataFrame:
    """One row a date and station; the least value where one repeats, 0 where a type is missing."""
    names = {"TMAX": "temp_max", "TMIN": "temp_min", "PRCP": "precipitation", "AWND": "wind_speed", "SNWD": "snow_depth"}
    of = lambda kind: F.coalesce(F.min(F.when(F.col("datatype") == kind, F.col("value"))), F.lit(0.0))
    return long.groupBy("date", "station_id").agg(*[of(k).alias(v) for k, v in names.items()])


def poi_presence(cells: DataFrame, poi_cells: DataFrame) -> DataFrame:
    """Per cell and kind of place 0.2 km if the cell has one, else the kind's default."""
    has = poi_cells.where("cell is not null").groupBy("cell").agg(*[F.min(F.when(F.col("poi_type") == k, POI_PRESENT)).alias(k) for k in POI_DEFAULTS])
    short = {"transit_station": "station"}
    return cells.select("cell").join(has, "cell", "left").select("cell", *[F.coalesce(k, F.lit(v)).alias(f"dist_nearest_{short.get(k, k)}") for k, v in POI_DEFAULTS.items()])


def nearest_places(cells: DataFrame, places: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(cell, poi_type, km): the distance from each cell's centroid to the nearest place of each kind, of kinds that there are.

    ``cells`` has cell, lat, lon of the grid, ``places`` latitude, longitude, poi_type. Rings of cells around
    each cell are searched, twice as far each time, and a cell is done with a kind when the next ring cannot be nearer than
    what was found; so no place is passed over, and far places are never compared with cells that have near ones. The
    number of rounds is the logarithm of the grid's width.
    """
    q, r = hexgrid.axial(F.col("latitude"), F.col("longitude"), cfg)
    points = places.where("latitude is not null and longitude is not null and poi_type is not null").dropDuplicates(["latitude", "longitude", "poi_type"])
    points = written(points.select("latitude", "longitude", "poi_type", q.alias("q"), r.alias("r")).where("q is not null"), "places")
    q, r = hexgrid.axial(F.col("lat"), F.col("lon"), cfg)
    grid = cells.select("cell", "lat", "lon", q.alias("q0"), r.alias("r0"))
    kinds = points.select("poi_type").distinct()
    open_ = grid.crossJoin(F.broadcast(kinds)).withColumn("best", F.lit(None).cast("double"))  # kinds of places are few
    ends = points.agg(F.min("q"), F.max("q"), F.min("r"), F.max("r")).first()
    own = grid.agg(F.min("q0"), F.max("q0"), F.min("r0"), F.max("r0")).first()
    if None in (ends[0], own[0]):
        return open_.select("cell", "poi_type", F.col("best").alias("km")).limit(0)
    spread = lambda i: max(ends[i + 1], own[i + 1]) - min(ends[i], own[i])
    width, near, far, done = int(spread(0) + spread(2)), -1, 2, []
    while True:
        offsets = F.array(*[F.struct(F.lit(a).alias("q"), F.lit(b).alias("r")) for a, b in hexgrid.disk_offsets(near, far)])
        rings = open_.select("cell", "lat", "lon", "poi_type", F.explode(offsets).alias("o"), "q0", "r0").withColumns({"q": F.col("q0") + F.col("o.q"), "r": F.col("r0") + F.col("o.r")})
        km = great_circle_km("lat", "lon", "latitude", "longitude")
        found = rings.join(points, ["q", "r", "poi_type"]).groupBy("cell", "poi_type").agg(F.min(km).alias("km"))
        open_ = open_.join(found, ["cell", "poi_type"], "left").withColumn("best", F.least("best", "km")).drop("km")
        open_ = written(open_, "nearest")
        sure = F.col("best").isNotNull() & (F.col("best") <= hexgrid.least_km(far + 1, cfg)) if far < width else F.lit(True)
        done.append(open_.where(sure).select("cell", "poi_type", F.col("best").alias("km")))
        open_ = open_.where(~sure)
        if far >= width or open_.isEmpty():
            break
        near, far = far, min(2 * far, width)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def observing_stations(days: DataFrame, cells: DataFrame, stations: DataFrame, weather: DataFrame) -> DataFrame:
    """(cell, date, station_id) of the pairs ``days`` (cell, date): the nearest station that has values on the day.

    Each cell has its stations in order (by distance, then id), each day the stations with values; both are bounded by
    the grid, the stations and the calendar. A pair takes the first of its cell's order that its day has,
    null if the day has none. ``weather`` is (date, station_id, ...), in any number of rows a day and station.
    """
    km = great_circle_km("lat", "lon", "st_lat", "st_lon")
    orders = cells.crossJoin(F.broadcast(stations)).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct(km.alias("km"), "station_id"))).alias("order"))
    observed = weather.groupBy("date").agg(F.collect_set("station_id").alias("observed"))
    pairs = days.select("cell", "date").distinct().join(F.broadcast(orders), "cell").join(F.broadcast(observed), "date", "left")
    first = F.filter("order", lambda s: F.array_contains(F.coalesce("observed", F.array()), s["station_id"]))
    return pairs.select("cell", "date", F.get(first, F.lit(0))["station_id"].alias("station_id"))


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.bround(F.col(part) / F.col(whole) * 100, 2))


def socio_dim(tracts: DataFrame, crosswalk: DataFrame, names: DataFrame) -> DataFrame:
    """Area sums of census tracts: unemployment, income, poverty (hardship) and population."""
    key = F.concat(F.lit("17031"), padded("tract", 6))
    walk = crosswalk.select(F.trim("GEOID10").alias("geo"), F.col("COMMAREA").try_cast("int").alias("community_area")).na.drop()
    area = tracts.withColumn("geo", key).join(walk, "geo").groupBy("community_area").agg(*[F.sum(c).alias(c) for c in ("population", "income", "labor_force", "unemployed", "poverty_denom", "poverty_count")])
    return area.join(F.broadcast(names), "community_area", "left").select(
        "community_area",
        F.coalesce(F.upper(F.trim("community_area_name")), F.lit("")).alias("community_area_name"),
        F.when(F.col("population") > 0, F.bround(F.col("income") / F.col("population"), 2)).alias("per_capita_income"),
        _percent("unemployed", "labor_force").alias("unemployment_rate"),
        F.bround(F.col("poverty_count") / F.when(F.col("poverty_denom") > 0, F.col("poverty_denom")) * 100).cast("int").alias("hardship_index"),
        F.col("population").alias("population_density"),
    )


def enrich(facts: DataFrame, stations: DataFrame, weather: DataFrame, poi_cells: DataFrame, socio: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The enriched fact: rolling counts, the nearest station's weather, places and socio-economics.

    Cells, places by cell and areas are dimensions bounded by the city's grid; weather is joined by
    (date, station). Facts without a cell are dropped. ``cells`` has the centroids where ``facts`` are a part
    of all facts.
    """
    facts = rolling_events(facts.where("cell is not null"))
    cells = centroids(facts) if cells is None else cells
    dims = nearest_station(cells, stations).select("cell", "station_id").join(poi_presence(cells, poi_cells), "cell")
    ts = F.col("incident_ts")
    df = facts.join(F.broadcast(dims), "cell", "left").withColumn("date", F.to_date(ts))
    df = df.join(weather, ["date", "station_id"], "left").join(F.broadcast(socio), "community_area", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return df.select(
        "unique_key", "case_number", "date", "primary_type", "community_area", "cell", "latitude", "longitude", "arrest",
        F.hour(ts).alias("hour_of_day"), F.weekday(ts).alias("day_of_week"), F.month(ts).alias("month"),
        *map(zero, ("temp_max", "temp_min", "precipitation", "wind_speed")),
        *[f"dist_nearest_{k}" for k in ("school", "station", "park", "nightlife")],
        "crime_density_7d", "crime_density_30d", "arrest_rate",
        zero("unemployment_rate"), F.coalesce("hardship_index", F.lit(0)).alias("hardship_index"), zero("population_density"), zero("per_capita_income"),
    )
