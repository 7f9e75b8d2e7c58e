"""Cleaning: validate, normalise, deduplicate, filter, place on the grid."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions import hexgrid
from hotgrid.functions.exprs import great_circle_km, parse_ts

MANDATORY = ("unique_key", "case_number", "incident_ts", "primary_type", "latitude", "longitude", "community_area")


def validate(df: DataFrame, columns: tuple[str, ...] = MANDATORY) -> DataFrame:
    """The frame itself; raises if a mandatory column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself; raises if it has no row (reads until the first)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def parse_dates(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Parse both formats once; the parsed column is what all later stages use."""
    ts = parse_ts(date_col)
    return df.withColumn("parsed_date", ts).withColumns({"part_year": F.year("parsed_date"), "part_month": F.month("parsed_date"), "part_day": F.dayofmonth("parsed_date")})


def normalize(df: DataFrame) -> DataFrame:
    """Upper-case, trimmed texts and strict types; a value that does not fit its type is null."""
    texts = [c for c in ("primary_type", "description", "location_description", "block") if c in df.columns]
    kinds = {"arrest": "boolean", "domestic": "boolean", "beat": "int", "district": "int", "ward": "int", "community_area": "int", "year": "int", "latitude": "double", "longitude": "double"}
    casts = {c: F.col(c).try_cast(t) for c, t in kinds.items() if c in df.columns}
    return df.withColumns({c: F.upper(F.trim(c)) for c in texts} | casts).drop("location", "x_coordinate", "y_coordinate", "updated_on")


def deduplicate(df: DataFrame, key: str = "unique_key") -> DataFrame:
    """One row a key, the least by all columns: the same at every run.

    One scan and one shuffle. Each task first keeps one row of every key that it has, so a key that
    is delivered very often sends a row a task.
    """
    rest = [c for c in df.columns if c != key]
    least = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def clean(df: DataFrame, as_of: str, cfg: Config = Config()) -> DataFrame:
    """Drop rows without the critical columns, repeated keys, points outside the box, dates out of range."""
    return deduplicate(df.na.drop(subset=[c for c in MANDATORY if c in df.columns])).where(_kept(as_of, cfg))


def _kept(as_of: str, cfg: Config) -> Column:
    """Whether a row is inside of the box and in the range of dates."""
    box, ts = cfg.box, F.col("incident_ts")
    inside = F.col("latitude").between(box.lat_min, box.lat_max) & F.col("longitude").between(box.lon_min, box.lon_max)
    return inside & (ts >= F.make_date(F.lit(cfg.first_year), F.lit(1), F.lit(1)).cast("timestamp")) & (ts <= F.lit(as_of).cast("timestamp"))


def encode(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    return hexgrid.with_cell(df, cfg=cfg).withColumn("distance_to_center_km", great_circle_km("latitude", "longitude", F.lit(cfg.center_lat), F.lit(cfg.center_lon)))


def silver(raw: DataFrame, as_of: str, cfg: Config = Config()) -> DataFrame:
    return encode(clean(normalize(validate(raw)), as_of, cfg), cfg)


def new_rows(batch: DataFrame, existing: DataFrame | None, key: str = "unique_key") -> DataFrame:
    """The rows of a batch whose key is not loaded yet; an absent target passes all through."""
    return batch if existing is None else batch.join(existing.select(key), key, "left_anti")


def load_summary(df: DataFrame, start: str, end: str) -> DataFrame:
    """(date, n_rows, loaded) of every day of a range, days without rows included."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    # the filter on the timestamp itself reaches the scan
    within = (F.col("incident_ts") >= F.lit(start).cast("timestamp")) & (F.col("incident_ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    loaded = df.where(within).groupBy(F.to_date("incident_ts").alias("date")).agg(F.count("*").alias("n"))
    return days.join(loaded, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n_rows"), F.col("n").isNotNull().alias("loaded"))


def nothing_new(batch: DataFrame, existing: DataFrame | None, key: str = "unique_key") -> bool:
    """Whether a run can stop early: no row of the batch is new. Stops at the first row that is."""
    return new_rows(batch, existing, key).isEmpty()


def unloaded(rows: DataFrame, loaded: DataFrame, day: str = "date") -> DataFrame:
    """Rows of days that are not loaded yet; the days of a table are few and broadcast."""
    return rows.join(F.broadcast(loaded.select(day).distinct()), day, "left_anti")


def run_windows(runs: DataFrame, first: str, lag: int = 5, span: int = 21) -> DataFrame:
    """(run_date, full, start, end) of each run: all since ``first`` for a full load, else the trailing days."""
    end = F.date_sub("run_date", lag)
    return runs.select("run_date", "full", F.when(F.col("full"), F.lit(first).cast("date")).otherwise(F.date_sub(end, span)).alias("start"), end.alias("end"))


def year_chunks(ranges: DataFrame) -> DataFrame:
    """(chunk_start, chunk_end): ranges (start, end) cut at the ends of calendar years."""
    years = ranges.select("start", "end", F.explode(F.sequence(F.year("start"), F.year("end"))).alias("y"))
    first, last = F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31))
    return years.select(F.greatest("start", first).alias("chunk_start"), F.least("end", last).alias("chunk_end"))


def quality_report(before: DataFrame, after: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row: rows before and after cleaning, share of rows without a cell, verdict."""
    a = before.agg(F.count("*").alias("rows_before"), F.count_distinct("unique_key").alias("keys_before"))
    b = after.agg(F.count("*").alias("rows_after"), F.count_if(F.col("cell").isNull()).alias("null_cells"))
    return a.crossJoin(b).withColumn("passed", _passed(cfg))


def _passed(cfg: Config) -> Column:
    share = F.when(F.col("rows_after") > 0, F.col("null_cells") / F.col("rows_after")).otherwise(1.0)
    return (F.col("rows_after") > 0) & (share <= cfg.max_null_share)


def cleaning_report(raw: DataFrame, as_of: str, cfg: Config = Config()) -> DataFrame:
    """The row of :func:`quality_report` for the raw rows and what :func:`silver` makes of them, from one scan and one shuffle.

    The pass that keeps a key's least row counts the rows and the keys on its way; the cleaned rows are not written.
    """
    df, key = normalize(validate(raw)), "unique_key"
    rest, needed = [c for c in df.columns if c != key], [c for c in MANDATORY if c in df.columns]
    kinds = dict(df.dtypes)
    lacks = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
    whole = F.when(~functools.reduce(operator.or_, map(lacks, needed)), F.struct(*rest))
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(whole).alias("_row"))
    one = hexgrid.with_cell(keys.select(key, "_n", *[F.col(f"_row.{c}").alias(c) for c in ("latitude", "longitude", "incident_ts")]), cfg=cfg).withColumn("_kept", _kept(as_of, cfg))
    rows = F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before")
    out = one.agg(rows, F.count(key).alias("keys_before"), F.count_if("_kept").alias("rows_after"), F.count_if(F.col("_kept") & F.col("cell").isNull()).alias("null_cells"))
    return out.withColumn("passed", _passed(cfg))


#: The types that raw texts have to fit (fixed values).
KINDS = {"unique_key": "long", "arrest": "boolean", "domestic": "boolean", "beat": "int", "district": "int", "ward": "int", "community_area": "int", "year": "int", "latitude": "double", "longitude": "double"}


def reasons(raw: DataFrame, mandatory: tuple[str, ...] = MANDATORY) -> Column:
    """Why a row of texts cannot be used, all reasons in the order of the columns; empty if it can."""
    known = [(c, F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), f"{c} is no {t}") for c, t in KINDS.items() if c in raw.columns]
    if "date" in raw.columns:
        known.append(("date", F.col("date").isNotNull() & parse_ts("date").isNull(), "date is no timestamp"))
    lacking = [(c, F.col(c).isNull(), f"{c} is missing") for c in mandatory if c in raw.columns]
    broken = [("_corrupt", F.col("_corrupt").isNotNull(), "row does not fit the schema")] if "_corrupt" in raw.columns else []
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for _, cond, text in (*broken, *lacking, *known)]))


def load(raw: DataFrame, path: str, mandatory: tuple[str, ...] = MANDATORY) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write a batch of texts in one pass, good rows typed and the others as they are with their reasons.

    (good rows, rows in quarantine, metrics). Both are partitions of one table at ``path``. The metrics (rows, bad, and how often each
    mandatory column is missing) are observed while the batch is written, so it is read once. Nothing is
    lost: every row is in one of the two.
    """
    why, seen = reasons(raw, mandatory), Observation("load")
    marked = raw.withColumn("reasons", why).withColumn("quarantined", F.size("reasons") > 0)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if("quarantined").alias("bad"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in mandatory if c in raw.columns]]
    marked.observe(seen, *counts).write.mode("overwrite").partitionBy("quarantined").parquet(path)
    back = raw.sparkSession.read.schema(marked.schema).parquet(path)
    good = back.where("not quarantined").drop("quarantined", "reasons")
    typed = good.withColumns({c: F.col(c).cast(t) for c, t in KINDS.items() if c in raw.columns} | ({"date": parse_ts("date")} if "date" in raw.columns else {}))
    return typed, back.where("quarantined").drop("quarantined"), seen.get
