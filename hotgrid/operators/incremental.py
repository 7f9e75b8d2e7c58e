"""A gold table that follows its inputs: only months that a change can reach are made again.

Beside the table lie the keys of the rows that it was made of, by month, the dimensions of its cells and a
list of the dimensions' files. A refresh compares these with what there is now. It writes the months first and the keys
last, so that a refresh that ends early is done again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotgrid.sources.layers import delete, discard, exists, files, written
from hotgrid.sources.tables import write_gold

#: Days after an incident whose rows look back on it.
REACH = 30


def month(day: Column) -> Column:
    return F.trunc(day, "month")


def keyed(silver: DataFrame, key: str = "unique_key", ts: str = "incident_ts") -> DataFrame:
    """(key, day, digest, month_start): of each incident its day and a hash of all its columns."""
    day = F.to_date(ts)
    return silver.select(F.col(key).alias("key"), day.alias("day"), F.xxhash64(*sorted(silver.columns)).alias("digest"), month(day).alias("month_start"))


def _sums(keys: DataFrame) -> DataFrame:
    return keys.groupBy("month_start").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key", "day", "digest").cast("decimal(20,0)")).alias("mark"))


def changed_months(now: DataFrame, old: DataFrame) -> DataFrame:
    """(month_start) of which the keys are others: from a sum a month, before any key is compared."""
    a, b = _sums(now), _sums(old).withColumnsRenamed({"n": "n_old", "mark": "mark_old"})
    return a.join(b, "month_start", "full").where(~(F.col("n").eqNullSafe(F.col("n_old")) & F.col("mark").eqNullSafe(F.col("mark_old")))).select("month_start")


def changed_days(now: DataFrame, old: DataFrame) -> DataFrame:
    """(day) that an incident was added to, taken from or changed on; one that moves changes both its days."""
    a, b = now.select("key", "day", "digest"), old.select("key", F.col("day").alias("day_old"), F.col("digest").alias("digest_old"))
    pairs = a.join(b, "key", "full").where(~(F.col("digest").eqNullSafe(F.col("digest_old")) & F.col("day").eqNullSafe(F.col("day_old"))))
    return pairs.select(F.explode(F.array("day", "day_old")).alias("day")).where("day is not null").distinct()


def reached_months(days: DataFrame, reach: int = REACH) -> DataFrame:
    """(month_start) of the rows that look back on the days."""
    later = F.sequence(month(F.col("day")), month(F.date_add("day", reach)), F.expr("interval 1 month"))
    return days.select(F.explode(later).alias("month_start")).distinct()


def changed_cells(now: DataFrame, old: DataFrame) -> DataFrame:
    """(cell) whose dimensions are others than before, or that are new or gone."""
    return now.join(old.withColumnRenamed("digest", "digest_old"), "cell", "full").where(~F.col("digest").eqNullSafe(F.col("digest_old"))).select("cell")


def _replace(df: DataFrame, path: str, by: str, values: list[str]) -> None:
    """Put the partitions ``values`` of ``df`` in the place of those at ``path``; one without rows goes."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    _drop_missing(df.select(by), path, by, values)


def _drop_missing(rows: DataFrame, path: str, by: str, values: list[str]) -> None:
    have = {str(r[0]) for r in rows.distinct().collect()}  # months
    for v in values:
        if v not in have:
            delete(rows.sparkSession, f"{path}/{by}={v}")


def refresh(silver: DataFrame, root: str, make: Callable[[DataFrame], DataFrame], dims: DataFrame, sources: tuple[str, ...] = ()) -> DataFrame:
    """Bring the gold table at ``root``/gold up to ``silver``: (month_start, why) of the months that were made.

    ``make`` turns incidents into gold rows with a column ``date``; a row may depend on its cell's incidents of the ``REACH``
    days before and on its cell's row of ``dims`` (cell and any columns). ``sources`` are the folders or files of other inputs: if one of
    their files is another (path, size, time), everything is made. Months are made if incidents that they can see
    were added, changed or removed (``rows``), late ones too, or if their cells' dimensions changed (``cells``). An
    input of no rows empties the table. The number of months is bounded by the calendar; keys are compared only within changed months.
    """
    spark = silver.sparkSession
    keys, cells = written(keyed(silver), "keys"), written(dims.select("cell", F.xxhash64(*sorted(dims.columns)).alias("digest")), "cells")
    stamp = [(p, n, t) for s in sources for p, n, t in files(spark, s)]
    found = _plan(spark, silver, keys, cells, stamp, root)
    why = {str(r["month_start"]): r["why"] for r in found.collect()}
    if why:
        days = [F.lit(m).cast("date") for m in sorted(why)]
        own = lambda day: month(day).isin(*days)
        day = F.to_date("incident_ts")
        # all months that can look back on a day: of the end of January, February lies between its own and that of its reach
        rows = silver.where(own(day) | own(F.add_months(month(day), 1)) | own(F.date_add(day, REACH)))
        gold = written(make(rows).where(own(F.col("date"))), "gold")
        write_gold(gold, f"{root}/gold")
        _drop_missing(gold.select(month(F.col("date")).alias("month_start")), f"{root}/gold", "month_start", list(why))
        old = _read_keys(spark, root)
        others = sorted(str(r[0]) for r in (changed_months(keys, old) if old is not None else keys.select("month_start").distinct()).collect())
        discard(gold)
        if others:
            _replace(keys.where(F.col("month_start").isin(*[F.lit(m).cast("date") for m in others])), f"{root}/keys", "month_start", others)
    cells.write.mode("overwrite").parquet(f"{root}/cells")
    discard(keys)
    discard(cells)
    spark.createDataFrame(stamp, "path string, size long, changed long").coalesce(1).write.mode("overwrite").parquet(f"{root}/sources")
    return spark.createDataFrame(sorted(why.items()), "month_start string, why string").withColumn("month_start", F.col("month_start").cast("date"))


def _read_keys(spark: SparkSession, root: str) -> DataFrame | None:
    if not files(spark, f"{root}/keys"):
        return None
    return spark.read.schema("key long, day date, digest long, month_start date").parquet(f"{root}/keys")


def _plan(spark: SparkSession, silver: DataFrame, keys: DataFrame, cells: DataFrame, stamp: list, root: str) -> DataFrame:
    """(month_start, why) of the months to make."""
    old = _read_keys(spark, root)
    every = keys.select("month_start").distinct()
    if old is None or not exists(spark, f"{root}/sources/_SUCCESS"):
        return every.withColumn("why", F.lit("new"))
    if sorted(stamp) != sorted(map(tuple, spark.read.parquet(f"{root}/sources").collect())):
        return every.unionByName(old.select("month_start")).distinct().withColumn("why", F.lit("sources"))
    some = F.broadcast(changed_months(keys, old))
    days = changed_days(keys.join(some, "month_start", "left_semi"), old.join(some, "month_start", "left_semi"))
    by_rows = reached_months(days).withColumn("why", F.lit("rows"))
    other = changed_cells(cells, spark.read.schema("cell string, digest long").parquet(f"{root}/cells"))
    by_cells = silver.join(other, "cell", "left_semi").select(month(F.to_date("incident_ts")).alias("month_start"), F.lit("cells").alias("why")).distinct()
    both = by_rows.unionByName(by_cells).groupBy("month_start").agg(F.max("why").alias("why"))
    # a month after the last has no rows to make
    return both.join(F.broadcast(every.unionByName(old.select("month_start")).distinct()), "month_start", "left_semi")
