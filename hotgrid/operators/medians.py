"""Exact medians of many columns in bounded memory, by counts of ranges.

``percentile`` keeps all distinct values of a column in one buffer. Here a pass counts, for each column, the rows below,
at and between two bounds, and sketches the values between; the next pass has the closest bounds of the
sketch that are sure to hold the wanted ranks. A few values are left at last, and are sorted.

A pass has a dozen expressions a column, whose planning costs seconds at any size. So more than a few columns are ranked all at
once instead: their distinct values are sorted by ranges over the cluster, and only the ranges that hold a middle are gone through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.functions.exprs import finite
from hotgrid.sources.layers import discard, written

#: Values that are sorted at last, cuts of the sketch, its accuracy (ranks are right to one in so many), and columns of one pass.
FEW, CUTS, ACCURACY, TOGETHER = 20_000, 100, 2_000, 40
#: Columns that are searched one by one; more are ranked at once.
NARROW = 4


@dataclass
class _Search:
    """The ranks of a column still looked for, and the bounds that hold them (both among the values, or infinite)."""

    low: float = -math.inf
    high: float = math.inf
    ranks: list[int] | None = None
    found: dict[int, float] = field(default_factory=dict)
    few: bool = False

    def value(self) -> float | None:
        return None if not self.found else sum(self.found.values()) / len(self.found)


def _counts(column: str, s: _Search) -> list:
    x = finite(F.col(column).cast("double"))
    low, high = F.lit(s.low), F.lit(s.high)
    inner = F.when((x > low) & (x < high), x)
    parts = [F.count_if(x < low), F.count_if(x == low), F.count(inner), F.count_if(x == high)]
    if s.few:
        return [*parts, F.sort_array(F.collect_list(inner))]
    return [*parts, F.percentile_approx(inner, [i / CUTS for i in range(CUTS + 1)], ACCURACY)]


def _narrow(s: _Search, below: int, at_low: int, inner: int, at_high: int, values: list[float] | None, few: int) -> None:
    """What a pass tells: ranks that are at a bound or among the values, or closer bounds for the others."""
    if s.ranks is None:
        n = below + at_low + inner + at_high
        s.ranks = [] if not n else sorted({(n - 1) // 2, n // 2})
    left = []
    for rank in s.ranks:
        at = rank - below - at_low
        if at < 0:
            s.found[rank] = s.low
        elif at >= inner:
            s.found[rank] = s.high
        elif s.few:
            s.found[rank] = values[at]
        else:
            left.append(at)
    s.ranks = [r for r in s.ranks if r not in s.found]
    if not left:
        return
    s.few = inner <= few
    if s.few:
        return
    first, last = min(left) * CUTS // inner, max(left) * CUTS // inner
    if first >= 1:
        s.low = values[first - 1]
    if last + 2 <= CUTS:
        s.high = values[last + 2]


def _ranked(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exact medians of columns that have a value, in three jobs however many columns there are.

    Values are counted by column and value and dealt by ranges of both, so that no task has all values of a column. What comes to the
    driver are the rows of each column in each range: as many numbers as columns and ranges.
    """
    # one expression after the explode, not one a column before it
    values = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("place", "x")).select("place", finite(F.col("x")).alias("x")).where("x is not null")
    counted = values.groupBy("place", "x").agg(F.count("*").alias("n")).repartitionByRange("place", "x")
    table = written(counted.withColumn("range", F.spark_partition_id()), "ranked")
    ranges: dict[int, list] = {}
    for r in table.groupBy("place", "range").agg(F.sum("n").alias("n"), F.min("x").alias("least")).orderBy("place", "least").collect():
        ranges.setdefault(r["place"], []).append(r)
    wanted = []
    for place, own in ranges.items():
        n, before = sum(r["n"] for r in own), 0
        for r in own:
            wanted += [(place, r["range"], rank - before) for rank in {(n - 1) // 2, n // 2} if before <= rank < before + r["n"]]
            before += r["n"]
    if not wanted:
        discard(table)
        return {}
    spark = df.sparkSession
    at = F.broadcast(spark.createDataFrame(wanted, "place int, range int, rank long"))
    up = Window.partitionBy("place", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    held = table.join(F.broadcast(at.select("place", "range").distinct()), ["place", "range"]).withColumn("up_to", F.sum("n").over(up))
    hits = held.join(at, ["place", "range"]).where((F.col("rank") < F.col("up_to")) & (F.col("rank") >= F.col("up_to") - F.col("n")))
    found: dict[int, list[float]] = {}
    for r in hits.select("place", "x").collect():
        found.setdefault(r["place"], []).append(r["x"])
    discard(table)
    return {columns[place]: sum(xs) / len(xs) for place, xs in found.items()}


def medians(df: DataFrame, columns: list[str], few: int = FEW) -> dict[str, float | None]:
    """The exact median of each column's finite values: the mean of the two in the middle; None where there are none.

    Every pass reads only the columns that are still open, and leaves a twentieth of the values between the
    bounds at most, however they are distributed; values that repeat are found as bounds. The sketch of a column has a fixed
    size, and up to ``few`` values are collected. So is what comes to the driver: a fixed size a column. Columns of few
    values are sorted at once. More than ``NARROW`` columns are ranked together, in which ``few`` plays no part.
    """
    if not columns:
        return {}
    if len(columns) > NARROW:
        return dict.fromkeys(columns) | _ranked(df, columns)
    values = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    n = values.agg(*[F.count(c).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    todo = [c for k, c in enumerate(columns) if n[k] > few]
    searches = {c: _Search() for c in todo}
    out = dict.fromkeys(columns)
    short = [c for k, c in enumerate(columns) if 0 < n[k] <= few]
    for i in range(0, len(short), TOGETHER):
        some = short[i : i + TOGETHER]
        row = values.agg(*[F.collect_list(c).alias(f"c{k}") for k, c in enumerate(some)]).first()
        for k, c in enumerate(some):
            own = sorted(row[k])
            out[c] = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
    while todo:
        for i in range(0, len(todo), TOGETHER):
            some = todo[i : i + TOGETHER]
            row = df.agg(*[F.struct(*_counts(c, searches[c])).alias(f"c{k}") for k, c in enumerate(some)]).first()
            for k, c in enumerate(some):
                _narrow(searches[c], *row[f"c{k}"], few)
        todo = [c for c in todo if searches[c].ranks]
    return out | {c: s.value() for c, s in searches.items()}


def fill(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """``df`` whose columns are finite doubles: what is not gets the given value, else 0."""
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(v), F.lit(0.0)) for c, v in values.items()})
