"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotgrid.sources.layers import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows reads files that survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hotgrid-{uuid.uuid4().hex[:12]}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made and that no frame still in use reads."""
    for df in tables:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Groups that may be called hot, and the rows that a hot group has at least: the hot ones are broadcast.
HOT_GROUPS, HOT_ROWS = 50_000, 300


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``groups``, one row a key, which tells in ``_rows`` how many rows have it.

    Groups with over a 50,000th of all rows, of which there can be 50,000, are broadcast to their rows, which
    stay where they are. Only the others are dealt by key, so no task gets a hot group. ``total`` is the number
    of rows, or more, where counting them is dear.
    """
    limit = max(HOT_ROWS, (rows.count() if total is None else total) // HOT_GROUPS)
    hot, rest = groups.where(F.col("_rows") > limit).drop("_rows"), groups.where(F.col("_rows") <= limit).drop("_rows")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def with_groups(rows: DataFrame, keys: list[str], what: dict[str, Column], where: str = "true", how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` with aggregates of their group, however many of them one group has.

    Groups that fail ``where`` are left out, with their rows or (``how`` left) with nulls for these.
    """
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in what.items()]).where(where)
    return join_hot(rows, written(groups, "grouped"), keys, how, total)


def with_lookup(rows: DataFrame, key: str, lookup: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``lookup`` (one row a key), where a third of the rows may have one key."""
    counted = rows.groupBy(key).agg(F.count("*").alias("_rows")).join(lookup, key)
    return join_hot(rows, written(counted, "counted"), [key], "left")


def map_texts(
    df: DataFrame,
    start: Callable[[], Callable[[list, list], dict[str, list]]],
    out: pa.Schema,
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = 512,
) -> DataFrame:
    """Apply a function to (ids, texts) in blocks of ``rows`` rows, without a shuffle.

    ``start`` runs once a task and returns the function, which gets two lists and
    returns one list per output column. A block bounds what a task holds besides
    its Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                got = f(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[c.name], c.type) for c in out], schema=out)

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).mapInArrow(run, schema)


#: Ids that may be broadcast to take out or pick rows without a shuffle: 8 bytes each.
BROADCAST_IDS = 1_000_000


def without(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is not in the one column of ``ids``.

    Few ids are broadcast, so that the texts stay where they are; more are joined by id.
    """
    gone = written(ids.toDF(id_col).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return df.join(F.broadcast(gone) if few else gone, id_col, "left_anti")


def only(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is in the one column of ``ids``; broadcast or joined as in :func:`without`."""
    kept = written(ids.toDF(id_col).distinct(), "kept")
    few = kept.count() <= BROADCAST_IDS
    return df.join(F.broadcast(kept) if few else kept, id_col, "left_semi")
