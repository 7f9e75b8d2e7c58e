"""Layers of the engine that a session writes once and reads from then on."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Hashable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, ...], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; set here only for a local session without one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hotgrid-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    """A path of Hadoop's and its file system, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of all data files below ``path``, in order; none if it is not there."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it does not repeat its lineage, nor after a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/hotgrid-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`written` made and that no frame still in use reads."""
    delete(df.sparkSession, df._written_to)


def layer(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The layer ``name`` of the tables at ``source``: made by the first who asks in this application.

    It is made again if its folder is gone, and if the files of the source are others than they were: added, removed, or of
    another size or time.
    """
    state = hashlib.sha256(repr(files(spark, source)).encode()).hexdigest()
    key = (spark.sparkContext.applicationId, source, name, state)
    if key in _written:
        try:
            return _read(spark, _written[key])
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    path = f"{shared_dir(spark)}/hotgrid-{name}-{uuid.uuid4().hex[:12]}"
    make().write.parquet(path)
    _written[key] = path
    return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.parquet(path)
    out._written_to = path
    return out


def folder(df: DataFrame) -> str:
    """Where the files of a table are that :func:`written` or :func:`layer` made."""
    return df._written_to


def together[K: Hashable, T](spark: SparkSession, calls: dict[K, Callable[[], T]]) -> dict[K, T]:
    """The results of independent calls, each of which runs many small jobs: their jobs share the cluster instead of waiting for each other."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        started = {k: pool.submit(inheritable_thread_target(spark)(f)) for k, f in calls.items()}
        return {k: f.result() for k, f in started.items()}
