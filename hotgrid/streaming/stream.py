"""The trailing re-read of late rows as Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions import hexgrid
from hotgrid.operators.silver import new_rows
from hotgrid.sources.layers import files as data_files


def incidents(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Files are picked up once each, as they come; the checkpoint remembers which."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path)


def deliver(rows: DataFrame, path: str, files: int) -> None:
    """Add a delivery of exactly ``files`` files to ``path``, written by as many tasks, so that a stream of as many files a batch takes it as one batch."""
    seen = len(data_files(rows.sparkSession, path))
    rows.repartition(files).write.mode("append").parquet(path)
    nothing = rows.sparkSession.createDataFrame([], rows.schema).coalesce(1)
    for _ in range(files - (len(data_files(rows.sparkSession, path)) - seen)):  # tasks without rows write no file
        nothing.write.mode("append").parquet(path)


def deduplicated(stream: DataFrame, ts: str = "incident_ts", key: str = "unique_key", late: str = "26 days") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, ts: str = "incident_ts", late: str = "26 days", cfg: Config = Config()) -> DataFrame:
    """Incidents per cell and day; a day is final when the watermark has passed it."""
    cells = hexgrid.with_cell(stream.withWatermark(ts, late), cfg=cfg)
    return cells.groupBy(F.window(ts, "1 day").alias("w"), "cell").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("date"), "cell", "n")


def upsert(path: str, key: str = "unique_key", by: str = "day"):
    """For ``foreachBatch``: add the rows whose key is not in the target's same days yet.

    Of a key that repeats in a batch the least row is taken. A key keeps its day (or month, as ``by`` says) when it is delivered again, so only the batch's days of the
    target are read: days are few, and their filter prunes the target's partitions.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        fresh = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("least")).select(key, "least.*").select(*batch.columns)
        try:
            target = spark.read.parquet(path)
        except AnalysisException as e:  # only an absent target passes all rows through
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            fresh = new_rows(fresh, target.join(F.broadcast(batch.select(by).distinct()), by, "left_semi"), key)
        fresh.repartition(by).write.mode("append").partitionBy(by).parquet(path)

    return write


def run_each(stream: DataFrame, write, checkpoint: str) -> None:
    """Process what is there, batch by batch, and stop."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(counts: DataFrame, path: str) -> DataFrame:
    """Process what is there and stop; the aggregate's last state as a table under ``path``."""

    def keep(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.read.parquet(f"{path}/result")


def run_append(counts: DataFrame, path: str) -> tuple[DataFrame, list[dict]]:
    """Process what is there and stop; each group is written once, when the watermark has passed it, and leaves the state.

    The groups of ``counts`` that are final, as a table under ``path``, and for each batch (batch, rows, watermark,
    state_rows, late_rows) of its progress: late_rows are the groups of rows that came after their window was final. A later
    run goes on where this one stopped; windows that the watermark has not passed stay in the state.
    """
    spark = counts.sparkSession
    query = counts.writeStream.format("parquet").outputMode("append").option("path", f"{path}/result").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    told = [
        {"batch": p["batchId"], "rows": p["numInputRows"], "watermark": p["eventTime"].get("watermark"), "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"]), "late_rows": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])}
        for p in query.recentProgress
    ]
    return spark.read.schema(counts.schema).parquet(f"{path}/result"), told
