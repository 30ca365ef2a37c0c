"""Incremental ingest and running hourly volume."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidlens import schema
from bidlens.session import materialize
from bidlens.sources import commits, rawlogs, tables


def stream_lines(spark: SparkSession, folder: str, log_type: str) -> DataFrame:
    """New raw files of one log type below ``folder`` as a stream of lines.

    Files whose path names no known season or no day are left out, as by the batch load.
    """
    lines = (spark.readStream.format("text").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"{log_type}.*.txt*").load(folder)
             .select("value", F.col("_metadata.file_path").alias("_path")))
    parts = rawlogs._path_parts(F.col("_path"))
    known = lines.where(parts["season"].isNotNull() & (parts["log_type"] == log_type))
    return known.select(F.col("value").alias("line"), parts["season"].alias("season"), parts["date"].alias("date"))


def ingest_available(spark: SparkSession, folder: str, log_type: str, root: str,
                     checkpoint: str) -> StreamingQuery:
    """Loads the files that came since the last run, each exactly once, and stops.

    Every micro-batch is stored as a version named by its number and the checkpoint,
    then committed to the ledger, where it adds to its days.  A batch that is run
    again after a failure writes the same version and is committed once.
    """
    table, ledger = schema.TABLE_OF_LOG_TYPE[log_type], tables.ledger_path(root)
    stream = hashlib.md5(f"{checkpoint}/{table}".encode()).hexdigest()

    def store(batch: DataFrame, number: int) -> None:
        session, version = batch.sparkSession, f"s{stream}-{number}"
        if commits.all_commits(session, ledger).where(F.col("version") == version).isEmpty():
            stored = commits.write_version(rawlogs.parse_lines(batch, log_type), root, table, version)
            days = materialize(tables.ledger_rows(batch, stored, table), "streamed-days")
            tables.require_equal_counts(days)
            if not days.isEmpty():
                commits.commit(session, ledger, days, version, adds=True)

    return (stream_lines(spark, folder, log_type).writeStream.foreachBatch(store)
            .option("checkpointLocation", f"{checkpoint}/{table}").trigger(availableNow=True).start())


def hourly_volume(stream: DataFrame, timestamp: str = "timestamp", late: str = "2 hours") -> DataFrame:
    """Rows and spend per hour.  In append and update mode rows later than ``late`` may be left out; complete mode counts all."""
    timed = stream.withColumn("_t", F.col(timestamp).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", "1 hour")).agg(
        F.count("*").alias("n"), F.sum("payprice").alias("spend")).select(
        F.col("window.start").alias("hour_start"), "n", "spend")


def run_to_table(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Drives a streaming aggregate over everything available into a stored table.

    Complete mode keeps one row per hour, so the state grows with the calendar only.
    """
    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run = (counts.writeStream.outputMode("complete").foreachBatch(store)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    run.awaitTermination()
