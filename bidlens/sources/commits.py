"""The commit log of a set of tables: which stored version of each day readers see.

A load writes its rows below ``table/load=<version>/season=/date=`` first.  Nobody
reads them until one new file in the ledger folder names them; that file appears
by a single rename which never replaces another one, so all days of a load, of all
its tables, become visible together or not at all.  A load that dies before leaves
every old day as it was, and its unnamed files are never read.

A row of the ledger either replaces its day or adds a version to it; the newest
replacing commit of a day and all later additions are its current versions.
What passes through the driver is one row per loaded day, never data.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from bidlens import schema

DAY_KEYS = ["table_name", "season", "date"]
COMMIT_FIELDS = ("table_name string, season int, date date, rows_in long, rows_out long, loaded_at timestamp, "
                 "version string, adds boolean")
FILE_NAME = r"commit-(\d+)\.json$"


def new_version() -> str:
    return f"v{uuid.uuid4().hex}"


def version_path(root: str, table: str, version: str) -> str:
    return f"{root}/{table}/load={version}"


def write_version(df: DataFrame, root: str, table: str, version: str) -> DataFrame:
    """Stores a load's rows where no reader looks yet, and returns them as stored."""
    path = version_path(root, table, version)
    (df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "snappy")
     .partitionBy(*schema.PARTITION_COLUMNS).parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def all_commits(spark: SparkSession, ledger: str) -> DataFrame:
    """Every ledger row with the number of its commit; no rows without a ledger."""
    try:
        rows = spark.read.schema(COMMIT_FIELDS).json(ledger)
    except AnalysisException:
        return spark.createDataFrame([], f"{COMMIT_FIELDS}, number long")
    name = F.regexp_extract(F.col("_metadata.file_name"), FILE_NAME, 1)
    return rows.withColumn("number", F.nullif(name, F.lit("")).cast("long"))


def current_versions(spark: SparkSession, ledger: str) -> DataFrame:
    """The versions that make up every day now."""
    since = F.max(F.when(~F.col("adds"), F.col("number"))).over(Window.partitionBy(*DAY_KEYS))
    rows = all_commits(spark, ledger).withColumn("_since", since)
    return rows.where(F.col("_since").isNull() | (F.col("number") >= F.col("_since"))).drop("_since")


def commit(spark: SparkSession, ledger: str, days: DataFrame, version: str, adds: bool = False) -> int:
    """Publishes ``days`` (table, season, date, rows in and out) of one version; returns the commit's number.

    Two loads that commit at once get different numbers: the later rename finds the
    name taken and goes on with the next one.
    """
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    lines = [json.dumps({**row.asDict(), "date": str(row["date"]), "loaded_at": now, "version": version, "adds": adds})
             for row in days.select(*DAY_KEYS, "rows_in", "rows_out").collect()]
    number = all_commits(spark, ledger).agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0] + 1
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    written = path(f"{ledger}/_{version}-{uuid.uuid4().hex}")
    out = written.getFileSystem(spark._jsc.hadoopConfiguration()).create(written)
    out.write(bytearray("".join(line + "\n" for line in lines).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        written.toUri(), spark._jsc.hadoopConfiguration())
    never_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        try:
            files.rename(written, path(f"{ledger}/commit-{number:012d}.json"), never_replace)
            return number
        except Exception as taken:  # the driver's bridge has one error class for all Java exceptions
            if "FileAlreadyExistsException" not in str(taken):
                raise
            number += 1


def committed_paths(spark: SparkSession, root: str, table: str, ledger: str) -> list[str]:
    """The folders of a table's current days; one per day and version."""
    rows = current_versions(spark, ledger).where(F.col("table_name") == table).select("version", "season", "date").distinct()
    return sorted(f"{version_path(root, table, r.version)}/season={r.season}/date={r.date}" for r in rows.collect())
