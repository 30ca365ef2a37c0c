"""Typed, hive-partitioned tables and the ledger of what was loaded."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens import schema
from bidlens.sources import commits
from bidlens.sources.commits import DAY_KEYS

LEDGER_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("date", T.DateType()),
    T.StructField("rows_in", T.LongType()),
    T.StructField("rows_out", T.LongType()),
    T.StructField("loaded_at", T.TimestampType()),
])


def output_root(base: str, sample: bool = False) -> str:
    """Samples live under a root of their own and can never replace full tables."""
    return f"{base.rstrip('/')}/{'sample' if sample else 'processed'}"


def ledger_path(root: str) -> str:
    return f"{root}/ledger"


def write_table(df: DataFrame, root: str, table: str, overwrite: bool = True,
                rebalance: bool = False) -> None:
    """Snappy Parquet under ``root/table/season=/date=``, for tables outside the ledger.

    Only the partitions present in ``df`` are replaced.  Raw files hold one day
    each, so a task writes one day and nothing is shuffled.  For input whose days
    are scattered over many tasks ``rebalance`` first gathers each day into
    well-sized files and splits a day that holds far more rows than the others.
    """
    rows = df.hint("rebalance", *schema.PARTITION_COLUMNS) if rebalance else df
    (rows.write.mode("overwrite" if overwrite else "append")
     .option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
     .partitionBy(*schema.PARTITION_COLUMNS).parquet(f"{root}/{table}"))


def file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def table_exists(spark: SparkSession, root: str, table: str) -> bool:
    """True when a day is committed, or a Parquet file is there without a ledger; an empty folder is not a table."""
    if commits.committed_paths(spark, root, table, ledger_path(root)):
        return True
    fs, path = file_system(spark, f"{root}/{table}")
    if not fs.exists(path):
        return False
    files = fs.listFiles(path, True)
    while files.hasNext():
        found = files.next().getPath().toString()
        if found.endswith(".parquet") and f"/{table}/load=" not in found:
            return True
    return False


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, jpath = file_system(spark, path)
    return fs.getContentSummary(jpath).getLength() if fs.exists(jpath) else 0


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A lazy scan with its partition columns; Catalyst prunes days and columns.

    Of a table in the ledger only the committed versions of its days are read.
    """
    days = commits.committed_paths(spark, root, table, ledger_path(root))
    if days:
        return spark.read.option("basePath", f"{root}/{table}").parquet(*days).drop("load")
    if not table_exists(spark, root, table):
        raise FileNotFoundError(f"no table {table!r} under {root}: run the ingest job first")
    return spark.read.parquet(f"{root}/{table}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per loaded day, from the commits that make it up; a day that was loaded again has its last load's."""
    now = commits.current_versions(spark, path)
    return now.groupBy(*DAY_KEYS).agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"),
                                      F.max("loaded_at").alias("loaded_at"))


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose (table, season, day) the ledger does not list yet."""
    return files.join(ledger.select(*DAY_KEYS).distinct(), DAY_KEYS, "left_anti")


def count_by_day(df: DataFrame, table: str, name: str) -> DataFrame:
    return (df.groupBy("season", "date").agg(F.count("*").alias(name))
            .select(F.lit(table).alias("table_name"), "season", "date", name))


def ledger_rows(source: DataFrame, stored: DataFrame, table: str) -> DataFrame:
    """Rows in and rows out per day; a day missing on one side counts as zero there."""
    joined = count_by_day(source, table, "rows_in").join(
        count_by_day(stored, table, "rows_out"), DAY_KEYS, "full")
    return joined.select(*DAY_KEYS, F.coalesce("rows_in", F.lit(0)).alias("rows_in"),
                         F.coalesce("rows_out", F.lit(0)).alias("rows_out"))


def require_equal_counts(ledger: DataFrame) -> None:
    """The row-count tripwire: no load may lose or invent rows."""
    broken = ledger.where("rows_in <> rows_out").limit(5).collect()
    if broken:
        raise AssertionError(f"rows lost or added during load: {broken}")


def write_manifest(spark: SparkSession, path: str) -> None:
    text = json.dumps(schema.schema_manifest())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
