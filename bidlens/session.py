"""Session settings and the one way this library cuts lineage.

Everything that has to be computed once and read several times is written as a
Parquet table below the shared checkpoint folder (``spark.checkpoint.dir``) and
read back.  Such a table survives lost executors, is column-pruned on re-read,
and reports its true size, so Spark's own size-checked broadcast rule can act
on it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "bidlens", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings this library is tested with."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the cluster names it.

    Only a local master may fall back to a temporary folder; on a cluster an
    unset ``spark.checkpoint.dir`` is an error, because a machine-local folder
    would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app] = tempfile.mkdtemp(prefix="spark-bidlens-")
    return _LOCAL_FOLDER[app]


def folder_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def new_table_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the stored table."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    schema = df.schema
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
