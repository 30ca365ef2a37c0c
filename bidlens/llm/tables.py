"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(df: DataFrame, *derived: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``doc``, next to derived columns.

    Inside an operator only ``doc`` and the operator's own names exist, so input
    columns may have any name.  Parquet keeps the fields apart, so a later read
    of some of them stays pruned.
    """
    return df.select(whole_row(df.columns).alias("doc"), *derived)


def whole_row(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(quoted(c)).alias(c) for c in columns])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("doc.*")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_last(column: Column, *ties: Column) -> Column:
    """A struct that sorts NULL after every value, then by ``ties``; for ``min``."""
    return F.struct(column.isNull().alias("missing"), column.alias("value"),
                    *[t.alias(f"tie{i}") for i, t in enumerate(ties)])


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a stored table of this library that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
