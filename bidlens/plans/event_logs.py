"""The four log tables derived from the ``events`` table, in full layout.

This stands in for real auction logs: every column of the layout is computed
from an event, row by row, so the tables grow with ``events``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens import schema

KEEP = ["season", "date", "event_id", "event_type"]


def bids_with_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with all fields of the 24-column layout as typed values."""
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    user = F.col("user_id")
    tag_text = F.when(k % 5 != 0, F.concat_ws(
        ",", k.cast("string"), (k % 7).cast("string"), (k % 3).cast("string")))

    def text(number):
        return number.cast("string")

    return events.select(
        text(F.expr("event_id div 2")).alias("bidid"),
        F.col("ts").alias("timestamp"),
        F.lit(2).alias("season"),
        F.to_date("ts").alias("date"),
        text(user).alias("userid"),
        F.concat(F.lit("agent "), text(user % 50)).alias("useragent"),
        F.concat(F.lit("10.0."), text(user % 250), F.lit(".*")).alias("IP"),
        text(user % 7).alias("region"),
        text(user % 31).alias("city"),
        text(F.nullif(user % 4, F.lit(3))).alias("adexchange"),
        text(F.nullif(k % 11, F.lit(0))).alias("domain"),
        F.concat(F.lit("u"), text((user + k) % 97)).alias("url"),
        F.lit(None).cast("string").alias("urlid"),
        F.concat(F.lit("s"), text(k % 20)).alias("slotid"),
        (100 + 50 * (k % 4)).alias("slotwidth"),
        (30 * (k % 10)).alias("slotheight"),
        text(k % 5).alias("slotvisibility"),
        text(k % 3).alias("slotformat"),
        (k % 20).alias("slotprice"),
        F.concat(F.lit("c"), text(user % 13)).alias("creative"),
        (100 + 20 * (user % 5)).cast("int").alias("bidprice"),
        F.floor("value").cast("int").alias("payprice"),
        F.lit(None).cast("string").alias("keypage"),
        text(user % 5).alias("advertiser"),
        tag_text.alias("usertag_text"),
        F.transform(F.split(tag_text, ","), lambda t: t.cast("int")).alias("usertag"),
        "event_id", "event_type",
    )


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids_with_prices(spark, sf_dir)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).where("event_type <> 'error'").withColumn("logtype", F.lit("1"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click event; two events share a ``bidid``, so click ids repeat."""
    return bids(spark, sf_dir).where("event_type = 'click'").withColumn("logtype", F.lit("2"))


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).where("event_type = 'purchase'").withColumn("logtype", F.lit("3"))


def predictions(rows: DataFrame, rate: float = 0.02) -> DataFrame:
    """Stand-in scores on labelled rows: raw, recalibrated and a step function."""
    from bidlens.functions.probability import recalibrate
    raw = (((F.col("event_id") * 7919 + 13) % 10007) + 0.5) / F.lit(10007.0)
    scored = rows.withColumn("p_raw", raw)
    scored = scored.withColumn("p_calibrated", recalibrate(F.col("p_raw"), rate))
    return scored.withColumn("p_step", F.floor(F.col("p_calibrated") * 1000) / F.lit(1000.0))


def raw_lines(table: DataFrame, log_type: str) -> DataFrame:
    """Raw tab-separated lines of a log table, with its null markers."""
    from bidlens.sources.rawlogs import render_lines
    plain = table.drop("usertag").withColumnRenamed("usertag_text", "usertag")
    return render_lines(plain, log_type, keep=KEEP)

