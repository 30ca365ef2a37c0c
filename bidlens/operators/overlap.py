"""Rows whose placement was, or was not, part of the training data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlens.functions import tokens
from bidlens.operators import metrics
from bidlens.operators.prefix import join_null_safe
from bidlens.session import materialize


def flag_seen(test: DataFrame, train: DataFrame, fields: Sequence[str] = tuple(tokens.PLACEMENT_FIELDS),
              flag: str = "seen") -> DataFrame:
    """Adds ``flag``: does the row's combination of ``fields`` occur in ``train``?

    Combinations are made distinct before the join, so each test row finds at
    most one partner.
    """
    key = tokens.composite_key(*fields)
    known = train.select(key.alias("_key")).distinct().withColumn("_known", F.lit(True))
    joined = test.withColumn("_key", key).join(known, "_key", "left")
    return joined.withColumn(flag, F.coalesce("_known", F.lit(False))).drop("_key", "_known")


def bucket_stats(flagged: DataFrame, score: str, flag: str = "seen", label: str = "y_true") -> DataFrame:
    """Per bucket: rows, positives, rate, area under the curve and share of all rows."""
    areas = metrics.auc(flagged, score, label, [flag])
    total = areas.agg(F.sum("n")).scalar()
    return areas.withColumns({"positive_rate": F.col("n_positive") / F.col("n"),
                              "share": F.col("n") / total})


def require_partition(stats: DataFrame, whole: DataFrame, label: str = "y_true") -> None:
    """The buckets must add up to the whole."""
    parts = stats.agg(F.sum("n").alias("n"), F.sum("n_positive").alias("p")).first()
    rows = whole.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    if tuple(parts) != tuple(rows):
        raise AssertionError(f"buckets hold {tuple(parts)}, the table {tuple(rows)}")


def seen_unseen(test: DataFrame, full_train: DataFrame, sampled_train: DataFrame, score: str,
                label: str = "y_true", fields: Sequence[str] = tuple(tokens.PLACEMENT_FIELDS)) -> DataFrame:
    """Both definitions of "seen" side by side, with standard errors."""
    flagged = materialize(flag_seen(flag_seen(test, full_train, fields, "seen_in_full_train"),
                                    sampled_train, fields, "seen_in_sampled_train"), "seen-flags")
    both = F.array(*[F.struct(F.lit(name).alias("definition"), F.when(F.col(f), "seen").otherwise("unseen").alias("bucket"))
                     for name, f in (("full train", "seen_in_full_train"), ("sampled train", "seen_in_sampled_train"))])
    long = flagged.select(score, label, F.explode(both).alias("d")).select(score, label, "d.definition", "d.bucket")
    areas = metrics.auc(long, score, label, ["definition", "bucket"])
    total = F.sum("n").over(Window.partitionBy("definition"))  # two rows per definition
    return metrics.auc_standard_error(areas.select(
        "definition", "bucket", "n", "n_positive", (F.col("n_positive") / F.col("n")).alias("positive_rate"),
        (F.col("n") / total).alias("share"), "auc", "undefined_reason"))


def same_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Do two tables hold the same keys equally often?  Counts of keys that differ."""
    left = a.groupBy(*keys).agg(F.count("*").alias("_a"))
    right = b.groupBy(*keys).agg(F.count("*").alias("_b")).withColumn("_right", F.lit(1))
    both = join_null_safe(left.withColumn("_left", F.lit(1)), right, keys, "full")
    return both.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("rows_b"),
                    F.count_if(F.col("_right").isNull()).alias("only_a"),
                    F.count_if(F.col("_left").isNull()).alias("only_b"),
                    F.count_if(F.col("_a") != F.col("_b")).alias("different_count"))
