"""Isotonic calibration after recalibration, and the audits around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.functions import probability as prob
from bidlens.operators.prefix import BLOCK, place_in_blocks
from bidlens.session import materialize

TOLERANCE = 1e-9
MIN_REVERSE_DIFFERENCE = 1e-4
POOL_SCHEMA = "first double, last double, pos double, n double"


def _pool_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools neighbours whose rates do not rise, from points or pools in the order of their scores."""
    pools: list[tuple[float, float, float, float]] = []
    for batch in batches:
        for first, last, pos, n in zip(*(c.to_pylist() for c in batch.columns)):
            while pools and pools[-1][2] * n >= pos * pools[-1][3]:
                before = pools.pop()
                first, pos, n = before[0], before[2] + pos, before[3] + n
            pools.append((first, last, pos, n))
    if pools:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*pools)], names=["first", "last", "pos", "n"])


def _ends_fall(pools: DataFrame) -> bool:
    """Whether some block's first rate is not above the last one of the block before; one row per block is looked at."""
    rate = F.col("pos") / F.col("n")
    ends = pools.groupBy(BLOCK).agg(F.min_by(rate, "first").alias("low"), F.max_by(rate, "first").alias("high"))
    before = F.lag("high").over(Window.orderBy(BLOCK))
    return not ends.withColumn("before", before).where("before >= low").isEmpty()


def fit_isotonic(val: DataFrame, score: str, label: str = "y_true") -> DataFrame:
    """Monotone fit of the click rate on the score, on validation rows only: its knots (score, value), a stored table.

    Rows are folded to one point per different score; rows without one take no part.
    Points are range-partitioned and pooled block by block; the pools are points again
    and are pooled in half as many blocks until no block's first pool lies below the
    one before it.  Pooling neighbours gives the same result in any order.  Pools have
    different rates, so there are at most about (rows)**(2/3) of them.
    """
    points = val.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("first")).agg(
        F.sum(F.col(label).cast("double")).alias("pos"), F.count(label).cast("double").alias("n")).where("n > 0")
    pools = points.select("first", F.col("first").alias("last"), "pos", "n")
    blocks = int(val.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = pools.repartitionByRange(blocks, "first").sortWithinPartitions("first")
        pools = materialize(dealt.mapInArrow(_pool_block, POOL_SCHEMA).withColumn(BLOCK, F.spark_partition_id()), "isotonic-pools")
        if blocks == 1 or not _ends_fall(pools):
            break
        pools, blocks = pools.drop(BLOCK), blocks // 2
    value = F.col("pos") / F.col("n")
    ends = F.array_distinct(F.array("first", "last"))
    return materialize(pools.select(F.explode(ends).alias("score"), value.alias("value")), "isotonic-knots")


def apply_isotonic(df: DataFrame, knots: DataFrame, score: str, output: str = "p_isotonic") -> DataFrame:
    """Interpolates between knots and clips outside them; a missing score stays missing.

    Every different score meets the knots around it in range-partitioned blocks; one
    row per block tells what lies in the blocks before and after.
    """
    knot = F.struct(F.col("score").alias("x"), F.col("value").alias("y"))
    scores = df.select(F.col(score).cast("double").alias("_x")).where("_x IS NOT NULL").distinct()
    rows = knots.select(F.col("score").alias("_x"), knot.alias("_knot")).unionByName(
        scores.withColumn("_knot", F.lit(None).cast("struct<x:double,y:double>")))
    placed = place_in_blocks(rows, ["_x"], "isotonic-blocks")
    ends = placed.where("_knot IS NOT NULL").groupBy(BLOCK).agg(F.min("_knot").alias("low"), F.max("_knot").alias("high"))
    every = placed.select(BLOCK).distinct().join(ends, BLOCK, "left")
    across = Window.orderBy(BLOCK)
    around = materialize(every.select(
        BLOCK, F.last("high", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("low", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after")), "isotonic-ends")
    inside = Window.partitionBy(BLOCK).orderBy("_x")
    below = F.last("_knot", True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("_knot", True).over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = placed.join(around, BLOCK).select("_x", "_knot", F.coalesce(below, "_before").alias("a"), F.coalesce(above, "_after").alias("b"))
    share = (F.col("_x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    value = (F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (F.col("a.x") == F.col("b.x")), F.col("a.y"))
             .otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * share))
    fitted = materialize(near.where("_knot IS NULL").select("_x", value.alias("_y")), "isotonic-values")
    return df.join(fitted, F.col(score).cast("double") == F.col("_x"), "left").select(*df.columns, F.col("_y").alias(output))


def same_provenance(val_info: dict, test_info: dict, fields=("model", "sampling_rate")) -> None:
    """Both score tables must come from one model and one sampling rate."""
    for f in fields:
        if val_info.get(f) != test_info.get(f):
            raise ValueError(f"validation and test scores differ in {f}: "
                             f"{val_info.get(f)!r} and {test_info.get(f)!r}")


Calibrator = Callable[[DataFrame, str, str], DataFrame]


def correction_audit(predictions: DataFrame, calibrator: Calibrator, *, sampling_rate: float, fit_split: str,
                     final: str = "p_isotonic", expected_fit_split: str = "val",
                     tolerance: float = TOLERANCE,
                     min_reverse: float = MIN_REVERSE_DIFFERENCE) -> DataFrame:
    """Was the score recalibrated first and calibrated second?  One row of evidence.

    ``calibrator(df, column, output)`` adds the calibrated value of a column.
    """
    recomputed = predictions.withColumn("_recal", prob.recalibrate(F.col("p_raw"), sampling_rate))
    right = calibrator(recomputed, "_recal", "_right")
    wrong = calibrator(right, "p_raw", "_iso_first").withColumn(
        "_wrong", prob.recalibrate(F.col("_iso_first"), sampling_rate))

    def gap(a: str, b: str) -> Column:
        return F.max(F.abs(F.col(a) - F.col(b)))

    row = wrong.agg(gap("_recal", "p_calibrated").alias("recalibration_gap"),
                    gap("_right", final).alias("calibration_gap"),
                    gap("_wrong", final).alias("reverse_gap"))
    ok = ((F.col("recalibration_gap") <= tolerance) & (F.col("calibration_gap") <= tolerance)
          & (F.col("reverse_gap") > min_reverse) & F.lit(fit_split == expected_fit_split))
    return row.withColumns({"fit_split": F.lit(fit_split), "passed": F.coalesce(ok, F.lit(False))})


def require_correction_order(audit: DataFrame) -> None:
    row = audit.first()
    if not row["passed"]:
        raise AssertionError(f"correction order not verified: {row.asDict()}")
