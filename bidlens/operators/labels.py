"""Labels and log-to-log agreement by ``bidid``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_label(rows: DataFrame, positives: DataFrame, label: str = "click",
               key: str = "bidid") -> DataFrame:
    """0/1 label from an id list.

    Only the key crosses over, so nothing recorded after the auction can leak,
    and ids are made distinct first, so no row multiplies.  Each row finds at
    most one partner; a hot id's rows can therefore be split over several tasks
    by the skew-join rule without changing the result.
    """
    ids = positives.select(key).distinct().withColumn("_hit", F.lit(1))
    return (rows.join(ids, key, "left")
            .withColumn(label, F.coalesce("_hit", F.lit(0))).drop("_hit"))


def label_counts(rows: DataFrame, positives: DataFrame, key: str = "bidid") -> DataFrame:
    """Second, independent count of labelled rows, by way of a semi join."""
    total = rows.agg(F.count("*").alias("n_rows"))
    hits = rows.join(positives.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_positive"))
    return total.select("n_rows", hits.scalar().alias("n_positive"))


def in_split(date: Column, boundaries: dict[str, tuple[str, str]]) -> Column:
    """Name of the split whose inclusive range holds ``date``, else NULL."""
    name = F.lit(None).cast("string")
    for split, (start, end) in boundaries.items():
        inside = date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        name = F.when(inside, F.lit(split)).otherwise(name)
    return name


def _folded(df: DataFrame, key: str, columns: list[str], count: str, suffix: str) -> DataFrame:
    """Copies folded to a count before any join, so equal rows never pair up."""
    return df.groupBy(key, *columns).agg(F.count("*").alias(count)).select(
        key, count, *[F.col(c).alias(f"{c}{suffix}") for c in columns])


def price_agreement(impressions: DataFrame, clicks: DataFrame, key: str = "bidid") -> DataFrame:
    """Do impression and click log agree on the prices of the same ``bidid``?

    Counts are those of the inner join of the two logs; both sides are first
    folded to (key, prices, count), so the join is over different prices only.
    """
    prices = ["bidprice", "payprice"]
    left = _folded(impressions, key, prices, "_l", "_imp")
    right = _folded(clicks, key, prices, "_r", "_clk")
    pairs = left.join(right, key).withColumn("_n", F.col("_l") * F.col("_r"))

    def total(condition: Column | None = None) -> Column:
        n = F.col("_n") if condition is None else F.when(condition, F.col("_n"))
        return F.coalesce(F.sum(n), F.lit(0))

    return pairs.agg(
        total().alias("joined_rows"),
        total(F.col("bidprice_imp") != F.col("bidprice_clk")).alias("bidprice_differs"),
        total(F.col("payprice_imp") != F.col("payprice_clk")).alias("payprice_differs"),
        total((F.col("payprice_imp") != F.col("payprice_clk")) & (F.col("payprice_clk") == 0))
        .alias("click_price_zero"),
        F.count_distinct(key).alias("shared_ids"))


def bid_log_match(impressions: DataFrame, bids: DataFrame, key: str = "bidid",
                  field: str = "slotprice", by: tuple[str, ...] = ()) -> DataFrame:
    """How many impressions have a bid-log row, and does ``field`` agree there."""
    by = list(by)
    # Equal (key, field) pairs are folded before the joins, so none is hot.
    left = impressions.groupBy(*by, key, field).agg(F.count("*").alias("_l"))
    pairs = bids.select(key, field).distinct()
    ids = pairs.select(key).distinct().withColumn("_id", F.lit(1))
    flagged = left.join(ids, key, "left").join(pairs.withColumn("_pair", F.lit(1)), [key, field], "left")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_l"))), F.lit(0))

    matched = F.col("_id").isNotNull()
    return flagged.groupBy(*by).agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("n"),
        rows(matched).alias("matched"),
        rows(matched & F.col("_pair").isNotNull()).alias("agrees"),
        rows(~matched).alias("unmatched"))


def rows_with_partner(rows: DataFrame, others: DataFrame, key: str = "bidid") -> DataFrame:
    """Rows whose key occurs in another log (a semi join, so none multiplies)."""
    return rows.join(others.select(key).distinct(), key, "left_semi")
