"""Descriptive aggregates over the log tables.

All of them are hash aggregates with map-side partial sums, so a key that holds
a large share of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens import schema
from bidlens.functions.cleaning import hash_bucket
from bidlens.functions.probability import safe_ratio

ABOVE_BID = "payprice > bidprice"
ZERO_PRICE = "payprice = 0"


def rate_by(df: DataFrame, by: Sequence[str], label: str = "click", min_rows: int = 0) -> DataFrame:
    """Rows, positives and rate per group; groups of ``min_rows`` rows or fewer may be left out."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("n_positive"),
                              F.avg(label).alias("rate"))
    return out.where(F.col("n") > min_rows) if min_rows else out


def rate_by_fields(df: DataFrame, fields: Sequence[str], label: str = "click") -> DataFrame:
    """The same for several fields at once, each on its own, from one scan."""
    values = df.select(F.col(label), F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        for f in fields])).alias("f"))
    return rate_by(values.select(label, "f.*"), ["field", "value"], label)


def by_hour(df: DataFrame, label: str = "click", timestamp: str = "timestamp") -> DataFrame:
    return rate_by(df.withColumn("hour", F.hour(timestamp)), ["hour"], label)


def by_weekday(df: DataFrame, label: str = "click", timestamp: str = "timestamp") -> DataFrame:
    """Weekday 1 is Sunday."""
    return rate_by(df.withColumn("weekday", F.dayofweek(timestamp)), ["weekday"], label)


def peak_to_trough(hourly: DataFrame) -> DataFrame:
    """Busiest and quietest hour, the earlier one of equals; only 24 rows come in."""
    return hourly.agg(
        F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"), F.max("n").alias("peak_n"),
        F.min_by("hour", F.struct("n", "hour")).alias("trough_hour"), F.min("n").alias("trough_n"),
        (F.max("n") / F.min("n")).alias("peak_to_trough"))


def minute_burst(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Each minute of an hour with its share of that hour's rows."""
    minutes = df.groupBy(F.hour(timestamp).alias("hour"), F.minute(timestamp).alias("minute")).agg(
        F.count("*").alias("n"))
    hour_total = F.sum("n").over(Window.partitionBy("hour"))
    return minutes.withColumn("share_of_hour", F.col("n") / hour_total)


def largest_cells(df: DataFrame, by: Sequence[str | Column], k: int) -> DataFrame:
    """The ``k`` most frequent combinations, ties in key order."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"))
    keys = [c for c in counted.columns if c != "n"]
    return counted.orderBy(F.desc("n"), *keys).limit(k)


def anomaly_crosstab(df: DataFrame, by: Sequence[str] = ("advertiser", "season", "adexchange"),
                     rule: str = ABOVE_BID) -> DataFrame:
    """Share of rows breaking ``rule`` per key, per pair of keys and overall.

    ``level`` numbers the grouping (a bit is set where the key is summed over), so
    a NULL key and a total stay apart.
    """
    out = df.cube(*by).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"),
                           F.count_if(F.expr(rule)).alias("n_anomalous"))
    return out.withColumn("share", F.col("n_anomalous") / F.col("n"))


def overage_size(df: DataFrame) -> DataFrame:
    """How far prices exceed the bid: difference and ratio, from counts per price pair."""
    pairs = df.where(ABOVE_BID).groupBy("payprice", "bidprice").agg(F.count("*").alias("_n"))
    diff = F.col("payprice") - F.col("bidprice")
    ratio = F.col("payprice") / F.col("bidprice")
    n = F.col("_n")
    rows = pairs.select(n, diff.alias("d"), ratio.alias("r"))
    return rows.agg(
        F.sum("_n").alias("n"),
        F.min("d").alias("diff_min"), F.percentile("d", 0.5, n).alias("diff_median"),
        (F.sum(F.col("d") * n) / F.sum(n)).alias("diff_mean"), F.max("d").alias("diff_max"),
        F.min("r").alias("ratio_min"), F.percentile("r", 0.5, n).alias("ratio_median"),
        (F.sum(F.col("r") * n) / F.sum(n)).alias("ratio_mean"), F.max("r").alias("ratio_max"))


def overage_histogram(df: DataFrame, k: int | None = None) -> DataFrame:
    diff = (F.col("payprice") - F.col("bidprice")).alias("overage")
    rows = df.where(ABOVE_BID).select(diff)
    if k is not None:
        return largest_cells(rows, ["overage"], k)
    return rows.groupBy("overage").agg(F.count("*").alias("n"))


def anomaly_by_tier(df: DataFrame) -> DataFrame:
    return shares(df, ABOVE_BID, ["advertiser", "bidprice"])


def shares(df: DataFrame, rule: str, by: Sequence[str | Column]) -> DataFrame:
    """Rows, hits and the rate within the group."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.expr(rule)).alias("n_hit"))
    return out.withColumn("rate", F.col("n_hit") / F.col("n"))


def concentration(df: DataFrame, rule: str, by: Sequence[str | Column]) -> DataFrame:
    """Where the rows of ``rule`` sit: rate within each group, share of all hits, share of all rows."""
    out = shares(df, rule, by)
    total = out.agg(F.sum("n_hit").alias("hits"), F.sum("n").alias("rows"))
    hits, rows = total.select("hits").scalar(), total.select("rows").scalar()
    return out.withColumns({
        "share_of_hits": safe_ratio(F.col("n_hit"), hits),
        "share_of_rows": safe_ratio(F.col("n"), rows)})


def concentration_by_keys(df: DataFrame, rule: str, keys: Mapping[str, Column]) -> DataFrame:
    """``concentration`` for several keys in one scan; rows are summed per (by, value) before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(name).alias("by"), value.cast("string").alias("value")) for name, value in keys.items()])
    hit = F.coalesce(F.expr(rule), F.lit(False)).cast("int").alias("_hit")
    out = df.select(hit, F.explode(pairs).alias("k")).groupBy("k.by", "k.value").agg(
        F.count("*").alias("n"), F.sum("_hit").alias("n_hit"))
    # Every row has each key, so the sums of one key are those of the table.
    whole = out.where(F.col("by") == next(iter(keys)))
    hits, rows = whole.agg(F.sum("n_hit")).scalar(), whole.agg(F.sum("n")).scalar()
    return out.select("by", "value", "n", "n_hit", (F.col("n_hit") / F.col("n")).alias("rate"),
                      safe_ratio(F.col("n_hit"), hits).alias("share_of_hits"), safe_ratio(F.col("n"), rows).alias("share_of_rows"))


def floor_test(df: DataFrame, population: Column, rule: str = ZERO_PRICE) -> DataFrame:
    """Of the rows of ``rule``: how many had a positive floor, per population."""
    return df.where(rule).groupBy(population.alias("population")).agg(
        F.count("*").alias("n"), F.count_if(F.col("slotprice") > 0).alias("floor_breached"),
        F.count_if(F.col("slotprice") == 0).alias("no_floor"),
        F.avg((F.col("slotprice") > 0).cast("int")).alias("breach_share"))


def population_compare(df: DataFrame, population: Column, value_shares: dict[str, tuple[str, object]],
                       distinct: Sequence[str] = (), nulls: Sequence[str] = ()) -> DataFrame:
    """Two or more populations side by side: share of a value, different values, NULL rate.

    Shares and NULL rates count over all rows of a population.
    """
    parts = [F.count("*").alias("n")]
    for name, (column, value) in value_shares.items():
        hit = F.coalesce(F.col(column) == F.lit(value), F.lit(False))
        parts.append(F.avg(hit.cast("int")).alias(name))
    parts += [F.count_distinct(c).alias(f"{c}_distinct") for c in distinct]
    parts += [F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null_rate") for c in nulls]
    return df.groupBy(population.alias("population")).agg(*parts)


def duplicate_ids(df: DataFrame, key: str = "bidid") -> DataFrame:
    """Rows, different ids, excess rows, ids that repeat and the worst repeat."""
    per_id = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_id.agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_distinct"),
        (F.sum("_n") - F.count("*")).alias("excess"),
        F.count_if(F.col("_n") > 1).alias("n_repeated"), F.max("_n").alias("worst"))


def repeat_consistency(df: DataFrame, key: str = "bidid",
                       fields: Sequence[str] = ("payprice", "bidprice", "advertiser", "slotid", "creative"),
                       timestamp: str = "timestamp") -> DataFrame:
    """Among repeated ids: how many keep each field constant, and have different times."""
    per_id = df.groupBy(key).agg(
        F.count("*").alias("_n"),
        *[(F.min(f).eqNullSafe(F.max(f)) & (F.count(f).isin(0) | (F.count(f) == F.count("*"))))
          .alias(f"_{f}") for f in fields],
        (F.min(timestamp) < F.max(timestamp)).alias("_spread")).where("_n > 1")
    return per_id.agg(F.count("*").alias("n_repeated"),
                      *[F.count_if(F.col(f"_{f}")).alias(f"same_{f}") for f in fields],
                      F.count_if("_spread").alias("different_times"))


def hash_collisions(df: DataFrame, fields: Sequence[str], buckets: int = schema.HASH_BUCKETS,
                    bucket=hash_bucket) -> DataFrame:
    """Different values before and after hashing, and the occupancy a fair hash would show.

    Works on the different values of each field (one aggregate for all fields).
    """
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        for f in fields])).alias("v")).select("v.*").where("value is not null")
    distinct = values.distinct().withColumn("bucket", bucket(F.col("value"), buckets))
    per_bucket = distinct.groupBy("field", "bucket").agg(F.count("*").alias("_n"))
    out = per_bucket.groupBy("field").agg(F.sum("_n").alias("n_values"), F.count("*").alias("n_buckets"))
    expected = F.lit(float(buckets)) * (F.lit(1.0) - F.exp(-F.col("n_values") / F.lit(float(buckets))))
    return out.withColumns({"collision_rate": F.lit(1.0) - F.col("n_buckets") / F.col("n_values"),
                            "expected_buckets": expected})


def price_shape(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mode, median, mean, 95th percentile and zero share, from counts per price.

    Prices are whole numbers in a narrow range, so the counts stay small.
    """
    per_price = (df.where(F.col("payprice").isNotNull()).groupBy(*by, "payprice")
                 .agg(F.count("*").alias("_n")))
    n, price = F.col("_n"), F.col("payprice")
    return per_price.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.max_by("payprice", F.struct(n, -price)).alias("mode"),
        F.percentile("payprice", 0.5, n).alias("median"),
        (F.sum(price * n) / F.sum(n)).alias("mean"),
        F.percentile("payprice", 0.95, n).alias("p95"),
        (F.coalesce(F.sum(F.when(price == 0, n)), F.lit(0)) / F.sum(n)).alias("zero_share"))


def win_rate(impressions: DataFrame, bids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Impressions over bids, per group; a group without wins has rate 0."""
    sides = (bids.select(*by, F.lit(0).alias("_won"))
             .unionByName(impressions.select(*by, F.lit(1).alias("_won"))))
    out = sides.groupBy(*by).agg(F.count_if(F.col("_won") == 0).alias("n_bids"),
                                 F.count_if(F.col("_won") == 1).alias("n_impressions"))
    return out.withColumn("win_rate", safe_ratio(F.col("n_impressions"), F.col("n_bids")))


def tag_stats(df: DataFrame, tags: str = "usertag") -> DataFrame:
    per_row = df.agg(
        F.count("*").alias("n"), F.avg(F.size(tags)).alias("mean_tags"),
        F.avg(F.col(tags).isNull().cast("int")).alias("share_without"))
    distinct = df.select(F.explode(tags).alias("tag")).agg(F.count_distinct("tag").alias("n"))
    return per_row.withColumn("n_distinct_tags", distinct.scalar())


def campaign_profile(df: DataFrame, label: str = "click", by: str = "advertiser") -> DataFrame:
    """Days active, users behind the clicks, share without exchange, click rate and its rank gap."""
    clicker = F.when(F.col(label) == 1, F.col("userid"))
    out = df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("active_days"),
        F.sum(label).alias("n_clicks"), F.count_distinct(clicker).alias("n_clicking_users"),
        F.avg(F.col("adexchange").isNull().cast("int")).alias("share_no_exchange"),
        F.avg(label).alias("rate"))
    # One row per campaign reaches this window.
    next_lower = F.lead("rate").over(Window.orderBy(F.desc("rate"), by))
    return out.withColumn("times_next", safe_ratio(F.col("rate"), next_lower))


def class_balance(df: DataFrame, label: str = "click", by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("n_positive"),
                              F.avg(label).alias("positive_rate"))
    return out.withColumns({
        "one_in": safe_ratio(F.col("n"), F.col("n_positive")),
        "majority_accuracy": F.greatest(F.col("positive_rate"), F.lit(1.0) - F.col("positive_rate"))})
