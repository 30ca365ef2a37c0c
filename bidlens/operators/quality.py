"""Validation reports.  Nothing found here is repaired, only counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens import schema
from bidlens.session import materialize

PRICE_COLUMNS = ["slotprice", "bidprice", "payprice"]
APPROX_ACCURACY = 10_000
SKETCH_SIZE = 4_096
RANK_ERROR = 0.003  # of a quantile sketch of that size; twice what its authors state for 99 of 100 cases
REPORT_QUANTILES = {"p50": 0.5, "p95": 0.95}


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _long_form(one_row: DataFrame, names: Sequence[str], parts: Sequence[str], key: str) -> DataFrame:
    """One row of ``name__part`` columns to one row per name."""
    structs = [F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{p}").alias(p) for p in parts])
               for n in names]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, NULLs and NULL rate of every column, in one scan."""
    names = list(columns or df.columns)
    aggregates = []
    for n in names:
        aggregates += [F.count("*").alias(f"{n}__n_rows"),
                       F.count_if(F.col(n).isNull()).alias(f"{n}__n_null")]
    long = _long_form(df.agg(*aggregates), names, ["n_rows", "n_null"], "column_name")
    rate = F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows"))
    return long.withColumn("null_rate", rate)


def missingness(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """NULL rates of the bid-time features only."""
    return null_rates(df, schema.feature_columns(c for c in df.columns if c not in keys))


def price_profile(df: DataFrame, columns: Sequence[str] = tuple(PRICE_COLUMNS),
                  accuracy: int = APPROX_ACCURACY) -> DataFrame:
    """Range, approximate median and 95th percentile, mean and negatives, in one scan."""
    names = _present(df, columns)
    aggregates: list[Column] = []
    for n in names:
        quantiles = F.percentile_approx(n, [0.5, 0.95], accuracy)
        aggregates += [
            F.min(n).alias(f"{n}__min"), F.max(n).alias(f"{n}__max"),
            quantiles[0].alias(f"{n}__p50"), quantiles[1].alias(f"{n}__p95"),
            F.avg(n).alias(f"{n}__mean"), F.count_if(F.col(n) < 0).alias(f"{n}__n_negative")]
    return _long_form(df.agg(*aggregates), names,
                      ["min", "max", "p50", "p95", "mean", "n_negative"], "column_name")


ANOMALIES = {
    "payprice_greater_than_bidprice": "payprice > bidprice",
    "nonpositive_slot_dimensions": "slotwidth <= 0 or slotheight <= 0",
}


def anomaly_counts(df: DataFrame) -> DataFrame:
    """Rows breaking each rule that applies to this table's columns."""
    rules = {n: r for n, r in ANOMALIES.items()
             if "payprice" not in r or "payprice" in df.columns}
    counted = df.agg(*[F.count_if(F.expr(r)).alias(f"{n}__n_rows") for n, r in rules.items()])
    return _long_form(counted, list(rules), ["n_rows"], "anomaly")


def bidprice_spread(df: DataFrame, by: Sequence[str] = ("season", "advertiser")) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("bidprice").alias("n_distinct_bidprice"),
        F.min("bidprice").alias("min_bidprice"), F.max("bidprice").alias("max_bidprice"))


def bidprice_lookup(df: DataFrame, by: Sequence[str] = ("season", "advertiser", "adexchange")) -> DataFrame:
    """Is the bid price a function of these keys?  ``recoverable`` says so per key."""
    spread = bidprice_spread(df, by)
    return spread.withColumn("recoverable", F.col("n_distinct_bidprice") == 1)


def validation_parts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ("season", "advertiser")) -> DataFrame:
    """Everything a report needs of a table, per group, in one scan; stored.

    Counts, sums and quantile sketches merge, so figures of the table and of any
    coarser grouping come from these rows without reading the table again.
    """
    names, prices = list(columns or df.columns), _present(df, PRICE_COLUMNS)
    parts = [F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null__{c}") for c in names]]
    for p in prices:
        parts += [F.min(p).alias(f"min__{p}"), F.max(p).alias(f"max__{p}"), F.sum(F.col(p).cast("double")).alias(f"sum__{p}"),
                  F.count(p).alias(f"count__{p}"), F.count_if(F.col(p) < 0).alias(f"negative__{p}"),
                  F.kll_sketch_agg_bigint(F.col(p).cast("long"), F.lit(SKETCH_SIZE)).alias(f"sketch__{p}")]
    parts += [F.count_if(F.expr(rule)).alias(f"anomaly__{name}") for name, rule in _rules(df).items()]
    parts += [F.count_distinct("bidprice").alias("n_distinct_bidprice")]
    return materialize(df.groupBy(*by).agg(*parts), "validation-parts")


def _rules(df: DataFrame) -> dict[str, str]:
    return {n: r for n, r in ANOMALIES.items() if "payprice" not in r or "payprice" in df.columns}


def complete_report(name: str, parts: DataFrame, by: Sequence[str] = ("season", "advertiser")) -> DataFrame:
    """The whole report of a table in long form: table_name, check, subject, value.

    Checks are rows, nulls and null_rate per column, price_min, price_max, price_mean,
    price_negative, price_p50 and price_p95 (within RANK_ERROR) per price, anomaly per
    rule, and per group how many different bid prices it has.
    """
    kinds = [c.split("__", 1) for c in parts.columns if "__" in c]
    of_kind = lambda kind: [s for k, s in kinds if k == kind]
    total = F.sum("n_rows")
    rows: list[tuple[str, str, Column]] = [("rows", "", total)]
    for c in of_kind("null"):
        rows += [("nulls", c, F.sum(f"null__{c}")), ("null_rate", c, F.try_divide(F.sum(f"null__{c}"), total))]
    for p in of_kind("sketch"):
        rows += [("price_min", p, F.min(f"min__{p}")), ("price_max", p, F.max(f"max__{p}")),
                 ("price_mean", p, F.try_divide(F.sum(f"sum__{p}"), F.sum(f"count__{p}"))), ("price_negative", p, F.sum(f"negative__{p}"))]
        merged = F.kll_merge_agg_bigint(f"sketch__{p}")
        rows += [(f"price_{q}", p, F.when(F.sum(f"count__{p}") > 0, F.kll_sketch_get_quantile_bigint(merged, F.lit(at))))
                 for q, at in REPORT_QUANTILES.items()]
    rows += [("anomaly", a, F.sum(f"anomaly__{a}")) for a in of_kind("anomaly")]
    figures = parts.agg(*[v.cast("double").alias(f"v{i}") for i, (_, _, v) in enumerate(rows)])
    long = figures.select(F.explode(F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), F.col(f"v{i}").alias("value"))
        for i, (check, subject, _) in enumerate(rows)])).alias("r")).select("r.*")
    spread = parts.select(F.lit("distinct_bidprices").alias("check"), F.concat_ws("/", *by).alias("subject"),
                          F.col("n_distinct_bidprice").cast("double").alias("value"))
    return long.unionByName(spread).select(F.lit(name).alias("table_name"), "check", "subject", "value")


def sketch_quality(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Per price and quantile: rows that have it, and whether the sketch's value lies within RANK_ERROR of the asked rank."""
    prices = [c.removeprefix("sketch__") for c in parts.columns if c.startswith("sketch__")]
    asked = [(p, q, at) for p in prices for q, at in REPORT_QUANTILES.items()]
    values = parts.agg(*[F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint(f"sketch__{p}"), F.lit(at)).alias(f"{p}_{q}")
                         for p, q, at in asked]).first()  # two numbers per price
    counted = df.agg(*[c for p, q, _ in asked for c in (
        F.count(p).alias(f"n_{p}_{q}"), F.count_if(F.col(p) < values[f"{p}_{q}"]).alias(f"below_{p}_{q}"),
        F.count_if(F.col(p) <= values[f"{p}_{q}"]).alias(f"upto_{p}_{q}"))])
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("column_name"), F.lit(q).alias("quantile"), F.col(f"n_{p}_{q}").alias("n"),
                 ((F.col(f"below_{p}_{q}") <= (at + RANK_ERROR) * F.col(f"n_{p}_{q}"))
                  & (F.col(f"upto_{p}_{q}") >= (at - RANK_ERROR) * F.col(f"n_{p}_{q}"))).alias("within_bound"))
        for p, q, at in asked])).alias("r")).select("r.*")


def validation_report(tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row per table: does it exist, its rows and its anomaly counts.

    ``None`` stands for a table with no files.
    """
    parts = []
    spark = next((t.sparkSession for t in tables.values() if t is not None), None)
    if spark is None:
        raise ValueError("no table to validate: this is a failure, not a clean pass")
    for name, df in tables.items():
        if df is None:
            row = spark.range(1).select(
                F.lit(name).alias("table_name"), F.lit(False).alias("exists"),
                *[F.lit(None).cast("long").alias(c) for c in ["n_rows", *ANOMALIES]])
        else:
            counts = [F.count_if(F.expr(rule)) if "payprice" not in rule or "payprice" in df.columns
                      else F.lit(None).cast("long") for rule in ANOMALIES.values()]
            row = df.agg(F.count("*").alias("n_rows"),
                         *[c.alias(a) for a, c in zip(ANOMALIES, counts)]).select(
                F.lit(name).alias("table_name"), F.lit(True).alias("exists"), "n_rows", *ANOMALIES)
        parts.append(row)
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def validation_verdict(report: DataFrame) -> DataFrame:
    """``nothing validated``, ``anomalies`` or ``pass``, with the exit code to use."""
    per_table = [F.coalesce(F.col(a), F.lit(0)) for a in ANOMALIES]
    found = sum(per_table[1:], per_table[0])
    summed = report.agg(
        F.count_if("exists").alias("n_tables"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(found), F.lit(0)).alias("n_anomalies"))
    verdict = (F.when(F.col("n_tables") == 0, "nothing validated")
               .when(F.col("n_anomalies") > 0, "anomalies").otherwise("pass"))
    return summed.select("*", verdict.alias("verdict"),
                         F.when(verdict == "pass", 0).otherwise(1).alias("exit_code"))


def impression_summary(df: DataFrame) -> DataFrame:
    """Headline price figures; the median comes from counts per price."""
    per_price = df.groupBy("payprice").agg(
        F.count("*").alias("_n"), F.sum("bidprice").alias("_bid"), F.count("bidprice").alias("_nb"))
    return per_price.agg(
        F.sum("_n").alias("impressions"), F.min("payprice").alias("price_lowest"),
        F.max("payprice").alias("price_highest"),
        F.round(F.sum(F.col("payprice") * F.col("_n"))
                / F.sum(F.when(F.col("payprice").isNotNull(), F.col("_n"))), 2).alias("price_average"),
        F.percentile("payprice", 0.5, F.col("_n")).alias("price_middle"),
        F.round(F.sum("_bid") / F.sum("_nb"), 2).alias("bid_average"))
