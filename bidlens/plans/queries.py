"""One query per operator over the log tables derived from ``events``.

Every query takes ``(spark, sf_dir)``, runs over whole tables and rounds its
floating-point results so that another engine can be compared with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens import schema
from bidlens.functions import cleaning, probability as prob, tokens
from bidlens.operators import (auction, calibrate, features, labels, metrics, models, overlap,
                               prefix, profile, quality, report, sample, split, sweep)
from bidlens.plans import event_logs as logs
from bidlens.session import materialize, new_table_path
from bidlens.sources import commits, rawlogs, tables
from bidlens.streaming import logs as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RATE = 0.02
SEED = 42
SEASONS = (2,)
TIEBREAK = ["event_id"]
KEYS = ["event_id", "bidid", "timestamp", "advertiser"]
EXTRA = ["event_id", "event_type", "usertag_text"]
SPLIT = split.Split({"train": ("2024-01-01", "2024-01-20"), "val": ("2024-01-21", "2024-01-25"),
                     "test": ("2024-01-26", "2024-12-31")})


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name: F.round(f.name, digits) for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(doubles) if doubles else df


def text_time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def labelled(spark, d) -> DataFrame:
    return labels.with_label(logs.impressions(spark, d), logs.clicks(spark, d))


def predictions(spark, d) -> DataFrame:
    return logs.predictions(labelled(spark, d), RATE).withColumnRenamed("click", "y_true")


def in_split(df: DataFrame, name: str) -> DataFrame:
    start, end = SPLIT.range_of(name)
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def pool(spark, d) -> DataFrame:
    return auction.auction_pool(logs.impressions(spark, d), logs.clicks(spark, d),
                                seasons=SEASONS, tiebreak=TIEBREAK)


def pool_with_scores(spark, d) -> DataFrame:
    scores = logs.predictions(logs.impressions(spark, d), RATE)
    return auction.align_predictions(pool(spark, d), scores, "p_step")


# --- Validation ---------------------------------------------------------------

def _tables(spark, d) -> dict[str, DataFrame]:
    return {"bids": logs.bids(spark, d).drop("payprice", "keypage"), "impressions": logs.impressions(spark, d),
            "clicks": logs.clicks(spark, d), "conversions": logs.conversions(spark, d)}


@query
def table_counts(spark, d):
    report_rows = quality.validation_report(_tables(spark, d))
    return report_rows.select("table_name", "exists", "n_rows", *quality.ANOMALIES)


@query
def validation_verdict(spark, d):
    return quality.validation_verdict(quality.validation_report(_tables(spark, d)))


@query
def null_rates(spark, d):
    return rounded(quality.null_rates(logs.impressions(spark, d), schema.EVENT_COLUMNS))


@query
def missingness(spark, d):
    rows = logs.impressions(spark, d).drop(*EXTRA)
    return rounded(quality.missingness(rows))


@query
def price_profile(spark, d):
    # The approximate quantiles differ between engines by design; the exact parts are compared.
    return rounded(quality.price_profile(logs.impressions(spark, d)).drop("p50", "p95"))


@query
def price_profile_quantiles(spark, d):
    """Quantiles read from merged sketches, held against exact ranks."""
    rows = logs.impressions(spark, d)
    return quality.sketch_quality(rows, quality.validation_parts(rows, []))


@query
def validation_complete(spark, d):
    """Every check of every table; approximate quantiles are left to ``price_profile_quantiles``."""
    out = None
    for log_type, name in schema.TABLE_OF_LOG_TYPE.items():
        parts = quality.validation_parts(_tables(spark, d)[name], schema.raw_columns(log_type))
        part = quality.complete_report(name, parts).where("check NOT IN ('price_p50', 'price_p95')")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query
def anomaly_counts(spark, d):
    return quality.anomaly_counts(logs.impressions(spark, d))


@query
def bidprice_spread(spark, d):
    return quality.bidprice_spread(logs.impressions(spark, d)).orderBy("season", "advertiser")


@query
def bidprice_lookup(spark, d):
    return quality.bidprice_lookup(logs.impressions(spark, d))


@query
def impression_summary(spark, d):
    return quality.impression_summary(logs.impressions(spark, d))


# --- Ingest -------------------------------------------------------------------

@query
def parse_raw_lines(spark, d):
    """Typed impressions written as raw lines and read back through the parser."""
    lines = logs.raw_lines(logs.impressions(spark, d), "imp")
    typed = rawlogs.parse_lines(lines, "imp", keep=logs.KEEP, bucket=cleaning.hash_bucket_md5)
    tags = F.array_join(F.col("usertag").cast("array<string>"), ",")
    return typed.select("event_id", "bidid", text_time("timestamp").alias("time_text"), "logtype", "userid",
                        "userid_hash", "useragent", "IP", "region", "city", "adexchange", "domain", "domain_hash",
                        "url", "urlid", "slotid", "slotwidth", "slotheight", "slotvisibility", "slotformat",
                        "slotprice", "creative", "bidprice", "payprice", "keypage", "keypage_hash", "advertiser",
                        tags.alias("usertag"), "season", "date")


@query
def parse_bid_lines(spark, d):
    lines = logs.raw_lines(logs.bids(spark, d), "bid")
    typed = rawlogs.parse_lines(lines, "bid", keep=logs.KEEP, bucket=cleaning.hash_bucket_md5)
    return typed.groupBy("season", "date").agg(
        F.count("*").alias("n"), F.sum("bidprice").alias("bidprice_total"),
        F.sum("slotprice").alias("slotprice_total"), F.count("adexchange").alias("with_exchange"),
        F.count("usertag").alias("with_tags"), F.count_distinct("userid_hash").alias("user_buckets"))


@query
def stored_table_roundtrip(spark, d):
    """Raw lines parsed, written as hive-partitioned Parquet and scanned again."""
    root = new_table_path(spark, "tables")
    lines = logs.raw_lines(logs.clicks(spark, d), "clk")
    tables.write_table(rawlogs.parse_lines(lines, "clk"), root, "clicks")
    stored = tables.read_table(spark, root, "clicks").where(
        (F.col("season") == 2) & (F.col("date") >= F.lit("2024-01-10").cast("date")))
    return stored.groupBy("season", "date", "advertiser").agg(
        F.count("*").alias("n"), F.sum("payprice").alias("spend"))


@query
def load_ledger(spark, d):
    """Rows in and out per day of a stored load that lost the rows of one bid."""
    source = logs.impressions(spark, d)
    typed = rawlogs.parse_lines(logs.raw_lines(source, "imp"), "imp")
    root = new_table_path(spark, "ledger-load")
    tables.write_table(typed.where(F.col("bidid") != source.agg(F.min("bidid")).scalar()), root, "impressions")
    return tables.ledger_rows(source, tables.read_table(spark, root, "impressions"), "impressions")


@query
def committed_days(spark, d):
    """What readers see of four loads: all days, later days replaced by their clicks, one never committed, purchases added."""
    root, table = new_table_path(spark, "committed"), "impressions"
    typed = materialize(rawlogs.parse_lines(logs.raw_lines(logs.impressions(spark, d), "imp"), "imp", keep=logs.KEEP), "typed-lines")
    clicks = typed.where("event_type = 'click' and date >= date'2024-01-10'")
    purchases = typed.where("event_type = 'purchase'")
    for name, rows, adds in (("first", typed, False), ("second", clicks, False), ("third", purchases, None), ("fourth", purchases, True)):
        stored = commits.write_version(rows.drop(*EXTRA), root, table, name)
        if adds is not None:
            commits.commit(spark, tables.ledger_path(root), tables.ledger_rows(rows, stored, table), name, adds)
    seen = tables.read_table(spark, root, table).groupBy("season", "date").agg(
        F.count("*").alias("n"), F.sum("payprice").alias("spend"))
    ledger = tables.read_ledger(spark, tables.ledger_path(root)).select("season", "date", "rows_in", "rows_out")
    return seen.join(ledger, ["season", "date"], "full")


@query
def pending_days(spark, d):
    """Days that still have to be loaded when the ledger lists those with clicks."""
    def days(df, name):
        return df.select(F.lit(name).alias("table_name"), "season", "date").distinct()

    done = days(logs.clicks(spark, d).where("advertiser = '0' and adexchange = '0'"), "impressions")
    return tables.pending(days(logs.impressions(spark, d), "impressions"), done)


@query
def usertag_array(spark, d):
    rows = logs.impressions(spark, d).select("event_id", cleaning.tag_array(F.col("usertag_text")).alias("tags"))
    return rows.select("event_id", F.size("tags").alias("n_tags"), F.array_max("tags").alias("max_tag"),
                       F.array_join(F.col("tags").cast("array<string>"), "|").alias("tags"))


@query
def hash_bucket_md5(spark, d):
    rows = logs.impressions(spark, d)
    return rows.select("event_id", *[cleaning.hash_bucket_md5(F.col(c)).alias(f"{c}_hash") for c in schema.HASHED_COLUMNS])


# --- Labels, splits, features ---------------------------------------------------

@query
def click_label(spark, d):
    return labelled(spark, d).select("event_id", "bidid", "click")


@query
def conversion_label(spark, d):
    rows = labels.with_label(logs.impressions(spark, d), logs.conversions(spark, d), "conversion")
    return profile.rate_by(rows, ["advertiser"], "conversion").transform(rounded)


@query
def label_counts(spark, d):
    return labels.label_counts(logs.impressions(spark, d), logs.clicks(spark, d))


@query
def split_counts(spark, d):
    return rounded(split.split_counts(labelled(spark, d), SPLIT))


LOOSE_RANGES = {"train": ("2024-01-03", "2024-01-20"), "val": ("2024-01-18", "2024-01-25"), "test": ("2024-01-28", "2024-12-31")}


@query
def split_coverage(spark, d):
    """Every day against the split in use and against ranges that overlap and leave days out."""
    days = split.calendar(logs.impressions(spark, d))
    return split.split_coverage(days, SPLIT).withColumn("ranges", F.lit("in use")).unionByName(
        split.split_coverage(days, split.Split(LOOSE_RANGES)).withColumn("ranges", F.lit("loose")))


@query
def feature_table(spark, d):
    table = split.load_split(logs.impressions(spark, d).drop("event_type", "usertag_text"),
                             logs.clicks(spark, d), 2, "val", SPLIT, keys=["bidid"], extra=["event_id"])
    return table.select("event_id", "bidid", text_time("timestamp").alias("time_text"),
                        *[c for c in table.columns if c not in ("event_id", "bidid", "timestamp", "usertag")])


@query
def triple_key(spark, d):
    return logs.impressions(spark, d).select(
        "event_id", F.md5(tokens.composite_key(*tokens.PLACEMENT_FIELDS)).alias("placement"))


@query
def feature_tokens(spark, d):
    rows = logs.impressions(spark, d)
    return rows.select("event_id", F.array_join(tokens.feature_tokens(), "|").alias("tokens"))


@query
def downsample_negatives(spark, d):
    kept, _ = sample.downsample_negatives(labelled(spark, d), 0.1, SEED, ["event_id"])
    return kept.select("event_id", "click")


@query
def sampling_record(spark, d):
    return rounded(sample.sampling_record(labelled(spark, d), 0.1, SEED))


@query
def sampling_record_check(spark, d):
    """The record re-derived from the drawn rows, all of them and without those of no known exchange."""
    rows = labelled(spark, d)
    kept, record = sample.downsample_negatives(rows, 0.1, SEED, ["event_id"])
    kept = materialize(kept.select("event_id", "adexchange", "click"), "drawn")
    cases = {"all drawn rows": kept, "rows lost": kept.where("adexchange is not null or click = 1")}
    found = [sample.same_record(record, sample.record_of_draw(rows, part, 0.1, SEED)).select(
        F.lit(name).alias("drawn"), F.array_join("differing", "|").alias("differing"), "same") for name, part in cases.items()]
    return found[0].unionByName(found[1])


@query
def vocabulary_rare(spark, d):
    train = in_split(labelled(spark, d), "train")
    return features.vocabulary(train)


@query
def vocabulary_summary(spark, d):
    train = in_split(labelled(spark, d), "train")
    return features.vocabulary_summary(features.vocabulary(train))


@query
def encode_indices(spark, d):
    rows = labelled(spark, d)
    fields = tokens.CATEGORICAL_FIELDS
    indexed = features.index_vocabulary(features.vocabulary(in_split(rows, "train"), fields, 5))
    encoded = features.encode_indices(in_split(rows, "test"), materialize(indexed, "vocabulary"), fields)
    return encoded.select("event_id", *[f"{f}_idx" for f in fields], "hour_idx")


@query
def tag_vocabulary(spark, d):
    return features.tag_vocabulary(in_split(labelled(spark, d), "train"))


@query
def tag_multihot(spark, d):
    rows = labelled(spark, d)
    return features.tag_multihot(in_split(rows, "test"), in_split(rows, "train"), ["event_id"])


@query
def tag_indicators(spark, d):
    """An indicator per tag of the training split; per row those that are set, in order."""
    rows = labelled(spark, d)
    known = sorted(r.tag for r in features.tag_vocabulary(in_split(rows, "train")).where("tag IS NOT NULL").collect())
    flags = features.tag_indicators(rows, known)
    return flags.select("event_id", F.concat_ws("|", *[F.when(F.col(f"usertag_{t}") == 1, str(t)) for t in known]).alias("tags"))


# --- Profile --------------------------------------------------------------------

@query
def imp_clk_agreement(spark, d):
    return labels.price_agreement(logs.impressions(spark, d), logs.clicks(spark, d))


@query
def imp_bid_agreement(spark, d):
    zero = logs.impressions(spark, d).where(profile.ZERO_PRICE)
    return labels.bid_log_match(zero, logs.bids(spark, d), by=("advertiser",))


@query
def zero_price_clicks(spark, d):
    zero = logs.impressions(spark, d).where(profile.ZERO_PRICE)
    hit = labels.rows_with_partner(zero, logs.clicks(spark, d))
    return hit.groupBy("advertiser").agg(F.count("*").alias("n"))


@query
def ctr_by_field(spark, d):
    fields = ["advertiser", "adexchange", "slotvisibility", "region"]
    return rounded(profile.rate_by_fields(labelled(spark, d), fields))


@query
def ctr_min_rows(spark, d):
    return rounded(profile.rate_by(labelled(spark, d), ["slotid"], min_rows=400))


@query
def ctr_by_hour(spark, d):
    return rounded(profile.by_hour(labelled(spark, d)))


@query
def ctr_by_weekday(spark, d):
    return rounded(profile.by_weekday(labelled(spark, d)))


@query
def peak_to_trough(spark, d):
    return rounded(profile.peak_to_trough(profile.by_hour(labelled(spark, d))))


@query
def minute_burst(spark, d):
    return rounded(profile.minute_burst(logs.impressions(spark, d)))


@query
def largest_minutes(spark, d):
    rows = logs.impressions(spark, d)
    cells = [F.col("date"), F.hour("timestamp").alias("hour"), F.minute("timestamp").alias("minute")]
    return profile.largest_cells(rows, cells, 30)


@query
def anomaly_crosstab(spark, d):
    return rounded(profile.anomaly_crosstab(logs.impressions(spark, d)))


@query
def overage_size(spark, d):
    return rounded(profile.overage_size(logs.impressions(spark, d)))


@query
def overage_histogram(spark, d):
    return profile.overage_histogram(logs.impressions(spark, d), 10)


@query
def anomaly_by_tier(spark, d):
    return rounded(profile.anomaly_by_tier(logs.impressions(spark, d)))


@query
def duplicate_ids(spark, d):
    return profile.duplicate_ids(logs.impressions(spark, d))


@query
def repeat_consistency(spark, d):
    return profile.repeat_consistency(logs.impressions(spark, d))


@query
def hash_collisions(spark, d):
    return rounded(profile.hash_collisions(logs.impressions(spark, d), schema.HASHED_COLUMNS, bucket=cleaning.hash_bucket_md5))


@query
def price_shape(spark, d):
    return rounded(profile.price_shape(logs.impressions(spark, d)))


@query
def price_shape_by_advertiser(spark, d):
    return rounded(profile.price_shape(logs.impressions(spark, d), ["advertiser"]))


@query
def win_rate(spark, d):
    return rounded(profile.win_rate(logs.impressions(spark, d), logs.bids(spark, d), ["advertiser", "date"]))


@query
def tag_stats(spark, d):
    return rounded(profile.tag_stats(logs.impressions(spark, d)))


@query
def campaign_profile(spark, d):
    return rounded(profile.campaign_profile(labelled(spark, d)))


@query
def class_balance(spark, d):
    return rounded(profile.class_balance(labelled(spark, d), by=["date"]))


@query
def zero_price_concentration(spark, d):
    rows = logs.impressions(spark, d)
    keys = {"advertiser": F.col("advertiser"), "date": F.col("date").cast("string"),
            "hour": F.hour("timestamp").cast("string"), "exchange": F.coalesce("adexchange", F.lit("none")),
            "slot": F.col("slotid"), "creative": F.col("creative"), "season": F.col("season")}
    return rounded(profile.concentration_by_keys(rows, profile.ZERO_PRICE, keys))


def _population():
    return F.when(F.col("advertiser") == "2", "advertiser 2").otherwise("others")


@query
def floor_test(spark, d):
    return rounded(profile.floor_test(logs.impressions(spark, d), _population()))


@query
def population_compare(spark, d):
    rows = logs.impressions(spark, d)
    return rounded(profile.population_compare(
        rows, F.when(F.col("payprice") == 0, "zero price").otherwise("priced"),
        {"wide_slot_share": ("slotwidth", 250), "region_0_share": ("region", "0")},
        distinct=["region", "useragent"], nulls=["domain", "usertag"]))


# --- Ranking and calibration ------------------------------------------------------

@query
def recalibrate(spark, d):
    rows = predictions(spark, d)
    return rounded(rows.select("event_id", "p_raw", "p_calibrated",
                               prob.clip(prob.recalibrate(F.col("p_raw"), 1.0)).alias("p_identity")))


@query
def auc(spark, d):
    return rounded(metrics.auc(predictions(spark, d), "p_raw").drop("undefined_reason"))


@query
def auc_by_advertiser(spark, d):
    return rounded(metrics.auc(predictions(spark, d), "p_calibrated", groups=["advertiser"]))


@query
def auc_undefined_groups(spark, d):
    """Grouped by the label itself every group lacks one class, so no area is defined."""
    rows = predictions(spark, d).withColumn("grp", F.col("y_true"))
    return rounded(metrics.auc(rows, "p_raw", groups=["grp"]))


@query
def auc_means(spark, d):
    return rounded(metrics.auc_means(metrics.auc(predictions(spark, d), "p_calibrated", groups=["advertiser"])))


@query
def log_loss(spark, d):
    return rounded(metrics.log_loss(predictions(spark, d), "p_calibrated"))


def _ranked(spark, d):
    return metrics.ranked_scores(metrics.score_table(predictions(spark, d), "p_calibrated"))


@query
def reliability_bins(spark, d):
    return rounded(metrics.reliability_bins(_ranked(spark, d)))


@query
def reliability_bins_tied(spark, d):
    """Heavily tied scores: repeated edges collapse into fewer bins."""
    rows = predictions(spark, d).withColumn("p_tied", F.floor(F.col("p_raw") * 4) / F.lit(4.0))
    ranked = metrics.ranked_scores(metrics.score_table(rows, "p_tied"))
    return rounded(metrics.reliability_bins(ranked))


@query
def ece(spark, d):
    return rounded(metrics.calibration_error(metrics.reliability_bins(_ranked(spark, d))))


@query
def reliability_curve(spark, d):
    return rounded(metrics.reliability_curve(metrics.reliability_bins(_ranked(spark, d))))


@query
def matched_edge_bins(spark, d):
    return rounded(metrics.matched_edge_bins(predictions(spark, d), "p_calibrated", "p_step"))


@query
def calibration_deviation(spark, d):
    bins = metrics.matched_edge_bins(predictions(spark, d), "p_calibrated", "p_step")
    return rounded(metrics.calibration_deviation(bins, ["ratio_before", "ratio_after"]))


@query
def evaluation_record(spark, d):
    return rounded(metrics.evaluate(in_split(predictions(spark, d), "test"), "p_raw", model="stand-in",
                                    split="test", sampling_rate=RATE))


@query
def metric_deltas(spark, d):
    rows = predictions(spark, d)
    out = None
    for name in ("val", "test"):
        part = in_split(rows, name)
        before = metrics.evaluate(part, "p_raw", model="raw", split=name, sampling_rate=RATE)
        after = metrics.evaluate(part, "p_step", model="stepped", split=name)
        delta = metrics.metric_deltas(before, after, ["split"])
        out = delta if out is None else out.unionByName(delta)
    return rounded(out)


@query
def evaluation_by_advertiser(spark, d):
    """One evaluation record per advertiser, its bins with edges of its own."""
    return rounded(metrics.evaluate(in_split(predictions(spark, d), "test"), "p_raw", model="stand-in", split="test",
                                    sampling_rate=RATE, groups=["advertiser"]))


@query
def metric_deltas_by_advertiser(spark, d):
    part = in_split(predictions(spark, d), "test")
    before = metrics.evaluate(part, "p_raw", model="raw", split="test", sampling_rate=RATE, groups=["advertiser"])
    after = metrics.evaluate(part, "p_step", model="stepped", split="test", groups=["advertiser"])
    return rounded(metrics.metric_deltas(before, after, ["advertiser"]))


@query
def matched_edge_bins_by_advertiser(spark, d):
    return rounded(metrics.matched_edge_bins(predictions(spark, d), "p_calibrated", "p_step", groups=["advertiser"]))


@query
def metrics_reproduce(spark, d):
    """A second evaluation of the same scores reproduces the first to 1e-9; one without the rate does not."""
    part = in_split(predictions(spark, d), "test")
    found = metrics.evaluate(part, "p_raw", model="a", split="test", sampling_rate=RATE)
    others = {"again": metrics.evaluate(part.repartition("userid"), "p_raw", model="b", split="test", sampling_rate=RATE),
              "uncorrected": metrics.evaluate(part, "p_raw", model="c", split="test")}
    rows = [metrics.metrics_reproduce(found, other).select(
        F.lit(name).alias("run"), "metric", F.round("found", 6).alias("found"), "agrees") for name, other in others.items()]
    return rows[0].unionByName(rows[1])


@query
def precision_at_threshold(spark, d):
    return rounded(metrics.precision_at(predictions(spark, d), "p_calibrated", [0.01, 0.1, 0.5, 0.9]))


@query
def top_confident(spark, d):
    top = metrics.most_confident(predictions(spark, d), "p_calibrated", 20, ["event_id"])
    return rounded(top.select("event_id", "p_calibrated", "y_true"))


def _seen_unseen(spark, d):
    rows = predictions(spark, d)
    train, test = in_split(rows, "train"), in_split(rows, "test")
    kept, _ = sample.downsample_negatives(train, RATE, SEED, ["event_id"], "y_true")
    return overlap.seen_unseen(test, train, kept, "p_calibrated")


@query
def seen_unseen(spark, d):
    return rounded(_seen_unseen(spark, d).drop("se", "ci_low", "ci_high"))


@query
def auc_standard_error(spark, d):
    return rounded(_seen_unseen(spark, d).select("definition", "bucket", "auc", "se", "ci_low", "ci_high"))


@query
def auc_difference(spark, d):
    stats = _seen_unseen(spark, d).where("definition = 'sampled train'")
    return rounded(metrics.auc_difference(stats, "bucket", "unseen", "seen"))


@query
def exact_quantiles(spark, d):
    """Order statistics of the event value itself, with almost no two values alike."""
    events = spark.read.parquet(f"{d}/events.parquet")
    out = prefix.exact_quantiles(events, "value", [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0], ["event_type"])
    return rounded(out.select("event_type", F.posexplode("quantiles").alias("pos", "value")))


@query
def running_value(spark, d):
    """Running event count and running whole value per type over the full time order."""
    events = spark.read.parquet(f"{d}/events.parquet").select(
        "event_type", "ts", "event_id", F.lit(1).cast("long").alias("one"), F.floor("value").alias("whole"))
    out = prefix.running_totals(events, ["ts", "event_id"], {"n_upto": "one", "value_upto": "whole"}, ["event_type"])
    return out.select("event_id", "n_upto", "value_upto")


# --- Auctions ----------------------------------------------------------------------

@query
def advertisers_in_scope(spark, d):
    return auction.advertisers_in_scope(logs.impressions(spark, d), SEASONS, SPLIT.range_of("test"))


@query
def exclusions(spark, d):
    return rounded(auction.exclusion_counts(logs.impressions(spark, d)))


@query
def exclusion_cost(spark, d):
    return rounded(auction.exclusion_counts(labelled(spark, d), ["advertiser"], "click"))


@query
def bid_time_view(spark, d):
    rows = logs.impressions(spark, d).drop("event_type", "usertag_text", "event_id")
    view = schema.bid_time_view(rows, ["bidid", "timestamp"])
    return view.groupBy("advertiser", "slotid").agg(F.count("*").alias("n"), F.max("slotprice").alias("floor"))


@query
def auction_pool(spark, d):
    return pool(spark, d).select("event_id", "advertiser", "bidid", "payprice", "click")


@query
def price_quantiles(spark, d):
    q = auction.price_quantiles(pool(spark, d), sweep.QUANTILE_ANCHORS)
    return rounded(q.select("advertiser", F.posexplode("quantiles").alias("pos", "price")))


@query
def historical_spend(spark, d):
    return auction.historical_spend(pool(spark, d))


@query
def oracle_cost(spark, d):
    return rounded(auction.oracle_cost(pool(spark, d)))


@query
def align_predictions(spark, d):
    return rounded(pool_with_scores(spark, d).select("event_id", "p_click"))


@query
def alignment_report(spark, d):
    """Scores that miss the rows of no known exchange and hold those of one visibility twice."""
    scores = logs.predictions(logs.impressions(spark, d), RATE)
    scores = scores.where("adexchange is not null").unionByName(scores.where("slotvisibility = '1'"))
    return auction.alignment_report(pool(spark, d), scores)


@query
def same_rows(spark, d):
    """Later impressions against pool and clicks together: keys on one side, and keys held more often on the other."""
    keys = ["advertiser", "bidid", "timestamp"]
    later = logs.impressions(spark, d).where("date >= date'2024-01-05'")
    return overlap.same_rows(later, pool(spark, d).select(keys).unionByName(logs.clicks(spark, d).select(keys)), keys)


@query
def correction_audit(spark, d):
    def step(df, column, output):
        return df.withColumn(output, F.floor(F.col(column) * 1000) / F.lit(1000.0))

    audit = calibrate.correction_audit(predictions(spark, d), step, sampling_rate=RATE, fit_split="val",
                                       final="p_step")
    return rounded(audit)


def _one_run(stats: DataFrame, strategy: str) -> DataFrame:
    wanted = {"constant": "q50", "random": "q10-q95", "linear_ctr": "q75"}[strategy]
    return sweep.sweep_grid(stats).where((F.col("strategy") == strategy) & (F.col("label") == wanted))


def _settle(spark, d, strategy: str) -> DataFrame:
    rows = materialize(pool_with_scores(spark, d), "pool")
    stats = materialize(auction.pool_statistics(rows, sweep.QUANTILE_ANCHORS), "statistics")
    budgets = sweep.budget_ladder(stats, {"1/8": 1 / 8})
    return auction.settle(rows, _one_run(stats, strategy), budgets, TIEBREAK, SEED)


def settled_view(results: DataFrame) -> DataFrame:
    return rounded(results.select(
        "advertiser", "run_id", "budget_id", "budget", "impressions_pool", "impressions_bid_on", "impressions_won",
        "win_rate_bid_on", "win_rate_pool", "clicks_won", "total_spend", "effective_cpc", "budget_exhausted",
        "exhaustion_index", text_time("exhaustion_timestamp").alias("exhaustion_time")))


@query
def settle_constant(spark, d):
    return settled_view(_settle(spark, d, "constant"))


@query
def settle_random(spark, d):
    return settled_view(_settle(spark, d, "random"))


@query
def settle_linear(spark, d):
    return settled_view(_settle(spark, d, "linear_ctr"))


@query
def spend_trajectory(spark, d):
    rows = materialize(pool_with_scores(spark, d), "pool")
    stats = materialize(auction.pool_statistics(rows, sweep.QUANTILE_ANCHORS), "statistics")
    budgets = sweep.budget_ladder(stats, {"1/8": 1 / 8})
    out = auction.spend_trajectory(rows, _one_run(stats, "constant"), budgets, TIEBREAK, SEED)
    return out.select("event_id", "advertiser", "position", "bid_on", "cumulative_spend")


_SWEEPS: dict[tuple[str, str], tuple[sweep.Sweep, DataFrame, DataFrame]] = {}


def _sweep(spark, d) -> tuple[sweep.Sweep, DataFrame, DataFrame]:
    """The sweep of a data folder; its stored results serve all reports of one application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _SWEEPS:
        one = sweep.Sweep(pool_with_scores(spark, d), TIEBREAK, SEED)
        results = materialize(one.results(), "results")
        _SWEEPS[key] = (one, results, materialize(one.with_hourly(results), "results-hourly"))
    return _SWEEPS[key]


@query
def sweep_results(spark, d):
    return settled_view(sweep.Sweep(pool_with_scores(spark, d), TIEBREAK, SEED).results())


@query
def sweep_grid(spark, d):
    one, _, _ = _sweep(spark, d)
    return rounded(one.runs)


@query
def budget_ladder(spark, d):
    one, _, _ = _sweep(spark, d)
    return rounded(one.budgets)


@query
def sweep_design(spark, d):
    one, _, _ = _sweep(spark, d)
    design = sweep.sweep_design(one, auction.exclusion_counts(logs.impressions(spark, d)))
    return rounded(design.select(
        "advertiser", "n_loaded", "n_pool", "excluded_payprice_gt_bidprice_count", "excluded_payprice_zero_count",
        "historical_spend", "mean_p_click", F.col("budgets")[0]["budget"].alias("smallest_budget"),
        F.size("constant_amounts").alias("n_constant"), F.size("random_ranges").alias("n_random"),
        F.size("linear_bases").alias("n_linear"), F.col("linear_bases")[2]["base"].alias("median_base")))


@query
def hourly_spend(spark, d):
    one, results, _ = _sweep(spark, d)
    return rounded(one.hourly(results).select("advertiser", "run_id", "budget_id", "date", "hour_of_day",
                                              "spend_fraction"))


@query
def best_of_sweep(spark, d):
    _, results, _ = _sweep(spark, d)
    return rounded(report.headline(results).select(
        "advertiser", "budget_id", "strategy", "label", "clicks_won", "total_spend", "effective_cpc", "win_rate_pool"))


@query
def sweep_cells(spark, d):
    """The dashboard's nested cells, opened again to one row per point."""
    _, _, hourly = _sweep(spark, d)
    cells = report.dashboard_cells(hourly)
    parts = [cells.select("advertiser", "budget_label", F.lit(s).alias("strategy"),
                          F.explode(f"strategies.{s}").alias("p")) for s in report.STRATEGY_ORDER]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(rows.select(
        "advertiser", "budget_label", "strategy", "p.point", "p.label", "p.is_best_by_clicks", "p.clicks_won",
        F.col("p.exhaustion.exhausted").alias("exhausted"), F.col("p.spend_fen").alias("spend_fen"),
        F.size("p.spend_trajectory_fen").alias("n_hours"),
        F.array_max("p.spend_trajectory_fen").alias("last_spend")), 2)


@query
def dashboard_json(spark, d):
    _, _, hourly = _sweep(spark, d)
    cells = report.dashboard_cells(hourly)
    days = auction.pool_dates(pool(spark, d)).agg(F.min("first_date"), F.max("last_date")).first()
    return report.dashboard_json(cells, report.dashboard_meta(cells, 2, tuple(map(str, days))))


@query
def dashboard_readback(spark, d):
    """The exported JSON lines read again as text and opened to one row per point."""
    _, _, hourly = _sweep(spark, d)
    cells = report.dashboard_cells(hourly)
    path = new_table_path(spark, "dashboard")
    report.dashboard_json(cells, report.dashboard_meta(cells, 2, ("2024-01-01", "2024-12-31"))).write.text(path)
    lines = spark.read.text(path).select(F.from_json("value", cells.schema).alias("c")).select("c.*").where("budget_label is not null")

    def of(strategy: str):
        return F.transform(f"strategies.{strategy}", lambda p: F.struct(F.lit(strategy).alias("strategy"), p.alias("p")))

    points = F.concat(*map(of, report.STRATEGY_ORDER))
    return lines.select("advertiser", "budget_label", F.explode(points).alias("x")).select(
        "advertiser", "budget_label", "x.strategy", "x.p.point", "x.p.label", "x.p.is_best_by_clicks", "x.p.clicks_won",
        F.col("x.p.exhaustion.exhausted").alias("exhausted"), F.round("x.p.spend_fen", 2).alias("spend_fen"),
        F.size("x.p.spend_trajectory_fen").alias("n_hours"))


@query
def sweep_series(spark, d):
    _, _, hourly = _sweep(spark, d)
    return report.sweep_series(report.sweep_points(hourly))


@query
def trajectory_series(spark, d):
    _, _, hourly = _sweep(spark, d)
    return rounded(report.trajectory_series(report.sweep_points(hourly)), 1)


@query
def strategy_comparison(spark, d):
    _, results, _ = _sweep(spark, d)
    return report.strategy_comparison(report.headline(results))


@query
def strategy_wins(spark, d):
    _, results, _ = _sweep(spark, d)
    return rounded(report.strategy_wins(report.headline(results)))


@query
def sweep_gaps(spark, d):
    """Completeness of the sweep, and of one that lost points and calls every budget exhausted."""
    _, results, _ = _sweep(spark, d)
    damaged = results.where("clicks_won % 3 <> 1").withColumn("budget_exhausted", F.lit(True))

    def faults(part: DataFrame, name: str) -> DataFrame:
        broken = report.grid_gaps(part).agg(F.count("*")).scalar()
        wrong = report.exhaustion_violations(part).agg(F.count("*")).scalar()
        return part.agg(F.count("*").alias("n_results")).withColumns(
            {"results": F.lit(name), "incomplete_cells": broken, "exhaustion_violations": wrong})

    return faults(results, "whole").unionByName(faults(damaged, "damaged"))


@query
def params_json(spark, d):
    """Parameters to JSON text and back, with the place of each point."""
    _, results, _ = _sweep(spark, d)
    texts = report.params_to_json(results).withColumn("p", report.params_from_json(F.col("params_json")))
    label = F.coalesce("p.quantile_label", "p.range_label")
    return rounded(texts.select("advertiser", "budget_id", "strategy", label.alias("label"),
                                report.label_position(F.col("strategy"), label).alias("point"),
                                report.budget_label(F.col("budget_fraction")).alias("budget_label"),
                                F.coalesce("p.amount", "p.base", "p.low").alias("first_number")))


# --- Streaming ------------------------------------------------------------------------

@query
def stream_hourly_volume(spark, d):
    """Rows and spend per hour by a streaming aggregate over the event file."""
    events = spark.read.parquet(f"{d}/events.parquet")
    stream = (spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
              .selectExpr("ts as timestamp", "cast(floor(value) as bigint) as payprice"))
    path = new_table_path(spark, "hourly-volume")
    streaming.run_to_table(streaming.hourly_volume(stream), path, new_table_path(spark, "stream-state"))
    stored = spark.read.parquet(path)
    return stored.select(F.date_format("hour_start", "yyyy-MM-dd HH").alias("hour_text"), "n", "spend")


# --- Models (compared by row count; their numbers are those of Spark's solvers) ------

def _model_frames(spark, d):
    rows = materialize(labelled(spark, d), "labelled")  # read for the digests, the draw and each split
    train, _ = sample.downsample_negatives(in_split(rows, "train"), 0.2, SEED, ["event_id"])
    return materialize(train, "train"), in_split(rows, "val"), in_split(rows, "test")


@query
def lr_scores(spark, d):
    train, val, test = _model_frames(spark, d)
    search = models.LinearSearch(train, val, 0.2, keys=KEYS)
    return search.score(test).select("event_id", "click", "p_raw")


@query
def lr_search(spark, d):
    """Per penalty: validation rows, whether the fit is at its optimum, the mean prediction there, and how many runs are better."""
    train, val, _ = _model_frames(spark, d)
    found = models.LinearSearch(train, val, 0.2, keys=KEYS)
    chosen = (F.col("c") == found.best_c) & (F.col("log_loss") == F.min("log_loss").over(Window.partitionBy()))  # one row per penalty
    return found.records.select("c", "n_rows", "n_positive", (F.col("gradient") < 1e-4).alias("at_optimum"),
                                F.round("mean_prediction", 3).alias("mean_prediction"), chosen.cast("int").alias("chosen")).groupBy(
        "n_rows", "n_positive", "at_optimum", "mean_prediction").agg(F.count("*").alias("n_runs"), F.sum("chosen").alias("n_chosen"))


@query
def gbt_scores(spark, d):
    train, val, test = _model_frames(spark, d)
    search = models.TreeSearch(train, val, 0.2, keys=KEYS)
    return search.score(test).select("event_id", "click", "p_raw")


@query
def gbt_rounds(spark, d):
    """Ensembles cut at their best validation round, and those that waited PATIENCE rounds for a better one."""
    train, val, _ = _model_frames(spark, d)
    search = models.TreeSearch(train, val, 0.2, keys=KEYS)
    losses = spark.createDataFrame([(m, i + 1, x) for m, found in search.losses.items() for i, x in enumerate(found)],
                                   "model string, round int, loss double")
    best = losses.groupBy("model").agg(F.min_by("round", F.struct("loss", "round")).alias("best"), F.max("round").alias("last"))
    return search.records.join(best, "model").groupBy("n_rows", "n_positive").agg(
        F.count("*").alias("n_models"), F.count_if(F.col("n_trees") == F.col("best")).alias("n_cut_at_best"),
        F.count_if(F.col("last") >= F.col("best") + models.PATIENCE).alias("n_waited"))


@query
def tree_value_rates(spark, d):
    """The features of training rows: per field, rows and clicks of a row's value outside the row's own fold."""
    train, _, _ = _model_frames(spark, d)
    fields = tokens.CATEGORICAL_FIELDS
    rates = materialize(models.value_rates(train, fields, ["event_id"]), "value-rates")
    overall = train.agg(F.avg("click")).first()[0]
    rows = models.with_value_rates(train, rates, fields, overall, models.fold_of(["event_id"]))
    return rounded(rows.select("event_id", *[f"{f}_{x}" for f in fields for x in ("rate", "rows")]))


@query
def isotonic_scores(spark, d):
    rows = predictions(spark, d)
    model = calibrate.fit_isotonic(in_split(rows, "val"), "p_calibrated")
    return calibrate.apply_isotonic(in_split(rows, "test"), model, "p_calibrated").select(
        "event_id", "y_true", "p_calibrated", "p_isotonic")


@query
def ablation(spark, d):
    """Fields left out by groups; the first variant must meet the record of the search's model with that penalty."""
    train, val, _ = _model_frames(spark, d)
    val = materialize(val, "val")
    recorded = models.LinearSearch(train, val, 0.2, keys=KEYS, c_grid=[0.1]).records
    return models.ablation(train, val, 0.2, keys=KEYS, recorded=recorded)
