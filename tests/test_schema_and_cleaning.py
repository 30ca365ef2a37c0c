import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlens import schema
from bidlens.functions import cleaning, tokens
from bidlens.operators import features


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_settlement_and_ids_are_never_features():
    allowed = schema.feature_columns(schema.EVENT_COLUMNS + ["season", "date"])
    assert not set(allowed) & {"payprice", "bidprice", "bidid", "logtype", "keypage", "season", "date"}
    assert {"timestamp", "slotprice", "usertag", "advertiser"} <= set(allowed)


def test_hash_companion_follows_its_base():
    assert schema.feature_columns(["domain_hash", "keypage_hash"]) == ["domain_hash"]


@pytest.mark.parametrize("name", ["payprice_1", "timestamp_1", "pay_price", "region_hash", "click"])
def test_unknown_columns_raise(name):
    with pytest.raises(ValueError, match=name):
        schema.feature_columns(["region", name])


def test_requested_features_keep_allowlist_order_and_must_be_allowed():
    assert schema.narrow_features(schema.EVENT_COLUMNS, ["city", "region"]) == ["region", "city"]
    with pytest.raises(ValueError, match="payprice"):
        schema.narrow_features(schema.EVENT_COLUMNS, ["payprice"])


def test_layouts():
    assert len(schema.raw_columns("imp")) == 24 and len(schema.raw_columns("bid")) == 21
    assert "payprice" not in schema.output_schema("bid").names
    assert schema.schema_manifest()["roles"]["payprice"] == "known"


def test_bid_time_view_refuses_settlement_keys(spark):
    df = spark.createDataFrame([("a", 1, 2, "r")], "bidid string, payprice int, bidprice int, region string")
    assert schema.bid_time_view(df).columns == ["bidid", "region"]
    with pytest.raises(ValueError, match="payprice"):
        schema.bid_time_view(df, ["bidid", "payprice"])


def test_encoder_guard():
    features.assert_known_columns(["region", "usertag", "domain_hash"])
    with pytest.raises(ValueError, match="brand_new"):
        features.assert_known_columns(["region", "brand_new"])


def test_null_markers(spark):
    assert column(spark, ["null", "", "0"], lambda c: cleaning.null_markers("region", c)) == [None, "", "0"]
    assert column(spark, ["null", "", "0"], lambda c: cleaning.null_markers("url", c)) == [None, None, "0"]


def test_timestamp_keeps_milliseconds(spark):
    got = column(spark, ["20130606000104008", None], cleaning.log_timestamp)
    assert got == [dt.datetime(2013, 6, 6, 0, 1, 4, 8000), None]


@pytest.mark.parametrize("text", ["2013060600010400", "2013-06-06", "20131306000104008"])
def test_bad_timestamp_stops_the_job(spark, text):
    with pytest.raises(Exception):
        column(spark, [text], cleaning.log_timestamp)


def test_bad_number_stops_the_job(spark):
    assert column(spark, ["12", None], lambda c: cleaning.strict_int(c, "payprice")) == [12, None]
    with pytest.raises(Exception, match="payprice"):
        column(spark, ["12x"], lambda c: cleaning.strict_int(c, "payprice"))


def test_tags(spark):
    assert column(spark, ["1,2,,3", "", None], cleaning.tag_array) == [[1, 2, 3], [], None]


@pytest.mark.parametrize("bucket", [cleaning.hash_bucket, cleaning.hash_bucket_md5])
def test_hash_buckets(spark, bucket):
    a, b, none = column(spark, ["x", "x", None], lambda c: bucket(c))
    assert a == b and 0 <= a < schema.HASH_BUCKETS and none is None
    assert column(spark, ["x"], lambda c: bucket(c, seed=1))[0] != a


def test_uniform_is_keyed_not_positional(spark):
    df = spark.range(1000).select("id", cleaning.unit_interval(F.lit(42), F.col("id")).alias("u"))
    again = df.repartition(7).orderBy(F.desc("id"))
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in again.collect()}
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.05


def test_tokens(spark):
    df = spark.createDataFrame([("r", None, dt.datetime(2024, 1, 1, 5), [3, 3, 4]), ("r", "d", dt.datetime(2024, 1, 1, 0), None)],
                               "region string, domain string, timestamp timestamp_ntz, usertag array<int>")
    rows = [r[0] for r in df.select(tokens.feature_tokens(["region", "domain"])).collect()]
    assert rows[0] == ["region=r", "domain=__null__", "hour=5", "usertag=3", "usertag=4"]
    assert rows[1] == ["region=r", "domain=d", "hour=0"]
