"""The one-scan validation report, its sketches, and the one-scan sample of files."""

import random

from pyspark.sql import functions as F

from bidlens.operators import quality
from bidlens.sources import rawlogs


def table(spark, rows=4000):
    rng = random.Random(2)
    data = [(2, str(rng.randrange(5)), rng.choice([None, *range(90)]), 100 + 20 * rng.randrange(3), rng.randrange(-2, 300), rng.randrange(-1, 4), 250)
            for _ in range(rows)]
    return spark.createDataFrame(data, "season int, advertiser string, slotprice int, bidprice int, payprice int, slotwidth int, slotheight int"), data


def test_complete_report(spark):
    df, data = table(spark)
    parts = quality.validation_parts(df.repartition(7), ["slotprice", "bidprice"])
    got = {(r["check"], r["subject"]): r["value"] for r in quality.complete_report("t", parts).collect()}
    slot = [r[2] for r in data if r[2] is not None]
    assert got[("rows", "")] == len(data) and got[("nulls", "slotprice")] == len(data) - len(slot)
    assert got[("null_rate", "bidprice")] == 0 and got[("price_max", "slotprice")] == max(slot)
    assert abs(got[("price_mean", "slotprice")] - sum(slot) / len(slot)) < 1e-9
    assert got[("price_negative", "payprice")] == sum(r[4] < 0 for r in data)
    assert got[("anomaly", "payprice_greater_than_bidprice")] == sum(r[4] > r[3] for r in data)
    assert got[("anomaly", "nonpositive_slot_dimensions")] == sum(r[5] <= 0 for r in data)
    for a in "01234":
        assert got[("distinct_bidprices", f"2/{a}")] == len({r[3] for r in data if r[1] == a})
    pay = sorted(r[4] for r in data)
    for name, at in quality.REPORT_QUANTILES.items():
        rank = sum(x <= got[(f"price_{name}", "payprice")] for x in pay) / len(pay)
        assert abs(rank - at) < quality.RANK_ERROR + 0.01  # 0.01: copies of one price
    assert all(r.within_bound for r in quality.sketch_quality(df, parts).collect())


def test_a_wrong_quantile_is_noticed(spark):
    df, _ = table(spark)
    parts = quality.validation_parts(df.where("payprice < 100"), [])
    assert "payprice" in {r.column_name for r in quality.sketch_quality(df, parts).where("NOT within_bound").collect()}


def test_report_of_an_empty_table(spark):
    df, _ = table(spark, 10)
    report = quality.complete_report("t", quality.validation_parts(df.limit(0)))
    values = {(r["check"], r["subject"]): r["value"] for r in report.collect()}
    assert values[("price_p50", "payprice")] is None and values[("null_rate", "bidprice")] is None


def test_sample_reads_all_files_in_one_scan(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"imp.201306{i % 28 + 1:02d}.{i}.txt").write_text("".join(f"{i}-{n}\n" for n in range(i % 9)))
    found = rawlogs.sample_lines(spark, [str(tmp_path)], rows=4)
    lines = [r.line for r in found.collect()]
    assert sorted(lines) == sorted(f"{i}-{n}" for i in range(300) for n in range(min(4, i % 9)))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan text") == 1 and "WindowGroupLimit" in plan
    split = spark.createDataFrame([(f"line {i:06d}",) for i in range(5000)], "value string").coalesce(1).sortWithinPartitions("value")
    split.write.text(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        first = [r.line for r in rawlogs.sample_lines(spark, [str(tmp_path / "one")], rows=700).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(first) == [f"line {i:06d}" for i in range(700)]
