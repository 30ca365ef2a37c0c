import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bidlens.functions import probability as prob
from bidlens.operators import calibrate, features, labels, metrics, models, overlap, prefix, profile, quality, report, sample, split


def value(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_recalibration_values(spark):
    assert abs(value(spark, prob.recalibrate(F.lit(1 / 11), 0.1)) - 1 / 101) < 1e-9
    assert value(spark, prob.recalibrate(F.lit(0.37), 1.0)) == 0.37
    assert value(spark, prob.recalibrate(F.lit(0.0), 0.02)) == 0.0 and value(spark, prob.recalibrate(F.lit(1.0), 0.02)) == 1.0
    for bad in (0.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            prob.recalibrate(F.lit(0.5), bad)


def test_normal_tail(spark):
    for z, p in ((0.0, 1.0), (1.96, 0.0499958), (-2.68, 0.0073622)):
        assert abs(value(spark, prob.normal_tail(F.lit(z))) - p) < 1e-6


def rows_of(spark, n_pos, n_neg):
    return spark.range(n_pos + n_neg).select("id", (F.col("id") < n_pos).cast("int").alias("click"), F.lit("x").alias("v"))


def test_downsample_counts_and_repeatability(spark):
    rows = rows_of(spark, 50, 10_000)
    kept, record = sample.downsample_negatives(rows, 0.1, 42, ["id"])
    counts = {r.click: r["count"] for r in kept.groupBy("click").count().collect()}
    assert counts == {1: 50, 0: 1000} and kept.distinct().count() == 1050
    again, _ = sample.downsample_negatives(rows.repartition(5).orderBy(F.desc("id")), 0.1, 42, ["id"])
    assert kept.exceptAll(again).count() == 0
    other, _ = sample.downsample_negatives(rows, 0.1, 43, ["id"])
    assert kept.exceptAll(other).count() > 500
    r = record.first()
    assert (r.n_positive, r.n_negative_true, r.n_negative_sampled) == (50, 10_000, 1000)
    assert abs(r.positive_rate_after - 50 / 1050) < 1e-12
    assert sample.same_record(record, record).first().same
    assert sample.same_record(record, record.withColumn("seed", F.lit(1))).first().differing == ["seed"]


@pytest.mark.parametrize("n_neg,rate,kept", [(25, 0.1, 2), (35, 0.1, 4), (15, 0.1, 2), (10, 1.0, 10), (3, 0.1, 0)])
def test_half_rounds_to_even_and_extremes(spark, n_neg, rate, kept):
    got, _ = sample.downsample_negatives(rows_of(spark, 1, n_neg), rate, 42, ["id"])
    assert got.where("click = 0").count() == kept


def test_hot_key_of_copies_is_cut_by_number(spark):
    """A third of the rows share one key: still the exact count, and never a cap."""
    copies = spark.range(4000).select(F.lit(7).cast("long").alias("id"), F.lit(0).alias("click"), F.lit("x").alias("v"))
    rows = rows_of(spark, 10, 8000).unionByName(copies)
    for rate in (0.05, 0.5, 0.9):
        kept, record = sample.downsample_negatives(rows, rate, 1, ["id"])
        assert kept.where("click = 0").count() == record.first().n_negative_sampled == round(rate * 12_000)


def test_bad_rate(spark):
    with pytest.raises(ValueError):
        sample.downsample_negatives(rows_of(spark, 1, 1), 0.0, 1, ["id"])


def scored(spark, seed, n=600, groups=("a", "b")):
    rng = random.Random(seed)
    rows = [(rng.choice(groups), round(rng.random(), rng.choice([1, 6])), int(rng.random() < 0.3)) for _ in range(n)]
    rows += [(groups[0], 0.5, 1), (groups[0], 0.5, 0)] * (n // 4)     # one score holds a third of the rows
    return rows, spark.createDataFrame(rows, "g string, p double, y_true int").repartition(8)


def brute_auc(rows):
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_against_pairs(spark, seed):
    rows, df = scored(spark, seed)
    assert abs(metrics.auc(df, "p").first().auc - brute_auc(rows)) < 1e-12
    by = {r.g: r.auc for r in metrics.auc(df, "p", groups=["g"]).collect()}
    for g in "ab":
        assert abs(by[g] - brute_auc([r for r in rows if r[0] == g])) < 1e-12


def test_auc_undefined_is_never_a_half(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0), ("b", 0.3, 1), ("c", 0.1, 0), ("c", 0.4, 1)],
                               "g string, p double, y_true int")
    got = {r.g: (r.auc, r.undefined_reason) for r in metrics.auc(df, "p", groups=["g"]).collect()}
    assert got == {"a": (None, "zero positives"), "b": (None, "zero negatives"), "c": (1.0, None)}


def test_auc_is_unchanged_by_recalibration(spark):
    _, df = scored(spark, 5)
    a = metrics.auc(df, "p").first().auc
    b = metrics.auc(df.withColumn("q", prob.recalibrate(F.col("p"), 0.02)), "q").first().auc
    assert abs(a - b) < 1e-12


@pytest.mark.parametrize("values", ["continuous", "tied", "constant", "two"])
def test_bins_are_those_of_qcut(spark, values):
    rng = np.random.default_rng(3)
    p = {"continuous": rng.random(501), "tied": np.round(rng.random(400), 1), "constant": np.full(50, 0.25),
         "two": np.repeat([0.1, 0.9], 40)}[values]
    y = (rng.random(len(p)) < 0.3).astype(int)
    try:
        cut = pd.qcut(p, 10, duplicates="drop")
    except ValueError:
        cut = np.zeros(len(p))
    want = pd.DataFrame({"bin": cut, "p": p, "y": y}).groupby("bin", observed=True).agg(
        n=("p", "size"), m=("p", "mean"), a=("y", "mean")).reset_index(drop=True)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y_true int")
    got = metrics.reliability_bins(metrics.ranked_scores(metrics.score_table(df, "p"))).orderBy("bin").collect()
    if len(want) == 0:       # a constant has no interval: everything is one bin
        assert [r.n for r in got] == [len(p)]
        return
    assert [r.n for r in got] == want["n"].tolist()
    assert np.allclose([r.mean_predicted for r in got], want["m"]) and np.allclose([r.mean_actual for r in got], want["a"])


def test_bin_without_positives_has_a_named_ratio(spark):
    df = spark.createDataFrame([(0.1, 0)] * 10 + [(0.9, 1)] * 10, "p double, y_true int")
    ranked = metrics.ranked_scores(metrics.score_table(df, "p"))
    rows = metrics.reliability_bins(ranked, 2).collect()
    assert any(r.ratio is None and r.ratio_note == prob.NO_POSITIVES for r in rows) or len(rows) == 1


def test_evaluation_record(spark):
    rows, df = scored(spark, 9)
    r = metrics.evaluate(df, "p", model="m", split="val", sampling_rate=0.5).first()
    p = np.array([x[1] for x in rows]); y = np.array([x[2] for x in rows])
    q = np.clip(p / (p + (1 - p) / 0.5), 1e-12, 1 - 1e-12)
    assert abs(r.log_loss - float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())) < 1e-9
    assert abs(r.auc - brute_auc(rows)) < 1e-12 and r.n_rows == len(rows) and 0 <= r.ece <= 1


@pytest.mark.parametrize("groups", [(), ("g",)])
def test_running_totals_and_quantiles_with_a_hot_group(spark, groups):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.1 else ("hot" if rng.random() < 0.6 else str(rng.randrange(5))),
             rng.random() if rng.random() < 0.7 else 0.5, i, rng.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, i long, c long")
    pdf = pd.DataFrame(rows, columns=["g", "v", "i", "c"]).fillna({"g": "none"}).sort_values(["v", "i"])
    want = (pdf.groupby("g")["c"].cumsum() if groups else pdf["c"].cumsum())
    out = prefix.running_totals(df, ["v", "i"], {"upto": "c"}, groups)
    got = {r.i: r.upto for r in out.collect()}
    assert got == dict(zip(pdf["i"], want))
    probs = [0.0, 0.05, 0.5, 0.93, 1.0]
    for r in prefix.exact_quantiles(df, "v", probs, groups).collect():
        part = pdf if not groups else pdf[pdf["g"] == (r.g or "none")]
        assert np.allclose(r.quantiles, np.quantile(part["v"], probs))


def test_split_rules(spark):
    assert split.season_split(2).range_of("val") == ("2013-06-11", "2013-06-11")
    for season in (1, 3):
        with pytest.raises(NotImplementedError):
            split.season_split(season)
    with pytest.raises(ValueError):
        split.season_split(2).range_of("dev")
    days = [dt.date(2013, 6, 6) + dt.timedelta(days=i) for i in range(8)]
    got = {r.date: r.n_splits for r in split.split_coverage(
        spark.createDataFrame([(d,) for d in days], "date date"), split.season_split(2)).collect()}
    assert [got[d] for d in days] == [1] * 7 + [0]


def test_label_join_does_not_multiply_or_leak(spark):
    imp = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "bidid string, i int")
    clk = spark.createDataFrame([("a", 9.0), ("a", 9.5), ("z", 1.0), (None, 2.0)], "bidid string, payprice double")
    out = labels.with_label(imp, clk)
    assert out.columns == ["bidid", "i", "click"]
    assert sorted((r.i, r.click) for r in out.collect()) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert tuple(labels.label_counts(imp, clk).first()) == (4, 2)


def test_price_agreement_equals_the_pairwise_join(spark):
    rng = random.Random(0)
    make = lambda n: [(rng.choice("aabcd"), rng.randrange(2), rng.randrange(2)) for _ in range(n)]
    a, b = make(200), make(60)
    df = [spark.createDataFrame(x, "bidid string, bidprice int, payprice int") for x in (a, b)]
    pairs = [(x, y) for x in a for y in b if x[0] == y[0]]
    r = labels.price_agreement(*df).first()
    assert r.joined_rows == len(pairs) and r.bidprice_differs == sum(x[1] != y[1] for x, y in pairs)
    assert r.click_price_zero == sum(x[2] != y[2] and y[2] == 0 for x, y in pairs)


def test_rare_is_not_unseen(spark):
    train = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)] * 5, "domain string").withColumn(
        "timestamp", F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"))
    indexed = features.index_vocabulary(features.vocabulary(train, ["domain"]))
    test = spark.createDataFrame([("a",), ("b",), (None,), ("new",)], "domain string").withColumn(
        "timestamp", F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"))
    got = {r.domain: r.domain_idx for r in features.encode_indices(test, indexed, ["domain"]).collect()}
    assert got == {None: 0, "a": 1, "b": 2, "new": None}
    s = features.vocabulary_summary(features.vocabulary(train, ["domain"])).first()
    assert (s.n_values, s.n_rare_folded, s.cardinality) == (3, 1, 3)


def test_seen_flags_and_partition(spark):
    cols = "domain string, slotid string, creative string, y_true int, p double"
    train = spark.createDataFrame([("d", "s", "c", 0, 0.1), (None, "s", "c", 0, 0.1)], cols)
    test = spark.createDataFrame([("d", "s", "c", 1, 0.9), (None, "s", "c", 0, 0.2), ("x", "s", "c", 1, 0.3), ("d", "s", "q", 0, 0.4)], cols)
    flagged = overlap.flag_seen(test, train)
    assert [r.seen for r in flagged.orderBy(F.desc("p")).collect()] == [True, False, False, True]
    stats = overlap.bucket_stats(flagged, "p")
    overlap.require_partition(stats, test)
    with pytest.raises(AssertionError):
        overlap.require_partition(stats.where("seen"), test)
    same = overlap.same_rows(train, test, ["domain", "slotid", "creative"]).first()
    assert (same.only_a, same.only_b, same.different_count) == (0, 2, 0)


def root(df, column, output):
    return df.withColumn(output, F.sqrt(column))


def identity(df, column, output):
    return df.withColumn(output, F.col(column))


def audited(spark, calibrator=root, rate=0.02):
    df = spark.range(1, 51).select((F.col("id") / 60).alias("p_raw"))
    df = df.withColumn("p_calibrated", prob.recalibrate(F.col("p_raw"), rate))
    return calibrator(df, "p_calibrated", "p_isotonic")


def test_correction_order_audit(spark):
    good = audited(spark)
    calibrate.require_correction_order(calibrate.correction_audit(good, root, sampling_rate=0.02, fit_split="val"))
    cases = [(good, root, 0.5, "val"), (good.withColumn("p_calibrated", F.col("p_calibrated") * 3), root, 0.02, "val"),
             (audited(spark, identity), root, 0.02, "val"), (audited(spark, identity, 1.0), identity, 1.0, "val"),
             (good, root, 0.02, "test")]
    for df, cal, rate, fit in cases:
        with pytest.raises(AssertionError):
            calibrate.require_correction_order(calibrate.correction_audit(df, cal, sampling_rate=rate, fit_split=fit))
    with pytest.raises(ValueError):
        calibrate.same_provenance({"model": "a", "sampling_rate": 0.1}, {"model": "a", "sampling_rate": 0.2})


def test_isotonic_is_monotone_and_clips(spark):
    rng = random.Random(2)
    val = spark.createDataFrame([(round(x, 2), int(rng.random() < x * x)) for x in (rng.uniform(0.2, 0.8) for _ in range(2000))],
                                "p double, y_true int")
    model = calibrate.fit_isotonic(val, "p")
    test = spark.range(101).select((F.col("id") / 100).alias("p"))
    got = [r.p_isotonic for r in calibrate.apply_isotonic(test, model, "p").orderBy("p").collect()]
    assert got == sorted(got) and got[0] == got[20] and got[-1] == got[80] and abs(got[50] - 0.25) < 0.1


def test_models_find_a_signal(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        adv, tag = rng.randrange(4), rng.randrange(3)
        click = int(rng.random() < 0.1 + 0.25 * adv * (adv != 2))
        rows.append((i, f"b{i}", dt.datetime(2024, 1, 1, i % 24), str(adv), [tag], rng.randrange(100), click))
    df = spark.createDataFrame(rows, "event_id long, bidid string, timestamp timestamp_ntz, advertiser string, "
                                     "usertag array<int>, slotprice int, click int")
    for f in ("region", "city", "adexchange", "slotvisibility", "slotformat", "domain", "url", "slotid", "creative",
              "useragent", "IP", "userid"):
        df = df.withColumn(f, F.lit(None).cast("string"))
    df = df.withColumns({"slotwidth": F.lit(300), "slotheight": F.lit(None).cast("int")})
    train, val = df.where("event_id % 3 > 0"), df.where("event_id % 3 = 0")
    linear = models.LinearSearch(train, val, 1.0, keys=["event_id"], c_grid=[0.1, 10.0], dimension=1 << 10, max_iter=20)
    assert linear.records.count() == 2 and linear.records.agg(F.min("auc")).first()[0] > 0.6
    trees = models.TreeSearch(train, val, 1.0, keys=["event_id"], rounds=3,
                              grid={"stumpy": models.TREE_GRID["stumpy"]})
    assert trees.records.first().auc > 0.6
    assert trees.score(val).where("p_raw between 0 and 1").count() == val.count()


def test_trees_go_on_for_small_gains_and_no_tags_merge(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, dt.datetime(2024, 1, 1, i % 24), str(i % 4), [i % 600, 7], int(rng.random() < 0.1 + 0.2 * (i % 4 == 1))) for i in range(1800)]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp_ntz, advertiser string, usertag array<int>, click int")
    for f in ("region", "city", "adexchange", "slotvisibility", "slotformat", "domain", "url", "slotid", "creative",
              "useragent", "IP", "userid"):
        df = df.withColumn(f, F.lit(None).cast("string"))
    df = df.withColumns({n: F.lit(1) for n in ("slotwidth", "slotheight", "slotprice")})
    # Validation rows as in training: every round gains, though seldom one per cent of the loss.
    trees = models.TreeSearch(df, df, 1.0, keys=["event_id"], rounds=5, grid={"one": dict(maxDepth=2, stepSize=0.02)})
    assert trees.records.first().n_trees == 5
    slots = trees._encode(df).select("features").first().features.size
    empty = trees._encode(df.where("false"))
    assert slots == 2 * len(trees.fields) + 1 + 3 + 600 and empty.count() == 0
    trees.save(spark, str(tmp_path / "t"))
    again = models.load_search(spark, str(tmp_path / "t"))
    assert again.score(df).exceptAll(trees.score(df)).count() == 0


def sweep_results(spark, **changes):
    rows = []
    for adv in ("10", "9"):
        for s, labels_ in (("constant", 6), ("random", 4), ("linear_ctr", 6)):
            from bidlens.operators.sweep import label_order
            for i, label in enumerate(label_order(s)):
                rows.append((adv, f"{s}:{label}", "1/8", 0.125, 100.0, s, label, i, 5 if i in (1, 2) else i % 2, 0.5, 40, 8.0,
                             False, None, [0.1] * 24))
    return spark.createDataFrame(rows, (
        "advertiser string, run_id string, budget_id string, budget_fraction double, budget double, strategy string, "
        "label string, grid_pos int, clicks_won long, win_rate_pool double, total_spend long, effective_cpc double, "
        "budget_exhausted boolean, exhaustion_timestamp timestamp_ntz, hourly_spend_fraction array<double>")).withColumn(
        "params", F.struct(F.lit(1.0).alias("amount"), F.lit(None).cast("double").alias("low"),
                           F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("base")))


def test_report_rules(spark):
    res = sweep_results(spark)
    best = report.headline(res)
    assert {r.grid_pos for r in best.collect()} == {1} and best.count() == 6       # first in grid order wins a tie
    cells = report.dashboard_cells(res)
    assert cells.count() == 2
    points = cells.first().strategies
    assert [p.label for p in points.random] == ["q10-q50", "q25-q75", "q50-q90", "q10-q95"]
    assert points.constant[0].spend_trajectory_fen == [10.0] * 24
    text = [r.json for r in report.dashboard_json(cells, report.dashboard_meta(cells, 2, ("a", "b"))).collect()]
    assert '"n_leaf_records":32' in text[0] and '"advertiser":"9"' in text[1] and '"advertiser":"10"' in text[2]
    assert report.cell(cells, "9", "1/8").count() == 1
    for broken in (res.where("label <> 'q25'"), res.where("not (advertiser = '9' and strategy = 'random')"),
                   res.withColumn("budget_exhausted", F.lit(True)), res.unionByName(res.limit(1))):
        with pytest.raises(ValueError):
            report.dashboard_cells(broken)
    for bad in (res.withColumn("budget_fraction", F.lit(0.3)), res.withColumn("win_rate_pool", F.lit(float("nan")))):
        with pytest.raises(Exception):
            report.sweep_points(bad).collect()


def test_verdicts(spark):
    table = spark.createDataFrame([(5, 3, 10, 10)], "payprice int, bidprice int, slotwidth int, slotheight int")
    verdict = lambda t: quality.validation_verdict(quality.validation_report(t)).first()
    assert (verdict({"a": table, "b": None}).verdict, verdict({"a": table}).exit_code) == ("anomalies", 1)
    clean = table.withColumn("payprice", F.lit(1))
    assert (verdict({"a": clean}).verdict, verdict({"a": clean}).exit_code) == ("pass", 0)
    with pytest.raises(ValueError):
        quality.validation_report({"a": None})


def test_concentration_parts_add_up(spark):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("b", 0), ("c", 1)], "advertiser string, payprice int")
    rows = profile.concentration(df, profile.ZERO_PRICE, ["advertiser"]).collect()
    assert abs(sum(r.share_of_hits for r in rows) - 1) < 1e-12 and abs(sum(r.share_of_rows for r in rows) - 1) < 1e-12


def test_stable_sample(spark):
    df = spark.range(10_000)
    a = split.stable_sample(df, 0.1, "id")
    assert a.exceptAll(split.stable_sample(df.repartition(9), 0.1, "id")).count() == 0 and 800 < a.count() < 1200
