import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bidlens.operators import auction, sweep
from bidlens.session import materialize

POOL = ("advertiser string, timestamp timestamp_ntz, bidid string, event_id long, payprice int, click int, p_click double")
START = dt.datetime(2013, 6, 6)


def pool(spark, prices, clicks=None, times=None, p=None, advertiser="1458"):
    n = len(prices)
    clicks, p = clicks or [0] * n, p or [0.5] * n
    times = times or [START + dt.timedelta(seconds=i) for i in range(n)]
    rows = [(advertiser, times[i], f"bid{i:04d}", i, prices[i], clicks[i], p[i]) for i in range(n)]
    return spark.createDataFrame(rows, POOL)


def runs(spark, *amounts, advertiser="1458"):
    rows = [(advertiser, f"r{i}", "constant", float(a)) for i, a in enumerate(amounts)]
    return spark.createDataFrame(rows, "advertiser string, run_id string, strategy string, amount double")


def budgets(spark, *values, advertiser="1458"):
    return spark.createDataFrame([(advertiser, str(i), float(b)) for i, b in enumerate(values)],
                                 "advertiser string, budget_id string, budget double")


def settle(spark, rows, bid, budget, tiebreak=("event_id",)):
    return auction.settle(rows, runs(spark, bid), budgets(spark, budget), tiebreak).first()


def test_hard_stop(spark):
    rows = pool(spark, [10, 10, 10, 1, 10], [0, 0, 0, 1, 0])
    r = settle(spark, rows, 100, 25)
    assert (r.impressions_won, r.impressions_bid_on, r.total_spend, r.clicks_won) == (2, 2, 20, 0)
    assert (r.exhaustion_index, r.budget_exhausted) == (2, True)
    assert r.exhaustion_timestamp == START + dt.timedelta(seconds=2)
    assert (r.win_rate_bid_on, r.win_rate_pool, r.effective_cpc) == (1.0, 0.4, None)
    t = auction.spend_trajectory(rows, runs(spark, 100), budgets(spark, 25), ["event_id"]).orderBy("event_id")
    assert [x.cumulative_spend for x in t.collect()] == [10, 20, 20, 20, 20]


def test_never_exhausted(spark):
    r = settle(spark, pool(spark, [10, 10, 10, 1, 10], [0, 0, 0, 1, 0]), 100, 1_000_000)
    assert (r.impressions_won, r.total_spend, r.win_rate_bid_on, r.win_rate_pool) == (5, 41, 1.0, 1.0)
    assert (r.exhaustion_index, r.exhaustion_timestamp, r.effective_cpc) == (None, None, 41.0)


@pytest.mark.parametrize("bid,won,spend", [(100, 1, 100), (99, 0, 0), (500, 1, 100)])
def test_price_boundary(spark, bid, won, spend):
    r = settle(spark, pool(spark, [100]), bid, 1000)
    assert (r.impressions_won, r.total_spend) == (won, spend)


def test_budget_boundary(spark):
    r = settle(spark, pool(spark, [10, 10]), 100, 20)
    assert (r.impressions_won, r.budget_exhausted) == (2, False)
    r = settle(spark, pool(spark, [10, 10]), 100, 0)
    assert (r.impressions_won, r.impressions_bid_on, r.budget_exhausted, r.exhaustion_index) == (0, 0, True, 0)
    assert r.win_rate_bid_on == 0.0


def test_zero_bids_and_empty_pool(spark):
    r = settle(spark, pool(spark, [10, 20, 30], [1, 0, 1]), 0, 1000)
    assert (r.impressions_won, r.total_spend, r.clicks_won, r.win_rate_pool, r.effective_cpc) == (0, 0, 0, 0.0, None)
    r = settle(spark, pool(spark, [10]).where("payprice < 0"), 10, 1000)
    assert (r.impressions_pool, r.impressions_won, r.win_rate_bid_on, r.win_rate_pool) == (0, 0, 0.0, 0.0)


def test_bad_bids_and_budgets_raise(spark):
    for bid, budget in ((-1, 10), (float("nan"), 10), (10, -5)):
        with pytest.raises(Exception, match="at least 0"):
            settle(spark, pool(spark, [10]), bid, budget)
    bad = runs(spark, 1).select("advertiser", "run_id", F.lit("random").alias("strategy"),
                                F.lit(5.0).alias("low"), F.lit(2.0).alias("high"))
    with pytest.raises(Exception, match="at least 0"):
        auction.settle(pool(spark, [10]), bad, budgets(spark, 10)).collect()


def test_exclusion_rules(spark):
    strict = spark.createDataFrame([(10, 20), (25, 20), (5, 5), (40, 30), (8, 8), (100, 90), (3, 30)],
                                   "payprice int, bidprice int").withColumn("advertiser", F.lit("a"))
    c = auction.exclusion_counts(strict).first()
    assert c.excluded_payprice_gt_bidprice_count == 3 and abs(c.excluded_payprice_gt_bidprice_share - 3 / 7) < 1e-12
    assert sorted(r.payprice for r in auction.exclude_unsimulatable(strict).collect()) == [3, 5, 8, 10]
    both = spark.createDataFrame([(10, 20), (25, 20), (0, 5), (0, 30), (8, 8), (9, 90), (3, 30), (1, 1)],
                                 "payprice int, bidprice int").withColumn("advertiser", F.lit("a"))
    c = auction.exclusion_counts(both).first()
    assert (c.excluded_payprice_gt_bidprice_share, c.excluded_payprice_zero_share, c.n_pool) == (1 / 8, 2 / 8, 5)
    with pytest.raises(Exception, match="both exclusion rules"):
        auction.exclusion_counts(spark.createDataFrame([("a", 0, -5)], "advertiser string, payprice int, bidprice int")).collect()


def test_scope_checks(spark):
    with pytest.raises(ValueError, match="numbers"):
        auction.check_advertiser("1458; drop")
    empty = pool(spark, [1]).where("false")
    with pytest.raises(ValueError, match="no impressions"):
        auction.require_rows(empty, "x")


def preds(spark, rows):
    return spark.createDataFrame(rows, "bidid string, advertiser string, timestamp timestamp_ntz, p_isotonic double")


def test_alignment_by_key(spark):
    rows = pool(spark, [1, 1, 1]).drop("p_click")
    times = [START + dt.timedelta(seconds=i) for i in range(3)]
    table = preds(spark, [(f"bid{i:04d}", "1458", times[i], 0.1 * (i + 1)) for i in (2, 0, 1)]
                  + [("bid0000", "3358", times[0], 0.9)])
    got = {r.event_id: round(r.p_click, 6) for r in auction.align_predictions(rows, table).collect()}
    assert got == {0: 0.1, 1: 0.2, 2: 0.3}
    clash = preds(spark, [("bid0000", "1458", START, 0.2), ("bid0000", "1458", START, 0.6)])
    one = rows.where("event_id = 0")
    assert abs(auction.align_predictions(one, clash).first().p_click - 0.4) < 1e-12
    report = auction.alignment_report(one, clash)
    assert report.first().colliding_keys == 1
    auction.require_aligned(report, max_share=1.0)
    with pytest.raises(ValueError, match="line up"):
        auction.require_aligned(report)
    with pytest.raises(Exception, match="no matching prediction"):
        auction.align_predictions(rows, clash).collect()


def brute_force(rows, bid_of, budget):
    spent = won = clicks = on = 0
    stop = None
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        wins = bid_of(r) >= r[4]
        if wins and spent + r[4] > budget:
            stop = r[1]
            break
        on += 1
        if wins:
            spent, won, clicks = spent + r[4], won + 1, clicks + r[5]
    return on, won, clicks, spent, stop


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force_with_hot_groups(spark, seed):
    """A third of all rows share one instant, many rows are exact copies, ids share prefixes."""
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        hot = rng.random() < 0.35
        when = START + (dt.timedelta(hours=5, seconds=7) if hot else dt.timedelta(seconds=rng.randrange(80_000)))
        rows.append((rng.choice("12"), when, f"{rng.randrange(300):04d}", rng.randrange(3), rng.randrange(0, 30),
                     int(rng.random() < 0.2), rng.random()))
    rows += [("1", START + dt.timedelta(hours=5, seconds=7), "0042", 1, 11, 1, 0.25)] * 200
    df = materialize(spark.createDataFrame(rows, POOL).repartition(8), "brute")
    table = spark.createDataFrame(
        [(a, "c", "constant", 15.0, None) for a in "12"] + [(a, "l", "linear_ctr", None, 40.0) for a in "12"],
        "advertiser string, run_id string, strategy string, amount double, base double")
    limits = [0.0, 37.0, 500.5, 1500.0, 2600.0, 1e9]
    money = spark.createDataFrame([(a, str(i), b) for a in "12" for i, b in enumerate(limits)],
                                  "advertiser string, budget_id string, budget double")
    got = {(r.advertiser, r.run_id, r.budget_id): r for r in auction.settle(
        df, table, money, ["event_id"]).collect()}
    assert len(got) == 24
    for (adv, run, b), r in got.items():
        mine = [x for x in rows if x[0] == adv]
        # equal order keys with different prices need the same order in both: price, click, probability
        mine.sort(key=lambda x: (x[1], x[2], x[3], x[4], x[5], x[6]))
        bid_of = (lambda x: 15.0) if run == "c" else (lambda x: 40.0 * x[6])
        want = brute_force(mine, bid_of, limits[int(b)])
        assert (r.impressions_bid_on, r.impressions_won, r.clicks_won, r.total_spend, r.exhaustion_timestamp) == want
        assert r.total_spend <= r.budget and r.impressions_pool == len(mine)


@pytest.mark.parametrize("seed", [0, 1])
def test_settlement_is_the_end_of_the_trajectory(spark, seed):
    """Rows without a time, equal instants, and one instant and id that hold most of the pool."""
    rng = random.Random(seed)
    rows = [("1", rng.choice([None, START, START + dt.timedelta(seconds=rng.randrange(9000))]), f"{rng.randrange(40):03d}",
             rng.randrange(2), rng.randrange(0, 30), int(rng.random() < 0.3), 0.5) for _ in range(150)]
    rows += [("1", START, "hot", 0, 9, 1, 0.5)] * 400
    df = materialize(spark.createDataFrame(rows, POOL).repartition(5), "nulls")
    run = spark.createDataFrame([("1", "c", "constant", 15.0)], "advertiser string, run_id string, strategy string, amount double")
    late = sorted(rows, key=lambda r: (r[1] is None, r[1] or START, *r[2:6]))
    for limit in (0.0, 20.0, 900.0, 3700.0, 4300.0, 1e9):
        money = spark.createDataFrame([("1", "b", limit)], "advertiser string, budget_id string, budget double")
        r = auction.settle(df, run, money, ["event_id"]).first()
        path = auction.spend_trajectory(df, run, money, ["event_id"]).agg(
            F.sum("bid_on"), F.max("cumulative_spend"), F.sum(F.when(F.col("win"), F.col("bid_on")).otherwise(0))).first()
        spent = on = won = 0
        for row in late:
            if row[4] <= 15 and spent + row[4] > limit:
                break
            on, won, spent = on + 1, won + (row[4] <= 15), spent + row[4] * (row[4] <= 15)
        assert tuple(path) == (on, spent, won) == (r.impressions_bid_on, r.total_spend, r.impressions_won)
        assert r.budget_exhausted == (on < len(rows)) and r.impressions_pool == len(rows)


def test_random_bids_do_not_depend_on_partitioning(spark):
    rows = pool(spark, [random.Random(1).randrange(1, 50) for _ in range(200)])
    run = spark.createDataFrame([("1458", "r", "random", 5.0, 40.0, 1)],
                                "advertiser string, run_id string, strategy string, low double, high double, range_index int")
    a = auction.settle(rows.repartition(1), run, budgets(spark, 300), ["event_id"]).collect()
    b = auction.settle(rows.repartition(13, "bidid"), run, budgets(spark, 300), ["event_id"]).collect()
    assert a == b


def test_equal_bounds_are_a_constant(spark):
    run = spark.createDataFrame([("1458", "r", "random", 10.0, 10.0, 0)],
                                "advertiser string, run_id string, strategy string, low double, high double, range_index int")
    r = auction.settle(pool(spark, [10, 11]), run, budgets(spark, 100), ["event_id"]).first()
    assert r.impressions_won == 1


def test_zero_mean_probability_is_refused(spark):
    stats = spark.createDataFrame([("1458", [1.0] * 6, 0.0, 10)],
                                  "advertiser string, quantiles array<double>, mean_p_click double, historical_spend long")
    grid = sweep.sweep_grid(stats)
    assert grid.count() == 16 and grid.where("strategy = 'linear_ctr' and base is null").count() == 6
    with pytest.raises(Exception, match="at least 0"):
        auction.settle(pool(spark, [10], p=[0.0]), grid, budgets(spark, 10)).collect()


def test_hourly_spend_carries_forward(spark):
    times = [START + dt.timedelta(hours=h) for h in (2, 2, 5, 9)]
    rows = pool(spark, [10, 10, 10, 10], times=times)
    hours = auction.hourly_outcome(rows, runs(spark, 100), ["event_id"])
    results = auction.settle(rows, runs(spark, 100), budgets(spark, 35), ["event_id"], hours=hours)
    out = auction.hourly_spend(hours, results, auction.pool_dates(rows)).orderBy("hour_of_day").collect()
    want = [0.0] * 2 + [20 / 35] * 3 + [30 / 35] * 19
    assert [round(r.spend_fraction, 9) for r in out] == [round(x, 9) for x in want]
    zero = auction.settle(rows, runs(spark, 100), budgets(spark, 0), ["event_id"], hours=hours)
    assert {r.spend_fraction for r in auction.hourly_spend(hours, zero, auction.pool_dates(rows)).collect()} == {0.0}
