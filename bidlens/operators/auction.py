"""Second-price replay of logged auctions under a hard budget.

Rules: a bid of at least the logged price wins and pays that price.  Wins are
honoured in pool order (time, id, tiebreak).  The first win that would pass the
budget is void, and from that row on the bidder takes no part at all.

Rows without a time come last.

Costs are never negative, so the running cost only grows and "still bidding" is
the same as "running cost within budget".  To find the last row of each run the
pool is not sorted: costs are summed per hour, then per second of the one hour in
which the budget gives out, both map-side.  The rows of that second alone are
ordered, by range-partitioned running totals over folded equal rows, so neither a
large advertiser nor a burst of rows in one instant ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.functions.cleaning import unit_interval
from bidlens.functions.probability import safe_ratio
from bidlens.operators.labels import with_label
from bidlens.operators.prefix import running_totals
from bidlens.session import materialize

ABOVE_BID, ZERO_PRICE = "payprice_gt_bidprice", "payprice_zero"
MAX_COLLIDING_SHARE = 1e-4
NO_TIME_HOUR = 48_000_000  # after any hour; stands for rows without a time
STRATEGIES = ["constant", "random", "linear_ctr"]
RUN_KEY = ["advertiser", "run_id"]
CELL_KEY = [*RUN_KEY, "budget_id"]
SUMS = ["n", "won", "clicks", "cost"]


# --- Pool -------------------------------------------------------------------

def exclusion_rule(payprice: Column, bidprice: Column) -> Column:
    """Which of the two disjoint rules removes a row, NULL if none does."""
    above = F.coalesce(payprice > bidprice, F.lit(False))
    zero = F.coalesce(payprice == 0, F.lit(False))
    return (F.when(above & zero, F.raise_error(F.lit("a row matches both exclusion rules")))
            .when(above, ABOVE_BID).when(zero, ZERO_PRICE))


def exclusion_counts(rows: DataFrame, by: Sequence[str] = ("advertiser",),
                     label: str | None = None) -> DataFrame:
    """Loaded rows, rows removed by each rule and their shares of the loaded total.

    With ``label`` also the positives each rule removes.
    """
    flagged = rows.withColumn("_rule", exclusion_rule(F.col("payprice"), F.col("bidprice")))
    parts = [F.count("*").alias("n_loaded")]
    for rule in (ABOVE_BID, ZERO_PRICE):
        hit = F.coalesce(F.col("_rule") == rule, F.lit(False))
        parts.append(F.count_if(hit).alias(f"excluded_{rule}_count"))
        if label:
            parts.append(F.coalesce(F.sum(F.when(hit, F.col(label))), F.lit(0))
                         .alias(f"positives_lost_{rule}"))
    parts.append(F.count_if(F.col("_rule").isNull()).alias("n_pool"))
    if label:
        parts.append(F.sum(label).alias("positives_loaded"))
    out = flagged.groupBy(*by).agg(*parts)
    return out.withColumns({
        f"excluded_{rule}_share": safe_ratio(F.col(f"excluded_{rule}_count"), F.col("n_loaded"), 0.0)
        for rule in (ABOVE_BID, ZERO_PRICE)})


def exclude_unsimulatable(rows: DataFrame) -> DataFrame:
    return rows.where(exclusion_rule(F.col("payprice"), F.col("bidprice")).isNull())


def check_advertiser(advertiser: int | str) -> str:
    text = str(advertiser)
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"advertiser ids are numbers, got {advertiser!r}")
    return text


def loaded_rows(impressions: DataFrame, clicks: DataFrame, *, seasons: Sequence[int],
                date_range: tuple[str, str] | None = None, advertiser: int | str | None = None,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """Labelled impressions in scope with the columns a replay needs, before exclusions."""
    if not seasons:
        raise ValueError("name at least one season")
    scope = F.col("season").isin(*[int(s) for s in seasons])
    if date_range is not None:
        scope = scope & F.col("date").between(*[F.lit(d).cast("date") for d in date_range])
    if advertiser is not None:
        scope = scope & (F.col("advertiser") == check_advertiser(advertiser))
    columns = ["advertiser", "date", "timestamp", "bidid", *tiebreak, "payprice", "bidprice"]
    return with_label(impressions.where(scope).select(*columns), clicks)


def auction_pool(impressions: DataFrame, clicks: DataFrame, **scope) -> DataFrame:
    """The rows that can be replayed.  Advertisers share the table but never a run."""
    return exclude_unsimulatable(loaded_rows(impressions, clicks, **scope)).drop("bidprice")


def require_rows(pool: DataFrame, what: str) -> DataFrame:
    if pool.isEmpty():
        raise ValueError(f"no impressions for {what}: check the advertiser, seasons and dates")
    return pool


def advertisers_in_scope(impressions: DataFrame, seasons: Sequence[int],
                         date_range: tuple[str, str] | None = None) -> DataFrame:
    scope = F.col("season").isin(*[int(s) for s in seasons])
    if date_range is not None:
        scope = scope & F.col("date").between(*[F.lit(d).cast("date") for d in date_range])
    return impressions.where(scope).select("advertiser").distinct().orderBy("advertiser")


def price_quantiles(pool: DataFrame, probs: Sequence[float], by: str = "advertiser") -> DataFrame:
    """Exact interpolated price quantiles of every advertiser at once.

    Prices are whole numbers in a narrow range: counting per price first keeps
    the quantile state small for any number of rows.
    """
    counts = pool.groupBy(by, "payprice").agg(F.count("*").alias("_n"))
    return counts.groupBy(by).agg(
        F.percentile("payprice", F.array(*[F.lit(p) for p in probs]), F.col("_n")).alias("quantiles"))


def historical_spend(pool: DataFrame, by: str = "advertiser") -> DataFrame:
    return pool.groupBy(by).agg(F.sum("payprice").alias("historical_spend"))


def pool_statistics(pool: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Price quantiles, spend and (when there) mean ``p_click`` per advertiser, in one scan."""
    has_p = "p_click" in pool.columns
    counts = pool.groupBy("advertiser", "payprice").agg(
        F.count("*").alias("_n"), *([F.sum("p_click").alias("_p")] if has_p else []))
    price, n = F.col("payprice"), F.col("_n")
    parts = [F.sum(n).alias("n_pool"), F.sum(price * n).alias("historical_spend"),
             F.percentile("payprice", F.array(*[F.lit(p) for p in probs]), n).alias("quantiles")]
    if has_p:
        parts.append((F.sum("_p") / F.sum(n)).alias("mean_p_click"))
    return counts.groupBy("advertiser").agg(*parts)


def oracle_cost(pool: DataFrame, by: str = "advertiser") -> DataFrame:
    """Price of winning exactly the clicked rows; median price of clicked and of all rows."""
    counts = pool.groupBy(by, "payprice").agg(F.count("*").alias("_n"), F.sum("click").alias("_c"))
    clicked = F.when(F.col("_c") > 0, F.col("payprice"))
    return counts.groupBy(by).agg(
        F.sum("_c").alias("clicks"), F.sum(F.col("payprice") * F.col("_c")).alias("oracle_cost"),
        F.percentile(clicked, 0.5, F.col("_c")).alias("median_price_clicked"),
        F.percentile("payprice", 0.5, F.col("_n")).alias("median_price_all"))


# --- Predictions onto pool rows ----------------------------------------------

PREDICTION_KEY = ["advertiser", "bidid", "timestamp"]


def align_predictions(pool: DataFrame, predictions: DataFrame, score: str = "p_isotonic") -> DataFrame:
    """Adds ``p_click`` by key; predictions that share a key are averaged.

    A pool row without prediction stops the job, as does an undefined or
    negative probability.
    """
    per_key = predictions.groupBy(*PREDICTION_KEY).agg(F.avg(score).alias("p_click"),
                                                       F.count("*").alias("_found"))
    joined = pool.join(per_key, PREDICTION_KEY, "left")
    p = F.col("p_click")
    checked = (F.when(F.col("_found").isNull(), F.raise_error(F.lit("no matching prediction for a pool row")))
               .when(p.isNull() | F.isnan(p) | (p < 0), F.raise_error(F.lit("p_click must be a probability")))
               .otherwise(p))
    return joined.withColumn("p_click", checked).drop("_found")


def alignment_report(pool: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per advertiser: rows and keys on both sides, keys that collide, keys without partner."""
    left = pool.groupBy(*PREDICTION_KEY).agg(F.count("*").alias("_pool"))
    right = predictions.groupBy(*PREDICTION_KEY).agg(F.count("*").alias("_pred"))
    both = left.join(right, PREDICTION_KEY, "full")
    return both.groupBy("advertiser").agg(
        F.coalesce(F.sum("_pool"), F.lit(0)).alias("pool_rows"),
        F.coalesce(F.sum("_pred"), F.lit(0)).alias("prediction_rows"),
        F.count_if(F.col("_pred") > 1).alias("colliding_keys"),
        F.coalesce(F.sum(F.when(F.col("_pred").isNull(), F.col("_pool"))), F.lit(0)).alias("pool_unmatched"),
        F.coalesce(F.sum(F.when(F.col("_pool").isNull(), F.col("_pred"))), F.lit(0)).alias("predictions_unused"))


def require_aligned(report: DataFrame, max_share: float = MAX_COLLIDING_SHARE) -> None:
    """Stops where a pool row has no prediction or more than ``max_share`` of the predictions collide."""
    broken = report.where((F.col("pool_unmatched") > 0)
                          | (F.col("colliding_keys") > max_share * F.col("prediction_rows")))
    found = broken.limit(5).collect()
    if found:
        raise ValueError(f"predictions do not line up with the pool: {found}")


# --- Bids --------------------------------------------------------------------

RUN_FIELDS = {"strategy": "string", "amount": "double", "low": "double", "high": "double",
              "range_index": "int", "base": "double"}
RUN_STRUCT = f"struct(run_id, {', '.join(RUN_FIELDS)})"


def bid_amount(tiebreak: Sequence[str], seed: int, has_probability: bool) -> Column:
    """The bid of a pool row under the run in struct column ``run``.

    A random bid depends on seed, advertiser, range and row key only, so it is
    the same for every budget, partitioning and retry.
    """
    u = unit_interval(F.lit(seed), F.col("advertiser"), F.col("run.range_index"), F.col("bidid"),
                      F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                      *[F.col(t) for t in tiebreak])
    linear = "run.base * p_click" if has_probability else "double(null)"
    constant = F.when(F.col("run.strategy") == "constant", F.col("run.amount"))
    uniform = F.expr("run.strategy = 'random' and run.low between 0 and run.high")
    return (constant.when(uniform, F.expr("run.low") + F.expr("run.high - run.low") * u)
            .when(F.col("run.strategy") == "linear_ctr", F.expr(linear)))


def complete_runs(runs: DataFrame) -> DataFrame:
    """Runs with every parameter column, NULL where a strategy has no use for it."""
    have = set(runs.columns)
    return runs.selectExpr(*RUN_KEY, *[
        f"cast({c if c in have else 'null'} as {t}) as {c}" for c, t in RUN_FIELDS.items()])


def _outcome(rows: DataFrame, tiebreak: Sequence[str], seed: int) -> DataFrame:
    """Adds the bid's result; a run that gives a row no valid bid stops the job."""
    bid = bid_amount(tiebreak, seed, "p_click" in rows.columns)
    checked = "if(_bid >= 0 and not isnan(_bid), _bid, raise_error('every bid must be at least 0'))"
    win = rows.withColumn("_bid", bid).withColumn("_win", F.expr(f"coalesce({checked} >= payprice, false)"))
    return win.withColumn("_cost", F.expr("cast(if(_win, payprice, 0) as bigint)"))


def _cell_sums() -> list[Column]:
    return [F.expr(text) for text in (
        "count(*) as n", "sum(cast(_win as bigint)) as won",
        "sum(cast(if(_win, click, 0) as bigint)) as clicks", "sum(_cost) as cost")]


# --- Settlement --------------------------------------------------------------

def hour_number(timestamp: Column) -> Column:
    """Hours since 1970 on the local clock (no time zone is involved); no time is an hour after all others."""
    days = F.datediff(F.to_date(timestamp), F.lit("1970-01-01").cast("date"))
    return F.coalesce(days.cast("long") * 24 + F.hour(timestamp), F.lit(NO_TIME_HOUR).cast("long"))


def second_number(timestamp: Column) -> Column:
    within = F.minute(timestamp) * 60 + F.second(timestamp)
    return hour_number(timestamp) * 3600 + F.coalesce(within, F.lit(0))


def check_budgets(budgets: DataFrame) -> DataFrame:
    bad = F.col("budget").isNull() | (F.col("budget") < 0)
    return budgets.withColumn("budget", F.when(
        bad, F.raise_error(F.lit("a budget must be at least 0"))).otherwise(F.col("budget").cast("double")))


def _pack(runs: DataFrame) -> DataFrame:
    """One row per advertiser with its (few) runs, so that a pool row meets them
    by an equi-join on advertiser.  Built from a stored table, it has a known size."""
    return complete_runs(runs).groupBy("advertiser").agg(F.expr(f"collect_list({RUN_STRUCT}) as runs"))


def hourly_outcome(pool: DataFrame, runs: DataFrame, tiebreak: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Rows, wins, clicks and cost per run and hour as if money were no object,
    with the cost up to the end of each hour (``upto``).  This is the only pass
    over the whole pool; it shuffles sums, not rows."""
    rows = pool.join(_pack(runs), "advertiser").withColumn("run", F.explode("runs")).drop("runs")
    hours = _outcome(rows, tiebreak, seed).groupBy(
        "advertiser", "run", hour_number(F.col("timestamp")).alias("hour")).agg(*_cell_sums())
    stored = materialize(hours.withColumn("run_id", F.col("run.run_id")), "hours")
    upto = F.sum("cost").over(Window.partitionBy(*RUN_KEY).orderBy("hour").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    return stored.withColumn("upto", upto)


def _close_cells(cells: DataFrame, label: str) -> DataFrame:
    """Sums over the cells within budget, and the first cell (``cut``) that is not."""
    closed = cells.groupBy(*CELL_KEY, "run", "budget", "spent_before").agg(
        *[F.expr(f"coalesce(sum({c}) filter (where upto <= budget), 0) as {c}") for c in SUMS],
        F.expr("sum(n) as n_all"), F.expr("min(cell) filter (where upto > budget) as cut"))
    return materialize(closed, label)


def _rows_of_cuts(pool: DataFrame, closed: DataFrame, outer: Column) -> DataFrame:
    """The pool rows of the cut cells of ``closed``: an equi-join on advertiser and cell."""
    open_cells = closed.where(F.col("cut").isNotNull()).select(
        *CELL_KEY, "run", "budget", (F.col("spent_before") + F.col("cost")).alias("spent_before"),
        F.col("cut").alias("_outer"))
    return pool.withColumn("_outer", outer).join(open_cells, ["advertiser", "_outer"])


def _cut_seconds(pool: DataFrame, closed: DataFrame, tiebreak: Sequence[str], seed: int) -> DataFrame:
    """The seconds of the cut hours with their running cost."""
    rows = _rows_of_cuts(pool, closed, hour_number(F.col("timestamp")))
    finer = _outcome(rows.withColumn("cell", second_number(F.col("timestamp"))), tiebreak, seed).groupBy(
        *CELL_KEY, "run", "budget", "spent_before", "cell").agg(*_cell_sums())
    running = F.sum("cost").over(Window.partitionBy(*CELL_KEY).orderBy("cell").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    return finer.withColumn("upto", running + F.col("spent_before"))


# How many of the equal rows ending at running cost ``upto`` are still bid on.
AFFORDABLE = """cast(case when upto - cost > budget then 0 when cost = 0 then {copies}
    else greatest(0, least({copies}, floor((budget - (upto - cost)) * {copies} / nullif(cost, 0))))
    end as bigint)"""


def _in_order(rows: DataFrame, groups: Sequence[str], tiebreak: Sequence[str], seed: int, label: str) -> DataFrame:
    """Outcomes folded to equal rows in pool order, with the running cost ``upto`` and ``position``."""
    order = ["timestamp", "bidid", *tiebreak, "payprice", "click", *[c for c in ("p_click",) if c in rows.columns]]
    folded = _outcome(rows, tiebreak, seed).groupBy(*groups, *order).agg(
        F.expr("count(*) as copies"), F.expr("sum(_cost) as cost"), F.expr("first(_win) as win"))
    late = folded.withColumn("_late", F.col("timestamp").isNull())
    return running_totals(late, ["_late", *order], {"upto": "cost", "position": "copies"}, groups, label)


def _last_rows(rows: DataFrame) -> DataFrame:
    """Within the cut second, rows in order; equal rows are handled by number.

    ``k`` equal rows of cost ``c`` are taken while money lasts:
    ``floor((budget - spent) / c)`` of them, all if they cost nothing.
    """
    stepped = rows.withColumn("upto", F.expr("upto + spent_before")).withColumn(
        "_taken", F.expr(AFFORDABLE.format(copies="copies")))
    return stepped.groupBy(*CELL_KEY).agg(
        F.expr("sum(_taken) as n"), F.expr("sum(if(win, _taken, 0)) as won"),
        F.expr("sum(if(win, click * _taken, 0)) as clicks"), F.expr("sum(cost div copies * _taken) as cost"),
        F.expr("min(timestamp) filter (where _taken < copies) as stop"),
        F.expr("coalesce(bool_or(_taken < copies), false) as stopped"))


def settle(pool: DataFrame, runs: DataFrame, budgets: DataFrame, tiebreak: Sequence[str] = (),
           seed: int = 42, hours: DataFrame | None = None) -> DataFrame:
    """Outcome of every run under every budget of its advertiser, one row each.

    ``runs``: advertiser, run_id, strategy and its parameters.  ``budgets``:
    advertiser, budget_id, budget.  Both should be stored tables (see
    ``session.materialize``) unless they are literal.  Pass ``hours`` to reuse
    ``hourly_outcome``.
    """
    hours = hourly_outcome(pool, runs, tiebreak, seed) if hours is None else hours
    first = hours.join(check_budgets(budgets).select("advertiser", "budget_id", "budget"), "advertiser").withColumns(
        {"cell": F.col("hour"), "spent_before": F.lit(0).cast("long")})
    by_hour = _close_cells(first, "cut-hour")
    by_second = _close_cells(_cut_seconds(pool, by_hour, tiebreak, seed), "cut-second")
    rest = _last_rows(_in_order(_rows_of_cuts(pool, by_second, second_number(F.col("timestamp"))),
                                [*CELL_KEY, "budget", "spent_before"], tiebreak, seed, "cut-rows"))

    def gains(part: DataFrame, **more: Column) -> DataFrame:
        extra = {"impressions_pool": F.lit(0), "stop": F.lit(None), "stopped": F.lit(False), "budget": F.lit(None), **more}
        types = {"impressions_pool": "long", "stop": "timestamp_ntz", "stopped": "boolean", "budget": "double"}
        return part.select(*CELL_KEY, *SUMS, *[extra[c].cast(t).alias(c) for c, t in types.items()])

    # A run whose advertiser has no rows is still a result: nothing won, nothing spent.
    every = runs.select(*RUN_KEY).join(check_budgets(budgets), "advertiser")
    nothing = every.withColumns({c: F.lit(0).cast("long") for c in SUMS})
    total = gains(nothing, budget=F.col("budget"))
    for part in (gains(by_hour, impressions_pool=F.col("n_all")), gains(by_second),
                 gains(rest, stop=F.col("stop"), stopped=F.col("stopped"))):
        total = total.unionByName(part)
    return run_metrics(total.groupBy(*CELL_KEY).agg(
        *[F.sum(c).alias(c) for c in [*SUMS, "impressions_pool"]],
        F.max("stop").alias("stop"), F.bool_or("stopped").alias("stopped"), F.max("budget").alias("budget")))


def run_metrics(sums: DataFrame) -> DataFrame:
    def ratio(num: str, den: str, empty: str) -> str:
        return f"if({den} = 0, double({empty}), double({num}) / double(nullif({den}, 0)))"

    return sums.selectExpr(
        *CELL_KEY, "budget", "impressions_pool", "n as impressions_bid_on", "won as impressions_won",
        f"{ratio('won', 'n', '0')} as win_rate_bid_on",
        f"{ratio('won', 'impressions_pool', '0')} as win_rate_pool",
        "clicks as clicks_won", "cost as total_spend",
        f"{ratio('cost', 'clicks', 'null')} as effective_cpc",
        "stopped as budget_exhausted", "if(stopped, n, null) as exhaustion_index",
        "stop as exhaustion_timestamp")


def spend_trajectory(pool: DataFrame, runs: DataFrame, budgets: DataFrame, tiebreak: Sequence[str] = (),
                     seed: int = 42) -> DataFrame:
    """Cumulative spend after every pool row, flat once the money is gone.

    One budget per advertiser.  The output has every row, so here the pool is
    range-sorted and summed block by block; equal rows are one row with ``copies``.
    """
    params = materialize(complete_runs(runs).selectExpr("advertiser", "run_id", f"{RUN_STRUCT} as run").join(
        check_budgets(budgets).select("advertiser", "budget_id", "budget"), "advertiser"), "runs")
    order = ["timestamp", "bidid", *tiebreak, "payprice", "click"]
    running = _in_order(pool.join(params, "advertiser"), [*CELL_KEY, "budget"], tiebreak, seed, "trajectory")
    rows = running.withColumn("bid_on", F.expr(AFFORDABLE.format(copies="copies")))
    spent = "max(upto - cost + cost div copies * bid_on) filter (where bid_on > 0)"
    final = rows.groupBy(*CELL_KEY).agg(F.expr(f"coalesce({spent}, 0) as _final"))
    return rows.join(final, CELL_KEY).select(
        *CELL_KEY, "budget", *order, "copies", "win", "bid_on", "position",
        F.expr("if(bid_on = copies, upto, _final) as cumulative_spend"))


def hourly_spend(hours: DataFrame, results: DataFrame, dates: DataFrame) -> DataFrame:
    """Share of the budget spent by the end of every hour of every day of the pool.

    ``dates``: advertiser, first and last day.  Hours without rows carry the last
    value on; a zero budget gives zeros.
    """
    grid = (dates.withColumn("date", F.explode(F.sequence("first_date", "last_date")))
            .withColumn("hour_of_day", F.explode(F.sequence(F.lit(0), F.lit(23))))
            .select("advertiser", "date", "hour_of_day"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(hour div 24 as int)"))
    known = hours.select(*RUN_KEY, day.alias("date"),
                         (F.col("hour") % 24).cast("int").alias("hour_of_day"), "upto")
    slots = results.select(*CELL_KEY, "budget", "total_spend").join(grid, "advertiser").join(
        known, [*RUN_KEY, "date", "hour_of_day"], "left")
    spent = F.when(F.col("upto") <= F.col("budget"), F.col("upto")).when(
        F.col("upto").isNotNull(), F.col("total_spend"))
    carried = F.max(spent).over(Window.partitionBy(*CELL_KEY).orderBy("date", "hour_of_day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    fraction = F.when(F.col("budget") > 0, F.coalesce(carried, F.lit(0)) / F.col("budget")).otherwise(0.0)
    return slots.select(*CELL_KEY, "date", "hour_of_day", fraction.alias("spend_fraction"))


def pool_dates(pool: DataFrame) -> DataFrame:
    return pool.groupBy("advertiser").agg(F.min(F.to_date("timestamp")).alias("first_date"),
                                          F.max(F.to_date("timestamp")).alias("last_date"))
