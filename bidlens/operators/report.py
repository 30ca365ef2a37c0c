"""Reports over sweep results: best points, cells for a dashboard, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.operators.sweep import BUDGET_FRACTIONS, label_order

STRATEGY_ORDER = ["constant", "random", "linear_ctr"]
CELL = ["advertiser", "budget_id"]


def refuse_non_finite(value: Column, digits: int, name: str) -> Column:
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} is not finite"))).otherwise(F.bround(value, digits))


def budget_label(fraction: Column, labels: dict[str, float] | None = None) -> Column:
    """Display text of a budget fraction; an unknown fraction stops the job."""
    text = F.raise_error(F.concat(F.lit("unknown budget fraction "), fraction.cast("string")))
    for label, known in (labels or BUDGET_FRACTIONS).items():
        text = F.when(F.abs(fraction - known) < 1e-9, label).otherwise(text)
    return text


def label_position(strategy: Column, label: Column) -> Column:
    """Place of a sweep point within its strategy, from 1; an unknown label stops the job."""
    place = F.lit(None).cast("int")
    for name in STRATEGY_ORDER:
        order = F.array(*[F.lit(x) for x in label_order(name)])
        place = F.when(strategy == name, F.array_position(order, label).cast("int")).otherwise(place)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(
        F.raise_error(F.concat(F.lit("unknown sweep label "), label)))


def params_from_json(text: Column) -> Column:
    """Parameters stored as JSON text."""
    return F.from_json(text, "amount double, base double, low double, high double, "
                             "quantile_label string, range_label string")


def params_to_json(results: DataFrame) -> DataFrame:
    """Adds ``params_json``, the text form of a run's parameters."""
    quantile = F.when(F.col("strategy") != "random", F.col("label")).alias("quantile_label")
    span = F.when(F.col("strategy") == "random", F.col("label")).alias("range_label")
    return results.withColumn("params_json", F.to_json(F.struct(
        F.col("params.amount"), F.col("params.base"), F.col("params.low"), F.col("params.high"),
        quantile, span)))


def mark_best(results: DataFrame) -> DataFrame:
    """Flags the run with most clicks per advertiser, budget and strategy; the
    first in grid order wins a tie."""
    order = Window.partitionBy(*CELL, "strategy").orderBy(F.desc("clicks_won"), "grid_pos")
    return results.withColumn("is_best_by_clicks", F.row_number().over(order) == 1)


def headline(results: DataFrame) -> DataFrame:
    """The best run per advertiser, budget and strategy."""
    return mark_best(results).where("is_best_by_clicks")


def exhaustion_violations(results: DataFrame) -> DataFrame:
    """Rows where the exhaustion flag and time contradict each other (should be none)."""
    return results.where(F.col("budget_exhausted") != F.col("exhaustion_timestamp").isNotNull())


def grid_gaps(results: DataFrame) -> DataFrame:
    """Cells whose sweep is not complete: wrong number of points, repeated label, or two budgets."""
    wanted = F.lit(None).cast("int")
    for name in STRATEGY_ORDER:
        wanted = F.when(F.col("strategy") == name, len(label_order(name))).otherwise(wanted)
    cells = results.groupBy(*CELL, "strategy").agg(
        F.count("*").alias("n_points"), F.count_distinct("label").alias("n_labels"),
        F.count_distinct("budget").alias("n_budgets"))
    return cells.withColumn("expected", wanted).where(
        "n_points <> expected or n_labels <> expected or n_budgets <> 1")


def require_complete(results: DataFrame) -> None:
    shape = results.agg(
        F.count_distinct("advertiser").alias("a"), F.count_distinct("budget_id").alias("b"),
        F.count_distinct("advertiser", "budget_id", "strategy").alias("cells")).first()
    if shape["cells"] != shape["a"] * shape["b"] * len(STRATEGY_ORDER):
        raise ValueError("the sweep is not rectangular over advertisers, budgets and strategies")
    broken = grid_gaps(results).limit(5).collect() + exhaustion_violations(results).limit(5).collect()
    if broken:
        raise ValueError(f"the sweep is incomplete or inconsistent: {broken}")


def sweep_points(results: DataFrame) -> DataFrame:
    """Every sweep point as the dashboard shows it, in parameter order."""
    spend = F.transform("hourly_spend_fraction", lambda x: F.bround(x * F.col("budget"), 2))
    return mark_best(results).select(
        *CELL, budget_label(F.col("budget_fraction")).alias("budget_label"), "budget_fraction",
        refuse_non_finite(F.col("budget"), 2, "budget").alias("budget_fen"), "strategy",
        label_position(F.col("strategy"), F.col("label")).alias("point"), "label", "params",
        "is_best_by_clicks", "clicks_won",
        refuse_non_finite(F.col("win_rate_pool"), 4, "win_rate_pool").alias("win_rate_pool"),
        refuse_non_finite(F.col("total_spend").cast("double"), 2, "total_spend").alias("spend_fen"),
        refuse_non_finite(F.col("effective_cpc"), 2, "effective_cpc").alias("effective_cpc_fen"),
        F.struct(F.col("budget_exhausted").alias("exhausted"),
                 F.col("exhaustion_timestamp").alias("timestamp")).alias("exhaustion"),
        spend.alias("spend_trajectory_fen"))


def dashboard_cells(results: DataFrame) -> DataFrame:
    """One row per advertiser and budget with the nested points of all strategies.

    A cell holds as many points as the grid has (16), so the lists stay short.
    """
    require_complete(results)
    points = sweep_points(results)
    nested = ["point", "label", "params", "is_best_by_clicks", "clicks_won", "win_rate_pool", "spend_fen",
              "effective_cpc_fen", "exhaustion", "spend_trajectory_fen"]

    def of(strategy: str) -> Column:
        chosen = F.when(F.col("strategy") == strategy, F.struct(*nested))
        in_order = F.array_sort(F.collect_list(chosen),
                                lambda a, b: a["point"] - b["point"])
        return in_order.alias(strategy)

    cells = points.groupBy(*CELL, "budget_label", "budget_fraction", "budget_fen").agg(
        *[of(s) for s in STRATEGY_ORDER])
    return cells.select(*CELL, "budget_label", "budget_fraction", "budget_fen",
                        F.struct(*STRATEGY_ORDER).alias("strategies"))


def dashboard_meta(cells: DataFrame, season: int, date_range: tuple[str, str]) -> DataFrame:
    return cells.agg(
        F.sort_array(F.collect_set(F.col("advertiser").cast("int"))).cast("array<string>").alias("advertisers"),
        F.sort_array(F.collect_set("budget_fraction")).alias("budget_fractions"),
        F.count("*").alias("n_cells"),
        F.sum(sum([F.size(f"strategies.{s}") for s in STRATEGY_ORDER[1:]],
                  F.size(f"strategies.{STRATEGY_ORDER[0]}"))).alias("n_leaf_records")
    ).withColumns({"season": F.lit(season), "date_range": F.array(*[F.lit(d) for d in date_range]),
                   "strategies": F.array(*[F.lit(s) for s in STRATEGY_ORDER])})


def dashboard_json(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """JSON lines: the meta record first, then one line per cell in order."""
    head = meta.select(F.lit(0).alias("_o"), F.lit("").alias("_a"), F.lit(0.0).alias("_b"),
                       F.to_json(F.struct("*")).alias("json"))
    body = cells.select(F.lit(1).alias("_o"), F.lpad("advertiser", 12, "0").alias("_a"),
                        F.col("budget_fraction").alias("_b"), F.to_json(F.struct("*")).alias("json"))
    return head.unionByName(body).orderBy("_o", "_a", "_b").select("json")


def cell(cells: DataFrame, advertiser: str, label: str) -> DataFrame:
    return cells.where((F.col("advertiser") == advertiser) & (F.col("budget_label") == label))


def trajectory_series(points: DataFrame) -> DataFrame:
    """Chart rows: spend per hour of each cell's best runs, with the exhaustion hour."""
    best = points.where("is_best_by_clicks")
    return best.select(*CELL, "strategy", F.hour("exhaustion.timestamp").alias("exhaustion_hour"),
                       F.posexplode("spend_trajectory_fen").alias("hour", "spend_fen"))


def sweep_series(points: DataFrame) -> DataFrame:
    """Chart rows: clicks per sweep point, with the highest count of the cell."""
    top = F.max("clicks_won").over(Window.partitionBy(*CELL))
    return points.select(*CELL, "strategy", "point", "label", "clicks_won", top.alias("max_clicks"))


def strategy_comparison(best: DataFrame) -> DataFrame:
    """Per cell: which strategy has most clicks and which the lowest cost per click."""
    place = F.array_position(F.array(*[F.lit(s) for s in STRATEGY_ORDER]), F.col("strategy"))
    return best.groupBy(*CELL).agg(
        F.max_by("strategy", F.struct("clicks_won", -place)).alias("most_clicks"),
        F.min_by("strategy", F.when(F.col("effective_cpc").isNotNull(),
                                    F.struct("effective_cpc", place))).alias("lowest_cpc"))


def strategy_wins(best: DataFrame) -> DataFrame:
    """Cells won per strategy, with the range of its win rates and clicks."""
    winners = strategy_comparison(best)
    by_clicks = winners.groupBy(F.col("most_clicks").alias("strategy")).agg(F.count("*").alias("cells_by_clicks"))
    by_cpc = winners.groupBy(F.col("lowest_cpc").alias("strategy")).agg(F.count("*").alias("cells_by_cpc"))
    ranges = best.groupBy("strategy").agg(
        F.min("win_rate_pool").alias("win_rate_min"), F.max("win_rate_pool").alias("win_rate_max"),
        F.min("clicks_won").alias("clicks_min"), F.max("clicks_won").alias("clicks_max"))
    joined = ranges.join(by_clicks, "strategy", "left").join(by_cpc, "strategy", "left")
    return joined.fillna(0, ["cells_by_clicks", "cells_by_cpc"])
