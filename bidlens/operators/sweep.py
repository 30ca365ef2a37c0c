"""Parameter sweep: grids from each advertiser's own prices, all runs in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.operators import auction
from bidlens.session import materialize

# --- Fixed values of the sweep ----------------------------------------------
BUDGET_FRACTIONS = {"1/32": 1 / 32, "1/16": 1 / 16, "1/8": 1 / 8, "1/4": 1 / 4, "1/2": 1 / 2}
QUANTILE_ANCHORS = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
RANGE_ANCHORS = [(0.10, 0.50), (0.25, 0.75), (0.50, 0.90), (0.10, 0.95)]
SEED = 42
# ----------------------------------------------------------------------------


def anchor_label(q: float) -> str:
    return f"q{round(q * 100)}"


def label_order(strategy: str) -> list[str]:
    if strategy == "random":
        return [f"{anchor_label(a)}-{anchor_label(b)}" for a, b in RANGE_ANCHORS]
    return [anchor_label(q) for q in QUANTILE_ANCHORS]


def sweep_grid(statistics: DataFrame) -> DataFrame:
    """All runs of every advertiser: six amounts, four ranges, six bases.

    ``quantiles`` holds one array per advertiser in anchor order.  The base is the
    price quantile over ``mean_p_click``; a mean of zero leaves it undefined and
    such a run is refused when it has to bid.  Without that column there are no
    linear runs.
    """
    at = {q: f"quantiles[{i}]" for i, q in enumerate(QUANTILE_ANCHORS)}

    def run(strategy: str, label: str, position: int, amount="null", low="null", high="null",
            base="null", range_index="null") -> str:
        return (f"struct('{strategy}:{label}' as run_id, '{strategy}' as strategy, '{label}' as label, "
                f"{position} as grid_pos, double({amount}) as amount, double({low}) as low, "
                f"double({high}) as high, double({base}) as base, int({range_index}) as range_index)")

    runs = [run("constant", anchor_label(q), i, amount=at[q]) for i, q in enumerate(QUANTILE_ANCHORS)]
    runs += [run("random", f"{anchor_label(a)}-{anchor_label(b)}", i, low=at[a], high=at[b], range_index=i)
             for i, (a, b) in enumerate(RANGE_ANCHORS)]
    if "mean_p_click" in statistics.columns:
        runs += [run("linear_ctr", anchor_label(q), i, base=f"{at[q]} / nullif(mean_p_click, 0)")
                 for i, q in enumerate(QUANTILE_ANCHORS)]
    return statistics.selectExpr("advertiser", f"inline(array({', '.join(runs)}))")


def budget_ladder(spend: DataFrame, fractions: dict[str, float] | None = None) -> DataFrame:
    """Budgets as fractions of what the advertiser really spent on this pool."""
    steps = ", ".join(f"struct('{k}' as budget_id, double({v!r}) as budget_fraction)"
                      for k, v in (fractions or BUDGET_FRACTIONS).items())
    return (spend.selectExpr("advertiser", "historical_spend", f"inline(array({steps}))")
            .selectExpr("advertiser", "budget_id", "budget_fraction",
                        "budget_fraction * historical_spend as budget"))


class Sweep:
    """The tables of one sweep, each stored once: pool, statistics and hourly outcome.

    Runs and budgets are a few rows per advertiser, derived from the statistics.
    """

    def __init__(self, pool: DataFrame, tiebreak: Sequence[str] = (), seed: int = SEED,
                 fractions: dict[str, float] | None = None):
        self.tiebreak, self.seed = list(tiebreak), seed
        self.pool = materialize(pool, "pool")
        self.statistics = materialize(auction.pool_statistics(self.pool, QUANTILE_ANCHORS), "statistics")
        self.runs = sweep_grid(self.statistics)
        self.budgets = budget_ladder(self.statistics, fractions)
        self.hours = auction.hourly_outcome(self.pool, self.runs, self.tiebreak, seed)

    def results(self) -> DataFrame:
        """One row per advertiser, run and budget, parameters included."""
        settled = auction.settle(self.pool, self.runs, self.budgets, self.tiebreak, self.seed, self.hours)
        parameters = self.runs.select("advertiser", "run_id", "strategy", "label", "grid_pos",
                                      F.struct("amount", "low", "high", "base", "range_index").alias("params"))
        fractions = self.budgets.select("advertiser", "budget_id", "budget_fraction")
        return settled.join(parameters, auction.RUN_KEY).join(fractions, ["advertiser", "budget_id"])

    def hourly(self, results: DataFrame) -> DataFrame:
        return auction.hourly_spend(self.hours, results, auction.pool_dates(self.pool))

    def with_hourly(self, results: DataFrame) -> DataFrame:
        """Results with the hourly spend fractions as one array in time order
        (24 numbers for a pool of one day)."""
        slot = F.struct("date", "hour_of_day", "spend_fraction")
        arrays = self.hourly(results).groupBy(*auction.CELL_KEY).agg(
            F.transform(F.array_sort(F.collect_list(slot)), lambda s: s["spend_fraction"])
            .alias("hourly_spend_fraction"))
        return results.join(arrays, auction.CELL_KEY)


def sweep_design(sweep: Sweep, exclusions: DataFrame) -> DataFrame:
    """What the sweep was built from, one row per advertiser with nested lists."""
    def listed(strategy: str, *fields: str):
        item = F.when(F.col("strategy") == strategy, F.struct("grid_pos", "label", *fields))
        return F.array_sort(F.collect_list(item))

    grids = sweep.runs.groupBy("advertiser").agg(
        listed("constant", "amount").alias("constant_amounts"),
        listed("random", "low", "high").alias("random_ranges"),
        listed("linear_ctr", "base").alias("linear_bases"))
    ladder = sweep.budgets.groupBy("advertiser").agg(F.array_sort(F.collect_list(
        F.struct("budget_fraction", "budget_id", "budget"))).alias("budgets"))
    return (exclusions.drop("n_pool").join(sweep.statistics, "advertiser")
            .join(ladder, "advertiser").join(grids, "advertiser"))
