"""Temporal split and the feature + label table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens import schema
from bidlens.operators.labels import in_split, with_label

# --- Fixed values: the defined splits, inclusive dates ----------------------
SEASON_SPLITS = {
    2: {
        "train": ("2013-06-06", "2013-06-10"),
        "val": ("2013-06-11", "2013-06-11"),
        "test": ("2013-06-12", "2013-06-12"),
    },
}
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Split:
    """Named inclusive date ranges that follow each other."""

    ranges: dict[str, tuple[str, str]]

    def range_of(self, name: str) -> tuple[str, str]:
        if name not in self.ranges:
            raise ValueError(f"unknown split {name!r}, expected one of {list(self.ranges)}")
        return self.ranges[name]


def season_split(season: int) -> Split:
    """The split of a season; a season kept for out-of-time use has none."""
    if season not in SEASON_SPLITS:
        raise NotImplementedError(f"no split is defined for season {season!r}")
    return Split(SEASON_SPLITS[season])


def feature_table(impressions: DataFrame, clicks: DataFrame, *, seasons: Sequence[int],
                  date_range: tuple[str, str] | None = None, columns: Iterable[str] | None = None,
                  keys: Sequence[str] = ("bidid",), extra: Sequence[str] = (),
                  row_limit: int | None = None) -> DataFrame:
    """Bid-time features, row keys and the ``click`` label as one lazy plan.

    ``keys`` identify a row and are never features; ``extra`` names test-only
    columns outside the log layout.  Season and date filters prune partitions.
    """
    if not seasons:
        raise ValueError("name at least one season")
    known = [c for c in impressions.columns if c not in extra]
    features = [c for c in schema.narrow_features(known, columns) if c not in keys]
    rows = impressions.where(F.col("season").isin(*[int(s) for s in seasons]))
    if date_range is not None:
        start, end = date_range
        rows = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    kept = [*keys, *[e for e in extra if e not in keys], *features]
    labelled = with_label(rows.select("bidid", *[c for c in kept if c != "bidid"]), clicks)
    labelled = labelled.select(*kept, "click")
    return labelled if row_limit is None else labelled.limit(row_limit)


def load_split(impressions: DataFrame, clicks: DataFrame, season: int, name: str,
               split: Split | None = None, **options) -> DataFrame:
    chosen = (split or season_split(season)).range_of(name)
    return feature_table(impressions, clicks, seasons=(season,), date_range=chosen, **options)


def split_counts(labelled: DataFrame, split: Split, label: str = "click") -> DataFrame:
    """Impressions, positives and rate of every split; rows outside all splits get NULL."""
    named = labelled.withColumn("split", in_split(F.col("date"), split.ranges))
    return named.groupBy("split").agg(
        F.count("*").alias("n"), F.sum(label).alias("n_positive"), F.avg(label).alias("positive_rate"))


def split_coverage(dates: DataFrame, split: Split) -> DataFrame:
    """Per date of ``dates``: in how many splits it falls (exactly one is right)."""
    hits = [F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), 1).otherwise(0)
            for a, b in split.ranges.values()]
    return (dates.select("date").distinct()
            .withColumn("n_splits", sum(hits[1:], hits[0]))
            .withColumn("covered_once", F.col("n_splits") == 1))


def calendar(df: DataFrame) -> DataFrame:
    """Every day from the first to the last date of a table."""
    bounds = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b")).alias("date"))


def stable_sample(df: DataFrame, share: float, *keys: str, seed: int = 42) -> DataFrame:
    """A development subset that is the same on every run and partitioning."""
    cut = F.lit(int(share * (1 << 30)))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) < cut)
