"""End-to-end jobs: ingest, validate, train, calibrate, sweep and export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bidlens import schema
from bidlens.functions.probability import recalibrate
from bidlens.operators import auction, calibrate, metrics, models, quality, report, sample, split, sweep
from bidlens.session import folder_path, materialize, new_table_path
from bidlens.sources import artifacts, commits, rawlogs, tables


def ingest(spark: SparkSession, raw_root: str, base: str, *, seasons: Sequence[int] = (2, 3),
           log_types: Sequence[str] = tuple(schema.LOG_TYPES), sample_run: bool = False,
           overwrite: bool = False) -> DataFrame:
    """Raw files to typed tables, one Spark job per log type; returns the new ledger rows.

    Files whose day is already in the ledger are skipped unless ``overwrite``.  A
    load is all or nothing: each table's rows are stored as a version that no reader
    sees, and only when as many rows are there as lines were read, day by day, does
    one commit publish the days of all tables.
    """
    root = tables.output_root(base, sample_run)
    ledger = tables.ledger_path(root)
    names = F.create_map(*[F.lit(x) for pair in schema.TABLE_OF_LOG_TYPE.items() for x in pair])
    files = rawlogs.discover_files(spark, raw_root, seasons, log_types).withColumn("table_name", names[F.col("log_type")])
    todo = files if overwrite else tables.pending(files, tables.read_ledger(spark, ledger))
    listing = todo.select("path", "table_name", "season", "date").collect()  # file names only
    # Counting while writing uses an observation.  A session that ever held one cannot
    # ship a fitted model to its tasks, so the loads run in a session of their own.
    loader, version, loaded = spark.newSession(), commits.new_version(), None
    for log_type in log_types:
        table = schema.TABLE_OF_LOG_TYPE[log_type]
        paths = [f["path"] for f in listing if f["table_name"] == table]
        if not paths:
            continue
        require_ledger_table(spark, root, table)
        lines = rawlogs.sample_lines(loader, paths) if sample_run else rawlogs.read_lines(loader, paths)
        read = Observation(f"{table}-in")
        counted = lines.observe(read, F.count(F.lit(1)).alias("lines"), F.sum(day_mark()).alias("marks"))
        stored = commits.write_version(rawlogs.parse_lines(counted, log_type), root, table, version)
        days = materialize(tables.count_by_day(stored, table, "rows_out").withColumn("rows_in", F.col("rows_out")), "loaded-days")
        found = days.agg(F.sum("rows_out").alias("lines"), F.sum(F.col("rows_out") * day_mark()).alias("marks")).first()
        require_whole_load(read.get, found.asDict(), table)
        loaded = days if loaded is None else loaded.unionByName(days)
    tables.write_manifest(spark, folder_path(root, "manifest"))
    if loaded is None:
        return spark.createDataFrame([], tables.LEDGER_SCHEMA)
    number = commits.commit(spark, ledger, loaded, version)
    return commits.all_commits(spark, ledger).where(F.col("number") == number).select(*tables.LEDGER_SCHEMA.names)


def day_mark() -> Column:
    """A number of 16 bits per day: summed over rows it shows rows that changed their day."""
    return F.pmod(F.xxhash64("season", F.col("date").cast("string")), F.lit(1 << 16))


def require_ledger_table(spark: SparkSession, root: str, table: str) -> None:
    """A table with files but no commits was not written by a load; its days would vanish behind the first commit."""
    if tables.table_exists(spark, root, table) and not commits.committed_paths(spark, root, table, tables.ledger_path(root)):
        raise FileExistsError(f"{table!r} under {root} has files that no commit names: load into another root")


def require_whole_load(read: Mapping, stored: Mapping, table: str) -> None:
    """The gate before publication: what was published before stays when it is shut."""
    lines, rows = ({k: v or 0 for k, v in part.items()} for part in (read, stored))
    if lines != rows:
        raise AssertionError(f"{table}: {lines['lines']} lines were read but {rows['lines']} rows were stored, "
                             "or rows changed their day; nothing was published")


def validate(spark: SparkSession, base: str, sample_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per-table report and verdict over whatever tables exist."""
    root = tables.output_root(base, sample_run)
    found = {t: tables.read_table(spark, root, t) if tables.table_exists(spark, root, t) else None
             for t in schema.TABLE_OF_LOG_TYPE.values()}
    checked = quality.validation_report(found)
    return checked, quality.validation_verdict(checked)


def validation_figures(spark: SparkSession, base: str, sample_run: bool = False) -> DataFrame | None:
    """All figures of all stored tables in long form, each table read once; None without any."""
    root, out = tables.output_root(base, sample_run), None
    for log_type, name in schema.TABLE_OF_LOG_TYPE.items():
        if tables.table_exists(spark, root, name):
            parts = quality.validation_parts(tables.read_table(spark, root, name), schema.raw_columns(log_type))
            part = quality.complete_report(name, parts)
            out = part if out is None else out.unionByName(part)
    return out


def _split_frames(spark: SparkSession, root: str, season: int, chosen: split.Split):
    impressions, clicks = (tables.read_table(spark, root, t) for t in ("impressions", "clicks"))
    return {name: split.load_split(impressions, clicks, season, name, chosen,
                                   keys=["bidid"]) for name in ("train", "val", "test")}


def train(spark: SparkSession, base: str, out: str, *, kind: str = "linear", season: int = 2,
          rate: float = models.NEGATIVE_SAMPLING_RATE, seed: int = models.SEED,
          chosen: split.Split | None = None, touch_test: bool = False, overwrite: bool = False, **options):
    """Split, thin out negatives, search, store scores of val (and once of test) with records."""
    if touch_test and not overwrite and artifacts.record_exists(spark, f"{out}/evaluation-test"):
        raise FileExistsError("the test split has been evaluated already; it is not read again")
    frames = _split_frames(spark, tables.output_root(base), season, chosen or split.season_split(season))
    keys = ["bidid", "timestamp", "advertiser"]
    drawn, record = sample.downsample_negatives(frames["train"], rate, seed, ["bidid", "timestamp"])
    drawn = materialize(drawn, "train-sample")
    search = (models.LinearSearch if kind == "linear" else models.TreeSearch)(
        drawn, frames["val"], rate, keys=keys, **options)
    info = {"model": kind, "sampling_rate": rate, "seed": seed, "sampling": record.first().asDict(), "season": season,
            "bounds": bounds_of(chosen or split.season_split(season))}
    for name in ("val", "test") if touch_test else ("val",):
        scored = materialize(search.score(frames[name]).withColumnRenamed("click", "y_true"), f"scores-{name}")
        evaluation = metrics.evaluate(scored, "p_raw", model=kind, split=name, sampling_rate=rate)
        final = scored.withColumn("p_calibrated", recalibrate(F.col("p_raw"), rate))
        artifacts.write_predictions(final, f"{out}/{name}", {**info, "split": name})
        artifacts.write_record(spark, f"{out}/evaluation-{name}", evaluation.first().asDict(),
                               overwrite=overwrite or name == "val")
    search.save(spark, f"{out}/model")
    artifacts.append_run_log(spark, f"{out}/runs", {**info, "best": search.records.orderBy("log_loss").first().asDict()})
    return search


def bounds_of(chosen: split.Split) -> dict[str, list[str]]:
    return {name: list(chosen.range_of(name)) for name in ("train", "val", "test")}


def require_equal(found: Mapping, wanted: Mapping, names: Sequence[str], what: str) -> None:
    """A record must say the same about ``names`` as what it is held against."""
    off = {n: (found.get(n), wanted.get(n)) for n in names if found.get(n) != wanted.get(n)}
    if off:
        raise ValueError(f"{what}: {off}")


def require_record_rebuilt(spark: SparkSession, out: str, name: str, tolerance: float = 1e-9) -> None:
    """The evaluation of a split, computed anew from its stored scores, must give the stored record."""
    scores, info = artifacts.read_predictions(spark, f"{out}/{name}")
    rebuilt = metrics.evaluate(scores, "p_raw", model=info["model"], split=name, sampling_rate=info["sampling_rate"])
    recorded = artifacts.read_record(spark, f"{out}/evaluation-{name}")
    figures = [(float(recorded["auc"]), float(recorded["log_loss"]), float(recorded["ece"]))]
    models.require_figures(rebuilt, spark.createDataFrame(figures, "auc double, log_loss double, ece double"), tolerance)


def score_test(spark: SparkSession, base: str, out: str, *, chosen: split.Split | None = None) -> DataFrame:
    """Scores the test split, once, with the model that ``train`` stored below ``out``.

    Before a test row is read, the stored evidence must hold: the split has the bounds
    the model was trained with, the stored model gives the stored validation scores,
    and those give the stored validation record.
    """
    if artifacts.record_exists(spark, f"{out}/evaluation-test"):
        raise FileExistsError("the test split has been evaluated already; it is not read again")
    stored, info = artifacts.read_predictions(spark, f"{out}/val")
    chosen = chosen or split.season_split(info["season"])
    require_equal(info, {"bounds": bounds_of(chosen)}, ["bounds"], "the split is not the one of the training")
    frames = _split_frames(spark, tables.output_root(base), info["season"], chosen)
    rate = info["sampling_rate"]
    require_reproduced(score_stored(spark, out, frames["val"], rate), stored)
    require_record_rebuilt(spark, out, "val")
    scored = materialize(score_stored(spark, out, frames["test"], rate).withColumnRenamed("click", "y_true"), "scores-test")
    evaluation = metrics.evaluate(scored, "p_raw", model=info["model"], split="test", sampling_rate=rate)
    artifacts.write_predictions(scored, f"{out}/test", {**info, "split": "test"})
    artifacts.write_record(spark, f"{out}/evaluation-test", evaluation.first().asDict())
    return artifacts.read_predictions(spark, f"{out}/test")[0]


def verified_scores(spark: SparkSession, out: str, date_range: tuple[str, str], tolerance: float = 1e-9) -> tuple[DataFrame, dict]:
    """The calibrated test scores below ``out``, if they may be used for a sweep over ``date_range``.

    They must come from the model, rate and seed of the stored test scores, be fitted on
    validation rows, hold probabilities recalibrated at that rate, and cover the range.
    """
    scores, info = artifacts.read_predictions(spark, f"{out}/test-calibrated")
    _, raw_info = artifacts.read_predictions(spark, f"{out}/test")
    require_equal(info, raw_info, ["model", "sampling_rate", "seed", "season", "bounds"], "calibrated and raw test scores differ")
    require_equal(info, {"calibrator_fit_split": "val", "split": "test"}, ["calibrator_fit_split", "split"], "wrong splits")
    first, last = info["bounds"]["test"]
    if not first <= date_range[0] <= date_range[1] <= last:
        raise ValueError(f"scores of {first} to {last} do not cover {date_range}")
    gap = F.max(F.abs(recalibrate(F.col("p_raw"), info["sampling_rate"]) - F.col("p_calibrated")))
    worst = scores.agg(F.coalesce(gap, F.lit(0.0))).first()[0]
    if not worst <= tolerance:
        raise AssertionError(f"stored probabilities are not those of rate {info['sampling_rate']}: off by {worst}")
    return scores, info


def store_sweep(spark: SparkSession, base: str, out: str, name: str, date_range: tuple[str, str], seed: int = sweep.SEED) -> DataFrame:
    """A sweep over verified scores, stored as ``<out>/sweeps/<name>`` with the record of how it came about; never overwritten."""
    path = f"{out}/sweeps/{name}"
    if artifacts.record_exists(spark, f"{path}/info"):
        raise FileExistsError(f"there is a sweep called {name} already")
    scores, info = verified_scores(spark, out, date_range)
    root = tables.output_root(base)
    _, results = run_sweep(tables.read_table(spark, root, "impressions"), tables.read_table(spark, root, "clicks"), scores,
                           season=info["season"], date_range=date_range, seed=seed)
    results.write.parquet(f"{path}/results")
    stored = spark.read.parquet(f"{path}/results")
    # The record is written last: a sweep without one was not finished.
    artifacts.write_record(spark, f"{path}/info", {
        "name": name, "date_range": list(date_range), "sweep_seed": seed, "n_results": stored.count(),
        **{k: info[k] for k in ("model", "sampling_rate", "seed", "season", "bounds")}})
    return stored


def read_sweep(spark: SparkSession, out: str, name: str) -> tuple[DataFrame, dict]:
    """A stored sweep and its record, which must agree on the number of results."""
    path = f"{out}/sweeps/{name}"
    info, results = artifacts.read_record(spark, f"{path}/info"), spark.read.parquet(f"{path}/results")
    require_equal({"n_results": results.count()}, info, ["n_results"], "results were lost")
    return results, info


def score_stored(spark: SparkSession, out: str, rows: DataFrame, rate: float) -> DataFrame:
    """Raw and recalibrated scores of ``rows`` by the model that ``train`` stored below ``out``."""
    scored = models.load_search(spark, f"{out}/model").score(rows)
    return scored.withColumn("p_calibrated", recalibrate(F.col("p_raw"), rate))


def require_reproduced(again: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> None:
    """Scores of the same keys must agree; a key without partner or with another score stops the job."""
    keys = artifacts.PREDICTION_KEYS
    fold = [F.avg("p_raw").alias("p"), F.count("*").alias("n")]
    both = again.groupBy(*keys).agg(*fold).withColumnsRenamed({"p": "p2", "n": "n2"}).join(
        stored.groupBy(*keys).agg(*fold), keys, "full")
    wrong = both.where(~F.coalesce((F.col("n") == F.col("n2")) & (F.abs(F.col("p") - F.col("p2")) <= tolerance), F.lit(False)))
    if not wrong.isEmpty():
        raise AssertionError("the stored model does not give the stored scores")


def calibrate_scores(spark: SparkSession, out: str) -> DataFrame:
    """Isotonic fit on the validation scores, applied once to the test scores, and audited."""
    val, val_info = artifacts.read_predictions(spark, f"{out}/val")
    test, test_info = artifacts.read_predictions(spark, f"{out}/test")
    calibrate.same_provenance(val_info, test_info)
    model = calibrate.fit_isotonic(val, "p_calibrated")
    final = materialize(calibrate.apply_isotonic(test, model, "p_calibrated"), "calibrated")
    audit = calibrate.correction_audit(
        final, lambda df, column, output: calibrate.apply_isotonic(df, model, column, output),
        sampling_rate=test_info["sampling_rate"], fit_split=val_info["split"])
    calibrate.require_correction_order(audit)
    artifacts.write_predictions(final, f"{out}/test-calibrated", {**test_info, "calibrator_fit_split": val_info["split"]})
    return final


def run_sweep(impressions: DataFrame, clicks: DataFrame, scores: DataFrame, *, season: int,
              date_range: tuple[str, str], score: str = "p_isotonic", tiebreak: Sequence[str] = (),
              seed: int = sweep.SEED) -> tuple[sweep.Sweep, DataFrame]:
    """All advertisers, strategies, parameters and budgets; results with hourly spend."""
    scope = dict(seasons=(season,), date_range=date_range, tiebreak=tiebreak)
    pool = auction.require_rows(auction.auction_pool(impressions, clicks, **scope), f"{season} {date_range}")
    pool = materialize(pool, "scope")
    auction.require_aligned(auction.alignment_report(pool, scores))
    one = sweep.Sweep(auction.align_predictions(pool, scores, score), tiebreak, seed)
    results = materialize(one.results(), "results")
    return one, materialize(one.with_hourly(results), "results-hourly")


def export_dashboard(results: DataFrame, path: str, season: int, date_range: tuple[str, str]) -> None:
    """The nested JSON of all cells, one line per record, the meta record first."""
    cells = materialize(report.dashboard_cells(results), "cells")
    meta = report.dashboard_meta(cells, season, date_range)
    report.dashboard_json(cells, meta).coalesce(1).write.mode("overwrite").text(path)
