"""The whole way from raw files to the dashboard on the smallest data."""

import json

import pytest

from bidlens.operators import split
from bidlens.plans import event_logs, jobs, queries
from bidlens.sources import artifacts, tables

FOLDER = "/root/testdata/sf0.001"
TEST_DAYS = ("2024-01-26", "2024-12-31")


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    makers = {"imp": event_logs.impressions, "clk": event_logs.clicks, "conv": event_logs.conversions, "bid": event_logs.bids}
    for kind, maker in makers.items():
        lines = event_logs.raw_lines(maker(spark, FOLDER), kind)
        for day in [r.date for r in lines.select("date").distinct().collect()][:40]:
            target = root / "raw" / "training2nd" / f"{kind}.{day:%Y%m%d}.txt"
            target.parent.mkdir(parents=True, exist_ok=True)
            rows = lines.where(lines.date == day).select("line").toPandas()["line"]
            target.write_text("\n".join(rows) + "\n")
    jobs.ingest(spark, str(root / "raw"), str(root / "logs"))
    return str(root / "logs")


def test_pipeline(spark, base):
    processed = f"{base}/processed"
    imp, clk = tables.read_table(spark, processed, "impressions"), tables.read_table(spark, processed, "clicks")
    assert imp.count() == event_logs.impressions(spark, FOLDER).count()
    out = f"{base}/model"
    options = dict(rate=0.2, chosen=queries.SPLIT, touch_test=True, c_grid=[0.1], max_iter=5, dimension=1 << 10)
    jobs.train(spark, base, out, **options)
    with pytest.raises(FileExistsError):         # the test split is read once
        jobs.train(spark, base, out, **options)
    assert 0 <= artifacts.read_record(spark, f"{out}/evaluation-test")["ece"] <= 1
    val = split.load_split(imp, clk, 2, "val", queries.SPLIT, keys=["bidid"])
    stored = artifacts.read_predictions(spark, f"{out}/val")[0]
    again = jobs.score_stored(spark.newSession(), out, val, 0.2)
    jobs.require_reproduced(again, stored)
    with pytest.raises(AssertionError):
        jobs.require_reproduced(again.withColumn("p_raw", again.p_raw + 1e-6), stored)
    final = jobs.calibrate_scores(spark, out)
    assert final.where("p_isotonic is null or p_isotonic not between 0 and 1").count() == 0
    assert artifacts.read_predictions(spark, f"{out}/test-calibrated")[1]["calibrator_fit_split"] == "val"
    _, results = jobs.run_sweep(imp, clk, final, season=2, date_range=TEST_DAYS)
    assert results.count() == 5 * 16 * 5
    assert results.where("total_spend > budget").count() == 0
    jobs.export_dashboard(results, f"{base}/dashboard", 2, TEST_DAYS)
    records = [json.loads(r.value) for r in spark.read.text(f"{base}/dashboard").collect()]
    assert len(records) == 26
    assert sum(len(c["strategies"][s]) for c in records if "strategies" in c and "budget_fen" in c
               for s in ("constant", "random", "linear_ctr")) == 400


def test_loads_are_all_or_nothing(spark, base, tmp_path, monkeypatch):
    raw, logs = tmp_path / "raw" / "training2nd", str(tmp_path / "logs")
    raw.mkdir(parents=True)
    lines = [r.line for r in event_logs.raw_lines(event_logs.clicks(spark, FOLDER), "clk").limit(6).collect()]
    (raw / "clk.20240105.txt").write_text("\n".join(lines[:4]) + "\n")
    jobs.ingest(spark, str(tmp_path / "raw"), logs, log_types=["clk"])
    assert tables.read_table(spark, f"{logs}/processed", "clicks").count() == 4
    (raw / "clk.20240105.txt").write_text("\n".join(lines) + "\n")
    parse, lost = jobs.rawlogs.parse_lines, lines[0].split("\t")[0]
    monkeypatch.setattr(jobs.rawlogs, "parse_lines", lambda df, kind: parse(df, kind).where(f"bidid <> '{lost}'"))
    with pytest.raises(AssertionError, match="nothing was published"):
        jobs.ingest(spark, str(tmp_path / "raw"), logs, log_types=["clk"], overwrite=True)
    assert tables.read_table(spark, f"{logs}/processed", "clicks").count() == 4
    monkeypatch.undo()
    jobs.ingest(spark, str(tmp_path / "raw"), logs, log_types=["clk"], overwrite=True)
    ledger = tables.read_ledger(spark, f"{logs}/processed/ledger").collect()
    assert [(r.rows_in, r.rows_out) for r in ledger] == [(6, 6)]


def test_split_frames_hold_no_settlement_columns(spark, base):
    processed = f"{base}/processed"
    frame = split.load_split(tables.read_table(spark, processed, "impressions"),
                             tables.read_table(spark, processed, "clicks"), 2, "val", queries.SPLIT)
    assert not set(frame.columns) & {"payprice", "bidprice", "logtype", "keypage", "season", "date"}


def test_chain_of_evidence(spark, base):
    """Every gate lets the right input through and stops a wrong one."""
    out = f"{base}/evidence"
    jobs.train(spark, base, out, rate=0.2, chosen=queries.SPLIT, c_grid=[0.1], max_iter=5, dimension=1 << 10)
    moved = split.Split({**queries.SPLIT.ranges, "val": ("2024-01-21", "2024-01-24")})
    with pytest.raises(ValueError, match="not the one of the training"):
        jobs.score_test(spark, base, out, chosen=moved)
    record = artifacts.read_record(spark, f"{out}/evaluation-val")
    artifacts.write_record(spark, f"{out}/evaluation-val", {**record, "auc": record["auc"] + 1e-6}, overwrite=True)
    with pytest.raises(AssertionError, match="not reproduced"):
        jobs.score_test(spark, base, out, chosen=queries.SPLIT)
    artifacts.write_record(spark, f"{out}/evaluation-val", record, overwrite=True)
    assert jobs.score_test(spark, base, out, chosen=queries.SPLIT).where("p_calibrated between 0 and 1").count() > 0
    with pytest.raises(FileExistsError):
        jobs.score_test(spark, base, out, chosen=queries.SPLIT)
    jobs.calibrate_scores(spark, out)
    scores, info = jobs.verified_scores(spark, out, TEST_DAYS)
    with pytest.raises(ValueError, match="do not cover"):
        jobs.verified_scores(spark, out, ("2024-01-25", "2024-01-26"))
    whole = jobs.materialize(scores, "whole")
    for change, error, words in (({"sampling_rate": 0.5}, ValueError, "differ"), ({"calibrator_fit_split": "test"}, ValueError, "wrong splits")):
        artifacts.write_record(spark, f"{out}/test-calibrated/info", {**info, **change}, overwrite=True)
        with pytest.raises(error, match=words):
            jobs.verified_scores(spark, out, TEST_DAYS)
    artifacts.write_predictions(whole.withColumn("p_calibrated", whole.p_raw), f"{out}/test-calibrated", info)
    with pytest.raises(AssertionError, match="not those of rate"):
        jobs.verified_scores(spark, out, TEST_DAYS)
    artifacts.write_predictions(whole, f"{out}/test-calibrated", info)
    stored = jobs.store_sweep(spark, base, out, "first", TEST_DAYS)
    with pytest.raises(FileExistsError):
        jobs.store_sweep(spark, base, out, "first", TEST_DAYS)
    again, about = jobs.read_sweep(spark.newSession(), out, "first")
    assert about["n_results"] == 400 == again.count() and about["date_range"] == list(TEST_DAYS)
    assert sorted(map(str, again.select("run_id", "total_spend").collect())) == sorted(map(str, stored.select("run_id", "total_spend").collect()))
    artifacts.write_record(spark, f"{out}/sweeps/first/info", {**about, "n_results": 401}, overwrite=True)
    with pytest.raises(ValueError, match="lost"):
        jobs.read_sweep(spark, out, "first")
