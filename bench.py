"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bidlens.plans import event_logs, queries  # noqa: E402
from bidlens.session import build_session, new_table_path  # noqa: E402
from bidlens.sources import rawlogs, tables  # noqa: E402

HEADLINE = [
    "table_counts", "null_rates", "parse_raw_lines", "click_label", "feature_table", "downsample_negatives",
    "vocabulary_rare", "auc_by_advertiser", "evaluation_record", "matched_edge_bins", "seen_unseen",
    "zero_price_concentration", "price_quantiles", "settle_constant", "sweep_results", "hourly_spend",
    "dashboard_json",
]


COPIES = 10


def write_raw_files(spark, folder: str) -> str:
    """The bid log as daily bz2 files of raw lines, each line repeated to fill the files."""
    raw = new_table_path(spark, "raw")
    lines = event_logs.raw_lines(event_logs.bids(spark, folder), "bid").selectExpr(
        "date", "line as value", f"explode(sequence(1, {COPIES})) as copy").drop("copy")
    lines.repartition(8, "date").write.partitionBy("date").option("compression", "bzip2").text(raw)
    return raw


def ingest_raw_files(spark, raw: str) -> tuple[float, int]:
    """Raw bz2 lines parsed into hive-partitioned Parquet."""
    start, root = time.time(), new_table_path(spark, "ingest")
    lines = spark.read.text(raw).selectExpr("value as line", "2 as season", "date")
    tables.write_table(rawlogs.parse_lines(lines, "bid"), root, "bids")
    took = time.time() - start
    return took, tables.read_table(spark, root, "bids").count()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    raw = write_raw_files(spark, folder)
    ingest_raw_files(spark, raw)  # warm-up: class loading and first compilation, not timed
    seconds = {}
    took, rows = ingest_raw_files(spark, raw)
    seconds["ingest_raw_files"] = round(took, 3)
    for name in HEADLINE:
        queries._SWEEPS.clear()  # each query pays for its own sweep
        start = time.time()
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"), "cpus": int(cpus),
        "ingest_rows": rows, "ingest_rows_per_sec": round(rows / took, 1)}))


if __name__ == "__main__":
    main()
