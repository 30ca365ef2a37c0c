"""Runs registered queries and their SQL side by side and compares the values.

    python tests/oracle_compare.py sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TESTDATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(value) -> str:
    if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        number = float(value)
        return str(int(number)) if number == int(number) else repr(round(number, 9))
    return str(value).removesuffix(" 00:00:00")


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(zip(*[[_cell(v) for v in df[c].tolist()] for c in df.columns]))


def difference(found: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} against {sorted(wanted.columns)}"
    if len(found) != len(wanted):
        return f"{len(found)} rows against {len(wanted)}"
    a, b = canonical(found), canonical(wanted)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(off)} of {len(a)} rows differ, columns {sorted(found.columns)}, first {off[0]}" if off else None


def main() -> int:
    from bidlens.plans.oracles import ORACLES
    from bidlens.plans.queries import QUERIES
    from bidlens.session import build_session
    scale, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    folder = f"{TESTDATA}/{scale}"
    spark = build_session("compare", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            found = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            problem = difference(found, con.execute(ORACLES[name]).df()) if name in ORACLES else "rows only"
        except Exception as error:  # report and go on with the next query
            found, took, problem = pd.DataFrame(), time.time() - start, f"ERROR {str(error)[:500]}"
        bad += bool(problem) and problem != "rows only"
        print(f"{name:26s} {len(found):8d} rows {took:7.2f} s  {problem or 'ok'}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
