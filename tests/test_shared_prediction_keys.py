"""Sweeps over events of one moment: predictions that share their key are averaged on both sides."""

import duckdb
import pytest

from bidlens.plans import oracles, queries
from oracle_compare import TESTDATA, difference

NAMES = ["best_of_sweep", "dashboard_readback", "sweep_cells", "sweep_results", "sweep_series"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Every other event has time and user of the event before it, with which it shares the bid id."""
    path = str(tmp_path_factory.mktemp("shared-keys"))
    duckdb.connect().execute(f"""COPY (SELECT e.event_id, f.ts, f.user_id, e.event_type, e.value, e.props
        FROM '{TESTDATA}/sf0.001/events.parquet' e JOIN '{TESTDATA}/sf0.001/events.parquet' f ON f.event_id = e.event_id // 2 * 2)
        TO '{path}/events.parquet'""")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_shared_keys_match_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert difference(queries.QUERIES[name](spark, folder).toPandas(), con.execute(oracles.ORACLES[name]).df()) is None
