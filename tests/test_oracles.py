"""Every query with SQL gives the same values in DuckDB; the heavy ones are covered by
tools/check.py on the larger tables and by their own tests."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SLOW = {
    "rsi", "adx", "kama", "macd", "strategy_indicators", "technical_features", "technical_regimes", "feature_signals",
    "strategy_sizes", "trade_levels", "signal_events", "key_values", "strategy_snapshot", "training_export",
    "walk_forward_summary", "stream_indicators", "indicators_weekly", "adaptive_hull", "strategy_signals", "regime_models",
}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in SLOW])
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
