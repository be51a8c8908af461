"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import importlib
import sys
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__
from emberlog.plans import queries as log_queries

SF = "/root/testdata/sf0.001"
TABLES = "customer documents events nation pages part supplier".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(log_queries.SQL))
def test_query_matches_sql(spark, oracle, name):
    found = log_queries.QUERIES[name](spark, SF)
    expected = oracle.sql(log_queries.SQL[name])
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    want = expected.df()[columns]
    want = want.astype(object).where(want.notna(), None)
    assert list(map(repr, rows)) == list(map(repr, sorted(map(tuple, want.values.tolist()), key=repr)))


#: Of each request, the column where some of its four events have another value.
ODD = [("value", None, {1}), ("user_id", None, {0}), ("user_id", None, {0, 1, 2, 3}), ("user_id", -5, {3}), ("event_type", None, {2}), ("ts", None, {0}), ("ts", None, {0, 1, 2, 3})]


def test_correlate_by_field_counts_events_that_lack_a_value(spark, tmp_path):
    def event(k, i):
        column, value, odd = ODD[k]
        usual = {"event_id": 4 * k + i, "ts": datetime(2024, 1, 1) + timedelta(microseconds=i * 1_000_500), "user_id": i, "event_type": "error", "value": 1.5}
        return usual | ({column: value} if i in odd else {})

    rows = [event(k, i) for k in range(len(ODD)) for i in range(4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(connection.sql(f"SELECT correlation_id, files, size, span_ms FROM ({log_queries.SQL['correlate_by_field']})").fetchall())
    assert [r[::2] for r in want] == [(f"r{k}", 4) for k in range(6)]  # the last has no time
    assert sorted(map(tuple, log_queries.QUERIES["correlate_by_field"](spark, str(tmp_path)).collect())) == want


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_everything_else_works_without_the_training_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("emberlog.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "emberlog.llm", None)
    entry = importlib.reload(__spark_entry__)
    try:
        assert set(entry.queries()) == set(log_queries.QUERIES) and set(entry.oracle_sql()) == set(log_queries.SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
