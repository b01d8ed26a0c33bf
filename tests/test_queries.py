"""Every query with SQL returns what DuckDB returns on the same tables; the others run."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from barsmith.plans import registry
from barsmith.sources import tables as T

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(normal(x[i]) for i in order) for x in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    found = duck.execute(registry.ORACLES[name])
    want = rows_of([d[0] for d in found.description], found.fetchall())
    df = registry.QUERIES[name](spark, SF)
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_odds_of_certain_events(spark):
    """Probabilities of exactly 1, of which the given tables have none."""
    path = T.scratch(spark, "certain")
    spark.createDataFrame([(1, 200.0), (2, 199.99), (3, 200.01), (4, 0.0), (5, None), (6, -1.0)], "event_id long, value double").write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path.removeprefix('file://')}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["f1_odds"]).fetchall()
    got = registry.QUERIES["f1_odds"](spark, path).collect()
    assert rows_of(["event_id", "odds", "p"], [tuple(x) for x in got]) == rows_of(["event_id", "odds", "p"], want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
