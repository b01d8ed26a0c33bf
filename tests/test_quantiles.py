"""Rolling quantiles against a sort per window, and paths drawn as counts against plain draws."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.operators import quantiles as Q
from barsmith.operators import reviews as V


def plain(values, n, p):
    out = []
    for i in range(len(values)):
        window = sorted(values[max(0, i - n + 1) : i + 1])
        out.append(window[max(math.ceil(round(p * len(window), 9)) - 1, 0)])
    return out


@pytest.mark.parametrize(("size", "n"), [(1, 1), (2, 5), (50, 1), (300, 7), (400, 140), (257, 900)])
def test_rolling_quantiles_by_sorting(size, n):
    values = np.random.default_rng(size).integers(-9, 9, size) / 7
    got = Q.rolling_quantiles(values, n, [0.05, 0.5, 0.95])
    for p, column in zip([0.05, 0.5, 0.95], got, strict=True):
        assert column.tolist() == plain(values.tolist(), n, p)


def test_rolling_interval_over_chunks(spark, monkeypatch):
    """Chunks of 40 rows, maturing times that tie, rows without profit or time, columns of other names, an empty table."""
    r, start = np.random.default_rng(5), dt.datetime(2024, 1, 1)
    rows = []
    for symbol, size in (("a", 230), ("b", 3)):
        for i in range(size):
            due = start + dt.timedelta(days=int(i + r.integers(0, 9)))
            rows.append((symbol, start + dt.timedelta(days=i), due if i % 11 else None, float(r.integers(-5, 9)) if i % 7 else None, i, i))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, matured timestamp_ntz, profit double, idx long, size long")
    fill = Q.chunks.with_halo
    monkeypatch.setattr(Q.chunks, "with_halo", lambda *a, **k: fill(*a, size=40, **k))
    got = {(x.symbol, x.ts): (x.lower, x.upper, x.loss_margin) for x in Q.rolling_credible_interval(df, 40).collect()}
    for symbol in ("a", "b"):
        known = sorted((x for x in rows if x[0] == symbol and x[2] and x[3] is not None), key=lambda x: (x[2], x[1]))
        values = [x[3] for x in known]
        for x, lower, upper in zip(known, plain(values, 40, 0.05), plain(values, 40, 0.95), strict=True):
            assert got.pop((symbol, x[1])) == (lower, upper, abs(lower))
    assert not got
    assert Q.rolling_credible_interval(df.limit(0), 40).count() == 0


@pytest.fixture(scope="module")
def trades(spark):
    r = np.random.default_rng(2)
    rows = [("a", float(x)) for x in r.normal(0.002, 0.02, 500).round(3)] + [("b", 0.1)] * 3 + [("c", -1.0), ("c", 0.5), ("d", None), (None, 0.2)]
    return spark.createDataFrame(rows, "symbol string, profit double")


def test_counts_draw_like_plain_draws(spark, trades):
    """Mean and spread of log growth in a tree of three children a node, against the exact moments of plain draws."""
    got = V.bootstrap_counts(trades, sims=2000, steps=300, fan=3)
    logs = np.array([x.log_growth for x in got.filter("symbol = 'a'").collect()])
    one = np.log1p([x.profit for x in trades.filter("symbol = 'a'").collect()])
    assert len(logs) == 2000
    assert abs(logs.mean() - 300 * one.mean()) < 5 * one.std() * math.sqrt(300 / 2000)
    assert abs(logs.std() / (one.std() * math.sqrt(300)) - 1) < 0.1
    again = V.bootstrap_counts(trades.repartition(3), sims=2000, steps=300, fan=3)
    assert again.select(F.round("log_growth", 9)).exceptAll(got.select(F.round("log_growth", 9))).count() == 0


def test_counts_of_constant_ruinous_and_missing_profits(trades):
    rows = V.bootstrap_counts(trades, sims=50, steps=40, bet=1.0).collect()
    assert {x.symbol for x in rows} == {"a", "b", "c"}
    assert all(abs(x.log_growth - 40 * math.log(1.1)) < 1e-9 and x.sim in range(50) for x in rows if x.symbol == "b")
    assert all(x.capital == 0 and x.log_growth is None for x in rows if x.symbol == "c")
    assert V.bootstrap_counts(trades.limit(0)).count() == 0
