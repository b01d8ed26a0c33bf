"""The search over window lengths against plain loops, in chunks shorter than the series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from barsmith.operators import search as H

SETS = [H.ParameterSet(1, 3, 4, 2, 1.0), H.ParameterSet(2, 7, 2, 9, 0.5), H.ParameterSet(3, 1, 1, 1, 2.0), H.ParameterSet(4, 300, 5, 5, 1.0)]


def made(symbol, n, missing=0.0):
    r = np.random.default_rng(n)
    close = (50 + r.normal(size=n).cumsum()).round(1)
    start = dt.datetime(2024, 1, 1)
    rows = [[symbol, start + dt.timedelta(days=i), float(c + r.integers(0, 3)), float(c - r.integers(0, 3)), float(c), float(i)] for i, c in enumerate(close)]
    for row in rows:
        if r.random() < missing:
            row[int(r.integers(2, 5))] = None
    return rows


ROWS = made("a", 211) + made("b", 60, 0.03) + made("c", 1) + made("d", 12)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([(*x, 7) for x in [*ROWS, [None, dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0]]], "symbol string, ts timestamp_ntz, high double, low double, close double, idx_ double, n_ long")


def plain(rows, p):
    """(trades, mean profit) of one series and set."""
    high, low, close = ([x[k] for x in rows] for k in (2, 3, 4))
    spans, stops = [], []
    for i in range(len(rows)):
        known = [high[i] - low[i]] if None not in (high[i], low[i]) else []
        known += [abs(close[i - 1] - x) for x in (high[i], low[i]) if i and close[i - 1] is not None and x is not None]
        spans.append(max(known) if known else None)
    for i in range(len(rows)):
        ranges, lows = spans[i - p.atr : i], low[i - p.lower : i]
        whole = i >= p.atr and i >= p.lower and None not in ranges and None not in lows and close[i - 1] is not None
        stops.append(max(close[i - 1] - sum(ranges) / p.atr * p.margin, min(lows)) if whole else None)
    profits = []
    for i in range(len(rows)):
        highs = high[i - p.upper : i] if i >= p.upper else [None]
        if stops[i] is None or None in highs or None in (high[i], close[i]) or high[i] <= max(highs):
            continue
        exits = [s for s, c in zip(stops[i:], close[i:], strict=True) if s is not None and c is not None and c < s - 1e-12]
        profits += [exits[0] / close[i] - 1] if exits else []
    return len(profits), sum(profits) / len(profits) if profits else None


def by_symbol(rows):
    return {s: [x for x in rows if x[0] == s] for s in "abcd"}


def test_sets_cover_the_ranges():
    sets = H.spread()
    assert len(sets) == 105 and len({(p.atr, p.upper, p.lower, p.margin) for p in sets}) == 105
    assert all(2 <= n <= 900 for p in sets for n in (p.atr, p.upper, p.lower)) and all(1 <= p.margin <= 5 for p in sets)
    assert max(p.atr for p in sets) > 700 and min(p.upper for p in sets) < 4


def test_windows_of_every_length():
    r = np.random.default_rng(1)
    high, low = r.random(40) + 1, r.random(40)
    high[17] = np.nan
    w = H.Windows(high, low, low, True)
    for n in (1, 2, 3, 8, 13, 39, 40, 55):
        for got, x, pick in ((w.highest(n), high, np.max), (w.lowest(n), low, np.min)):
            want = [pick(x[i - n : i]) if i >= n else np.nan for i in range(40)]
            assert np.array_equal(got, want, equal_nan=True)


@pytest.mark.parametrize("sets", [SETS[:3], SETS])
def test_sweep_by_loops(bars, sets):
    """Chunks of 16 bars, and one of the longest window; trades that exit chunks later; missing prices; a series of one bar."""
    rows, size = H.chunked(bars, sets, 16)
    assert size == (16 if len(sets) == 3 else 301)
    got = {(x.symbol, x.param_id): (x.trades, x.score) for x in H.reviews(rows, sets, size).collect()}
    want = {(s, p.param_id): plain(x, p) for s, x in by_symbol(ROWS).items() for p in sets}
    assert got.keys() == want.keys() and sum(n for n, _ in want.values()) > 50
    for key, (n, mean) in want.items():
        assert got[key][0] == n and (got[key][1] is None if mean is None else abs(got[key][1] - mean) < 1e-9)


def test_halving_by_loops(bars, monkeypatch):
    chunked = H.chunked
    monkeypatch.setattr(H, "chunked", lambda b, s: chunked(b, s, 16))
    got = {x.symbol: (x.param_id, x.trades) for x in H.halving(bars, SETS[:3], ((0.4, 0.6),)).collect()}
    for s, rows in by_symbol(ROWS).items():
        left = SETS[:3]
        for share, keep in ((0.4, 2), (1.0, 1)):
            seen = rows[: int(np.ceil(round(len(rows) * share, 6)))]
            found = {p: plain(seen, p) for p in left}
            left = sorted(left, key=lambda p: (found[p][1] is None, -round(found[p][1] or 0, 6), p.param_id))[:keep]
        assert got[s] == (left[0].param_id, plain(rows, left[0])[0])


def test_empty_table(bars):
    assert H.sweep(bars.limit(0), SETS).count() == 0
    assert H.halving(bars.limit(0), SETS).count() == 0
