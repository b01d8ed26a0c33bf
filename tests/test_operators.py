"""Helpers against plain restatements, invariants, and edge tables."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith.functions import scalars as S
from barsmith.operators import accounts as A
from barsmith.operators import distributions as D
from barsmith.operators import indicators as I
from barsmith.operators import labels as L
from barsmith.operators import reviews as V
from barsmith.operators import wavelets as W
from barsmith.plans import analytics, registry  # noqa: F401

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, vol double"
START = dt.datetime(2024, 1, 1)


def bars(spark, closes, symbol="a", vol=5.0, step=6):
    rows = [(symbol, START + dt.timedelta(hours=step * i), c, None if c is None else c + 1, None if c is None else c - 1, c, vol) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def walk(n, seed=1):
    r = random.Random(seed)
    x, out = 50.0, []
    for _ in range(n):
        x = max(5.0, x + r.gauss(0, 2))
        out.append(round(x, 2))
    return out


def naive_kalman(close, vol, pred, vola, glv, gls, w, q=1e-3, r=1e-3, alpha=0.6, gamma=0.2, beta=0.2):
    out = []
    for t in range(len(close)):
        at = [i for i in range(max(0, t - w + 1), t + 1) if not math.isnan(vola[i])]
        if not at:
            out.append(close[t])
            continue
        x, p, before = pred[at[0]], 1.0, close[at[0]]
        for i in at[1:]:
            lv, ls = math.log(max(vol[i], 1e-6)), math.log(vola[i]) if vola[i] > 0 else 0.0
            noise = r * min(max(math.exp(-alpha * (lv - glv[t])), 0.1), 2.0) * math.exp(gamma * (ls - gls[t])) * math.exp(-beta * abs(close[i] - before))
            p += q
            k = p / (p + noise)
            x, p, before = x + k * (close[i] - x), (1 - k) * p, close[i]
        out.append(x)
    return out


def test_rolling_kalman():
    rng = np.random.default_rng(3)
    n = 120
    close, vol, vola = 50 + rng.normal(size=n).cumsum(), rng.uniform(1, 9, n), np.abs(rng.normal(size=n)) + 0.01
    vola[:3] = np.nan
    vola[40] = np.nan
    args = (close, vol, close * 1.01, vola, rng.normal(size=n), rng.normal(size=n))
    assert np.allclose(A.rolling_kalman(*args, 15), naive_kalman(*[a.tolist() for a in args], 15))


def test_ewm_is_the_recursion(spark):
    closes = walk(80)
    df = A.ewm_columns(bars(spark, closes).select("symbol", "ts", "close"), {"e": ("close", 0.2, False), "a": ("close", 0.2, True)})
    e, num, den = closes[0], 0.0, 0.0
    for row in df.orderBy("ts").collect():
        e = e + 0.2 * (row.close - e)
        num, den = num * 0.8 + row.close, den * 0.8 + 1
        assert row.e == pytest.approx(e) and row.a == pytest.approx(num / den)


def test_barriers_by_brute_force(spark):
    closes = walk(150, 5)
    df = I.turtle(bars(spark, closes))
    rows = df.orderBy("ts").collect()
    got = {r.ts: r for r in L.barrier_labels(df, 1.1, 0.9, 1.2, horizon=60, block=16).collect()}
    for i, e in enumerate(rows):
        stop = take = None
        for k, x in enumerate(rows[i + 1 : i + 61], 1):
            hit = (e.atr is not None and x.atr is not None and x.atr > 1.2 * e.atr) or (x.turtle_l is not None and x.close < x.turtle_l) or x.close <= 0.9 * e.close
            stop = stop or ((k, x.close) if hit else None)
            take = take or (max(float(k), 0.5) if x.high > 1.1 * e.close else None)
        g = got[e.ts]
        assert (g.stop_cost, g.stop_sell) == (stop or (None, None)) and g.take_cost == take


def test_barriers_look_to_the_end_of_the_series(spark):
    df = I.turtle(bars(spark, [100.0] * 1200 + [150.0, 80.0]))
    first = min(L.barrier_labels(df.withColumn("turtle_l", F.lit(0.0)).withColumn("atr", F.lit(1.0)), 1.1, 0.9).collect(), key=lambda r: r.ts)
    assert (first.take_cost, first.stop_cost, first.stop_sell) == (1200.0, 1201, 80.0)


def test_labels_never_exit_before_entry_and_are_causal(spark):
    closes = walk(120, 7)
    full = {r.ts: r for r in L.exit_labels(I.turtle(bars(spark, closes))).collect()}
    part = {r.ts: r for r in L.exit_labels(I.turtle(bars(spark, closes[:90]))).collect()}
    for ts, r in part.items():
        assert r.matured is None or r.matured >= ts
        assert (r.turtle_h, r.atr, r.exit_price, r.buy_signal) == (full[ts].turtle_h, full[ts].atr, full[ts].exit_price, full[ts].buy_signal)
        if r.matured is not None:
            assert (r.sell, r.matured) == (full[ts].sell, full[ts].matured)


def test_cash_is_conserved(spark):
    rows = [("a", START + dt.timedelta(days=i), 0.1 if i % 3 else -0.2, START + dt.timedelta(days=i + 2), 2, 0.5) for i in range(20)]
    rows += [("a", START + dt.timedelta(days=40), None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, profit double, matured timestamp_ntz, time_cost long, kelly double")
    out = A.cash_replay(df).orderBy("ts").collect()
    paid = sum(o.invested * (1 + r[2]) for o, r in zip(out, rows, strict=True) if r[2] is not None)
    assert out[-1].fund == pytest.approx(1000 - sum(o.invested for o in out) + paid)
    assert all(o.fund >= 0 for o in out)


def test_ledger_matches_a_plain_fold(spark):
    rng = random.Random(2)
    fills = [("a", i, rng.choice(["buy", "sell"]), rng.uniform(1, 5), rng.uniform(10, 20), START) for i in range(60)]
    df = spark.createDataFrame(fills, "symbol string, seq long, side string, position double, price double, time timestamp_ntz")
    held = avg = cash = 0.0
    for row, (_, _, side, pos, price, _) in zip(A.fill_ledger(df).orderBy("rn").collect(), fills, strict=True):
        profit = None
        if side == "buy":
            avg, held, cash = (avg * held + pos * price) / (held + pos), held + pos, cash - pos * price
        else:
            sold = min(pos, held)
            profit = price / avg - 1 if sold > 0 else None
            held, cash = held - sold, cash + sold * price
        assert row.held == pytest.approx(held) and row.cash == pytest.approx(cash) and row.held >= 0
        assert (row.profit is None) == (profit is None) and (profit is None or row.profit == pytest.approx(profit))


def test_stream_accounts_equal_batch(spark, sf):
    batch, stream = (sorted(map(tuple, registry.QUERIES[n](spark, sf).collect()), key=str) for n in ("g9_paper_account", "t5_stream_accounts"))
    assert batch == stream


def test_account_gate_and_stake():
    bar = {"high": 11.0, "low": 9.0, "close": 10.0, "exit_price": 8.0, "take_profit": None, "buy_signal": True, "hold": None}
    target = lambda state=A.STATE, **change: A.account_step(state, {**bar, **change}, 100.0, 0.9, 2.0)[0]["target"]
    assert target() == 10.0
    assert [target(buy_signal=False), target(hold=True), target(exit_price=None), target(exit_price=float("nan")), target(exit_price=9.99), target({**A.STATE, "cash": 10.0})] == [0.0] * 6
    assert target({**A.STATE, "avg_cost": 9.0}, exit_price=9.99) == 10.0  # leaves at 8.1, the cutoff of the last cost
    assert target({**A.STATE, "avg_cost": 20.0}, exit_price=9.99) == 0.0
    state = {**A.STATE, "target": 10.0, "atr_exit": 8.0}
    for bet, stake in ((1.0, 100.0), (0.5, 50.0), (0.01, A.MIN_STAKE)):
        got, done, price = A.account_step(state, bar, 100.0, 0.9, 2.0, bet)
        assert (done, price) == ("BUY", 10.0) and got["cash"] == pytest.approx(1000 - stake) and got["position"] == pytest.approx(stake / 10)


def test_regimes_of_separable_data():
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 60)
    x = rng.normal(size=(240, 2)) + truth[:, None] * 6
    got = A.gaussian_regimes(x, x[:, 0] > np.median(x[:, 0]))
    assert max((got == truth).mean(), (got != truth).mean()) > 0.98


def test_wavelet_is_exact_without_threshold():
    x = np.random.default_rng(0).normal(size=101)
    assert np.allclose(W.soft_smooth(x, threshold=0.0), x)
    assert W.soft_smooth(x, threshold=5.0).std() < x.std()


def test_density_peak_is_near_the_mode():
    x = np.concatenate([np.random.default_rng(4).normal(2, 0.1, 500), np.random.default_rng(5).normal(0, 1, 200)])
    assert abs(D.kde_peak(x) - 2) < 0.1
    assert math.isnan(D.kde_peak(np.array([1.0])))


def test_mass_sums_to_one(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("a", -0.2), ("b", None), ("b", 0.3)], "symbol string, profit double")
    sums = {r.symbol: r.s for r in D.mass_function(df).groupBy("symbol").agg(F.sum("pmf").alias("s")).collect()}
    assert sums == {"a": pytest.approx(1), "b": pytest.approx(1)}


@pytest.mark.parametrize("closes", [[], [10.0], [10.0] * 40, [float(i) for i in range(1, 41)], [10.0, None, 11.0] * 12], ids=["empty", "one bar", "constant", "rising", "null cells"])
def test_edge_series(spark, closes):
    df = bars(spark, closes)
    out = L.exit_labels(I.turtle(df))
    assert out.count() == len(closes)
    if closes == [float(i) for i in range(1, 41)]:
        assert out.filter("sell is not null").count() == 0
    for f in (lambda d: I.on_balance_volume(d, 5, 2), lambda d: I.volume_weighted(d, 5), lambda d: I.surprise(d, 5), lambda d: I.mean_reversion(d, 3, 5, 5), lambda d: I.returns_block(d, 5), I.hysteresis, lambda d: I.ribbon(d, 5, 2)):
        assert f(df).count() == len(closes)
    assert V.performance(out.filter("buy_signal")).count() <= 1


def test_zero_volume(spark):
    assert I.volume_weighted(bars(spark, walk(30), vol=0.0), 5).filter("vwma is not null").count() == 0


def test_kelly_bounds(spark):
    df = spark.createDataFrame([(p / 10, l / 10, g / 10) for p in range(11) for l in range(4) for g in range(4)], "p double, l double, g double")
    out = df.select(S.kelly(F.col("p"), F.col("l"), F.col("g")).alias("k")).collect()
    assert all(0 <= r.k <= 1 for r in out)


def test_odds_round_trip(spark):
    df = spark.createDataFrame([(p / 20,) for p in range(20)], "p double")
    assert all(abs(r.p - r.q) < 1e-6 for r in df.select("p", S.from_odds(S.odds(F.col("p"))).alias("q")).collect())


def test_bad_order_time_is_null(spark):
    df = spark.createDataFrame([("x_20240102_030405_CUTOFF",), ("x_20249999_030405_CUTOFF",), ("junk",)], "o string")
    assert [r.t for r in df.select(S.order_time(F.col("o")).alias("t")).collect()] == [dt.datetime(2024, 1, 2, 3, 4, 5), None, None]


def test_posterior_stays_a_probability():
    out = D.update_odds(pd.DataFrame({"likelihood": [1e9, 1e9, 1e-9, float("nan"), 0.0, 2.0]}))
    assert out["posterior"].between(0, 1).all()


def test_stream_accounts_write_bars_in_many_tasks(spark, sf, monkeypatch):
    paths, replay = [], analytics.B.replay
    monkeypatch.setattr(analytics.B, "replay", lambda spark, path, *rest: paths.append(path) or replay(spark, path, *rest))
    monkeypatch.setattr(analytics.B, "drain", lambda stream, label: spark.createDataFrame([], "symbol string, ts timestamp, reason string, price double, cash double, position double, avg_cost double"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        registry.QUERIES["t5_stream_accounts"](spark, sf)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(paths[0]).inputFiles()) > 1
