"""The regime model against sums over all paths of states, and labels that later bars cannot change."""

from __future__ import annotations

import datetime as dt
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from barsmith.operators import regimes as R


def normal(x, mean, cov):
    diff = x - mean
    return np.exp(-0.5 * diff @ np.linalg.inv(cov) @ diff) / np.sqrt((2 * np.pi) ** len(x) * np.linalg.det(cov))


def paths(x, start, trans, means, covs):
    """(path, probability with the observations) of every path of states."""
    for path in product((0, 1), repeat=len(x)):
        p = start[path[0]]
        for t, s in enumerate(path):
            p *= normal(x[t], means[s], covs[s]) * (trans[path[t - 1], s] if t else 1)
        yield path, p


def some(seed, n=8, d=2):
    r = np.random.default_rng(seed)
    a = r.normal(size=(2, d, d))
    return r.normal(size=(n, d)), np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.35, 0.65]]), r.normal(size=(2, d)), a @ a.transpose(0, 2, 1) + 0.3 * np.eye(d)


def test_expected_statistics_against_all_paths():
    for seed in range(5):
        x, start, trans, means, covs = some(seed)
        weighted = list(paths(x, start, trans, means, covs))
        total = sum(p for _, p in weighted)
        gamma, pairs = np.zeros((len(x), 2)), np.zeros((2, 2))
        for path, p in weighted:
            for t, s in enumerate(path):
                gamma[t, s] += p / total
                if t:
                    pairs[path[t - 1], s] += p / total
        np.testing.assert_allclose(R.expected(x, start, trans, means, covs), R.statistics(x, gamma, pairs), rtol=1e-9)


def test_maximum_from_statistics():
    x, high = np.random.default_rng(1).normal(size=(30, 3)), np.arange(30) % 3 == 0
    start, trans, means, covs = R.parameters(R.maximised(R.first_guess(x, high), 3), 3)
    g = np.where(high, 0.95, 0.05)
    np.testing.assert_allclose(means[1], (g[:, None] * x).sum(0) / g.sum())
    np.testing.assert_allclose(covs[1], np.cov(x.T, aweights=g, ddof=0) + R.FLOOR * np.eye(3))
    np.testing.assert_allclose(trans, [[0.9, 0.1], [0.1, 0.9]])


def bars(spark, n, seed=3, later=0.0):
    """Two symbols that change between two regimes every 25 bars; ``later`` shifts the bars of the last fifth."""
    r, rows = np.random.default_rng(seed), []
    for symbol in "ab":
        for i in range(n):
            up = i // 25 % 2
            x = r.normal(2.0 * up - 1, 0.6, 2) + (later if i >= 0.8 * n else 0)
            rows.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(x[0]), float(x[1]) if i % 40 else None, bool(up)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, f double, slope double, truth boolean")


def plain_filter(x, model, d=2):
    start, trans, means, covs = R.parameters(model, d)
    out = []
    for t in range(len(x)):
        weighted = list(paths(x[max(0, t - 9) : t + 1], start, trans, means, covs))
        out.append(sum(p for path, p in weighted if path[-1]) / sum(p for _, p in weighted))
    return out


def test_filter_over_chunks_against_all_paths(spark):
    df = bars(spark, 60).filter("slope is not null")
    model = R.fit_regimes(df, ["f", "slope"], "slope", F.lit(True), size=7, rounds=2)
    small = df.filter(F.col("ts") < F.lit(dt.datetime(2024, 1, 1, 10)))
    models = {r.symbol: r for r in model.collect()}
    got = R.label_regimes(small, model, ["f", "slope"], size=3).orderBy("symbol", "ts").collect()
    for symbol, m in models.items():
        rows = [r for r in got if r.symbol == symbol]
        x = (np.array([[r.f, r.slope] for r in rows]) - m.center) / np.array(m.spread)
        np.testing.assert_allclose([r.p_high for r in rows], plain_filter(x, m.model), rtol=1e-8)


def test_fit_adds_chunks(spark):
    """A fit over chunks of 16 bars is the fit of the chunks as series of their own."""
    df = bars(spark, 64).filter("slope is not null and symbol = 'a'")
    got = R.fit_regimes(df, ["f", "slope"], "slope", F.lit(True), size=16, rounds=3).first()
    pdf = df.orderBy("ts").toPandas()
    raw = pdf[["f", "slope"]].to_numpy()
    x, high = (raw - raw.mean(0)) / raw.std(0), pdf["slope"].to_numpy() > np.median(pdf["slope"])
    parts = [slice(i, i + 16) for i in range(0, len(x), 16)]
    model = R.maximised(sum(R.first_guess(x[p], high[p]) for p in parts), 2)
    for _ in range(3):
        model = R.maximised(sum(R.expected(x[p], *R.parameters(model, 2)) for p in parts), 2)
    np.testing.assert_allclose(got.model, model, rtol=1e-7, atol=1e-9)


def test_labels_are_right_and_never_look_ahead(spark):
    key = lambda df: {(r.symbol, r.ts): r.up for r in df.collect()}
    first = R.causal_regimes(bars(spark, 200), ["f", "slope"], size=32, rounds=4)
    labelled = first.filter("up is not null").collect()
    assert len(labelled) == sum(1 for r in first.collect() if r.slope is not None and r.ts >= dt.datetime(2024, 1, 1) + dt.timedelta(hours=100))
    assert sum(r.up == r.truth for r in labelled) / len(labelled) > 0.95
    a, b = key(first), key(R.causal_regimes(bars(spark, 200, later=5.0), ["f", "slope"], size=32, rounds=4))
    cut = dt.datetime(2024, 1, 1) + dt.timedelta(hours=160)
    assert all(a[k] == b[k] for k in a if k[1] < cut) and any(a[k] != b[k] for k in a if k[1] >= cut)


def test_without_enough_bars_there_is_no_label(spark):
    assert {r.up for r in R.causal_regimes(bars(spark, 12), ["f", "slope"], rounds=1).collect()} == {None}
    assert R.causal_regimes(bars(spark, 12).limit(0), ["f", "slope"], rounds=1).count() == 0


def test_account_buys_in_the_upper_regime_only(spark):
    from barsmith.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    up = {(r.symbol, r.ts): r.up for r in QUERIES["g3_causal_regimes"](spark, sf).collect()}
    rows = sorted(QUERIES["g9_regime_account"](spark, sf).collect(), key=lambda r: (r.symbol, r.ts))
    assert len(rows) == len(up)
    for a, b in zip(rows, rows[1:], strict=False):
        if b.symbol == a.symbol and b.reason == "BUY":
            assert up[(a.symbol, a.ts)]
