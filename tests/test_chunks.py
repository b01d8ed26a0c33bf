"""Chunked recursions against the same recursion over the whole series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith.operators import accounts as A
from barsmith.operators import chunks as C


def made(n, seed, holes=0.2):
    r = np.random.default_rng(seed)
    x = r.normal(size=n).cumsum() + 50
    x[r.random(n) < holes] = np.nan
    return x


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for symbol, n in (("a", 97), ("b", 10), ("c", 1), ("d", 40), ("e", 30)):
        x = made(n, n, 1.0 if symbol == "e" else 0.3)
        rows += [(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=int(d)), None if v != v else float(v)) for d, v in zip(np.sort(np.random.default_rng(n).choice(1000, n, False)), x, strict=True)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")


def series(df, *cols):
    got = df.toPandas().sort_values(["symbol", "ts"])
    return {s: [g[c].to_numpy(float) for c in cols] for s, g in got.groupby("symbol")}


def test_numbers_run_through_each_series(bars):
    rows = C.numbered(bars, 7, days=30).toPandas().sort_values(["symbol", "ts"])
    for _, g in rows.groupby("symbol"):
        assert g["idx_"].tolist() == list(range(len(g))) and (g["chunk_"] == g["idx_"] // 7).all()


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_exponential_means_with_holes(bars, size):
    specs = {"fast": ("x", 0.4, False), "slow": ("x", 0.05, False), "even": ("x", 0.3, True)}
    for _, (x, *found) in series(C.exponential_means(bars, specs, size), "x", *specs).items():
        for (_, alpha, adjust), y in zip(specs.values(), found, strict=True):
            np.testing.assert_allclose(y, pd.Series(x).ewm(alpha=alpha, adjust=adjust).mean(), rtol=1e-12)


def test_halo_gives_what_the_whole_series_gives(bars):
    fill = lambda pdf: pdf.assign(most=pdf["x"].rolling(9, min_periods=1).max())
    for _, (x, y) in series(C.with_halo(bars, 9, fill, "most double", size=11), "x", "most").items():
        np.testing.assert_array_equal(y, pd.Series(x).rolling(9, min_periods=1).max())


def plain_trend(z, q=1e-4, r=1e-2):
    out, x, p = np.full(len(z), np.nan), None, np.eye(2)
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0], [1.0, 0.0]])
    for i, obs in enumerate(z):
        if np.isnan(obs).any():
            continue
        if x is None:
            x = np.array([obs.mean(), 0.0])
        else:
            x, p = f @ x, f @ p @ f.T + q * np.eye(2)
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r * np.eye(2))
            x, p = x + k @ (obs - h @ x), (np.eye(2) - k @ h) @ p
        out[i] = x[0]
    return out


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_trend_filter(bars, size):
    df = bars.withColumns({"ema": F.col("x"), "wma": F.when(F.dayofmonth("ts") % 5 != 0, F.col("x") + 1)})
    for _, (ema, wma, trend) in series(C.trend_levels(df, 1e-4, 1e-2, size), "ema", "wma", "trend").items():
        np.testing.assert_allclose(trend, plain_trend(np.stack([ema, wma], 1)), rtol=1e-9)


def test_one_long_series_spreads_over_tasks(spark):
    """A symbol of 300,000 one-minute bars: dozens of chunks, and the same means as in one go."""
    n = 300_000
    df = spark.range(n).select(F.lit("a").alias("symbol"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"), (F.sin(F.col("id") / 50) * 10 + F.col("id") % 7).alias("x"))
    out = A.ewm_columns(df, {"m": ("x", A.span(60), False)})
    got = out.orderBy("ts").toPandas()
    np.testing.assert_allclose(got["m"], got["x"].ewm(alpha=A.span(60), adjust=False).mean(), rtol=1e-12, atol=1e-9)
    assert C.numbered(df).select("chunk_").distinct().count() == -(-n // C.SIZE)
