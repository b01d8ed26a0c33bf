"""Binned densities against exact ones, registered aggregates, and the plan of the volatility gate."""

from __future__ import annotations

import datetime as dt
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.operators import distributions as D
from barsmith.operators import indicators as I
from barsmith.plans.registry import PLAN


def exact(x, at):
    width = x.std(ddof=1) * len(x) ** -0.2
    return np.exp(-0.5 * ((at[:, None] - x[None, :]) / width) ** 2).sum(1)


def test_binned_peak_is_nearly_the_densest_place(spark):
    r = np.random.default_rng(2)
    groups = {"normal": r.normal(size=500), "two": np.concatenate([r.normal(-3, 0.5, 200), r.normal(4, 0.7, 260)]), "long": r.lognormal(0, 2, 400), "pair": np.array([1.0, 2.0]), "same": np.array([3.0] * 5), "one": np.array([1.0]), "tail": np.append(r.normal(size=300), 1e4)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("normal", None)], "symbol string, profit double")
    peaks = {row.symbol: row.peak for row in D.density_peaks(df).collect()}
    assert set(peaks) == set(groups) and peaks["same"] is None and peaks["one"] is None
    for k in set(groups) - {"same", "one"}:
        x = groups[k]
        grid = np.linspace(x.min(), x.max(), 1000)
        best = exact(x, grid).max()
        width, step = x.std(ddof=1) * len(x) ** -0.2, grid[1] - grid[0]
        # a value moves by half a place at most, which changes its part by less than the kernel's steepest slope allows
        most = len(x) * step / 2 * np.exp(-0.5) / width
        assert exact(x, np.array([peaks[k]]))[0] >= best - 2 * most - 1e-9 * best


def test_registered_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 4.0)], "symbol string, profit double")
    rows = {r.symbol: r for r in D.aggregate_with(df, ("mean", "median", "density_peak")).collect()}
    assert rows["a"].mean == 3 and rows["a"].median == 2 and 1 <= rows["a"].density_peak <= 2.5 and rows["b"].density_peak is None
    with pytest.raises(ValueError):
        D.aggregate_with(df, ("mode",))
    assert D.aggregate_with(df.limit(0), ("mean", "density_peak")).count() == 0


def test_volatility_plan(spark):
    r = np.random.default_rng(5)
    close = np.round(r.normal(size=40).cumsum() + 50, 3)
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(c)) for i, c in enumerate(close)], "symbol string, ts timestamp_ntz, close double")
    got = sorted((x.ts, x.action, x.level, x.ratio, round(x.price, 6)) for x in I.volatility_plan(df, 5, PLAN, F.lit(7.0)).collect())
    want, ring = [], []
    for i in range(4, 40):
        last = close[i - 4 : i + 1].tolist()
        std = statistics.stdev(last)
        ring = [*ring, std][-10:]
        if std >= statistics.median(ring):
            want += [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), a, lv, x, round((7.0 if a == "S" else statistics.mean(last)) + lv * std, 6)) for a, lv, x in PLAN]
    assert got == sorted(want)
