"""Profit distributions: win probabilities, margins, likelihoods, posteriors, bet sizes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import TINY, evidence_weight, kelly
from .indicators import series, yes


def mass_function(df: DataFrame, by: str = "symbol", digits: int = 5) -> DataFrame:
    """(by, profit, pmf, cdf) of rounded profits: counts are combined before the shuffle, the window runs over distinct values."""
    counted = df.filter("profit is not null").groupBy(by, F.round("profit", digits).alias("profit")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    share = F.col("n") / F.sum("n").over(w)
    below = F.sum("n").over(w.orderBy("profit").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    return counted.select(by, "profit", share.alias("pmf"), below.alias("cdf"))


def win_probability(df: DataFrame, by: str = "symbol") -> DataFrame:
    lost = F.avg((F.col("profit") <= 0).cast("int"))
    return df.groupBy(by).agg(lost.alias("p_loss"), (1 - lost).alias("p_win"))


def credible_interval(df: DataFrame, by: str = "symbol", mass: float = 0.9) -> DataFrame:
    """Discrete quantiles on either side of ``mass``; loss_margin is the lower one's size."""
    edge = (1 - mass) / 2
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by profit)")
    return df.groupBy(by).agg(q(round(edge, 6)).alias("lower"), q(round(1 - edge, 6)).alias("upper")).withColumn("loss_margin", F.abs("lower"))


def profit_margin(df: DataFrame, by: str = "symbol", digits: int = 5) -> DataFrame:
    """Most frequent positive profit; of equally frequent ones the smallest."""
    counted = df.filter("profit > 0").groupBy(by, F.round("profit", digits).alias("value")).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("profit_margin"), F.max("n").alias("times"))


def likelihood(df: DataFrame, windows: int, by: str = "symbol") -> DataFrame:
    """Evidence weight times P(win) / P(loss)."""
    lost = F.avg((F.col("profit") <= 0).cast("int"))
    out = df.groupBy(by).agg(F.count("*").alias("n"), lost.alias("p_loss"))
    return out.withColumn("likelihood", evidence_weight(F.col("n"), max(0.01 * windows, 3)) * F.try_divide(1 - F.col("p_loss"), F.greatest("p_loss", F.lit(TINY))))


def engine_likelihood(df: DataFrame, windows: int, by: str = "symbol") -> DataFrame:
    """Neutral without enough profits; otherwise weighted odds of the distribution, with the smallest loss as loss margin and
    the gains' densest place as profit margin, 0 where they have one value at most."""
    mid, known = windows / 2, F.col("profit").isNotNull()
    agg = df.groupBy(by).agg(
        F.count("*").alias("n"), F.count("profit").alias("known"), F.count_distinct(F.round("profit", 5)).alias("points"),
        F.avg(F.when(known, (F.col("profit") <= 0).cast("int"))).alias("p_loss"), F.count_distinct(F.when(F.col("profit") <= 0, F.col("profit"))).alias("losses"), F.min("profit").alias("worst"),
    )
    neutral = (F.col("n") < mid) | (F.col("known") == 0)
    raw = F.when(F.col("points") > 2, 1 / F.when(F.col("p_loss") == 0, 0.1).otherwise(F.col("p_loss")) - (1 - 10.0**-mid)).otherwise(1.0)
    gains = density_peaks(df.filter("profit > 0"), by)
    return agg.join(gains, by, "left").select(
        by, F.when(neutral | F.col("peak").isNull(), 0.0).otherwise(F.col("peak")).alias("profit_margin"), F.when(neutral, 1.0).otherwise(evidence_weight(F.col("n"), mid) * raw).alias("likelihood"),
        F.when(neutral | (F.col("points") <= 2), 0.5).otherwise(1 - F.col("p_loss")).alias("p_win"),
        F.when(neutral | (F.col("losses") <= 1), 0.0).otherwise(F.abs("worst")).alias("loss_margin"),
    )


def kde_peak(x: np.ndarray, points: int = 1000, block: int = 4096) -> float:
    """Argmax of a Gaussian density on an even grid between the extremes; Scott's bandwidth. NaN without two values."""
    x = x[~np.isnan(x)]
    if len(x) < 2 or x.std(ddof=1) == 0:
        return float("nan")
    width = x.std(ddof=1) * len(x) ** -0.2
    grid, total = np.linspace(x.min(), x.max(), points), np.zeros(points)
    for at in range(0, len(x), block):
        total += np.exp(-0.5 * ((grid[:, None] - x[None, at : at + block]) / width) ** 2).sum(1)
    return float(grid[total.argmax()])


def binned_peak(bins: np.ndarray, counts: np.ndarray, n: int, low: float, high: float, width: float, points: int) -> float:
    """The first of ``points`` even places from ``low`` to ``high`` where the counts' density is within a billionth of its largest."""
    step = (high - low) / (points - 1)
    apart = (np.arange(points)[:, None] - bins[None, :]) * (step / width)
    density = (np.exp(-0.5 * apart**2) * counts).sum(1)
    return float(low + step * np.flatnonzero(density >= density.max() * (1 - 1e-9))[0])


def density_peaks(df: DataFrame, by: str = "symbol", points: int = 1000, value: str = "profit") -> DataFrame:
    """(by, peak): where each group's values are densest under a Gaussian kernel of Scott's width, on ``points`` even places.

    Values go to the nearest place, and places are counted before they are shuffled: a group costs its places and not its
    values, at most ``points`` of them. Null without two different values.
    """
    known = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    stats = known.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("std"))
    width = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    stats = stats.filter("high > low").select(by, "n", "low", "high", width.alias("width"))
    place = F.round((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / (points - 1))).cast("int")
    counted = known.join(stats, by).groupBy(by, "n", "low", "high", "width", place.alias("bin")).agg(F.count("*").alias("times"))
    bins = counted.groupBy(by, "n", "low", "high", "width").agg(F.collect_list(F.struct("bin", "times")).alias("bins"))

    @F.pandas_udf("double")
    def peak(bins: pd.Series, n: pd.Series, low: pd.Series, high: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for b, *rest in zip(bins, n, low, high, width, strict=True):
            at, times = (np.array([x[k] for x in b], float) for k in ("bin", "times"))
            out.append(binned_peak(at, times, *rest, points))
        return pd.Series(out, dtype=float)

    found = bins.select(by, peak(F.expr("array_sort(bins)"), "n", "low", "high", "width").alias("peak"))
    return known.select(by).distinct().join(found, by, "left")


#: Aggregates by name, each a function of (table, group column, value column) that gives (group, name).
AGGREGATES = {
    "mean": lambda df, by, value: df.groupBy(by).agg(F.avg(value).alias("mean")),
    "median": lambda df, by, value: df.groupBy(by).agg(F.median(value).alias("median")),
    "density_peak": lambda df, by, value: density_peaks(df, by, value=value).withColumnRenamed("peak", "density_peak"),
}


def aggregate_with(df: DataFrame, names: tuple, by: str = "symbol", value: str = "profit") -> DataFrame:
    """(by, a column for each name) of registered aggregates; register more in ``AGGREGATES``. An unknown name raises."""
    out = df.select(by).distinct()
    for name in names:
        if name not in AGGREGATES:
            raise ValueError(f"no aggregate {name}")
        out = out.join(AGGREGATES[name](df, by, value), by, "left")
    return out


def conditional_likelihood(df: DataFrame, signal: str, by: str = "symbol") -> DataFrame:
    """P(signal | profit) / P(signal | loss), with 0/0 as 1 and zeros moved by 0.1."""
    win, lose = F.col("profit") > 0, F.col("profit") <= 0
    given = lambda c: F.coalesce(F.avg(F.when(c, F.col(signal).cast("int"))), F.lit(0.0))
    out = df.filter("profit is not null").groupBy(by).agg(given(win).alias("p_win"), given(lose).alias("p_loss"), F.sum(win.cast("int")).alias("wins"), F.sum(lose.cast("int")).alias("losses"))
    ratio = F.when((F.col("p_win") == 0) & (F.col("p_loss") == 0), 1.0).when(F.col("p_loss") == 0, F.col("p_win") + 0.1).when(F.col("p_win") == 0, 1 / (F.col("p_loss") + 0.1)).otherwise(F.try_divide("p_win", "p_loss"))
    return out.withColumn("likelihood", ratio)


def shrink(like: Column, wins: Column, losses: Column, enough: float = 30.0) -> Column:
    """Pull a likelihood toward 1 by how far its evidence falls short."""
    w = (wins + losses) / enough
    return F.when(w >= 1, like).when(like > 1, (like - 1) * w + 1).when(like < 1, 1 - (1 - like) * w).otherwise(like)


def posterior(df: DataFrame, prior: str, like: str, by: str) -> DataFrame:
    joint = F.col(prior) * F.col(like)
    return df.withColumn("posterior", F.try_divide(joint, F.sum(joint).over(Window.partitionBy(by))))


def profit_histogram(df: DataFrame, bins: int = 49, by: str = "symbol") -> DataFrame:
    """Counts in ``bins`` equal right-closed bins below zero and as many above, between the extremes."""
    known = df.filter("profit is not null and profit != 0").withColumn("side", F.when(F.col("profit") < 0, "loss").otherwise("win"))
    ends = known.groupBy(by).agg(F.min(F.when(F.col("side") == "loss", F.col("profit"))).alias("lo"), F.max(F.when(F.col("side") == "win", F.col("profit"))).alias("hi"))
    joined = known.join(ends, by)
    step = F.when(F.col("side") == "loss", -F.col("lo") / bins).otherwise(F.col("hi") / bins)
    base = F.when(F.col("side") == "loss", F.col("lo")).otherwise(0.0)
    place = F.ceil(F.round((F.col("profit") - base) / step, 9))
    return joined.withColumn("bin", F.greatest(F.least(place, F.lit(bins)), F.lit(1))).groupBy(by, "side", "bin").agg(F.count("*").alias("n"))


def streak_odds(df: DataFrame, signal: str, most: int = 9) -> DataFrame:
    """(symbol, k, odds): wins over losses among bars that start k + 1 signals in a row; 1 where there is none."""
    w = series()
    chain, rows = yes(F.col(signal)), []
    for i in range(1, most + 1):
        chain = chain & yes(F.lead(signal, i).over(w))
        rows.append(F.struct(F.lit(i).alias("k"), chain.alias("on")))
    flat = df.withColumn("all_", F.array(*rows)).select("symbol", "profit", F.explode("all_").alias("x"))
    out = flat.groupBy("symbol", F.col("x.k").alias("k")).agg(F.sum(F.col("x.on").cast("int")).alias("starts"), F.sum((F.col("x.on") & yes(F.col("profit") > 0)).cast("int")).alias("wins"), F.sum((F.col("x.on") & yes(F.col("profit") <= 0)).cast("int")).alias("losses"))
    return out.select("symbol", "k", F.when(F.col("starts") == 0, 1.0).otherwise(F.col("wins") / F.when(F.col("losses") == 0, 1e-10).otherwise(F.col("losses"))).alias("odds"))


def trailing_profits(df: DataFrame, signal: str, windows: int, step_s: int) -> DataFrame:
    """Every signal bar with the bars of the ``windows`` steps up to it: (symbol, today, ts, profit, state).

    An equi-join on time buckets as long as the window: each bar goes to its own bucket and the next, so a signal
    meets its window in its own bucket only. Profits not matured by today use the signal bar's close.
    """
    span = windows * step_s
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    today = df.filter(F.col(signal)).select("symbol", F.col("ts").alias("today"), sec.alias("today_s"), F.col("close").alias("today_close"), F.floor(sec / span).alias("bucket"))
    bars = df.withColumn("sec", sec).withColumn("bucket", F.explode(F.array(F.floor(sec / span), F.floor(sec / span) + 1)))
    found = today.join(bars.select("symbol", "bucket", "sec", "ts", "buy", "sell", "matured"), ["symbol", "bucket"]).filter((F.col("sec") <= F.col("today_s")) & (F.col("sec") >= F.col("today_s") - span))
    done = yes(F.col("matured") <= F.col("today"))
    sell = F.when(done, F.col("sell")).otherwise(F.col("today_close"))
    return found.select("symbol", "today", "ts", (sell / F.col("buy") - 1).alias("profit"), F.when(done, "matured").otherwise("open").alias("state"))


def signal_likelihoods(df: DataFrame, signal: str, windows: int, step_s: int) -> DataFrame:
    """Per signal bar: sample size, P(loss), likelihood, margins of the trailing profits."""
    found = trailing_profits(df, signal, windows, step_s)
    lost = F.avg((F.col("profit") <= 0).cast("int"))
    out = found.groupBy("symbol", "today").agg(F.count("*").alias("n"), lost.alias("p_loss"), F.expr("percentile_disc(0.05) within group (order by profit)").alias("lower"), F.avg(F.when(F.col("profit") > 0, F.col("profit"))).alias("mean_gain"), F.min("profit").alias("worst"))
    like = evidence_weight(F.col("n"), max(0.01 * windows, 3)) * F.try_divide(1 - F.col("p_loss"), F.greatest("p_loss", F.lit(1e-6)))
    return out.withColumns({"likelihood": like, "loss_margin": F.abs("lower")})


def update_odds(pdf: pd.DataFrame, like: str = "likelihood", start: float = 0.5) -> pd.DataFrame:
    """Posterior after each row: the odds of the one before times the likelihood. A few numbers per signal row."""
    p, out = start, []
    for x in pdf[like]:
        prior = 0.999999 if p == 1 else p
        o = prior / (1 - prior + 1e-10) * (x if x == x and x is not None else 1.0)
        p = o / (o + 1 + 1e-10) if math.isfinite(o) else 1.0
        out.append(p)
    return pdf.assign(posterior=out)


def win_updates(likes: DataFrame) -> DataFrame:
    """``likes`` with ``posterior``, the chain of each symbol's signal bars in time order; only those rows are grouped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return update_odds(pdf.sort_values("today", ignore_index=True))

    return likes.groupBy("symbol").applyInPandas(run, ", ".join(f"{c} {t}" for c, t in likes.dtypes) + ", posterior double")


def with_bets(bets: DataFrame) -> DataFrame:
    """``bets(posterior, worst, mean_gain)`` with kelly and expected profit: the margins are the trailing window's largest
    loss (1 without one) and mean gain (0 without one)."""
    loss = F.when(F.col("worst") <= 0, F.abs("worst")).otherwise(F.lit(1.0))
    gain, p = F.coalesce("mean_gain", F.lit(0.0)), F.col("posterior")
    tiny = lambda x: F.when(x == 0, F.lit(1e-30)).otherwise(x)
    return bets.withColumns({"kelly": kelly(p, loss, gain), "expected": p * tiny(gain) - (1 - p) * tiny(loss)})
