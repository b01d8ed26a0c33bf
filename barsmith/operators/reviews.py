"""Reviews of labelled bars, trades and portfolios."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .indicators import run_lengths, yes

YEAR_MINUTES = 365 * 24 * 60
#: Yearly return that a risk ratio is measured against.
HURDLE = 0.0419


def signal_scan(df: DataFrame, signal: str, recent: int = 90) -> DataFrame:
    """Per symbol: signals, whether the latest bar fired, whether any of the last ``recent`` bars did."""
    late = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    df = df.withColumn("rn_", F.row_number().over(late))
    return df.groupBy("symbol").agg(F.sum(F.col(signal).cast("int")).alias("signals"), F.max_by(signal, "ts").alias("latest"), F.bool_or(F.col(signal) & (F.col("rn_") <= recent)).alias("recent"))


def performance(df: DataFrame, by: str = "symbol") -> DataFrame:
    p = F.col("profit")
    out = df.filter("profit is not null").groupBy(by).agg(
        F.count("*").alias("trades"), F.avg(p).alias("mean"), F.sum(p).alias("total"), F.stddev_samp(p).alias("std"), F.min(p).alias("worst"),
        F.avg((p > 0).cast("int")).alias("win_rate"), F.avg((p < 0).cast("int")).alias("loss_rate"), F.stddev_samp(F.when(p < 0, p)).alias("downside"),
    )
    return out.withColumns({"sharpe": F.try_divide("mean", "std"), "sortino": F.try_divide("mean", "downside")})


def time_weighted_return(df: DataFrame, by: str = "symbol") -> DataFrame:
    """Sum of (1 + p)^(1/t) * t over the sum of t, less 1, over trades that lasted."""
    held = df.filter("profit is not null and time_cost > 0")
    t = F.col("time_cost")
    return held.groupBy(by).agg((F.sum(F.pow(1 + F.col("profit"), 1 / t) * t) / F.sum(t) - 1).alias("weighted_return"))


def annual_return(df: DataFrame, by: str = "symbol", bet: str = "bet") -> DataFrame:
    """Yearly growth of (1 + summed bet profits) and its ratio to the yearly deviation of profits under the hurdle."""
    minutes = (F.max(F.unix_seconds(F.col("ts").cast("timestamp"))) - F.min(F.unix_seconds(F.col("ts").cast("timestamp")))) / 60
    out = df.groupBy(by).agg(
        minutes.alias("minutes"), F.sum((F.col(bet) > 0).cast("int")).alias("trades"), F.stddev_samp(F.when((F.col(bet) > 0) & (F.col("profit") < HURDLE), F.col("profit"))).alias("downside"),
        (1 + F.sum(F.coalesce(F.col(bet) * F.col("profit"), F.lit(0.0)))).alias("growth"),
    )
    years = F.when(F.col("minutes") > 0, F.col("minutes") / YEAR_MINUTES)
    growth = F.when(F.col("growth") > 0, F.exp(F.log("growth") / years) - 1).otherwise(0.0)
    out = out.withColumns({"log_growth": F.when(F.col("growth") > 0, F.log("growth") / years), "annual": growth})
    spread = F.col("downside") * F.sqrt(F.col("trades") / years)
    return out.withColumn("risk_ratio", F.try_divide(F.col("log_growth") - HURDLE, spread)).drop("minutes")


def mission_review(df: DataFrame, by: str = "symbol") -> DataFrame:
    """Trades, median gain and loss, share of large gains that had a signal, worst and mean profit."""
    p, big = F.col("profit"), F.col("pl") > 3
    return df.groupBy(by).agg(
        F.count("profit").alias("sample"), F.percentile(F.when(p > 0, p), F.lit(0.5)).alias("median_gain"), F.percentile(F.when(p <= 0, p), F.lit(0.5)).alias("median_loss"),
        F.try_divide(F.sum((big & F.col("buy_signal")).cast("int")), F.sum(big.cast("int"))).alias("captured"), F.min(p).alias("worst"), F.avg(p).alias("mean"),
    )


def final_account(account: DataFrame, bars: DataFrame, funds: float = 1000.0, by: str = "symbol") -> DataFrame:
    """Each account after its last bar, and what it gained on its first funds with its position at the last close."""
    last = account.groupBy(by).agg(*[F.max_by(c, "ts").alias(c) for c in ("cash", "position", "avg_cost")])
    close = bars.groupBy(by).agg(F.max_by("close", "ts").alias("last_close"))
    return last.join(close, by).withColumn("profit", F.col("cash") + F.col("position") * F.col("last_close") - funds)


def exit_reasons(df: DataFrame, reasons: tuple, by: str = "symbol") -> DataFrame:
    """Share of each exit reason, zero where it is missing."""
    counted = df.filter("reason is not null").groupBy(by).pivot("reason", list(reasons)).count().fillna(0)
    total = sum((F.col(r) for r in reasons[1:]), F.col(reasons[0]))
    return counted.select(by, *[(F.col(r) / total).alias(r.lower()) for r in reasons])


def capture_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Gains in ``bins`` equal bins from 0 to the largest: all, those with a signal, and the share; empty bins stay."""
    gains = df.filter("pl >= 0").select("symbol", "pl", "buy_signal")
    top = gains.groupBy("symbol").agg(F.max("pl").alias("top"))
    spine = top.select("symbol", "top", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    place = F.greatest(F.ceil(F.round(F.try_divide(F.col("pl") * bins, F.col("top")), 9)) - 1, F.lit(0))
    counted = gains.join(top, "symbol").groupBy("symbol", place.cast("int").alias("bin")).agg(F.count("*").alias("total"), F.sum(F.col("buy_signal").cast("int")).alias("captured"))
    out = spine.join(counted, ["symbol", "bin"], "left")
    return out.select("symbol", "bin", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("captured", F.lit(0)).alias("captured"), F.coalesce(F.try_divide("captured", "total"), F.lit(0.0)).alias("rate"))


def backtest_indicators(df: DataFrame, by: str = "symbol") -> DataFrame:
    big, win = F.col("pl") > 3, yes(F.col("pl") > 0)
    lose = yes(F.col("pl") <= 0)
    hours = (F.unix_seconds(F.col("matured").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.groupBy(by).agg(
        zero(F.try_divide(F.sum((yes(big) & F.col("buy_signal")).cast("int")), F.sum(yes(big).cast("int")))).alias("capture_rate"), F.avg(F.col("buy_signal").cast("int")).alias("coverage"),
        zero(F.avg(hours)).alias("holding_hours"), F.avg(win.cast("int")).alias("win_rate"), zero(F.avg(F.when(win, F.col("pl")))).alias("avg_gain"), zero(-F.avg(F.when(lose, F.col("pl")))).alias("avg_loss"),
    )
    out = out.withColumn("expected", F.col("win_rate") * F.col("avg_gain") - (1 - F.col("win_rate")) * F.col("avg_loss"))
    ratio = F.try_divide("avg_gain", "avg_loss")
    return out.withColumn("breakeven", F.coalesce(F.when(ratio != 0, 1 / (1 + ratio)), F.lit(0.0)))


def streak_review(df: DataFrame) -> DataFrame:
    """Per symbol: longest runs of wins and of losses, and the signals in a row at the last bar."""
    df = df.withColumns({"win": yes(F.col("pl") > 0), "loss": yes(F.col("pl") <= 0)})
    for flag, name in (("win", "wins"), ("loss", "losses"), ("buy_signal", "signal_run")):
        df = run_lengths(df, flag, name)
    return df.groupBy("symbol").agg(F.max("wins").cast("long").alias("most_wins"), F.max("losses").cast("long").alias("most_losses"), F.max_by("signal_run", "ts").cast("long").alias("trailing_signals"))


def portfolio_total(df: DataFrame) -> DataFrame:
    """Detail rows and one total row: sums, the ratio of sums and the mean day change, in per cent."""
    detail = df.select(F.col("symbol").cast("string").alias("symbol"), "value", "cost", (F.col("value") - F.col("cost")).alias("pl"), (F.try_divide(F.col("value"), F.col("cost")) * 100 - 100).alias("pl_pct"), (F.col("change") * 100).alias("change_pct"))
    total = df.agg(F.sum("value").alias("value"), F.sum("cost").alias("cost"), F.avg("change").alias("change"))
    total = total.select(F.lit("TOTAL").alias("symbol"), "value", "cost", (F.col("value") - F.col("cost")).alias("pl"), (F.try_divide(F.col("value"), F.col("cost")) * 100 - 100).alias("pl_pct"), (F.col("change") * 100).alias("change_pct"))
    return detail.unionByName(total)


def bootstrap(trades: DataFrame, sims: int, steps: int, fund: float = 10_000.0, bet: Column | None = None) -> DataFrame:
    """(sim, capital, least): ``sims`` paths of ``steps`` draws with replacement from ``trades(symbol, i, n, profit)``.

    A draw's index is a digest of (symbol, sim, step) modulo the trade count, so reruns agree. Draws are dealt by index: a trade
    meets its draws in a hash join, and a path is a product, combined before it is shuffled.
    """
    spark = trades.sparkSession
    draws = spark.range(sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    counts = trades.groupBy("symbol").agg(F.max("n").alias("n"))
    index = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("draw"), "symbol", "sim", "step")), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = counts.crossJoin(draws).withColumn("i", index)
    found = drawn.join(trades.select("symbol", "i", "profit"), ["symbol", "i"])
    growth = 1 + (F.col("profit") if bet is None else bet * F.col("profit"))
    path = found.groupBy("symbol", "sim").agg(F.sum(F.when(growth > 0, F.log(growth))).alias("log_growth"), F.min(growth).alias("least"))
    return path.select("symbol", "sim", F.when(F.col("least") <= 0, 0.0).otherwise(fund * F.exp("log_growth")).alias("capital"))


def bootstrap_counts(trades: DataFrame, sims: int = 1000, steps: int = 1260, fund: float = 10_000.0, bet: float = 1.0, fan: int = 1024) -> DataFrame:
    """(symbol, sim, log_growth, capital): ``sims`` paths of ``steps`` draws with replacement from ``trades(symbol, profit)``.

    A path's end depends only on how often it draws each distinct profit, so counts are drawn instead of rows: a symbol's
    distinct profits are the leaves of a tree of ``fan`` children a node, and each node deals its draws to its children by
    multinomial (conditional binomial) draws seeded by symbol, level and node. No task holds more than a node's children
    (of the root: a child for every ``fan`` squared profits), and results do not depend on partitioning. Trades without
    symbol or profit are left out; a path that draws a loss of all it bets ends at 0 with a null log_growth.
    """
    known = trades.filter(F.col("symbol").isNotNull() & F.col("profit").isNotNull() & ~F.isnan("profit"))
    values = known.groupBy("symbol", "profit").agg(F.count("*").alias("weight")).withColumn("part", F.pmod(F.xxhash64("profit"), F.lit(1024)))
    before = F.sum("m").over(Window.partitionBy("symbol").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = values.groupBy("symbol", "part").agg(F.count("*").alias("m")).select("symbol", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("symbol", "part").orderBy("profit")) - 1
    leaves = values.join(starts, ["symbol", "part"]).withColumn("place", place).select("symbol", F.expr(f"place div {fan * fan}").alias("top"), F.expr(f"place div {fan}").alias("node"), "profit", "weight")
    nodes = leaves.groupBy("symbol", "top", "node").agg(F.sum("weight").alias("weight"))
    tops = nodes.groupBy("symbol", "top").agg(F.sum("weight").alias("weight"))

    def deal(level: str, children: pd.DataFrame, child: str, draws) -> tuple[pd.DataFrame, np.ndarray]:
        children = children.sort_values(child, ignore_index=True)
        weight = children["weight"].to_numpy(float)
        return children, _seeded(children["symbol"].iloc[0], level).multinomial(draws, weight / weight.sum(), None if np.ndim(draws) else sims)

    def to_tops(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, drawn = deal("root", pdf, "top", steps)
        return pdf[["symbol", "top"]].assign(draws=list(drawn.T))

    def to_nodes(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf, drawn = deal(f"top {pdf['top'].iloc[0]}", pdf, "node", np.asarray(above["draws"].iloc[0]))
        return pdf[["symbol", "node"]].assign(draws=list(drawn.T))

    def to_profits(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf, drawn = deal(f"node {pdf['node'].iloc[0]}", pdf, "profit", np.asarray(above["draws"].iloc[0]))
        growth = 1 + bet * pdf["profit"].to_numpy(float)
        logs = drawn @ np.log(np.where(growth > 0, growth, 1.0))
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "sim": np.arange(sims), "part_log": logs, "ruined": drawn @ (growth <= 0) > 0})

    drawn = tops.groupBy("symbol").applyInPandas(to_tops, "symbol string, top long, draws array<long>")
    drawn = nodes.groupBy("symbol", "top").cogroup(drawn.groupBy("symbol", "top")).applyInPandas(to_nodes, "symbol string, node long, draws array<long>")
    paths = leaves.groupBy("symbol", "node").cogroup(drawn.groupBy("symbol", "node")).applyInPandas(to_profits, "symbol string, sim long, part_log double, ruined boolean")
    out = paths.groupBy("symbol", "sim").agg(F.sum("part_log").alias("log_growth"), F.max("ruined").alias("ruined"))
    log = F.when(~F.col("ruined"), F.col("log_growth"))
    return out.select("symbol", "sim", log.alias("log_growth"), F.coalesce(fund * F.exp(log), F.lit(0.0)).alias("capital"))


def _seeded(symbol: str, level: str) -> np.random.Generator:
    """Random numbers that depend on the symbol and the place in the tree only."""
    key = hashlib.blake2b(f"{level} {symbol}".encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(key, "big")))


def bootstrap_summary(paths: DataFrame, fund: float = 10_000.0) -> DataFrame:
    c = F.col("capital")
    return paths.groupBy("symbol").agg(F.avg(c / fund - 1).alias("mean_return"), F.avg((c > fund).cast("int")).alias("win_rate"), F.avg(c).alias("mean"), F.max(c).alias("best"), F.min(c).alias("worst"))


def backtest_summary(df: DataFrame, cash: DataFrame, bet: float, fund: float = 1000.0, by: str = "symbol") -> DataFrame:
    """A row per series of labelled bars ``df`` and its cash account: gain, trades, win share weighted by the evidence a year,
    mean cost and gain, worst trade, time-weighted return, yearly growth of a fixed ``bet``."""
    kept = df.filter(F.col("buy_signal") & F.col("profit").isNotNull())
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    years = (F.max(seconds) - F.min(seconds)) / 86400 / 365.25
    won = F.avg((F.round("profit", 2) > 0).cast("int"))
    trades = kept.groupBy(by).agg(
        F.count("*").alias("trades"), F.sum((F.col("profit") > 0).cast("int")).alias("gains"), (won / (1 + F.exp(-(F.count("*") - years)))).alias("weighted_win"), F.avg("time_cost").alias("mean_cost"), F.min("profit").alias("drawdown"),
    )
    out = cash.groupBy(by).agg((F.max_by("fund", "ts") - fund).alias("gain"), F.sum("invested").alias("invested")).join(trades, by, "left").join(time_weighted_return(kept, by), by, "left")
    grown = annual_return(df.withColumn("bet", F.when(F.col("buy_signal"), bet).otherwise(0.0)), by).select(by, "log_growth")
    return out.join(grown, by, "left").withColumn("mean_gain", F.col("gain") / F.col("trades"))
