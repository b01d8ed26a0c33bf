"""Forward labels: the exit that each bar's purchase meets, and its profit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .indicators import KEYS, series, yes


def next_trigger(value: Column, trigger: Column, keys: tuple = KEYS) -> Column:
    """``value`` at the nearest bar, this one or later, where ``trigger`` holds: a running frame over descending time."""
    back = Window.partitionBy(*keys).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(trigger, value), ignorenulls=True).over(back)


def elapsed(start: str, stop: str, seconds: float, wrap_days: bool = False) -> Column:
    """Whole bars of ``seconds`` between two times; ``wrap_days`` drops whole days first."""
    gap = F.unix_seconds(F.col(stop).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))
    return F.floor((gap % 86400 if wrap_days else gap) / seconds)


def exit_labels(df: DataFrame, price: str = "close", margin: float = 1.5, interval_s: float = 21600, wrap_days: bool = False, keys: tuple = KEYS) -> DataFrame:
    """buy, sell, matured, profit, pl, time_cost: every bar with an exit price buys at its close and sells at the exit
    price of the first bar, itself included, whose ``price`` is below its exit price. Unmatured bars keep nulls."""
    open_ = F.col("exit_price").isNotNull()
    df = df.withColumn("buy", F.when(open_, F.col("close")))
    trigger = yes(open_ & (F.col(price) < F.col("exit_price")))
    df = df.withColumns({"sell": F.when(open_, next_trigger(F.col("exit_price"), trigger, keys)), "matured": F.when(open_, next_trigger(F.col("ts"), trigger, keys))})
    return df.withColumns({"profit": F.col("sell") / F.col("buy") - 1, "pl": F.try_divide(F.col("sell") - F.col("buy"), F.col("atr") * margin), "time_cost": elapsed("ts", "matured", interval_s, wrap_days)})


def next_open_labels(df: DataFrame, keys: tuple = KEYS) -> DataFrame:
    """Buy at the next open over the stop; sell at the stop once the next close falls below it or the channel."""
    stop = F.greatest("turtle_l", "exit_price")
    w = series(keys)
    df = df.withColumns({"stop_profit": stop, "next_open": F.lead("open").over(w), "next_close": F.lead("close").over(w), "next_ts": F.lead("ts").over(w)})
    buy = F.when(yes(F.col("stop_profit") < F.col("next_open")), F.col("next_open"))
    df = df.withColumn("buy", buy)
    trigger = F.col("buy").isNotNull() & yes((F.col("next_close") < F.col("stop_profit")) | (F.col("next_close") < F.col("turtle_l")))
    held = F.col("buy").isNotNull()
    df = df.withColumns({"sell": F.when(held, next_trigger(F.col("stop_profit"), trigger, keys)), "matured": F.when(held, next_trigger(F.col("next_ts"), trigger, keys))})
    return df.withColumn("profit", F.col("sell") / F.col("buy") - 1)


def temporary_close(df: DataFrame, today: Column, compat: bool = False) -> DataFrame:
    """Labels as they stand at ``today``: what has not matured by then sells at the last close in view.

    ``compat`` fills only missing sells, so exits later than today stay in view.
    """
    df = df.filter(F.col("ts") <= today)
    whole = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("close").over(whole)
    sell = F.coalesce("sell", last) if compat else F.when(F.col("matured") <= today, F.col("sell")).otherwise(last)
    return df.withColumn("sell", F.when(F.col("buy").isNotNull(), sell)).withColumn("profit", F.col("sell") / F.col("buy") - 1)


def full_close(df: DataFrame) -> DataFrame:
    """Every bar buys at its close and sells at the series' last close; time_cost in bars to the end."""
    whole = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"buy": F.col("close"), "sell": F.last("close").over(whole), "time_cost": F.count("*").over(whole) - F.row_number().over(series())})
    return df.withColumn("profit", F.col("sell") / F.col("buy") - 1)


def first_touch(touch: np.ndarray) -> np.ndarray:
    """For each row of a (entries x later bars) table of booleans the first true column, or -1."""
    return np.where(touch.any(1), touch.argmax(1), -1)


def barrier_labels(df: DataFrame, take: float = 1.05, stop: float = 0.95, atr_factor: float = 2.0, horizon: int | None = None, block: int = 512) -> DataFrame:
    """For every bar the first later bar, at most ``horizon`` on if given, at which an entry-dependent barrier is met.

    stop_*: the range grows over ``atr_factor`` times the entry's, or the close falls below the channel or stop * buy; the
    sell is that bar's close. take_*: the high rises over take * buy; the cost is the bars waited, half a bar at least.
    The thresholds differ by entry, which a frame cannot express: each symbol's arrays are scanned to
    their end in blocks, for entries still open, and only where a block's extremes can meet their barriers.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        n = len(pdf)
        close, high, atr, low = (pdf[c].to_numpy(float) for c in ("close", "high", "atr", "turtle_l"))
        reach, starts = n if horizon is None else horizon, np.arange(0, n, block)
        most_atr, most_high, least_close = np.fmax.reduceat(atr, starts), np.fmax.reduceat(high, starts), np.fmin.reduceat(close, starts)
        fell = np.logical_or.reduceat(close < low, starts)

        def scan(hit, may) -> np.ndarray:
            found = np.full(n, -1)
            for at in starts:
                left = np.arange(at, min(n, at + block))
                for lo in range(at, min(n, at + block + reach), block):
                    near = left[may(left, lo // block)]
                    if len(near):
                        entry, later = near[:, None], np.arange(lo, min(n, lo + block))[None, :]
                        first = first_touch(hit(entry, later) & (later > entry) & (later <= entry + reach))
                        found[near[first >= 0]] = lo + first[first >= 0]
                        left = left[found[left] < 0]
                    if not len(left):
                        break
            return found

        with np.errstate(invalid="ignore"):
            stop_at = scan(
                lambda e, x: (atr[x] > atr_factor * atr[e]) | (close[x] < low[x]) | (close[x] <= stop * close[e]),
                lambda e, k: (most_atr[k] > atr_factor * atr[e]) | fell[k] | (least_close[k] <= stop * close[e]),
            )
            take_at = scan(lambda e, x: high[x] > take * close[e], lambda e, k: most_high[k] > take * close[e])
        rows = np.arange(n)
        out = pdf[["symbol", "ts"]].copy()
        out["stop_sell"] = np.where(stop_at >= 0, close[stop_at], np.nan)
        out["stop_cost"] = pd.array(np.where(stop_at >= 0, stop_at - rows, 0), "Int64")
        out.loc[stop_at < 0, "stop_cost"] = pd.NA
        out["take_cost"] = np.where(take_at >= 0, np.maximum(take_at - rows, 0.5), np.nan)
        return out

    found = df.select("symbol", "ts", "close", "high", "atr", "turtle_l").groupBy("symbol").applyInPandas(label, "symbol string, ts timestamp_ntz, stop_sell double, stop_cost long, take_cost double")
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("stop_sell", "take_cost")})
