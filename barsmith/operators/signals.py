"""Named signals and exit rules that jobs take by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labels as L
from .indicators import series, yes

SIGNALS: dict[str, Callable[[], Column]] = {}

#: Exit rules: frame with turtle columns -> frame with labels.
EXITS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "close_below_stop": L.exit_labels,
    "low_below_stop": lambda df: L.exit_labels(df, price="low"),
    "next_open": L.next_open_labels,
    "barriers": lambda df: df.join(L.barrier_labels(df), ["symbol", "ts"]),
}


def signal(name: str):
    """Register a function that builds a boolean column over a bar's columns."""

    def keep(f: Callable[[], Column]):
        SIGNALS[name] = f
        return f

    return keep


@signal("channel")
def channel() -> Column:
    return yes(F.col("high") > F.col("turtle_h"))


@signal("close_channel")
def close_channel() -> Column:
    return yes(F.col("close") > F.col("turtle_h"))


@signal("monthly")
def monthly() -> Column:
    return F.dayofmonth("ts").isin(1, 5)


def with_signal(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("buy_signal", SIGNALS[name]())


def signal_table(df: DataFrame, names: tuple) -> DataFrame:
    """Long table (symbol, ts, signal) of the bars at which each named signal fires: one pass, no union of scans."""
    fired = F.array_compact(F.array(*[F.when(SIGNALS[n](), F.lit(n)) for n in names]))
    return df.select("symbol", "ts", F.explode(fired).alias("signal"))


def label_with(df: DataFrame, rule: str) -> DataFrame:
    return EXITS[rule](df)


def multi_signal_updates(df: DataFrame, names: tuple, window: int, shrink: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(symbol, ts, likelihood, posterior) of bars with any named signal.

    In view are the ``window`` bars up to the signal bar, less the series' first. Those that matured with a gain by then
    are wins, all others losses, so nothing is known before it happened. A signal's likelihood is P(signal | win) /
    P(signal | loss), shrunk by their number; a bar multiplies those of the signals it fires, and odds multiply along the
    series. Signal bars meet their windows in equi-joins on buckets of ``window`` bars.
    """
    df = df.withColumns({f"s_{n}": SIGNALS[n]() for n in names} | {"rn_": F.row_number().over(series())})
    own = F.floor(F.col("rn_") / window)
    today = df.filter(reduce(lambda a, c: a | c, [F.col(f"s_{n}") for n in names]))
    today = today.select("symbol", F.col("ts").alias("today"), F.col("rn_").alias("at_"), own.alias("bucket"), *[F.col(f"s_{n}").alias(f"t_{n}") for n in names])
    bars = df.select("symbol", "rn_", "profit", "matured", *[f"s_{n}" for n in names], F.explode(F.array(own, own + 1)).alias("bucket"))
    seen = today.join(bars, ["symbol", "bucket"], "left").withColumn("in_", yes((F.col("rn_") <= F.col("at_")) & (F.col("rn_") > F.greatest(F.col("at_") - window, F.lit(1)))))
    won = F.col("in_") & yes((F.col("matured") <= F.col("today")) & (F.col("profit") > 0))
    lost = F.col("in_") & ~won
    count = lambda c: F.sum(c.cast("int"))
    counts = {"wins_": count(won), "losses_": count(lost)} | {f"w_{n}": count(won & F.col(f"s_{n}")) for n in names} | {f"l_{n}": count(lost & F.col(f"s_{n}")) for n in names}
    df = seen.groupBy("symbol", F.col("today").alias("ts"), *[f"t_{n}" for n in names]).agg(*[v.alias(k) for k, v in counts.items()])
    likes = []
    for n in names:
        pw, pl = F.coalesce(F.try_divide(f"w_{n}", "wins_"), F.lit(0.0)), F.coalesce(F.try_divide(f"l_{n}", "losses_"), F.lit(0.0))
        ratio = F.when((pw == 0) & (pl == 0), 1.0).when(pl == 0, pw + 0.1).when(pw == 0, 1 / (pl + 0.1)).otherwise(F.try_divide(pw, pl))
        likes.append(F.when(F.col(f"t_{n}"), shrink(ratio, F.col("wins_"), F.col("losses_"))).otherwise(1.0))
    df = df.withColumn("likelihood", reduce(lambda a, c: a * c, likes))
    odds = F.exp(F.sum(F.log("likelihood")).over(series().rowsBetween(-(1 << 30), 0)))
    return df.select("symbol", "ts", "likelihood", (odds / (odds + 1 + 1e-10)).alias("posterior"))
