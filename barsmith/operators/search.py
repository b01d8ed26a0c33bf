"""Search over channel, range and margin parameters: every window length from one reading of the bars."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch
from . import chunks

#: Ranges of the window lengths and of the margin, the number of sets tried, and the shares of a series after
#: which only so large a part of the sets goes on.
LENGTHS, MARGINS, TRIED = (2, 900), (1.0, 5.0), 105
RUNGS = ((0.25, 0.35), (0.5, 0.35))


@dataclass(frozen=True)
class ParameterSet:
    param_id: int
    atr: int
    upper: int
    lower: int
    margin: float


def _digits(i: int, base: int) -> float:
    """The digits of ``i`` behind the point, in reverse order: evenly spread over 0 to 1."""
    x, part = 0.0, 1.0
    while i:
        part /= base
        i, digit = divmod(i, base)
        x += digit * part
    return x


def spread(tried: int = TRIED, lengths: tuple = LENGTHS, margins: tuple = MARGINS) -> list[ParameterSet]:
    """``tried`` sets spread evenly over the ranges, lengths by their ratio."""
    least, most = math.log(lengths[0]), math.log(lengths[1])
    length = lambda i, base: round(math.exp(least + (most - least) * _digits(i, base)))
    return [ParameterSet(i, length(i, 2), length(i, 3), length(i, 5), round(margins[0] + (margins[1] - margins[0]) * _digits(i, 7), 3)) for i in range(1, tried + 1)]


class Windows:
    """Means and extremes of windows of any length over one stretch of bars: running sums, and extremes of doubled spans.

    A place whose window is not full, or holds a missing value, is NaN.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, close: np.ndarray, first: bool) -> None:
        self.n = len(close)
        before = np.concatenate(([np.nan], close[:-1]))
        span = np.fmax(high - low, np.fmax(np.abs(before - high), np.abs(before - low)))
        if not first and self.n:
            span[0] = np.nan
        self.sums = np.concatenate(([0.0], np.cumsum(np.nan_to_num(span))))
        self.known = np.concatenate(([0], np.cumsum(~np.isnan(span))))
        self.high, self.low = [high], [low]

    def mean_range(self, n: int) -> np.ndarray:
        """Mean true range of the ``n`` bars up to each one."""
        out = np.full(self.n, np.nan)
        if n <= self.n:
            full = self.known[n:] - self.known[:-n] == n
            out[n - 1 :] = np.where(full, (self.sums[n:] - self.sums[:-n]) / n, np.nan)
        return out

    def _extreme(self, levels: list[np.ndarray], pick: np.ufunc, n: int) -> np.ndarray:
        """Extreme of the ``n`` bars before each one: of two spans of a power of two that cover them."""
        k = n.bit_length() - 1
        while len(levels) <= k and len(levels[-1]):
            half = 1 << (len(levels) - 1)
            levels.append(pick(levels[-1][:-half], levels[-1][half:]) if len(levels[-1]) > half else np.empty(0))
        out = np.full(self.n, np.nan)
        if n < self.n:
            at, span = levels[k], 1 << k
            starts = np.arange(self.n - n)
            out[n:] = pick(at[starts], at[starts + n - span])
        return out

    def highest(self, n: int) -> np.ndarray:
        return self._extreme(self.high, np.maximum, n)

    def lowest(self, n: int) -> np.ndarray:
        return self._extreme(self.low, np.minimum, n)


def _review(w: Windows, high: np.ndarray, close: np.ndarray, own: np.ndarray, p: ParameterSet) -> tuple:
    """(closed trades, their profit, still open trades, sum of 1 / price of these, first exit price) of one chunk's own bars.

    A bar above the highest high of the ``upper`` bars before it buys at its close; it sells at the stop of the first bar,
    itself included, whose close is below its stop: the higher of the close before less margin ranges and of the lowest low.
    """
    mean = w.mean_range(p.atr)
    with np.errstate(invalid="ignore"):
        stop = np.maximum(np.concatenate(([np.nan], close[:-1] - mean[:-1] * p.margin)), w.lowest(p.lower))[own]
        bought = (high > w.highest(p.upper))[own] & ~np.isnan(stop) & ~np.isnan(close[own])
        close = close[own]
        fires = close < stop
    never = len(close)
    at = np.where(fires, np.arange(never), never)
    at = np.minimum.accumulate(at[::-1])[::-1]
    closed, waiting = bought & (at < never), bought & (at == never)
    profit = stop[at[closed]] / close[closed] - 1
    return int(closed.sum()), float(profit.sum()), int(waiting.sum()), float((1 / close[waiting]).sum()), float(stop[at[0]]) if never and at[0] < never else None


_FIELDS = "symbol string, chunk_ long, param_id int, closed long, gained double, waiting long, inverse double, first_exit double"


def reviews(rows: DataFrame, sets: list[ParameterSet], size: int, kept: DataFrame | None = None) -> DataFrame:
    """(symbol, param_id, trades, score) over ``rows`` of ``chunked``; ``kept(symbol, ids)`` names the sets still tried.

    Each chunk yields a row a set. A trade that is open at the end of its chunk sells at the first exit of a later one, so
    it is enough to carry the number and the summed inverse prices of open trades; score is the mean profit, null without any.
    """
    tried = {p.param_id: p for p in sets}

    def run(pdf: pd.DataFrame, ids: list[int]) -> pd.DataFrame:
        pdf = pdf.sort_values("idx_", ignore_index=True)
        high, low, close = (pdf[c].to_numpy(float) for c in ("high", "low", "close"))
        own, chunk = (pdf["idx_"] // size == pdf["task_"]).to_numpy(), pdf["task_"].iloc[0]
        if not own.any():
            return pd.DataFrame(columns=[f.split()[0] for f in _FIELDS.split(", ")])
        w = Windows(high, low, close, pdf["idx_"].iloc[0] == 0)
        found = [(pdf["symbol"].iloc[0], chunk, i, *_review(w, high, close, own, tried[i])) for i in ids]
        out = pd.DataFrame(found, columns=[f.split()[0] for f in _FIELDS.split(", ")])
        return out.assign(first_exit=out["first_exit"].astype(float))

    if kept is None:
        parts = rows.groupBy("symbol", "task_").applyInPandas(lambda pdf: run(pdf, list(tried)), _FIELDS)
    else:
        chosen = kept.select(F.col("symbol").alias("of_"), "ids")
        tasks = rows.select(F.col("symbol").alias("of_"), F.col("task_").alias("in_")).distinct().join(chosen, "of_")
        both = rows.groupBy("symbol", "task_").cogroup(tasks.groupBy("of_", "in_"))
        parts = both.applyInPandas(lambda pdf, ids: run(pdf, list(ids["ids"].iloc[0])), _FIELDS)
    parts = parts.withColumn("first_exit", F.when(~F.isnan("first_exit"), F.col("first_exit")))
    later = Window.partitionBy("symbol", "param_id").orderBy("chunk_").rowsBetween(1, Window.unboundedFollowing)
    carried = parts.withColumn("exit", F.first("first_exit", ignorenulls=True).over(later))
    sold = F.col("exit").isNotNull()
    trades = F.sum(F.col("closed") + F.when(sold, F.col("waiting")).otherwise(0))
    total = F.sum(F.col("gained") + F.when(sold, F.col("exit") * F.col("inverse") - F.col("waiting")).otherwise(0.0))
    out = carried.groupBy("symbol", "param_id").agg(trades.alias("trades"), total.alias("total"))
    return out.select("symbol", "param_id", "trades", F.when(F.col("trades") > 0, F.col("total") / F.col("trades")).alias("score"))


def chunked(bars: DataFrame, sets: list[ParameterSet], size: int = chunks.SIZE) -> tuple[DataFrame, int]:
    """``bars(symbol, ts, high, low, close)`` numbered, with their series' length ``n_``, each in the tasks that need it; the chunk size."""
    halo = max(max(p.atr, p.upper, p.lower) for p in sets) + 1
    size = max(size, halo)
    rows = chunks.numbered(bars.filter(F.col("symbol").isNotNull()).select("symbol", "ts", "high", "low", "close"), size)
    ends = rows.groupBy("symbol").agg((F.max("idx_") + 1).alias("n_"))
    return chunks.haloed(rows.join(ends, "symbol"), halo, size).drop("ts", "chunk_"), size


def sweep(bars: DataFrame, sets: list[ParameterSet]) -> DataFrame:
    """(symbol, param_id, trades, score) of every set over whole series."""
    rows, size = chunked(bars, sets)
    return reviews(rows, sets, size)


def rung_sizes(tried: int, rungs: tuple = RUNGS) -> list[tuple[float, int]]:
    """(share of the bars, sets that go on) of each rung; the last one reads all bars and leaves one set."""
    out = []
    for share, part in (*rungs, (1.0, 0.0)):
        tried = max(1, math.ceil(round(tried * part, 6)))
        out.append((share, tried))
    return out


def halving(bars: DataFrame, sets: list[ParameterSet], rungs: tuple = RUNGS) -> DataFrame:
    """(symbol, param_id, trades, score) of each series' best set: all are tried on its first bars, the best on more of them.

    A rung ``(share, part)`` scores the sets left on the first ``share`` of the bars, trades that are open there left out,
    and keeps the best ``part`` of them, at least one; the last ones are scored on all bars. Scores are compared to six
    digits; sets without trades come last, ties go to the least id. The chunks are written once and read by every rung.
    """
    rows, size = chunked(bars, sets)
    path = scratch(bars.sparkSession, "search-chunks")
    rows.write.parquet(path)
    rows, kept = bars.sparkSession.read.parquet(path), None
    best = Window.partitionBy("symbol").orderBy(F.round("score", 6).desc_nulls_last(), "param_id")
    for share, left in rung_sizes(len(sets), rungs):
        seen = rows.filter(F.col("idx_") < F.ceil(F.round(F.col("n_") * share, 6)))
        ranked = reviews(seen, sets, size, kept).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= left)
        kept = ranked.groupBy("symbol").agg(F.sort_array(F.collect_list("param_id")).alias("ids"))
    return ranked.drop("rank")
