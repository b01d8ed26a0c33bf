"""Bars and day volumes of ticks that come in any order, with what comes too late counted in rows of its own.

State is keyed by symbol: a map of open intervals and a few numbers, on the RocksDB store. Event-time timers close an interval
when the watermark passes its end.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that typed state and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, vol double, n long, late long"
VOLUMES = "symbol string, ts timestamp, day_vol double, hold boolean, late long"

#: A low volume is under this share of the mean so far.
LEAST = 0.6


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    numbers = {c.split()[0]: "float64" for c in schema.split(", ") if c.endswith("double")}
    return out.assign(ts=pd.to_datetime(out["ts"], unit="ms")).astype(numbers)


class _Intervals(StatefulProcessor):
    """Ticks (symbol, us, price, qty) by the interval they belong to; an interval whose end the watermark has passed takes no more."""

    def __init__(self, width_ms: int, schema: str):
        self.width, self.schema = width_ms, schema

    def close(self) -> None:
        pass

    def _late_rows(self, key: tuple, late: pd.Series) -> Iterator[pd.DataFrame]:
        if len(late):
            blank = len(self.schema.split(", ")) - 3
            yield _frame([(key[0], int(at) * self.width, *[None] * blank, int(n)) for at, n in late.items()], self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for some in rows:
            some = some.assign(at=some["us"] // (1000 * self.width)).sort_values("us")
            over = (some["at"] + 1) * self.width <= passed
            yield from self._late_rows(key, some[over].groupby("at").size())
            self.take(some, over, passed)


class ClosedBars(_Intervals):
    """An open bar holds the places and prices of its first and last tick, its extremes, volume and count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "at long", "first_us long, open double, high double, low double, last_us long, close double, vol double, n long")

    def take(self, some: pd.DataFrame, over: pd.Series, passed: int) -> None:
        for at, t in some[~over].groupby("at"):
            new = (int(t["us"].iloc[0]), float(t["price"].iloc[0]), float(t["price"].max()), float(t["price"].min()), int(t["us"].iloc[-1]), float(t["price"].iloc[-1]), float(t["qty"].sum()), len(t))
            if self.bars.containsKey((int(at),)):
                old = tuple(self.bars.getValue((int(at),)))
                first, last = min(old[:2], new[:2]), max(old[4:6], new[4:6])
                new = (*first, max(old[2], new[2]), min(old[3], new[3]), *last, old[6] + new[6], old[7] + new[7])
            else:
                self.handle.registerTimer((int(at) + 1) * self.width)
            self.bars.updateValue((int(at),), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // self.width - 1
        _, opened, high, low, _, closed, vol, n = self.bars.getValue((at,))
        self.bars.removeKey((at,))
        yield _frame([(key[0], at * self.width, opened, high, low, closed, vol, n, 0)], self.schema)


class DayVolumes(_Intervals):
    """The volume of the last ``spans`` intervals at each interval's end, held against the mean of those before and itself.

    A tick that is late for its own interval still counts in the later windows that hold it.
    """

    def __init__(self, width_ms: int, schema: str, spans: int):
        super().__init__(width_ms, schema)
        self.spans = spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "at long", "vol double")
        self.mean = handle.getValueState("mean", "total double, n long")

    def take(self, some: pd.DataFrame, over: pd.Series, passed: int) -> None:
        for at, vol in some.groupby("at")["qty"].sum().items():
            at, ends = int(at), [(int(at) + k) * self.width for k in range(1, self.spans + 1)]
            ends = [e for e in ends if e > passed]
            if not ends:
                continue
            had = self.parts.getValue((at,))[0] if self.parts.containsKey((at,)) else 0.0
            self.parts.updateValue((at,), (had + float(vol),))
            for e in ends:
                self.handle.registerTimer(e)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() // self.width
        places = range(end - self.spans, end)
        found = [self.parts.getValue((at,))[0] for at in places if self.parts.containsKey((at,))]
        if self.parts.containsKey((places[0],)):
            self.parts.removeKey((places[0],))
        if found:
            total, n = tuple(self.mean.get()) if self.mean.exists() else (0.0, 0)
            total, n = total + sum(found), n + 1
            self.mean.update((total, n))
            yield _frame([(key[0], end * self.width, sum(found), sum(found) / (total / n) < LEAST, 0)], self.schema)


LEVELS = ("cutoff", "atr_exit", "profit_leave")
MET = "symbol string, us long, price double, " + ", ".join(f"{c} double" for c in LEVELS)


class AsOf(StatefulProcessor):
    """Ticks and levels of a symbol, each under its time; ticks wait in spans until the watermark has passed them, since by then
    every level that they may meet is there. Of the levels that no waiting tick is before, only the last is kept."""

    def __init__(self, width_ms: int):
        self.width = width_ms

    def close(self) -> None:
        pass

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getMapState("ticks", "at long", "us array<long>, price array<double>")
        self.levels = handle.getMapState("levels", "us long", ", ".join(f"{c} double" for c in LEVELS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        for some in rows:
            tick = some["price"].notna()
            for us, *values in some.loc[~tick, ["us", *LEVELS]].itertuples(index=False):
                self.levels.updateValue((int(us),), tuple(float(v) for v in values))
            some = some[tick]
            for at, t in some.groupby(some["us"] // (1000 * self.width)):
                if (int(at) + 1) * self.width <= passed:
                    late.append(t)
                    continue
                had = self.ticks.getValue((int(at),)) if self.ticks.containsKey((int(at),)) else None
                us, price = t["us"].tolist(), t["price"].tolist()
                self.ticks.updateValue((int(at),), (([*had[0]] if had else []) + us, ([*had[1]] if had else []) + price))
                if not had:
                    self.handle.registerTimer((int(at) + 1) * self.width)
        for t in late:
            yield self._met(key, t["us"].tolist(), t["price"].tolist())

    def _met(self, key, us: list[int], price: list[float]) -> pd.DataFrame:
        levels = sorted((int(k[0]), *v) for k, v in self.levels.iterator())
        times, rows = [x[0] for x in levels], []
        for u, p in sorted(zip(us, price, strict=True)):
            i = bisect_right(times, u) - 1
            rows.append((key[0], u, p, *(levels[i][1:] if i >= 0 else [float("nan")] * len(LEVELS))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MET.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        at = end // self.width - 1
        us, price = self.ticks.getValue((at,))
        yield self._met(key, list(us), list(price))
        self.ticks.removeKey((at,))
        old = sorted(int(k[0]) for k in self.levels.keys() if k[0] <= 1000 * end)
        for u in old[:-1]:
            self.levels.removeKey((u,))


def ticks_with_levels(ticks: DataFrame, levels: DataFrame, minutes: int = 360, delay: str = "5 seconds") -> DataFrame:
    """Each tick with the last levels of its symbol at or before it, from two streams; nulls where there are none.

    A tick is given when the watermark, the lesser of both streams', passes the end of its span of ``minutes``. One that comes
    later than that meets what levels are left: the last before the newest closed span, if not after it.
    """
    blank = [F.lit(None).cast("double").alias(c) for c in LEVELS]
    a = ticks.withWatermark("ts", delay).select("symbol", F.unix_micros("ts").alias("us"), "price", *blank)
    b = levels.withWatermark("ts", delay).select("symbol", F.unix_micros("ts").alias("us"), F.lit(None).cast("double").alias("price"), *LEVELS)
    out = a.unionByName(b).groupBy("symbol").transformWithStateInPandas(AsOf(minutes * 60_000), MET, "Append", "EventTime")
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in LEVELS]
    return out.select("symbol", F.timestamp_micros("us").alias("ts"), "price", *clean)


def _keyed(ticks: DataFrame, delay: str):
    """Ticks by symbol under a watermark. Their time goes on as a number: Spark drops late rows unseen where it sees an event time."""
    return ticks.withWatermark("ts", delay).select("symbol", F.unix_micros("ts").alias("us"), "price", "qty").groupBy("symbol")


def bars_and_late(ticks: DataFrame, minutes: int = 360, delay: str = "5 seconds") -> DataFrame:
    """A row per bar that the watermark has passed (``late`` 0), and rows that count ticks that came after their bar was due.

    Ticks may come in any order and in any number of triggers while their bar is open. A bar is given once. Rows of late
    ticks have the bar's time and their number, nulls else; a bar's late ticks may come in several rows.
    """
    return _keyed(ticks, delay).transformWithStateInPandas(ClosedBars(minutes * 60_000, BARS), BARS, "Append", "EventTime")


def volumes_and_late(ticks: DataFrame, minutes: int = 360, spans: int = 4, delay: str = "5 seconds") -> DataFrame:
    """The volume of the last ``spans`` intervals at each interval's end and whether it is low, and late ticks as in ``bars_and_late``."""
    return _keyed(ticks, delay).transformWithStateInPandas(DayVolumes(minutes * 60_000, VOLUMES, spans), VOLUMES, "Append", "EventTime")


def late_ticks(out: DataFrame) -> DataFrame:
    """(symbol, ts, late) of a drained stream: how many ticks each interval lost."""
    return out.filter("late > 0").groupBy("symbol", "ts").agg(F.sum("late").alias("late"))
