"""The live loop on Structured Streaming: closed bars, exits, accounts, statements."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.accounts import STATE, account_step, fill_step
from ..sources.tables import merge_statements, read_statements, scratch
from .late import ROCKS

TICK = "symbol string, ts timestamp, price double, qty long"


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored series as a stream of its files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def closed_bars(ticks: DataFrame, interval: str = "6 hours", delay: str = "5 seconds") -> DataFrame:
    """Bars that the watermark has passed: late ticks inside ``delay`` count, later ones are dropped unseen (``late.bars_and_late`` counts them)."""
    grouped = ticks.withWatermark("ts", delay).groupBy(F.window("ts", interval), "symbol")
    out = grouped.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("qty").cast("double").alias("vol"), F.count("*").alias("n"))
    return out.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "vol", "n")


def unique_events(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def tick_exits(ticks: DataFrame) -> DataFrame:
    """Ticks that leave by the levels they carry: cutoff, then range exit, then profit; the first that holds wins."""
    p = F.col("price")
    reason = F.when(p <= F.col("cutoff") * 1.0001, "CUTOFF").when(p < F.col("atr_exit") * 1.0001, "ATR_EXIT").when(p >= F.col("profit_leave") * 0.99, "PROFIT_LEAVE")
    return ticks.withColumn("reason", reason).filter("reason is not null").select("symbol", "ts", "price", "reason")


def day_volume(ticks: DataFrame, slide: str = "6 hours", delay: str = "5 seconds") -> DataFrame:
    return ticks.withWatermark("ts", delay).groupBy(F.window("ts", "24 hours", slide), "symbol").agg(F.sum("qty").cast("double").alias("day_vol")).select("symbol", F.col("window.end").alias("ts"), "day_vol")


def _bar_update(n: int, margin: float, keep: int):
    """State: a symbol's last ``keep`` bars, the version of its last output, and how many bars came too late for it.

    Bars that come again replace what was held, late ones go to their place, and the output starts at the oldest bar
    touched, so that every bar that depends on it is given again under a newer version.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version, late = json.loads(state.get[0]) if state.exists else ([], 0, 0)
        names = ["ts", "high", "low", "close"]
        tail = pd.DataFrame(held, columns=names)
        tail["ts"] = pd.to_datetime(tail["ts"], unit="us")
        new = pd.concat(list(batches))[names].drop_duplicates("ts", keep="last")
        if len(tail) >= keep:
            fits = new["ts"] >= tail["ts"].min()
            late, new = late + int((~fits).sum()), new[fits]
        if not len(new):
            state.update((json.dumps((held, version, late)),))
            return
        bars = pd.concat([tail, new]).drop_duplicates("ts", keep="last").sort_values("ts", ignore_index=True)
        before = bars["close"].shift(1)
        tr = pd.concat([bars["high"] - bars["low"], (before - bars["high"]).abs(), (before - bars["low"]).abs()], axis=1).max(axis=1)
        atr = tr.rolling(n).mean()
        out = bars.assign(turtle_h=bars["high"].shift(1).rolling(n).max(), turtle_l=bars["low"].shift(1).rolling(n).min(), exit_price=before - atr.shift(1) * margin)
        out["buy_signal"] = (out["high"] > out["turtle_h"]).fillna(False)
        kept = bars.tail(keep)
        rows = list(zip(kept["ts"].astype("datetime64[us]").astype("int64").tolist(), *(kept[c].tolist() for c in names[1:]), strict=True))
        state.update((json.dumps((rows, version + 1, late)),))
        fresh = out[out["ts"] >= new["ts"].min()].assign(symbol=key[0], version=version + 1, late=late)
        yield fresh[["symbol", "ts", "high", "low", "close", "turtle_h", "turtle_l", "exit_price", "buy_signal", "version", "late"]]

    return step


def bar_updates(bars: DataFrame, n: int = 10, margin: float = 1.5, keep: int = 2000) -> DataFrame:
    """Bars with their indicators as they come: state per symbol is its last ``keep`` bars, so history is never read again.

    A bar is given again under a higher ``version`` when it or one before it came anew (see ``latest``). Bars older than
    all ``keep`` retained ones change nothing; ``late`` counts them.
    """
    out = "symbol string, ts timestamp, high double, low double, close double, turtle_h double, turtle_l double, exit_price double, buy_signal boolean, version long, late long"
    return bars.groupBy("symbol").applyInPandasWithState(_bar_update(n, margin, keep), out, "tail string", "append", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """The last version of each bar."""
    kept = updates.groupBy("symbol", "ts").agg(F.max_by(F.struct(*updates.columns), "version").alias("row"))
    return kept.select("row.*")


def write_in_order(df: DataFrame, path: str, order: str, parts: int, by: str | None = "symbol") -> int:
    """Write a table as a stream's files in ``parts`` consecutive ranges of ``order``, a symbol's rows of a range in one file.

    A range is written when the one before it is there, and the file source takes older files first, so a symbol's rows
    arrive in order however few files a trigger takes. Without ``by`` a range is one file, so that symbols keep step too.
    The table is made once, in the shared folder, and each range read from there. Returns the most files of a range.
    """
    spark, made = df.sparkSession, scratch(df.sparkSession, "ordered")
    df.write.parquet(made)
    df = spark.read.schema(df.schema).parquet(made)
    value = F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else F.col(order).cast("long")
    cuts = df.select(value.alias("v")).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 1000).alias("c")).first()["c"] or []
    edges, files = [None, *sorted(set(cuts)), None], [0]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = (value > low if low is not None else F.lit(True)) & (value <= high if high is not None else F.lit(True))
        some = df.filter(inside)
        (some.repartition(by) if by else some.coalesce(1)).write.mode("append").parquet(path)
        files.append(len(spark.read.schema(df.schema).parquet(path).inputFiles()))
    return max(b - a for a, b in zip(files[:-1], files[1:], strict=True))


def _account(cap: float, hard_cutoff: float, ratio: float, bet: float):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        account, rows = json.loads(state.get[0]) if state.exists else dict(STATE), []
        for bar in pd.concat(list(batches)).sort_values("ts").to_dict("records"):
            account, done, price = account_step(account, bar, cap, hard_cutoff, ratio, bet)
            rows.append((key[0], bar["ts"], done, float("nan") if price is None else price, account["cash"], account["position"], account["avg_cost"]))
        state.update((json.dumps(account),))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "reason", "price", "cash", "position", "avg_cost"])

    return step


def account_updates(bars: DataFrame, cap: float = 100.0, hard_cutoff: float = 0.9, ratio: float = 2.0, bet: float = 1.0) -> DataFrame:
    """The paper account of each symbol, one row per bar: the fold of the batch job with its state kept between batches."""
    out = "symbol string, ts timestamp, reason string, price double, cash double, position double, avg_cost double"
    return bars.groupBy("symbol").applyInPandasWithState(_account(cap, hard_cutoff, ratio, bet), out, "account string", "append", GroupStateTimeout.NoTimeout)


def _order_updates(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the accounts of a bucket's symbols, as the bytes of the symbols and of three numbers each."""
    symbols, numbers = state.get if state.exists else (b"", b"")
    accounts = dict(zip(np.frombuffer(symbols, np.int64).tolist(), np.frombuffer(numbers).reshape(-1, 3).tolist(), strict=True))
    new, rows = pd.concat(list(batches)).sort_values("rn", kind="stable"), []
    for symbol, side, position, price in zip(*[new[c].tolist() for c in ("symbol", "side", "position", "price")], strict=True):
        *now, profit = fill_step(*accounts.get(symbol, (0.0, 0.0, 0.0)), side == "buy", position, price)
        accounts[symbol] = now
        rows.append((now[0], now[1], profit, now[2]))
    state.update((np.array(list(accounts), np.int64).tobytes(), np.array(list(accounts.values()), float).tobytes()))
    yield pd.DataFrame(rows, columns=["held", "avg_cost", "profit", "cash"]).assign(symbol=new["symbol"].to_numpy(), rn=new["rn"].to_numpy(), side=new["side"].to_numpy())[["symbol", "rn", "side", "held", "avg_cost", "profit", "cash"]]


def ledger_updates(fills: DataFrame, buckets: int = 1024) -> DataFrame:
    """Order updates mutate each symbol's account: the ledger's rows as its fills arrive, three numbers of state a symbol.

    Symbols are dealt to ``buckets`` by a hash, a state and a call each, as a call costs far more than a symbol's few fills.
    """
    out = "symbol long, rn int, side string, held double, avg_cost double, profit double, cash double"
    dealt = fills.withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(_order_updates, out, "symbols binary, accounts binary", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, label: str, statements: bool = False, typed: bool = False) -> DataFrame:
    """Run a stream over what is there, into Parquet files; ``statements`` merges each batch by key and keeps one row a key.

    ``typed`` runs it on the store that typed state and timers need.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, label)
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    if typed:
        before = spark.conf.get(name)
        spark.conf.set(name, ROCKS)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("append")
        if statements:
            run = writer.foreachBatch(lambda df, batch: merge_statements(df, path, batch)).start()
        else:
            run = writer.format("parquet").option("path", path).start()
        run.awaitTermination()
    finally:
        if typed:
            spark.conf.set(name, before)
    return read_statements(spark, path, stream.schema) if statements else spark.read.schema(stream.schema).parquet(path)
