"""Streams whose ticks come out of order, too late, or twice."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from barsmith.operators.accounts import fill_step
from barsmith.sources import tables as T
from barsmith.streaming import bars as B
from barsmith.streaming import late as N

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 1)


def floor(ts):
    return ts.replace(hour=ts.hour // 6 * 6, minute=0, second=0, microsecond=0)


def stream(spark, files):
    path = T.scratch(spark, "test-ticks")
    for rows in files:
        spark.createDataFrame(rows, B.TICK).coalesce(1).write.mode("append").parquet(path)
    return B.replay(spark, path, B.TICK, 1)


def tick(hours, price, qty=1, symbol="a"):
    return symbol, START + hours * HOUR, float(price), qty


def test_bars_of_shuffled_ticks_and_what_is_late(spark):
    """The watermark follows each file's last tick: what comes for a bar that is due by then is counted, what comes for an open one counts."""
    r = random.Random(1)
    ticks = [tick(i / 7, r.randint(1, 9), r.randint(1, 5), r.choice("ab")) for i in range(280)]
    files = [ticks[k * 40 : (k + 1) * 40] for k in range(7)]
    late = [files[0].pop(3), files[1].pop(5)]
    for f in files:
        r.shuffle(f)
    files[4] += late
    out = B.drain(N.bars_and_late(stream(spark, files)), "test-bars", typed=True)
    got = {(x.symbol, x.ts): (x.open, x.high, x.low, x.close, x.vol, x.n) for x in out.filter("late = 0").collect()}
    want, end = {}, max(t[1] for t in ticks) - dt.timedelta(seconds=5)
    kept = sorted((t for t in ticks if t not in late), key=lambda t: t[1])
    for symbol, ts, price, qty in kept:
        bar = (symbol, floor(ts))
        if bar[1] + 6 * HOUR <= end:
            o = want.get(bar, (price, price, price, price, 0.0, 0))
            want[bar] = (o[0], max(o[1], price), min(o[2], price), price, o[4] + qty, o[5] + 1)
    assert got == want
    lost = {(x.symbol, x.ts): x.late for x in N.late_ticks(out).collect()}
    assert lost == Counter((t[0], floor(t[1])) for t in late)


def test_day_volume_holds_on_low_volume_and_takes_late_ticks_while_windows_are_open(spark):
    files = [[tick(h, 1, 10) for h in range(0, 30)], [tick(h, 1, 1) for h in range(30, 60)], [tick(20, 1, 100), tick(60, 1, 1)], [tick(90, 1)]]
    out = B.drain(N.volumes_and_late(stream(spark, files)), "test-volume", typed=True)
    assert [(x.ts.hour, x.late) for x in out.filter("late > 0").collect()] == [(18, 1)]
    rows = out.filter("late = 0").orderBy("ts").collect()
    hours = [round((x.ts - START) / HOUR) for x in rows]
    assert hours == list(range(6, 91, 6))[: len(hours)] and rows[0].day_vol == 60 and not rows[0].hold
    volumes = [x.day_vol for x in rows]
    assert [x.hold for x in rows] == [v / (sum(volumes[: i + 1]) / (i + 1)) < 0.6 for i, v in enumerate(volumes)] and any(x.hold for x in rows)


def test_a_batch_twice_and_a_corrected_bar_leave_one_row_a_key(spark):
    path, schema = T.scratch(spark, "test-store"), "symbol string, ts timestamp, close double"
    make = lambda *rows: spark.createDataFrame([("a", START + h * HOUR, c) for h, c in rows], schema)
    first, second = make((0, 1.0), (30, 2.0)), make((1, 3.0), (30, 2.5))
    for batch, rows in ((0, first), (0, first), (1, second), (1, second), (2, make((60, 4.0)))):
        T.merge_statements(rows, path, batch)
    got = sorted((round((x.ts - START) / HOUR), x.close) for x in T.read_statements(spark, path, first.schema).collect())
    assert got == [(0, 1.0), (1, 3.0), (30, 2.5), (60, 4.0)]


def test_an_old_batch_again_does_not_undo_a_correction(spark):
    path = T.scratch(spark, "test-store")
    old = spark.createDataFrame([("a", START, 1.0)], "symbol string, ts timestamp, close double")
    T.upsert(old, path, 0, ("symbol", "ts"), "symbol")
    T.upsert(old.withColumn("close", F.lit(2.0)), path, 1, ("symbol", "ts"), "symbol")
    T.upsert(old, path, 0, ("symbol", "ts"), "symbol")
    assert [x.close for x in T.read_store(spark, path, old.schema, "symbol").collect()] == [2.0]


def test_ticks_meet_the_last_levels_before_them(spark):
    """Levels come in files of their own, some after the ticks that they are for; ticks wait for the lesser watermark."""
    r = random.Random(3)
    ticks = [tick(i / 5, r.randint(1, 9), 1, r.choice("ab")) for i in range(200)]
    levels = [(r.choice("ab"), START + (i + 0.5) * HOUR, float(i), -float(i), None if i % 4 else 1.5) for i in range(0, 40, 3)]
    path = T.scratch(spark, "test-levels")
    schema = "symbol string, ts timestamp, cutoff double, atr_exit double, profit_leave double"
    for some in (levels[:2], levels[2:9], levels[9:]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
    files = [ticks[k * 50 : (k + 1) * 50] for k in range(4)]
    for f in files:
        r.shuffle(f)
    out = B.drain(N.ticks_with_levels(stream(spark, files), B.replay(spark, path, schema, 1)), "test-met", typed=True)
    end = min(ticks[-1][1], levels[-1][1]) - dt.timedelta(seconds=5)
    want = []
    for symbol, ts, price, _ in ticks:
        if floor(ts) + 6 * HOUR <= end:
            before = [x for x in levels if x[0] == symbol and x[1] <= ts]
            want.append((symbol, ts, price, *(before[-1][2:] if before else (None,) * 3)))
    key = lambda x: (x[0], x[1])
    assert sorted((tuple(x) for x in out.select("symbol", "ts", "price", "cutoff", "atr_exit", "profit_leave").collect()), key=key) == sorted(want, key=key)


def test_ledger_of_many_symbols_in_few_states(spark):
    """Accounts share a bucket's state and calls; rows are those of a fold of each symbol, over triggers of a whole range."""
    r = random.Random(5)
    fills = [(s, n + 1, r.choice(["buy", "sell"]), float(r.randint(1, 9)), r.randint(1, 99) / 7) for s in range(60) for n in range(r.randint(1, 9))]
    schema, path = "symbol long, rn int, side string, position double, price double", T.scratch(spark, "test-fills")
    files = B.write_in_order(spark.createDataFrame(fills, schema), path, "rn", 3)
    out = B.drain(B.ledger_updates(B.replay(spark, path, schema, files), buckets=4), "test-ledger")
    want, now = [], {}
    for symbol, rn, side, position, price in fills:
        *now[symbol], profit = fill_step(*now.get(symbol, (0.0, 0.0, 0.0)), side == "buy", position, price)
        want.append((symbol, rn, side, now[symbol][0], now[symbol][1], repr(profit), now[symbol][2]))
    assert sorted((x.symbol, x.rn, x.side, x.held, x.avg_cost, repr(x.profit if x.profit is not None else float("nan")), x.cash) for x in out.collect()) == want
    states = spark.read.format("statestore").load(out.inputFiles()[0].rsplit("/", 1)[0] + "-state")
    assert states.count() <= 4
