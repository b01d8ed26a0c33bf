"""The query registry, and the SQL pieces that the checking queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BY = "partition by symbol order by ts"
DIGITS = 6

#: Action, level in deviations and share of each order of the plan.
PLAN = [("S", 10, 0.25), ("S", 7, 0.25), ("S", 5, 0.5), ("B", -5, 0.125), ("B", -7, 0.125), ("B", -9, 0.25), ("B", -11, 0.5)]


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that returns the same rows, if any."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r(x: Column | str, digits: int = DIGITS) -> Column:
    """Rounded for comparison; negative zero becomes zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + 0.0


def rounded(df: DataFrame, *plain: str, **numbers: Column | str) -> DataFrame:
    return df.select(*plain, *[r(v).alias(k) for k, v in numbers.items()])


def q(x: str, name: str, digits: int = DIGITS) -> str:
    return f"round({x}, {digits}) + 0.0 as {name}"


def roll(agg: str, x: str, n: int, least: int | None = None, lag: bool = False) -> str:
    frame = f"over ({BY} rows between {n if lag else n - 1} preceding and {'1 preceding' if lag else 'current row'})"
    return f"case when count({x}) {frame} >= {n if least is None else least} then {agg}({x}) {frame} end"


CANDLES = """
with ticks as (
  select event_type || '_' || (user_id % 4) as symbol, ts, value + 1 as price, cast(json_extract_string(props, '$.k') as bigint) + 1 as qty from events
), candles as (
  select symbol, time_bucket(interval 6 hours, ts) as ts, arg_min(price, ts) as open, max(price) as high, min(price) as low,
    arg_max(price, ts) as close, cast(sum(qty) as double) as vol, count(*) as n
  from ticks group by symbol, time_bucket(interval 6 hours, ts)
)"""

FILLS = """
with fills as (
  select l_partkey as symbol,
    case when l_returnflag = 'R' then (case when l_linenumber % 2 = 0 then 'sell-limit' else 'sell-stop-limit' end) else (case when l_linenumber % 2 = 0 then 'buy-limit' else 'buy-stop-limit' end) end as type,
    case when l_linestatus = 'F' then 'filled' else 'partial-canceled' end as state,
    l_quantity as amount, case when l_returnflag = 'R' then l_extendedprice * l_tax else l_quantity * l_tax end as fees, l_extendedprice as cash,
    l_shipdate as time, l_orderkey as order_id, l_linenumber as line, l_suppkey as suppkey
  from lineitem
)"""

#: Channel, range, stop, breakout and exit labels with 10-bar windows and a margin of 1.5.
TURTLE = f"""{CANDLES}, base as (
  select *, lag(close) over ({BY}) as before, {roll("max", "high", 10, lag=True)} as turtle_h, {roll("min", "low", 10, lag=True)} as turtle_l from candles
), ranged as (
  select *, greatest(high - low, abs(before - high), abs(before - low)) as tr from base
), averaged as (
  select *, {roll("avg", "tr", 10)} as atr, {roll("stddev_samp", "tr", 10)} as atr_std from ranged
), turtle as (
  select *, before - lag(atr) over ({BY}) * 1.5 as exit_price, coalesce(high > turtle_h, false) as buy_signal from averaged
)"""

LABELS = f"""{TURTLE}, fired as (
  select *, coalesce(close < exit_price, false) as fires from turtle
), exits as (
  select *, min(case when fires then ts end) over ({BY} rows between current row and unbounded following) as next_ts from fired
), labels as (
  select e.*, case when e.exit_price is not null then e.close end as buy, case when e.exit_price is not null then f.exit_price end as sell,
    case when e.exit_price is not null then e.next_ts end as matured,
    case when e.exit_price is not null then f.exit_price / e.close - 1 end as profit,
    case when e.exit_price is not null and e.atr <> 0 then (f.exit_price - e.close) / (e.atr * 1.5) end as pl,
    case when e.exit_price is not null then cast(floor((epoch(e.next_ts) - epoch(e.ts)) / 21600) as bigint) end as time_cost
  from exits e left join fired f on e.symbol = f.symbol and e.next_ts = f.ts
)"""
