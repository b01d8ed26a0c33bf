"""Queries over indicators (W) and sorted reports (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import accounts as A
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import reviews as V
from ..sources.tables import candles
from .registry import BY, CANDLES, LABELS, PLAN, TURTLE, q, query, r, roll, rounded


def turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.turtle(candles(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exit_labels(turtle(spark, sf_dir))


@query("w1_donchian", f"{TURTLE} select symbol, ts, turtle_h, turtle_l from turtle")
def w1(spark, sf):
    return turtle(spark, sf).select("symbol", "ts", "turtle_h", "turtle_l")


@query("w1_donchian_close", f"{CANDLES} select symbol, ts, {roll('max', 'close', 10, lag=True)} as turtle_h, {roll('min', 'close', 5, lag=True)} as turtle_l from candles")
def w1_close(spark, sf):
    return I.donchian(candles(spark, sf), 10, 5, source="close").select("symbol", "ts", "turtle_h", "turtle_l")


@query("w2_true_range", f"{TURTLE} select symbol, ts, {q('tr', 'tr')}, {q('atr', 'atr')}, {q('atr_std', 'atr_std')} from turtle")
def w2(spark, sf):
    return rounded(turtle(spark, sf), "symbol", "ts", tr="tr", atr="atr", atr_std="atr_std")


@query("w3_trailing_stop", f"{TURTLE} select symbol, ts, {q('exit_price', 'exit_price')}, {q('greatest(turtle_l, exit_price)', 'channel_exit')} from turtle")
def w3(spark, sf):
    return rounded(turtle(spark, sf), "symbol", "ts", exit_price="exit_price", channel_exit="channel_exit")


@query("w4_take_profit", f"{CANDLES} select symbol, ts, {q('(' + roll('avg', 'high', 10) + ') + 3 * (' + roll('stddev_samp', 'high', 10) + ')', 'take_profit')} from candles")
def w4(spark, sf):
    return rounded(I.take_profit(candles(spark, sf), 10, 3), "symbol", "ts", take_profit="take_profit")


@query("w5_breakout", f"{TURTLE} select symbol, ts, buy_signal, coalesce(close > turtle_h, false) as close_signal from turtle")
def w5(spark, sf):
    return turtle(spark, sf).select("symbol", "ts", "buy_signal", I.yes(F.col("close") > F.col("turtle_h")).alias("close_signal"))


OBV = f"""{CANDLES}, signed as (
  select *, coalesce(sign(close - lag(close) over ({BY})), 0) * vol as sv from candles
), summed as (
  select *, sum(sv) over ({BY} rows unbounded preceding) as obv from signed
), banded as (
  select *, {roll("avg", "obv", 20)} as ma, {roll("stddev_samp", "obv", 20)} as dev, {roll("avg", "close", 20)} as cma, {roll("stddev_samp", "close", 20)} as cdev, lag(obv) over ({BY}) as obv_before from summed
)"""


@query(
    "w6_on_balance_volume",
    f"""{OBV} select symbol, ts, {q("obv", "obv")}, {q("ma + 1.2 * dev", "obv_upper")}, {q("ma - 1.2 * dev", "obv_lower")}, {q("case when ma <> 0 then (2.4 * dev) / ma end", "bound_diff", 4)},
    {q("case when cma <> 0 then cdev / cma * 100 end", "rolling_std")}, coalesce(high >= cma + 1.2 * cdev, false) as price_up, coalesce(low <= cma + 1.2 * cdev, false) as price_low,
    coalesce(obv > ma + 1.2 * dev and obv_before <= ma + 1.2 * dev and low <= cma + 1.2 * cdev, false) as obv_up from banded""",
)
def w6(spark, sf):
    df = I.on_balance_volume(candles(spark, sf), 20, 1.2)
    return df.select("symbol", "ts", r("obv").alias("obv"), r("obv_upper").alias("obv_upper"), r("obv_lower").alias("obv_lower"), r("bound_diff", 4).alias("bound_diff"), r("rolling_std").alias("rolling_std"), "price_up", "price_low", "obv_up")


@query(
    "w6b_volume_cross",
    f"""{OBV}, wide as (select *, case when ma <> 0 then 1 - (ma + 1.2 * dev) / ma end as bound_diff from banded)
    select symbol, ts, coalesce(obv > ma + 1.2 * dev and obv_before <= ma + 1.2 * dev and bound_diff > 0.05, false) as upper_cross,
    coalesce(obv < ma - 1.2 * dev and obv_before >= ma - 1.2 * dev and bound_diff > 0.05, false) as lower_cross from wide""",
)
def w6b(spark, sf):
    return I.volume_cross(candles(spark, sf), 20, 1.2).select("symbol", "ts", "upper_cross", "lower_cross")


@query("w7_exit_labels", f"{LABELS} select symbol, ts, buy, {q('sell', 'sell')}, matured, {q('profit', 'profit')}, {q('pl', 'pl')}, time_cost from labels")
def w7(spark, sf):
    df = labels(spark, sf)
    return df.select("symbol", "ts", "buy", r("sell").alias("sell"), "matured", r("profit").alias("profit"), r("pl").alias("pl"), "time_cost")


@query(
    "w7b_next_open_labels",
    f"""{TURTLE}, ahead as (
      select *, greatest(turtle_l, exit_price) as stop, lead(open) over ({BY}) as no, lead(close) over ({BY}) as nc, lead(ts) over ({BY}) as nt from turtle
    ), bought as (select *, case when stop < no then no end as buy from ahead
    ), fired as (select *, buy is not null and coalesce(nc < stop or nc < turtle_l, false) as fires from bought
    ), nexts as (select *, min(case when fires then ts end) over ({BY} rows between current row and unbounded following) as at from fired)
    select a.symbol, a.ts, a.buy, {q("case when a.buy is not null then b.stop end", "sell")}, case when a.buy is not null then b.nt end as matured, {q("case when a.buy is not null then b.stop / a.buy - 1 end", "profit")}
    from nexts a left join fired b on a.symbol = b.symbol and a.at = b.ts""",
)
def w7b(spark, sf):
    df = L.next_open_labels(turtle(spark, sf))
    return df.select("symbol", "ts", "buy", r("sell").alias("sell"), "matured", r("profit").alias("profit"))


@query(
    "w8_volume_weighted",
    f"""{CANDLES}, t as (select *, close * vol as cv from candles), v as (select *, ({roll("sum", "cv", 10)}) / ({roll("sum", "vol", 10)}) as vwma from t),
    s as (select *, (close - lag(vwma, 10) over ({BY})) / 10 as slope from v) select symbol, ts, {q("vwma", "vwma")}, {q("slope", "slope")}, {q(f"slope - lag(slope) over ({BY})", "slope_diff")} from s""",
)
def w8(spark, sf):
    return rounded(I.volume_weighted(candles(spark, sf), 10), "symbol", "ts", vwma="vwma", slope="slope", slope_diff="slope_diff")


@query(
    "w9_dip_plan",
    f"""{CANDLES}, b as (select *, {roll("avg", "close", 30, lag=True)} as m, {roll("stddev_samp", "close", 30, lag=True)} as d from candles),
    h as (select *, m - 0.5 * d as b1, m - 1.0 * d as b2, m - 1.5 * d as b3, m - 2.0 * d as b4 from b),
    p as (select *, case when low <= b1 and b1 > 0 then 12.5 else 0 end as p1, case when low <= b2 and b2 > 0 then 12.5 else 0 end as p2, case when low <= b3 and b3 > 0 then 25.0 else 0 end as p3, case when low <= b4 and b4 > 0 then 50.0 else 0 end as p4 from h),
    u as (select *, p1 + p2 + p3 + p4 as paid, coalesce(p1 / nullif(b1, 0), 0) + coalesce(p2 / nullif(b2, 0), 0) + coalesce(p3 / nullif(b3, 0), 0) + coalesce(p4 / nullif(b4, 0), 0) as units from p)
    select symbol, ts, {q("cast(paid as double)", "paid")}, {q("units", "units")}, {q("case when units > 0 then paid / units end", "avg_cost")} from u""",
)
def w9(spark, sf):
    df = I.dip_plan(candles(spark, sf), 30, (0.5, 1.0, 1.5, 2.0))
    return rounded(df, "symbol", "ts", paid="paid", units="units", avg_cost="avg_cost")


@query(
    "w9b_band_count",
    f"""{CANDLES}, b as (select *, {roll("avg", "close", 20, lag=True)} as m, {roll("stddev_samp", "close", 20, lag=True)} as d from candles)
    select symbol, ts, cast(coalesce(list_sum([case when low < m - i * d then 1 else 0 end for i in range(1, 11)]), 0) as integer) as bbl,
    cast(coalesce(list_sum([case when high > m + i * d then 1 else 0 end for i in range(1, 11)]), 0) as integer) as bbh,
    coalesce(list_sum([case when high > m + i * d then 1 else 0 end for i in range(1, 11)]), 0) > 2 as band_signal from b""",
)
def w9b(spark, sf):
    return I.band_count(candles(spark, sf), 20, 2).select("symbol", "ts", "bbl", "bbh", "band_signal")


@query(
    "w10_streaks",
    f"""{LABELS}, f as (select *, coalesce(pl > 0, false) as win, coalesce(pl <= 0, false) as loss from labels),
    g as (select *, row_number() over ({BY}) as rn, row_number() over (partition by symbol, win order by ts) as rw, row_number() over (partition by symbol, loss order by ts) as rl, row_number() over (partition by symbol, buy_signal order by ts) as rs from f),
    w as (select symbol, max(c) as m from (select symbol, rn - rw as grp, count(*) as c from g where win group by 1, 2) group by 1),
    l as (select symbol, max(c) as m from (select symbol, rn - rl as grp, count(*) as c from g where loss group by 1, 2) group by 1),
    t as (select symbol, max(rn) - coalesce(max(case when not buy_signal then rn end), 0) as m from g group by 1)
    select t.symbol, coalesce(w.m, 0) as most_wins, coalesce(l.m, 0) as most_losses, t.m as trailing_signals from t left join w using (symbol) left join l using (symbol)""",
)
def w10(spark, sf):
    return V.streak_review(labels(spark, sf))


@query("w11_win_rate", f"{LABELS} select symbol, ts, round(avg(case when profit > 0 then 1.0 else 0.0 end) over ({BY} rows between 59 preceding and current row), 6) as win_rate from labels")
def w11(spark, sf):
    return rounded(I.win_rate_trend(labels(spark, sf)), "symbol", "ts", win_rate="win_rate")


@query(
    "w12_average_cumulative_return",
    f"""{CANDLES}, spine as (select ts, symbol from (select distinct ts from candles), (select distinct symbol from candles)),
    filled as (select s.symbol, s.ts, last_value(c.close ignore nulls) over (partition by s.symbol order by s.ts rows unbounded preceding) as close from spine s left join candles c on s.symbol = c.symbol and s.ts = c.ts),
    grown as (select *, close / first_value(close ignore nulls) over (partition by symbol order by ts rows between unbounded preceding and unbounded following) - 1 as growth from filled)
    select ts, {q("avg(growth)", "mean_return")} from grown group by ts having count(growth) = (select count(distinct symbol) from candles)""",
)
def w12(spark, sf):
    return rounded(I.average_cumulative_return(candles(spark, sf)), "ts", mean_return="mean_return")


@query(
    "w13_trade_periods",
    f"""{TURTLE}, f as (select *, coalesce(close < exit_price, false) as sells from turtle),
    p as (select *, coalesce(sum(cast(sells as int)) over ({BY} rows between unbounded preceding and 1 preceding), 0) as period from f),
    s as (select *, min(case when buy_signal then ts end) over (partition by symbol, period) as start from p)
    select symbol, cast(period as bigint) as period, min(ts) as start, max(ts) as stop, count(*) as bars from s where ts >= start group by symbol, period having bool_or(sells) and count(*) > 3""",
)
def w13(spark, sf):
    df = turtle(spark, sf).withColumn("sells", I.yes(F.col("close") < F.col("exit_price")))
    return I.trade_periods(df, "buy_signal", "sells")


@query(
    "w14_mean_reversion",
    f"""{CANDLES}, g as (select *, ({roll("avg", "close", 5)}) - ({roll("avg", "close", 15)}) as gap, {roll("stddev_samp", "close", 10)} as sd from candles),
    h as (select *, {roll("avg", "gap", 10)} as gm from g) select symbol, ts, {q("(gap - gm) / nullif(sd, 0)", "reversion")} from h""",
)
def w14(spark, sf):
    return rounded(I.mean_reversion(candles(spark, sf), 5, 15, 10), "symbol", "ts", reversion="reversion")


RETURNS = f"""{CANDLES}, lr as (select *, ln(close / lag(close) over ({BY})) as log_return, case when vol > 0 then ln(vol) end as lv from candles),
    dv as (select *, {roll("avg", "log_return", 20, 1)} as drift, case when count(log_return) over ({BY} rows between 19 preceding and current row) >= 2 then stddev_samp(log_return) over ({BY} rows between 19 preceding and current row) end as volatility from lr),
    lw as (select *, case when volatility > 0 then ln(volatility) end as lvol from dv)"""


@query(
    "w15_returns",
    f"""{RETURNS} select symbol, ts, {q("log_return", "log_return")}, {q("drift", "drift")}, {q("volatility", "volatility")}, {q("close * exp(drift)", "pred_price", 9)},
    {q(roll("avg", "lv", 20, 1), "global_log_vol")}, {q(roll("avg", "lvol", 20, 1), "global_log_volatility")} from lw""",
)
def w15(spark, sf):
    names = ("log_return", "drift", "volatility", "pred_price", "global_log_vol", "global_log_volatility")
    df = I.returns_block(candles(spark, sf), 20)
    return df.select("symbol", "ts", *[r(c, 9 if c == "pred_price" else 6).alias(c) for c in names])


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with range, filtered price and its slope."""
    df = A.kalman_price(I.returns_block(I.average_true_range(candles(spark, sf_dir), 10), 20), 20)
    return I.local_slope(df, 20)


#: The rolling filter of G1 in SQL: for every bar at once a recursion over the 20 bars up to it; then the slope.
FILTERED = f"""{RETURNS.replace("with ticks", "with recursive ticks", 1)},
    rt as (select *, close * exp(drift) as pred, {roll("avg", "lv", 20, 1)} as glv, {roll("avg", "lvol", 20, 1)} as glvola, coalesce(lvol, 0) as ls, lag(close) over ({BY}) as before, row_number() over ({BY}) as rn from lw),
    rs as (select *, greatest(high - low, abs(before - high), abs(before - low)) as tr from rt),
    ra as (select *, {roll("avg", "tr", 10)} as atr from rs),
    kf as (select symbol, rn, glv, glvola, 20 as j, null::double as x, 1.0::double as p, null::double as b from ra
      union all
      select symbol, rn, glv, glvola, j, case when volatility is null then x when x is null then pred else x + gain * (close - x) end, case when volatility is null or x is null then p else (1 - gain) * (p + 0.001::double) end, case when volatility is null then b else close end
      from (select k.symbol, k.rn, k.glv, k.glvola, k.j - 1 as j, k.x, k.p, k.b, s.close, s.pred, s.volatility,
          (k.p + 0.001::double) / (k.p + 0.001::double + 0.001::double * least(greatest(exp(-0.6::double * (ln(greatest(s.vol, 1e-6)) - k.glv)), 0.1::double), 2.0::double) * exp(0.2::double * (s.ls - k.glvola)) * exp(-0.2::double * abs(s.close - k.b))) as gain
        from kf k left join ra s on s.symbol = k.symbol and s.rn = k.rn - (k.j - 1) where k.j > 0)),
    kal as (select ra.symbol, ra.ts, ra.close, ra.vol, ra.atr, coalesce(kf.x, ra.close) as kalman from ra join kf on kf.symbol = ra.symbol and kf.rn = ra.rn where kf.j = 0),
    lo as (select *, min(kalman) over ({BY} rows between 41 preceding and 2 preceding) as local_low from kal),
    filtered as (select *, (kalman - local_low + 1e-8) / 40 as slope from lo)"""


@query("w16_local_slope", f"{FILTERED} select symbol, ts, {q('kalman', 'kalman')}, {q('local_low', 'local_low')}, {q('slope', 'slope')} from filtered")
def w16(spark, sf):
    return rounded(filtered(spark, sf), "symbol", "ts", kalman="kalman", local_low="local_low", slope="slope")


FEATURES = ("kreturn", "kreturn_vol", "rvolume", "slope")


@query(
    "w17_regime_features",
    f"""{FILTERED}, bs as (select *, {roll("avg", "kalman", 60, 5, lag=True)} as base, {roll("avg", "vol", 60, 5)} as mv from filtered), kr as (select *, ln(kalman / base + 1e-8) as kreturn, ln(vol / mv + 1e-8) as rvolume from bs),
    kv as (select *, {roll("avg", "kreturn", 60, 5)} as kreturn_vol from kr), bf as (select symbol, ts, {", ".join(f"first_value({c} ignore nulls) over ({BY} rows between current row and unbounded following) as {c}" for c in FEATURES)} from kv)
    select symbol, ts, {", ".join(q(f"({c} - avg({c}) over (partition by symbol)) / nullif(stddev_pop({c}) over (partition by symbol), 0)", f"{c}_z") for c in FEATURES)} from bf""",
)
def w17(spark, sf):
    df = I.regime_features(filtered(spark, sf))
    return rounded(df, "symbol", "ts", **{f"{c}_z": f"{c}_z" for c in FEATURES})


@query(
    "w18_dynamic_stop",
    f"""{FILTERED}, qd as (select *, quantile_cont(slope, 0.05) over ({BY} rows between 59 preceding and current row) as q1, quantile_cont(slope, 0.5) over ({BY} rows between 59 preceding and current row) as q2 from filtered),
    mg as (select *, 0.1::double + coalesce((least(greatest(slope, q1), q2) - q1) / nullif(q2 - q1, 0), 0) * 1.9::double as margin from qd) select symbol, ts, {q("margin", "margin")}, {q(f"lag(kalman) over ({BY}) - lag(atr) over ({BY}) * margin", "exit_price")} from mg""",
)
def w18(spark, sf):
    return rounded(I.dynamic_stop(filtered(spark, sf), 60), "symbol", "ts", margin="margin", exit_price="exit_price")


@query(
    "w19_surprise",
    f"""{CANDLES}, s as (select *, {roll("avg", "close", 10, lag=True)} as cm, {roll("stddev_samp", "close", 10, lag=True)} as cs, {roll("avg", "vol", 10, lag=True)} as vm, {roll("stddev_samp", "vol", 10, lag=True)} as vs from candles)
    select symbol, ts, {q("cm + cs * cs / nullif(cs * cs + (close - cm) * (close - cm), 0) * (close - cm)", "close_updated")}, {q("vm + vs * vs / nullif(vs * vs + (vol - vm) * (vol - vm), 0) * (vol - vm)", "vol_updated")},
    {q("(close - cm) * (close - cm) / nullif(2 * cs * cs, 0) + (vol - vm) * (vol - vm) / nullif(2 * vs * vs, 0) + case when cs > 0 and vs > 0 then 0.5 * ln(2 * pi() * cs * vs) end", "surprise")} from s""",
)
def w19(spark, sf):
    return rounded(I.surprise(candles(spark, sf), 10), "symbol", "ts", close_updated="close_updated", vol_updated="vol_updated", surprise="surprise")


ACCELERATION = f"""{CANDLES}, sp as (select *, close - lag(close) over ({BY}) as cs, vol - lag(vol) over ({BY}) as vs from candles),
    ac as (select *, cs - lag(cs) over ({BY}) as ca, vs - lag(vs) over ({BY}) as va from sp)"""


@query("w20_acceleration", f"{ACCELERATION} select symbol, ts, {q('cs', 'close_speed')}, {q('ca', 'close_acc')}, {q('vs', 'vol_speed')}, {q('va', 'vol_acc')} from ac")
def w20(spark, sf):
    return rounded(I.acceleration(candles(spark, sf)), "symbol", "ts", **{c: c for c in ("close_speed", "close_acc", "vol_speed", "vol_acc")})


@query("w21_ribbon", f"{CANDLES}, b as (select *, {roll('avg', 'close', 20)} as m, {roll('stddev_pop', 'close', 20)} as d from candles) select symbol, ts, {q('m', 'mid')}, {q('m + 2 * d', 'top')}, {q('m - 2 * d', 'bottom')} from b")
def w21(spark, sf):
    return rounded(I.ribbon(candles(spark, sf), 20, 2), "symbol", "ts", mid="mid", top="top", bottom="bottom")


@query(
    "w22_hysteresis",
    f"""{CANDLES}, g as (select *, close - ({roll("avg", "close", 5)}) as gap from candles), s as (select *, stddev_pop(gap) over (partition by symbol) as d from g),
    e as (select *, case when gap < -2 * d then 1 when gap > d then 0 end as ev from s), h as (select *, coalesce(last_value(ev ignore nulls) over ({BY} rows unbounded preceding), 0) as holding from e),
    p as (select *, coalesce(lag(holding) over ({BY}), 0) as was from h)
    select symbol, ts, holding, was = 0 and holding = 1 as entered, was = 1 and holding = 0 as "left", {q("gain", "gain")}, {q(f"1000 * coalesce(product(1 + gain / entry) over ({BY} rows unbounded preceding), 1)", "capital", 4)}
    from (select *, case when was = 1 and holding = 0 then close - lag(close, 4) over ({BY}) end as gain, last_value(case when was = 0 and holding = 1 then close end ignore nulls) over ({BY} rows unbounded preceding) as entry from p)""",
)
def w22(spark, sf):
    df = I.hysteresis(candles(spark, sf))
    return df.select("symbol", "ts", "holding", "entered", "left", r("gain").alias("gain"), r("capital", 4).alias("capital"))


@query("w23_weighted_mean", f"{CANDLES} select symbol, ts, {q('(' + ' + '.join(f'{10 - i} * lag(close, {i}) over ({BY})' for i in range(10)) + ') / 55', 'wma')} from candles")
def w23(spark, sf):
    return rounded(I.weighted_mean(candles(spark, sf), 10), "symbol", "ts", wma="wma")


def ewm_sql(source: str, cols: dict[str, tuple[str, float]]) -> str:
    """Recursive exponential means without adjustment over ``source``'s rows in order; a null keeps the mean."""
    step = ", ".join(f"coalesce(n.{c} * {a} + e.{k} * (1 - {a}), n.{c}, e.{k}) as {k}" for k, (c, a) in cols.items())
    first = ", ".join(f"{c} as {k}" for k, (c, a) in cols.items())
    return f"""numbered as (select *, row_number() over ({BY}) as rn from {source}),
    ewm as (select symbol, ts, rn, {first} from numbered where rn = 1 union all select n.symbol, n.ts, n.rn, {step} from ewm e join numbered n on n.symbol = e.symbol and n.rn = e.rn + 1)"""


RECURSIVE = CANDLES.replace("with ticks", "with recursive ticks", 1)
EMA = f"{RECURSIVE}, {ewm_sql('candles', {'ema5': ('close', 2 / 6), 'ema60': ('close', 2 / 61)})}"


@query("w24_exponential_means", f"{EMA} select symbol, ts, {q('ema5', 'ema5')}, {q('ema60', 'ema60')} from ewm")
def w24(spark, sf):
    df = A.ewm_columns(candles(spark, sf).select("symbol", "ts", "close"), {"ema5": ("close", A.span(5), False), "ema60": ("close", A.span(60), False)})
    return rounded(df, "symbol", "ts", ema5="ema5", ema60="ema60")


@query(
    "w25_cross_signal",
    f"""{FILTERED}, {ewm_sql("(select symbol, ts, close, kalman from filtered)", {"ema5": ("close", 2 / 6), "ema60": ("close", 2 / 61)})}
    select e.symbol, e.ts, coalesce(ema5 > ema60 and kalman > ema5, false) as "cross" from ewm e join filtered f on e.symbol = f.symbol and e.ts = f.ts""",
)
def w25(spark, sf):
    df = A.ewm_columns(filtered(spark, sf).select("symbol", "ts", "close", "kalman"), {"ema5": ("close", A.span(5), False), "ema60": ("close", A.span(60), False)})
    return df.select("symbol", "ts", I.yes((F.col("ema5") > F.col("ema60")) & (F.col("kalman") > F.col("ema5"))).alias("cross"))


DIRECTION = f"""{TURTLE.replace("with ticks", "with recursive ticks", 1)}, mv as (select *, high - lag(high) over ({BY}) as up, lag(low) over ({BY}) - low as dn from turtle),
    dm as (select *, coalesce(case when up > dn then greatest(up, 0) end, 0) as updm, coalesce(case when dn > up then greatest(dn, 0) end, 0) as dndm from mv),
    {ewm_sql("dm", {"pdm": ("updm", 0.1), "mdm": ("dndm", 0.1)})},
    di as (select e.symbol, e.ts, coalesce(pdm / nullif(atr, 0), 0) as pdi, coalesce(mdm / nullif(atr, 0), 0) as mdi from ewm e join turtle t on e.symbol = t.symbol and e.ts = t.ts)"""


@query("w26_directional_index", f"{DIRECTION} select symbol, ts, {q('pdi', 'plus_di')}, {q('mdi', 'minus_di')} from di")
def w26(spark, sf):
    return rounded(A.directional_index(turtle(spark, sf), 10), "symbol", "ts", plus_di="plus_di", minus_di="minus_di")


@query(
    "w26_signed_index",
    f"""{DIRECTION}, dxs as (select *, abs(pdi - mdi) / nullif(pdi + mdi, 0) as dx from di), {ewm_sql("dxs", {"adx": ("dx", 0.1)}).replace("numbered", "numbered_dx").replace("ewm", "ewm_dx")}
    select d.symbol, d.ts, {q("dx", "dx")}, {q("adx", "adx")}, {q("adx * sign(pdi - mdi)", "adx_signed")} from dxs d join ewm_dx e on e.symbol = d.symbol and e.ts = d.ts""",
)
def w26_signed(spark, sf):
    return rounded(A.directional_index(turtle(spark, sf), 10), "symbol", "ts", dx="dx", adx="adx", adx_signed="adx_signed")


SPANS = (12, 144, 169, 576, 676)


def adjusted_sql(source: str, spans: tuple) -> str:
    """Recursive exponential means of the closes in ``source`` with adjustment: weighted sum over sum of weights."""
    first = ", ".join(f"close as n{n}, 1.0::double as d{n}" for n in spans)
    step = ", ".join(f"n.close + e.n{n} * (1 - {2 / (n + 1)}::double), 1 + e.d{n} * (1 - {2 / (n + 1)}::double)" for n in spans)
    return f"""counted as (select *, row_number() over ({BY}) as rn from {source}),
    sums as (select symbol, ts, rn, {first} from counted where rn = 1 union all select n.symbol, n.ts, n.rn, {step} from sums e join counted n on n.symbol = e.symbol and n.rn = e.rn + 1),
    means as (select c.*, {", ".join(f"n{n} / d{n} as ema{n}" for n in spans)} from sums s join counted c on c.symbol = s.symbol and c.rn = s.rn)"""


@query(
    "w27_tunnel",
    f"""{RECURSIVE}, {adjusted_sql("candles", SPANS)}, tn as (select *, greatest(ema144, ema169) as top, least(ema144, ema169) as low_ from means), tt as (select *, close <= top and close >= low_ as inside from tn),
    br as (select *, coalesce(lag(inside) over ({BY}), false) and not inside as breakout from tt)
    select symbol, ts, {q("top", "top")}, {q("low_", "low")}, {q("top + (top - low_) * 1.618::double", "fib1_618")}, inside as in_tunnel, breakout, breakout and ema12 > top and ema576 > ema676 as "long", breakout and ema12 < low_ and ema576 < ema676 as "short" from br""",
)
def w27(spark, sf):
    """Tunnel of two slow means, its fibonacci levels, and the flags of a break out of it."""
    df = A.ewm_columns(candles(spark, sf).select("symbol", "ts", "close"), {f"ema{n}": ("close", A.span(n), True) for n in SPANS})
    top, low = F.greatest("ema144", "ema169"), F.least("ema144", "ema169")
    df = df.withColumns({"top": top, "low": low, "width": top - low, "in_tunnel": (F.col("close") <= top) & (F.col("close") >= low)})
    df = df.withColumns({f"fib{str(k).replace('.', '_')}": F.col("top") + F.col("width") * k for k in (0.618, 1.618, 2.618, 4.236, 6.854)})
    was = F.coalesce(I.prior("in_tunnel"), F.lit(False))
    df = df.withColumn("breakout", was & ~F.col("in_tunnel"))
    df = df.withColumns({"long": F.col("breakout") & (F.col("ema12") > F.col("top")) & (F.col("ema576") > F.col("ema676")), "short": F.col("breakout") & (F.col("ema12") < F.col("low")) & (F.col("ema576") < F.col("ema676"))})
    return df.select("symbol", "ts", r("top").alias("top"), r("low").alias("low"), r("fib1_618").alias("fib1_618"), "in_tunnel", "breakout", "long", "short")


GATE = f"""{CANDLES}, g as (select *, {roll("avg", "close", 10)} as mean, {roll("stddev_samp", "close", 10)} as std, {roll("max", "close", 10)} as top from candles),
    gm as (select *, quantile_cont(std, 0.5) over ({BY} rows between 9 preceding and current row) as median from g)"""


@query(
    "w28_volatility_gate",
    f"""{GATE}, p(action, level, ratio) as (values {", ".join(f"('{a}', {lv}, {x})" for a, lv, x in PLAN)})
    select symbol, ts, action, cast(level as integer) as level, cast(ratio as double) as ratio, {q("case when action = 'S' then top else mean end + level * std", "price")} from gm, p where std >= median""",
)
def w28(spark, sf):
    """The plan of each bar whose gate is open; sells stand over the highest of the last ten closes."""
    out = I.volatility_plan(candles(spark, sf), 10, PLAN, I.rolling(F.max, F.col("close"), 10))
    return out.select("symbol", "ts", "action", "level", "ratio", r("price").alias("price"))


@query(
    "w29_missing_bars",
    f"""{CANDLES}, g as (select *, epoch(ts) - epoch(lag(ts) over ({BY})) as gap from candles) select symbol, ts, cast(gap as bigint) as gap, cast(floor(gap / 21600) as bigint) - 1 as missing from g where gap > 21600""",
)
def w29(spark, sf):
    return I.missing_bars(candles(spark, sf), 21600).select("symbol", "ts", "gap", "missing")


SCAN = f"{TURTLE}, c as (select symbol, count(*) filter (buy_signal) as signals from turtle group by symbol)"


@query("x1_rank_symbols", f"{SCAN} select symbol, signals from c order by signals desc, symbol limit 10")
def x1(spark, sf):
    df = turtle(spark, sf).groupBy("symbol").agg(F.sum(F.col("buy_signal").cast("int")).alias("signals"))
    return df.orderBy(F.desc("signals"), "symbol").limit(10)


@query("x2_time_order", f"{CANDLES} select symbol, ts, row_number() over ({BY}) as place from candles")
def x2(spark, sf):
    return candles(spark, sf).select("symbol", "ts", F.row_number().over(I.series()).cast("long").alias("place"))


@query("x3_last_row", f"{CANDLES} select symbol, max(ts) as ts, arg_max(close, ts) as close from candles group by symbol")
def x3(spark, sf):
    return candles(spark, sf).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


@query("x5_head_and_tail", f"{CANDLES}, n as (select *, row_number() over ({BY}) as a, row_number() over (partition by symbol order by ts desc) as z from candles) select symbol, ts, close, a <= 3 as head from n where a <= 3 or z <= 3")
def x5(spark, sf):
    df = candles(spark, sf).withColumns({"a": F.row_number().over(I.series()), "z": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))})
    return df.filter("a <= 3 or z <= 3").select("symbol", "ts", "close", (F.col("a") <= 3).alias("head"))
