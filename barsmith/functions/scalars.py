"""Column functions: odds, weights, bet sizes, order ids, precision, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Interval names in minutes, the suffixes of order ids, the smallest stake, guards against zero.
INTERVAL_MINUTES = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "60min": 60, "4hour": 240, "1day": 1440, "local": 0.001}
ORDER_SUFFIXES = ("_CUTOFF", "_ATR_EXIT", "_PROFIT_LEAVE", "_STRIKE")
MIN_STAKE = 10.01
TINY, ODDS_EPS = 2.2250738585072014e-308, 1e-10


def odds(p: Column, sure: float | None = 0.999999) -> Column:
    """p / (1 - p); a p of 1 counts as ``sure``, or as it is if that is None (then the guard against zero gives 1e10)."""
    if sure is not None:
        p = F.when(p == 1, sure).otherwise(p)
    return p / (1 - p + ODDS_EPS)


def from_odds(o: Column) -> Column:
    return o / (o + 1 + ODDS_EPS)


def evidence_weight(n: Column, mid: Column | float) -> Column:
    return 1 / (1 + F.exp(-(n - mid)))


def kelly(p: Column, loss: Column, gain: Column) -> Column:
    """Bet fraction from a win probability and both margins; a missing or zero margin counts as tiny; never below 0."""
    loss = F.when(F.coalesce(loss, F.lit(0.0)) == 0, F.lit(1e-30)).otherwise(loss)
    gain = F.when(F.coalesce(gain, F.lit(0.0)) == 0, F.lit(1e-30)).otherwise(gain)
    win, lose = p / loss, (1 - p) / gain
    return F.when(win > lose, (win - lose) / win).otherwise(0.0)


def simple_kelly(p: Column, ratio: Column) -> Column:
    """p - (1 - p) / r for a gain of r times the loss."""
    return p - (1 - p) / F.when(ratio != 0, ratio)


def order_suffix(order_id: Column) -> Column:
    return F.regexp_extract(order_id, "(" + "|".join(ORDER_SUFFIXES) + ")$", 1)


def order_time(order_id: Column) -> Column:
    """Time inside ``symbol_yyyymmdd_HHMMSS_SUFFIX``; null where there is none."""
    return F.try_to_timestamp(F.regexp_extract(order_id, r"_(\d{8}_\d{6})_", 1), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def order_id(symbol: Column, ts: Column, suffix: str) -> Column:
    return F.concat_ws("_", symbol, F.date_format(ts, "yyyyMMdd"), F.date_format(ts, "HHmmss"), F.lit(suffix))


def truncate(x: Column, digits: Column | int) -> Column:
    """Toward zero at so many decimals."""
    scale = F.pow(F.lit(10.0), F.lit(digits) if isinstance(digits, int) else digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def next_boundary(ts: Column, minutes: int, delay: int = 5) -> Column:
    """Epoch second of the next bar boundary after ts, and ``delay`` seconds."""
    step = minutes * 60
    return (F.floor(F.unix_seconds(ts.cast("timestamp")) / step) + 1) * step + delay


def ticket(text: Column) -> Column:
    """``type,price,position,stop,op`` as a struct; empty fields are null."""
    part = F.split(text, ",")
    field = lambda i: F.nullif(F.get(part, F.lit(i)), F.lit(""))
    number = lambda i: field(i).try_cast("double")
    return F.struct(field(0).alias("type"), number(1).alias("price"), number(2).alias("position"), number(3).alias("stop"), field(4).alias("op"))


def budget(cash: Column, cap: Column | float, ratio: Column | float = 1.0) -> Column:
    """Cash to stake: min(cap, cash) times ratio, MIN_STAKE at least; 0 where less than that is left."""
    stake = F.least(F.lit(cap) if isinstance(cap, int | float) else cap, cash)
    return F.when(stake < MIN_STAKE, 0.0).otherwise(F.greatest(stake * ratio, F.lit(MIN_STAKE)))


def bracket(avg_cost: Column, hard_cutoff: float, ratio: float, stop_profit: Column) -> Column:
    cutoff = avg_cost * hard_cutoff
    leave = F.greatest(stop_profit, avg_cost * (1 + (1 - hard_cutoff) * ratio))
    return F.struct(cutoff.alias("cutoff"), leave.alias("profit_leave"))


def usd_code(symbol: Column, quote: str = "usdt") -> Column:
    return F.upper(F.regexp_replace(symbol, quote, "-usd"))


def run_label(symbol: Column, interval: str, atr: int, margin: float, cutoff: float) -> Column:
    return F.concat(symbol, F.lit(f"{interval}_atr{atr}_margin{margin}_cut{cutoff}"))
