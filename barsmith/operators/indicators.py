"""Price and volume indicators as window expressions over (symbol, ts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEYS = ("symbol",)


def series(keys: tuple = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts")


def rolling(agg, x: Column, n: int, least: int | None = None, lagged: bool = False, keys: tuple = KEYS) -> Column:
    """``agg`` over the last n bars (lagged: the n bars before), null below ``least`` values (n unless given)."""
    frame = series(keys).rowsBetween(-n, -1) if lagged else series(keys).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def prior(x: Column | str, k: int = 1, keys: tuple = KEYS) -> Column:
    return F.lag(x, k).over(series(keys))


def yes(condition: Column) -> Column:
    """A comparison with null is false."""
    return F.coalesce(condition, F.lit(False))


def donchian(df: DataFrame, upper: int, lower: int, source: str = "range", keys: tuple = KEYS) -> DataFrame:
    """turtle_h, turtle_l: highest high and lowest low (or close) of the bars before."""
    hi, lo = ("high", "low") if source == "range" else ("close", "close")
    return df.withColumns({"turtle_h": rolling(F.max, F.col(hi), upper, lagged=True, keys=keys), "turtle_l": rolling(F.min, F.col(lo), lower, lagged=True, keys=keys)})


def average_true_range(df: DataFrame, n: int, keys: tuple = KEYS) -> DataFrame:
    before = prior("close", keys=keys)
    df = df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(before - F.col("high")), F.abs(before - F.col("low"))))
    return df.withColumns({"atr": rolling(F.avg, F.col("tr"), n, keys=keys), "atr_std": rolling(F.stddev_samp, F.col("tr"), n, keys=keys)})


def trailing_stop(df: DataFrame, margin: float, price: str = "close", keys: tuple = KEYS) -> DataFrame:
    """exit_price from the bar before; channel_exit is that or the channel's low, whichever is higher."""
    stop = prior(price, keys=keys) - prior("atr", keys=keys) * margin
    df = df.withColumn("exit_price", stop)
    return df.withColumn("channel_exit", F.greatest("turtle_l", "exit_price")) if "turtle_l" in df.columns else df


def take_profit(df: DataFrame, n: int, level: float) -> DataFrame:
    """Mean of the last n highs and ``level`` deviations; trailing, so no bar sees later ones."""
    return df.withColumn("take_profit", rolling(F.avg, F.col("high"), n) + level * rolling(F.stddev_samp, F.col("high"), n))


def breakout(df: DataFrame, price: str = "high") -> DataFrame:
    return df.withColumn("buy_signal", yes(F.col(price) > F.col("turtle_h")))


def turtle(df: DataFrame, atr: int = 10, upper: int = 10, lower: int = 10, margin: float = 1.5, keys: tuple = KEYS) -> DataFrame:
    """Channel, range, trailing stop and breakout: one shuffle by the keys, one sort."""
    return breakout(trailing_stop(average_true_range(donchian(df, upper, lower, keys=keys), atr, keys), margin, keys=keys))


def _signed_volume(df: DataFrame) -> DataFrame:
    sign = F.coalesce(F.signum(F.col("close") - prior("close")), F.lit(0.0))
    return df.withColumn("obv", F.sum(sign * F.col("vol")).over(series().rowsBetween(Window.unboundedPreceding, 0)))


def on_balance_volume(df: DataFrame, n: int, m: float, upper: int | None = None, lower: int | None = None) -> DataFrame:
    """Signed volume summed up and its band of m deviations; price_up and price_low: high and low against the closes' bands.

    obv_up: the sum is over its band, the bar before was not over the band of now, and price_low holds.
    """
    df = _signed_volume(df)
    mean, dev = rolling(F.avg, F.col("obv"), n), rolling(F.stddev_samp, F.col("obv"), n)
    df = df.withColumns({"obv_ma": mean, "obv_upper": mean + m * dev, "obv_lower": mean - m * dev})
    band = lambda k: rolling(F.avg, F.col("close"), k) + m * rolling(F.stddev_samp, F.col("close"), k)
    up, low = upper or n, lower or n
    share = F.try_divide(rolling(F.stddev_samp, F.col("close"), up), rolling(F.avg, F.col("close"), up)) * 100
    df = df.withColumns({"bound_diff": F.try_divide(F.col("obv_upper") - F.col("obv_lower"), "obv_ma"), "rolling_std": share, "price_up": yes(F.col("high") >= band(up)), "price_low": yes(F.col("low") <= band(low))})
    return df.withColumn("obv_up", yes((F.col("obv") > F.col("obv_upper")) & (prior("obv") <= F.col("obv_upper")) & F.col("price_low")))


def volume_cross(df: DataFrame, n: int = 60, m: float = 3.0, least: float = 0.05) -> DataFrame:
    """The summed volume leaves its band upward or downward while the band is over ``least`` wide relative to its mean."""
    df = _signed_volume(df)
    mean, dev = rolling(F.avg, F.col("obv"), n), rolling(F.stddev_samp, F.col("obv"), n)
    df = df.withColumns({"obv_upper": mean + m * dev, "obv_lower": mean - m * dev, "bound_diff": 1 - F.try_divide(mean + m * dev, mean)})
    wide = F.col("bound_diff") > least
    return df.withColumns({"upper_cross": yes((F.col("obv") > F.col("obv_upper")) & (prior("obv") <= F.col("obv_upper")) & wide), "lower_cross": yes((F.col("obv") < F.col("obv_lower")) & (prior("obv") >= F.col("obv_lower")) & wide)})


def volume_weighted(df: DataFrame, n: int) -> DataFrame:
    turnover = rolling(F.sum, F.col("close") * F.col("vol"), n)
    df = df.withColumn("vwma", F.try_divide(turnover, rolling(F.sum, F.col("vol"), n)))
    df = df.withColumn("slope", (F.col("close") - prior("vwma", n)) / n)
    return df.withColumn("slope_diff", F.col("slope") - prior("slope"))


def dip_plan(df: DataFrame, n: int = 30, bands: tuple = (3, 5, 7, 9), pays: tuple = (12.5, 12.5, 25.0, 50.0)) -> DataFrame:
    """Lagged bands below the mean; each pays its share when the low reaches it; units bought, total paid, average cost."""
    mean, dev = rolling(F.avg, F.col("close"), n, lagged=True), rolling(F.stddev_samp, F.col("close"), n, lagged=True)
    levels = [f"band_{i}" for i in range(len(bands))]
    df = df.withColumns({name: mean - b * dev for name, b in zip(levels, bands, strict=True)})
    hit = [F.when(yes((F.col("low") <= F.col(x)) & (F.col(x) > 0)), 1.0).otherwise(0.0) for x in levels]
    paid = reduce(lambda a, c: a + c, [h * p for h, p in zip(hit, pays, strict=True)])
    units = reduce(lambda a, c: a + c, [F.coalesce(F.try_divide(h * p, F.col(x)), F.lit(0.0)) for h, x, p in zip(hit, levels, pays, strict=True)])
    df = df.withColumns({"paid": paid, "units": units})
    return df.withColumn("avg_cost", F.when(F.col("units") > 0, F.col("paid") / F.col("units")))


def band_count(df: DataFrame, n: int, grade: int, levels: int = 10) -> DataFrame:
    """How many of the deviations 1..levels the price pierces below (bbl) and above (bbh); signal where bbh is over ``grade``."""
    mean, dev = rolling(F.avg, F.col("close"), n, lagged=True), rolling(F.stddev_samp, F.col("close"), n, lagged=True)
    df = df.withColumns({"mean_": mean, "dev_": dev})
    count = lambda f: reduce(lambda a, c: a + c, [yes(f(i)).cast("int") for i in range(1, levels + 1)])
    df = df.withColumns({"bbl": count(lambda i: F.col("low") < F.col("mean_") - i * F.col("dev_")), "bbh": count(lambda i: F.col("high") > F.col("mean_") + i * F.col("dev_"))})
    return df.withColumn("band_signal", F.col("bbh") > grade).drop("mean_", "dev_")


def run_lengths(df: DataFrame, flag: str, name: str) -> DataFrame:
    """``name``: bars for which ``flag`` has held in a row, 0 where it does not."""
    change = (F.col(flag) != F.coalesce(F.lag(flag).over(series()), ~F.col(flag))).cast("int")
    df = df.withColumn("run_", F.sum(change).over(series().rowsBetween(Window.unboundedPreceding, 0)))
    held = F.row_number().over(Window.partitionBy("symbol", "run_").orderBy("ts"))
    return df.withColumn(name, F.when(F.col(flag), held).otherwise(0)).drop("run_")


def win_rate_trend(df: DataFrame, n: int = 60) -> DataFrame:
    win = yes(F.col("profit") > 0).cast("double")
    return df.withColumn("win_rate", rolling(F.avg, win, n, least=1))


def average_cumulative_return(df: DataFrame) -> DataFrame:
    """(ts, mean_return): mean over symbols of growth since their first bar, on times where every symbol has one.

    A symbol keeps its growth until its next bar, so the sum over symbols changes by each bar's change of growth: the
    changes are summed by time, and only those sums, a row per time, run in one order. No symbol meets times it has no bar at.
    """
    close = F.last("close", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("close", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    grown = df.select("symbol", "ts", (close / first - 1).alias("growth"))
    grown = grown.withColumns({"change": F.col("growth") - F.coalesce(prior("growth"), F.lit(0.0)), "fresh": (F.col("growth").isNotNull() & prior("growth").isNull()).cast("int")})
    by_time = grown.groupBy("ts").agg(F.sum("change").alias("change"), F.sum("fresh").alias("fresh"), F.count("growth").alias("bars"))
    upto = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    symbols = F.broadcast(df.agg(F.count_distinct("symbol").alias("symbols")))  # one row
    summed = by_time.withColumns({"total": F.sum("change").over(upto), "present": F.sum("fresh").over(upto)}).crossJoin(symbols)
    return summed.filter("present = symbols").select("ts", (F.col("total") / F.col("symbols")).alias("mean_return"))


def trade_periods(df: DataFrame, buy: str, sell: str, least: int = 3) -> DataFrame:
    """(symbol, period, start, stop, bars): from the first buy bar after the last sell to the next sell bar, over ``least`` bars."""
    ended = F.coalesce(F.sum(F.col(sell).cast("int")).over(series().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("period", ended)
    start = F.min(F.when(F.col(buy), F.col("ts"))).over(Window.partitionBy("symbol", "period"))
    df = df.withColumn("start", start).filter(F.col("ts") >= F.col("start"))
    done = df.groupBy("symbol", "period").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("bars"), F.max(F.col(sell).cast("int")).alias("sold"))
    return done.filter((F.col("sold") == 1) & (F.col("bars") > least)).drop("sold")


def mean_reversion(df: DataFrame, a: int, b: int, z: int) -> DataFrame:
    df = df.withColumn("gap_", rolling(F.avg, F.col("close"), a) - rolling(F.avg, F.col("close"), b))
    return df.withColumn("reversion", F.try_divide(F.col("gap_") - rolling(F.avg, F.col("gap_"), z), rolling(F.stddev_samp, F.col("close"), z))).drop("gap_")


def returns_block(df: DataFrame, n: int) -> DataFrame:
    """Log return, drift, volatility, predicted price, and the rolling means of log volume and log volatility."""
    df = df.withColumn("log_return", F.log(F.col("close") / prior("close")))
    df = df.withColumns({"drift": rolling(F.avg, F.col("log_return"), n, least=1), "volatility": rolling(F.stddev_samp, F.col("log_return"), n, least=1)})
    df = df.withColumn("pred_price", F.col("close") * F.exp("drift"))
    log = lambda c: F.when(F.col(c) > 0, F.log(c))
    return df.withColumns({"global_log_vol": rolling(F.avg, log("vol"), n, least=1), "global_log_volatility": rolling(F.avg, log("volatility"), n, least=1)})


def local_slope(df: DataFrame, w: int, price: str = "kalman", eps: float = 1e-8) -> DataFrame:
    low = F.min(price).over(series().rowsBetween(-(2 * w) - 1, -2))
    return df.withColumn("local_low", low).withColumn("slope", (F.col(price) - F.col("local_low") + eps) / (2 * w))


def regime_features(df: DataFrame, n: int = 60, least: int = 5, eps: float = 1e-8, causal: bool = False) -> DataFrame:
    """Standardised return of the filtered price over its trailing mean, that return's mean, relative volume and slope.

    Leading nulls are filled backward and scores are over the whole series; ``causal``: no filling, scores so far.
    """
    base = rolling(F.avg, F.col("kalman"), n, least=least, lagged=True)
    df = df.withColumn("kreturn", F.log(F.col("kalman") / base + eps))
    df = df.withColumns({"kreturn_vol": rolling(F.avg, F.col("kreturn"), n, least=least), "rvolume": F.log(F.col("vol") / rolling(F.avg, F.col("vol"), n, least=least) + eps)})
    back = Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    names = ["kreturn", "kreturn_vol", "rvolume", "slope"]
    whole = series().rowsBetween(Window.unboundedPreceding, 0) if causal else Window.partitionBy("symbol")
    if not causal:
        df = df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in names})
    return df.withColumns({f"{c}_z": F.try_divide(F.col(c) - F.avg(c).over(whole), F.stddev_pop(c).over(whole)) for c in names})


def dynamic_stop(df: DataFrame, n: int, least_margin: float = 0.1, most: float = 2.0, up: str | None = None) -> DataFrame:
    """Exit below the filtered price: the margin grows as the slope falls between its trailing 5 % and 50 % quantiles."""
    frame = series().rowsBetween(-(n - 1), 0)
    q = F.percentile("slope", [0.05, 0.5]).over(frame)
    df = df.withColumn("q_", q)
    lo, hi = F.get("q_", F.lit(0)), F.get("q_", F.lit(1))
    clipped = F.least(F.greatest("slope", lo), hi)
    margin = least_margin + F.coalesce(F.try_divide(clipped - lo, hi - lo), F.lit(0.0)) * (most - least_margin)
    margin = F.when(F.col(up), most).otherwise(margin) if up else margin
    df = df.withColumn("margin", margin)
    return df.withColumn("exit_price", prior("kalman") - prior("atr") * F.col("margin")).drop("q_")


def surprise(df: DataFrame, n: int, noise: float = 0.1) -> DataFrame:
    """Prediction of price and volume from the n bars before, corrected by a gain; the bar's surprise."""
    out = {}
    for x in ("close", "vol"):
        out[f"{x}_mean"] = rolling(F.avg, F.col(x), n, lagged=True)
        out[f"{x}_std"] = rolling(F.stddev_samp, F.col(x), n, lagged=True)
    df = df.withColumns(out)
    for x in ("close", "vol"):
        error = F.col(x) - F.col(f"{x}_mean")
        gain = F.try_divide(F.pow(f"{x}_std", 2), F.pow(f"{x}_std", 2) + F.pow(error, 2))
        df = df.withColumns({f"{x}_updated": F.col(f"{x}_mean") + gain * error, f"{x}_term": F.try_divide(F.pow(error, 2), 2 * F.pow(f"{x}_std", 2))})
    spread = F.when((F.col("close_std") > 0) & (F.col("vol_std") > 0), 0.5 * F.log(2 * F.lit(3.141592653589793) * F.col("close_std") * F.col("vol_std")))
    return df.withColumn("surprise", F.col("close_term") + F.col("vol_term") + spread)


def acceleration(df: DataFrame) -> DataFrame:
    for x in ("close", "vol"):
        df = df.withColumn(f"{x}_speed", F.col(x) - prior(x)).withColumn(f"{x}_acc", F.col(f"{x}_speed") - prior(f"{x}_speed"))
    return df


def ribbon(df: DataFrame, n: int, k: float) -> DataFrame:
    mean, dev = rolling(F.avg, F.col("close"), n), rolling(F.stddev_pop, F.col("close"), n)
    return df.withColumns({"mid": mean, "top": mean + k * dev, "bottom": mean - k * dev})


def hysteresis(df: DataFrame, n: int = 5, causal: bool = False, fund: float = 1000.0) -> DataFrame:
    """Hold from a close two deviations below its mean until one above; the deviation is over the whole series (``causal``: so far).

    ``gain``: at an exit, the close less that of four bars before; ``capital``: ``fund`` compounded by gains over entry prices.
    """
    df = df.withColumn("gap", F.col("close") - rolling(F.avg, F.col("close"), n))
    dev = F.stddev_pop("gap").over(series().rowsBetween(Window.unboundedPreceding, 0) if causal else Window.partitionBy("symbol"))
    event = F.when(F.col("gap") < -2 * dev, 1).when(F.col("gap") > dev, 0)
    df = df.withColumn("event_", event)
    held = F.coalesce(F.last("event_", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    df = df.withColumn("holding", held).drop("event_")
    left = (F.coalesce(prior("holding"), F.lit(0)) == 1) & (F.col("holding") == 0)
    df = df.withColumns({"entered": (F.coalesce(prior("holding"), F.lit(0)) == 0) & (F.col("holding") == 1), "left": left, "gain": F.when(left, F.col("close") - prior("close", 4))})
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("growth_", 1 + F.col("gain") / F.last(F.when(F.col("entered"), F.col("close")), ignorenulls=True).over(upto))
    return df.withColumn("capital", fund * F.coalesce(F.product("growth_").over(upto), F.lit(1.0))).drop("growth_")


def weighted_mean(df: DataFrame, n: int = 10) -> DataFrame:
    total = reduce(lambda a, c: a + c, [(n - i) * (F.col("close") if i == 0 else prior("close", i)) for i in range(n)])
    return df.withColumn("wma", total / (n * (n + 1) / 2))


def volatility_plan(df: DataFrame, n: int, plan: list[tuple[str, int, float]], profit: Column, ring: int = 10) -> DataFrame:
    """(symbol, ts, action, level, ratio, price): each bar's plan where its deviation is at least the median of the last
    ``ring`` ones, none elsewhere. Buys (B) stand ``level`` deviations from the mean, sells (S) from ``profit``, the least price
    that pays."""
    df = df.withColumns({"mean": rolling(F.avg, F.col("close"), n), "std": rolling(F.stddev_samp, F.col("close"), n), "profit_": profit})
    median = F.percentile("std", 0.5).over(series().rowsBetween(-(ring - 1), 0))
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(lv).alias("level"), F.lit(x).alias("ratio")) for a, lv, x in plan])
    df = df.withColumn("median_", median).filter("std >= median_").withColumn("p", F.explode(rows))
    base = F.when(F.col("p.action") == "S", F.col("profit_")).otherwise(F.col("mean"))
    return df.select("symbol", "ts", "p.action", "p.level", "p.ratio", (base + F.col("p.level") * F.col("std")).alias("price"))


def missing_bars(df: DataFrame, seconds: int) -> DataFrame:
    """Bars that come more than one interval after the one before, and how many are missing."""
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(prior("ts").cast("timestamp"))
    return df.withColumn("gap", gap).filter(F.col("gap") > seconds).withColumn("missing", (F.col("gap") / seconds).cast("long") - 1)


def volume_hold(df: DataFrame, hours: int = 18, least: float = 0.6, causal: bool = False) -> DataFrame:
    """``day_vol``, the volume of the last hours, and ``hold``, true where it is under ``least`` of the symbol's mean of it
    (``causal``: of its mean so far)."""
    last = Window.partitionBy("symbol").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-hours * 3600, 0)
    df = df.withColumn("day_vol", F.sum("vol").over(last))
    whole = series().rowsBetween(Window.unboundedPreceding, 0) if causal else Window.partitionBy("symbol")
    return df.withColumn("hold", F.col("day_vol") / F.avg("day_vol").over(whole) < least)
