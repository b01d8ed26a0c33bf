"""Sequential jobs: exponential means, rolling filters, cash replay, fill ledgers, paper accounts.

Every recursion here is a small vectorised or per-row helper for one series; Spark deals the series.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MIN_STAKE
from .chunks import exponential_means, trend_levels, with_halo
from .indicators import prior


def ewm_columns(df: DataFrame, specs: dict[str, tuple[str, float, bool]], keys: tuple = ("symbol",)) -> DataFrame:
    """``df`` with exponential means: name -> (column, alpha, adjust); one pass of each series' chunks for all of them."""
    return exponential_means(df, specs, keys=keys)


def span(n: float) -> float:
    return 2 / (n + 1)


def directional_index(df: DataFrame, p: int) -> DataFrame:
    """Directional movement, smoothed; +DI, -DI, DX, ADX and signed ADX from ``df`` with an ``atr``."""
    up, down = F.col("high") - prior("high"), prior("low") - F.col("low")
    df = df.withColumns({"up_": F.coalesce(F.when(up > down, F.greatest(up, F.lit(0.0))), F.lit(0.0)), "down_": F.coalesce(F.when(down > up, F.greatest(down, F.lit(0.0))), F.lit(0.0))})
    df = ewm_columns(df, {"up_dm": ("up_", 1 / p, False), "down_dm": ("down_", 1 / p, False)})
    df = df.withColumns({"plus_di": F.coalesce(F.try_divide("up_dm", "atr"), F.lit(0.0)), "minus_di": F.coalesce(F.try_divide("down_dm", "atr"), F.lit(0.0))})
    df = df.withColumn("dx", F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    df = ewm_columns(df, {"adx": ("dx", 1 / p, False)})
    return df.withColumn("adx_signed", F.col("adx") * F.signum(F.col("plus_di") - F.col("minus_di"))).drop("up_", "down_")


def rolling_kalman(close, vol, pred, vola, glv, glvola, w: int, q: float = 1e-3, r: float = 1e-3, alpha: float = 0.6, gamma: float = 0.2, beta: float = 0.2) -> np.ndarray:
    """Filtered price at each bar from the w bars up to it, vectorised over bars: the loop is over the window's places.

    A window starts at its first bar with a volatility; without one the close stands.
    """
    n = len(close)
    x, p, before = np.full(n, np.nan), np.ones(n), np.full(n, np.nan)
    rows = np.arange(n)
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(w - 1, -1, -1):
            at = rows - j
            ok = (at >= 0) & ~np.isnan(vola[np.maximum(at, 0)])
            at = np.maximum(at, 0)
            first = ok & np.isnan(x)
            lv = np.log(np.maximum(vol[at], 1e-6))
            ls = np.where(vola[at] > 0, np.log(vola[at]), 0.0)
            noise = r * np.clip(np.exp(-alpha * (lv - glv)), 0.1, 2.0) * np.exp(gamma * (ls - glvola)) * np.exp(-beta * np.abs(close[at] - before))
            pp = p + q
            k = pp / (pp + noise)
            moved = ok & ~first
            x = np.where(first, pred[at], np.where(moved, x + k * (close[at] - x), x))
            p = np.where(moved, (1 - k) * pp, p)
            before = np.where(ok, close[at], before)
    return np.where(np.isnan(x), close, x)


def kalman_price(df: DataFrame, w: int, **options) -> DataFrame:
    """``df`` with ``kalman``, from the columns of ``returns_block``; a bar depends on its last w bars only, so chunks are filtered apart."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [pdf[c].to_numpy(float) for c in ("close", "vol", "pred_price", "volatility", "global_log_vol", "global_log_volatility")]
        return pdf.assign(kalman=rolling_kalman(*cols, w, **options))

    return with_halo(df, w, fill, "kalman double")


def trend_filter(df: DataFrame, q: float = 1e-4, r: float = 1e-2) -> DataFrame:
    """Two-state (level, trend) filter over the observations (ema, wma), from the first full wma."""
    return trend_levels(df, q, r)


def gaussian_regimes(x: np.ndarray, guess: np.ndarray, rounds: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Most likely state path of a two-state Gaussian hidden Markov model with full covariances, fitted from a start labelling."""
    n, d = x.shape
    state = guess.astype(float)
    gamma = np.stack([1 - state, state], 1) * 0.9 + 0.05
    trans, start, before = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), -np.inf
    for _ in range(rounds):
        logb = np.zeros((n, 2))
        for s in (0, 1):
            g = gamma[:, s]
            mean = (g[:, None] * x).sum(0) / g.sum()
            cov = (g[:, None] * (x - mean)).T @ (x - mean) / g.sum() + 1e-3 * np.eye(d)
            diff = x - mean
            logb[:, s] = -0.5 * (np.einsum("ij,ij->i", diff @ np.linalg.inv(cov), diff) + np.linalg.slogdet(cov)[1] + d * np.log(2 * np.pi))
        shift = logb.max(1)
        b = np.exp(logb - shift[:, None]) + 1e-300
        a, c = np.zeros((n, 2)), np.zeros(n)
        a[0] = start * b[0]
        c[0] = a[0].sum()
        a[0] /= c[0]
        for t in range(1, n):
            a[t] = (a[t - 1] @ trans) * b[t]
            c[t] = a[t].sum()
            a[t] /= c[t]
        back, pairs = np.ones((n, 2)), np.zeros((2, 2))
        for t in range(n - 2, -1, -1):
            nxt = b[t + 1] * back[t + 1] / c[t + 1]
            pairs += a[t][:, None] * trans * nxt[None, :]
            back[t] = trans @ nxt
        gamma = a * back
        gamma /= gamma.sum(1, keepdims=True)
        start, trans = gamma[0], pairs / np.maximum(pairs.sum(1, keepdims=True), 1e-12)
        score = float(np.log(c).sum() + shift.sum())
        if abs(score - before) < tol * abs(score):
            break
        before = score
    v, path = np.log(start + 1e-300) + logb[0], np.zeros((n, 2), int)
    for t in range(1, n):
        step = v[:, None] + np.log(trans + 1e-300)
        path[t], v = step.argmax(0), step.max(0) + logb[t]
    out = np.zeros(n, int)
    out[-1] = int(v.argmax())
    for t in range(n - 2, -1, -1):
        out[t] = path[t + 1, out[t + 1]]
    return out


def regimes(df: DataFrame, features: list[str], slope: str = "slope") -> DataFrame:
    """``df`` with ``up``: the state whose median slope is larger. Each symbol's model starts from a median split of its slope
    and is fitted to its whole series, so a bar's state looks ahead."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        known = pdf[features].notna().all(axis=1) & pdf[slope].notna()
        up = np.zeros(len(pdf), bool)
        if known.sum() > 10:
            x, s = pdf.loc[known, features].to_numpy(float), pdf.loc[known, slope].to_numpy(float)
            labels = gaussian_regimes(x, s > np.median(s))
            if 0 < labels.sum() < len(labels):
                high = int(np.median(s[labels == 1]) > np.median(s[labels == 0]))
                up[known.to_numpy()] = labels == high
        return pdf.assign(up=up)

    return df.groupBy("symbol").applyInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", up boolean")


def cash_replay(df: DataFrame, fund: float = 1000.0, most: float = 1000.0, compat: bool = False) -> DataFrame:
    """(symbol, ts, income, invested, fund) of a cash account over signal rows (ts, profit, matured, time_cost, kelly).

    Stakes whose exit is known pay out at maturity; those still due after the last row pay in a row of their own, at the
    last of their maturities; a stake without one is not invested (``compat``: it is, and lost when
    time_cost is 0). Pay-outs wait in a heap; rows are one per signal bar.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        cash, due, rows = fund, [], []
        for ts, profit, matured, cost, kelly in pdf[["ts", "profit", "matured", "time_cost", "kelly"]].itertuples(index=False):
            income = 0.0
            while due and due[0][0] <= ts:
                income += heapq.heappop(due)[1]
            cash += income
            known = not pd.isna(matured) and not pd.isna(profit) and (cost > 0 if compat else True)
            stake = min(most, cash) * kelly if cash >= 10 and kelly > 0 and (known or compat) else 0.0
            if stake and known:
                heapq.heappush(due, (matured, stake * (1 + profit)))
            cash -= stake
            rows.append((ts, income, stake, cash))
        if due:
            left = sum(p for _, p in due)
            rows.append((max(m for m, _ in due), left, 0.0, cash + left))
        out = pd.DataFrame(rows, columns=["ts", "income", "invested", "fund"])
        return out.assign(symbol=pdf["symbol"].iloc[0])[["symbol", "ts", "income", "invested", "fund"]]

    cols = ["symbol", "ts", "profit", "matured", "time_cost", "kelly"]
    return df.select(cols).groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, income double, invested double, fund double")


def net_fills(fills: DataFrame) -> DataFrame:
    """Fills that moved something: side, net position and price. Fees are coins on buys and cash on sells."""
    side = F.when(F.col("type").isin("buy-limit", "buy-stop-limit", "buy-market"), "buy").when(F.col("type").isin("sell-limit", "sell-stop-limit"), "sell")
    kept = fills.filter(F.col("state").isin("filled", "partial-canceled", "partial-filled")).withColumn("side", side)
    buy = F.col("side") == "buy"
    position = F.when(buy, F.col("amount") - F.col("fees")).otherwise(F.col("amount"))
    return kept.withColumn("position", position).withColumn("price", F.try_divide(F.when(buy, F.col("cash")).otherwise(F.col("cash") - F.col("fees")), F.col("position")))


def fill_step(held: float, avg: float, cash: float, buy: bool, position: float, price: float) -> tuple[float, float, float, float]:
    """(held, average cost, cash, realised profit) after a fill; the average changes on buys only, sells never go short."""
    if buy:
        return held + position, (avg * held + position * price) / (held + position), cash - position * price, float("nan")
    sold = min(position, held)
    return held - sold, avg, cash + sold * price, price / avg - 1 if sold > 0 else float("nan")


def fill_ledger(fills: DataFrame, keys: tuple = ("symbol",), order: str = "seq") -> DataFrame:
    """Running position, average cost, cash and realised profit of each symbol's fills in order.

    One shuffle by the keys and one sort; the fold runs down each sorted partition batch by batch, whatever the number of
    series and the length of one.
    """
    cols = [*keys, "side", "position", "price", "time"]
    kinds = dict(fills.select(cols).dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", rn int, held double, avg_cost double, profit double, cash double"

    def run(batches):
        key, now, rn = None, (0.0, 0.0, 0.0), 0
        for batch in batches:
            held, avg, cash, profit, place = ([] for _ in range(5))
            table = [batch.column(c).to_pylist() for c in (*keys, "side", "position", "price")]
            for *k, side, position, price in zip(*table, strict=True):
                if k != key:
                    key, now, rn = k, (0.0, 0.0, 0.0), 0
                rn += 1
                *now, gained = fill_step(*now, side == "buy", position, price)
                held.append(now[0])
                avg.append(now[1])
                cash.append(now[2])
                profit.append(None if gained != gained else gained)
                place.append(rn)
            got = [pa.array(place, pa.int32()), *[pa.array(x, pa.float64()) for x in (held, avg, profit, cash)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], *got], [*cols, "rn", "held", "avg_cost", "profit", "cash"])

    dealt = fills.repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.select(cols).mapInArrow(run, schema)


#: A buy is refused where its price is not this many times the price at which it would leave.
ROOM = 1.002

STATE = {"cash": 1000.0, "position": 0.0, "avg_cost": 0.0, "cutoff": 0.0, "atr_exit": 0.0, "leave": 0.0, "target": 0.0}


def opens(state: dict, bar: dict, hard_cutoff: float) -> bool:
    """Whether a bar may set a buy: a signal, no position, no hold, cash for the least stake, and room above where it would leave."""
    leave, cutoff = bar["exit_price"], state["avg_cost"] * hard_cutoff
    if not bar["buy_signal"] or bar["hold"] or state["position"] > 0 or state["cash"] <= MIN_STAKE or leave is None or leave != leave:
        return False
    leave = min(leave, cutoff) or leave
    return leave != 0 and bar["close"] / leave >= ROOM


def account_step(state: dict, bar: dict, cap: float, hard_cutoff: float, ratio: float, bet: float = 1.0) -> tuple[dict, str | None, float | None]:
    """One bar of a paper account: match the sell, then the buy, that earlier bars set; then set orders from this bar.

    A sell leaves at the cutoff, then the range exit, then the profit price. A buy stakes ``bet`` of the lesser of cap and
    cash, the least stake at least. A null ``hold`` holds nothing. Returns the new state, and the order that was filled
    with its price. The batch job and the stream share this function.
    """
    s, done, price = dict(state), None, None
    if s["position"] > 0:
        if bar["low"] <= s["cutoff"]:
            done, price = "CUTOFF", s["cutoff"]
        elif bar["low"] <= s["atr_exit"]:
            done, price = "ATR_EXIT", s["atr_exit"]
        elif bar["high"] >= s["leave"] > 0:
            done, price = "PROFIT_LEAVE", s["leave"]
        if done:
            s["cash"] += s["position"] * price
            s["position"], s["target"] = 0.0, 0.0
    elif s["target"] > 0 and s["atr_exit"] < bar["low"] <= s["target"]:
        stake = min(cap, s["cash"])
        if stake >= MIN_STAKE:
            done, price, stake = "BUY", s["target"], max(stake * bet, MIN_STAKE)
            s["position"], s["avg_cost"], s["cash"] = stake / price, price, s["cash"] - stake
    exit_price = bar["exit_price"]
    if exit_price is not None and exit_price == exit_price:
        s["atr_exit"] = exit_price
    if s["position"] > 0:
        s["cutoff"] = s["avg_cost"] * hard_cutoff
        s["leave"] = max(bar["take_profit"] if bar["take_profit"] is not None and bar["take_profit"] == bar["take_profit"] else 0.0, s["avg_cost"] * (1 + (1 - hard_cutoff) * ratio))
    s["target"] = bar["close"] if opens(s, bar, hard_cutoff) else 0.0
    return s, done, price


def paper_account(df: DataFrame, cap: float = 100.0, hard_cutoff: float = 0.9, ratio: float = 2.0, bet: float = 1.0) -> DataFrame:
    """(symbol, ts, reason, price, cash, position, avg_cost) after each bar, one account per symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = dict(STATE), []
        for bar in pdf.sort_values("ts").to_dict("records"):
            state, done, price = account_step(state, bar, cap, hard_cutoff, ratio, bet)
            rows.append((bar["symbol"], bar["ts"], done, price, state["cash"], state["position"], state["avg_cost"]))
        return pd.DataFrame(rows, columns=["symbol", "ts", "reason", "price", "cash", "position", "avg_cost"]).astype({"price": float})

    cols = ["symbol", "ts", "high", "low", "close", "exit_price", "take_profit", "buy_signal", "hold"]
    out = df.select(cols).groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, reason string, price double, cash double, position double, avg_cost double")
    return out.withColumn("price", F.when(~F.isnan("price"), F.col("price")))


def haar_last(x: np.ndarray, levels: int = 4) -> float:
    """Last value of the Haar approximation at ``levels`` of a short window."""
    x = np.asarray(x, float)
    for _ in range(levels):
        if len(x) % 2:
            x = np.append(x, x[-1])
        x = (x[::2] + x[1::2]) / 2
    return float(x[-1])


def haar_smooth(df: DataFrame, n: int = 14, levels: int = 4) -> DataFrame:
    """``haar``: the approximation of the last n closes, its last value."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["close"].to_numpy(float)
        out = np.full(len(c), np.nan)
        if len(c) >= n:
            view = np.lib.stride_tricks.sliding_window_view(c, n)
            for _ in range(levels):
                if view.shape[1] % 2:
                    view = np.concatenate([view, view[:, -1:]], axis=1)
                view = (view[:, ::2] + view[:, 1::2]) / 2
            out[n - 1 :] = view[:, -1]
        return pdf.assign(haar=out)

    return with_halo(df, n, fill, "haar double").withColumn("haar", F.when(~F.isnan("haar"), F.col("haar")))
