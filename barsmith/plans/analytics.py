"""Queries over distributions and reviews (A), range joins (J), folds (G), streams (T) and registries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as Fn
from ..operators import accounts as A
from ..operators import distributions as D
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import quantiles as Q
from ..operators import regimes as R
from ..operators import reviews as V
from ..operators import signals as S
from ..operators import wavelets
from ..sources import tables as T
from ..streaming import bars as B
from ..streaming import late as N
from .records import NET
from .registry import BY, CANDLES, LABELS, TURTLE, q, query, r, roll, rounded
from .windows import ACCELERATION, FILTERED, RECURSIVE, adjusted_sql, filtered, labels, turtle

KNOWN = f"{LABELS}, known as (select * from labels where profit is not null)"


@query("a1_signal_scan", f"{TURTLE}, n as (select *, row_number() over (partition by symbol order by ts desc) as rn from turtle) select symbol, count(*) filter (buy_signal) as signals, arg_max(buy_signal, ts) as latest, bool_or(buy_signal and rn <= 10) as recent from n group by symbol")
def a1(spark, sf):
    return V.signal_scan(turtle(spark, sf), "buy_signal", 10)


PORTFOLIO = "with p as (select cast(p_partkey as varchar) as symbol, p_retailprice * (0.8 + p_size / 100.0) as value, p_retailprice as cost, (p_size - 25) / 100.0 as change from part)"


@query(
    "a2_portfolio_total",
    f"""{PORTFOLIO}, d as (select symbol, value, cost, value - cost as pl, value / cost * 100 - 100 as pl_pct, change * 100 as change_pct from p
    union all select 'TOTAL', sum(value), sum(cost), sum(value) - sum(cost), sum(value) / sum(cost) * 100 - 100, avg(change) * 100 from p)
    select symbol, {q("value", "value", 4)}, {q("cost", "cost", 4)}, {q("pl", "pl", 4)}, {q("pl_pct", "pl_pct", 4)}, {q("change_pct", "change_pct", 4)} from d""",
)
def a2(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_retailprice") * (0.8 + F.col("p_size") / 100.0)).alias("value"), F.col("p_retailprice").alias("cost"), ((F.col("p_size") - 25) / 100.0).alias("change"))
    return V.portfolio_total(p).select("symbol", *[r(c, 4).alias(c) for c in ("value", "cost", "pl", "pl_pct", "change_pct")])


@query(
    "a3_performance",
    f"""{KNOWN} select symbol, count(*) as trades, {q("avg(profit)", "mean")}, {q("sum(profit)", "total")}, {q("stddev_samp(profit)", "std")}, {q("min(profit)", "worst")}, {q("avg(case when profit > 0 then 1.0 else 0.0 end)", "win_rate")},
    {q("avg(profit) / nullif(stddev_samp(profit), 0)", "sharpe", 4)}, {q("avg(profit) / nullif(stddev_samp(case when profit < 0 then profit end), 0)", "sortino", 4)} from known where buy_signal group by symbol""",
)
def a3(spark, sf):
    df = V.performance(labels(spark, sf).filter("buy_signal"))
    return df.select("symbol", "trades", *[r(c).alias(c) for c in ("mean", "total", "std", "worst", "win_rate")], r("sharpe", 4).alias("sharpe"), r("sortino", 4).alias("sortino"))


@query("a4_time_weighted_return", f"{KNOWN} select symbol, {q('sum(pow(1 + profit, 1.0 / time_cost) * time_cost) / sum(time_cost) - 1', 'weighted_return')} from known where time_cost > 0 group by symbol")
def a4(spark, sf):
    return rounded(V.time_weighted_return(labels(spark, sf)), "symbol", weighted_return="weighted_return")


@query(
    "a5_annual_return",
    f"""{LABELS}, g as (select symbol, (epoch(max(ts)) - epoch(min(ts))) / 60 / 525600 as years, sum(case when buy_signal then 1 else 0 end) as trades, stddev_samp(case when buy_signal and profit < 0.0419 then profit end) as downside,
    1 + sum(coalesce(case when buy_signal then 0.01 end * profit, 0)) as growth from labels group by symbol)
    select symbol, cast(trades as bigint) as trades, {q("ln(growth) / years", "log_growth", 4)}, {q("(ln(growth) / years - 0.0419) / nullif(downside * sqrt(trades / years), 0)", "risk_ratio", 3)} from g""",
)
def a5(spark, sf):
    df = V.annual_return(labels(spark, sf).withColumn("bet", F.when(F.col("buy_signal"), 0.01).otherwise(0.0)))
    return df.select("symbol", "trades", r("log_growth", 4).alias("log_growth"), r("risk_ratio", 3).alias("risk_ratio"))


@query(
    "a6_mission_review",
    f"""{LABELS} select symbol, count(profit) as sample, {q("quantile_cont(case when profit > 0 then profit end, 0.5)", "median_gain")}, {q("quantile_cont(case when profit <= 0 then profit end, 0.5)", "median_loss")},
    {q("(count(*) filter (pl > 3 and buy_signal))::double / nullif(count(*) filter (pl > 3), 0)", "captured")}, {q("min(profit)", "worst")}, {q("avg(profit)", "mean")} from labels group by symbol""",
)
def a6(spark, sf):
    return rounded(V.mission_review(labels(spark, sf)), "symbol", "sample", **{c: c for c in ("median_gain", "median_loss", "captured", "worst", "mean")})


REASONS = ("CUTOFF", "ATR_PROFIT", "ATR_LOSS", "PROFIT_LEAVE")


@query(
    "a7_exit_reasons",
    f"""{KNOWN}, x as (select symbol, case when profit <= -0.5 then 'CUTOFF' when profit >= 0.5 then 'PROFIT_LEAVE' when profit > 0 then 'ATR_PROFIT' else 'ATR_LOSS' end as reason from known)
    select symbol, {", ".join(f"(count(*) filter (reason = '{x}'))::double / count(*) as {x.lower()}" for x in REASONS)} from x group by symbol""",
)
def a7(spark, sf):
    p = F.col("profit")
    reason = F.when(p <= -0.5, "CUTOFF").when(p >= 0.5, "PROFIT_LEAVE").when(p > 0, "ATR_PROFIT").when(p.isNotNull(), "ATR_LOSS")
    return V.exit_reasons(labels(spark, sf).withColumn("reason", reason), REASONS)


@query("a8_mass_function", f"{KNOWN}, c as (select symbol, round(profit, 2) + 0.0 as profit, count(*) as n from known group by 1, 2) select symbol, profit, {q('n / sum(n) over (partition by symbol)', 'pmf')}, {q('sum(n) over (partition by symbol order by profit) / sum(n) over (partition by symbol)', 'cdf')} from c")
def a8(spark, sf):
    return rounded(D.mass_function(labels(spark, sf), digits=2), "symbol", profit="profit", pmf="pmf", cdf="cdf")


@query("a9_win_probability", f"{KNOWN} select symbol, {q('avg(case when profit <= 0 then 1.0 else 0.0 end)', 'p_loss')}, {q('1 - avg(case when profit <= 0 then 1.0 else 0.0 end)', 'p_win')} from known group by symbol")
def a9(spark, sf):
    return rounded(D.win_probability(labels(spark, sf).filter("profit is not null")), "symbol", p_loss="p_loss", p_win="p_win")


@query("a10_credible_interval", f"{KNOWN} select symbol, {q('quantile_disc(profit, 0.05)', 'lower')}, {q('quantile_disc(profit, 0.95)', 'upper')}, {q('abs(quantile_disc(profit, 0.05))', 'loss_margin')} from known group by symbol")
def a10(spark, sf):
    return rounded(D.credible_interval(labels(spark, sf).filter("profit is not null")), "symbol", lower="lower", upper="upper", loss_margin="loss_margin")


LAST = "over (partition by symbol order by matured, ts rows between 899 preceding and current row)"


@query("a10_rolling_interval", f"{KNOWN} select symbol, ts, matured, {q(f'quantile_disc(profit, 0.05) {LAST}', 'lower')}, {q(f'quantile_disc(profit, 0.95) {LAST}', 'upper')}, {q(f'abs(quantile_disc(profit, 0.05) {LAST})', 'loss_margin')} from known")
def a10_rolling(spark, sf):
    """The interval of the last 900 profits that had matured when each one did."""
    known = labels(spark, sf).select("symbol", "ts", "matured", "profit")
    return rounded(Q.rolling_credible_interval(known, 900), "symbol", "ts", "matured", lower="lower", upper="upper", loss_margin="loss_margin")


@query("a11_profit_margin", f"{KNOWN}, c as (select symbol, round(profit, 1) as value, count(*) as n from known where profit > 0 group by 1, 2) select symbol, value as profit_margin, n as times from c qualify row_number() over (partition by symbol order by n desc, value) = 1")
def a11(spark, sf):
    return D.profit_margin(labels(spark, sf), digits=1)


LIKE = "1 / (1 + exp(-(count(*) - 3)))"


@query("a12_likelihood", f"{KNOWN} select symbol, count(*) as n, {q(f'{LIKE} * (1 - avg(case when profit <= 0 then 1.0 else 0.0 end)) / avg(case when profit <= 0 then 1.0 else 0.0 end)', 'likelihood', 4)} from known group by symbol having avg(case when profit <= 0 then 1.0 else 0.0 end) > 0")
def a12(spark, sf):
    df = D.likelihood(labels(spark, sf).filter("profit is not null"), 120).filter("p_loss > 0")
    return df.select("symbol", "n", r("likelihood", 4).alias("likelihood"))


#: The densest place of values on 1000 even places by a Gaussian kernel: places are counted, and their counts meet every place.
def peak_sql(name: str, source: str) -> str:
    return f"""{name}_s as (select symbol, count(*) as n, min(profit) as lo, max(profit) as hi, stddev_samp(profit) * pow(count(*), -0.2) as width from {source} group by symbol having max(profit) > min(profit)),
    {name}_b as (select symbol, lo, hi, width, round((profit - lo) / ((hi - lo) / 999)) as bin, count(*) as times from {source} join {name}_s using (symbol) group by all),
    {name}_d as (select symbol, lo, hi, place, sum(times * exp(-0.5 * pow((place - bin) * ((hi - lo) / 999 / width), 2))) as density from {name}_b, (select unnest(range(0, 1000)) as place) group by all),
    {name} as (select symbol, any_value(lo) + any_value(hi - lo) / 999 * min(place) as peak from (select *, max(density) over (partition by symbol) as most from {name}_d) where density >= most * (1 - 1e-9) group by symbol)"""


@query(
    "a13_engine_likelihood",
    f"""{LABELS}, g as (select symbol, count(*) as n, count(profit) as k, count(distinct round(profit, 5)) as pts, avg(case when profit is not null then case when profit <= 0 then 1.0 else 0.0 end end) as pl, count(distinct case when profit <= 0 then profit end) as nl, min(profit) as worst from labels group by symbol),
    gn as (select symbol, profit from labels where profit > 0), {peak_sql("gp", "gn")}
    select symbol, {q("case when n < 60 or k = 0 then 0.0 else coalesce(peak, 0.0) end", "profit_margin")}, {q("case when n < 60 or k = 0 then 1.0 else 1 / (1 + exp(-(n - 60.0))) * case when pts > 2 then 1 / case when pl = 0 then 0.1 else pl end - (1 - pow(10, -60.0)) else 1.0 end end", "likelihood", 4)},
    {q("case when n < 60 or k = 0 or pts <= 2 then 0.5 else 1 - pl end", "p_win")}, {q("case when n < 60 or k = 0 or nl <= 1 then 0.0 else abs(worst) end", "loss_margin")} from g left join gp using (symbol)""",
)
def a13(spark, sf):
    df = D.engine_likelihood(labels(spark, sf), 120)
    return df.select("symbol", r("profit_margin").alias("profit_margin"), r("likelihood", 4).alias("likelihood"), r("p_win").alias("p_win"), r("loss_margin").alias("loss_margin"))


@query("a14_density_peak", f"{KNOWN}, {peak_sql('pk', 'known')} select symbol, {q('peak', 'peak')} from (select distinct symbol from known) left join pk using (symbol)")
def a14(spark, sf):
    return rounded(D.density_peaks(labels(spark, sf)), "symbol", peak="peak")


@query("d6_aggregates", f"{KNOWN}, {peak_sql('pk', 'known')}, g as (select symbol, avg(profit) as mean, median(profit) as median from known group by symbol) select symbol, {q('mean', 'mean')}, {q('median', 'median')}, {q('peak', 'density_peak')} from g left join pk using (symbol)")
def d6(spark, sf):
    """Registered aggregates by name, the density peak among them."""
    out = D.aggregate_with(labels(spark, sf).filter("profit is not null"), ("mean", "median", "density_peak"))
    return rounded(out, "symbol", mean="mean", median="median", density_peak="density_peak")


@query(
    "a15_conditional_likelihood",
    f"""{KNOWN}, g as (select symbol, coalesce(avg(case when profit > 0 then case when buy_signal then 1.0 else 0.0 end end), 0) as pw, coalesce(avg(case when profit <= 0 then case when buy_signal then 1.0 else 0.0 end end), 0) as pl from known group by symbol)
    select symbol, {q("pw", "p_win")}, {q("pl", "p_loss")}, {q("case when pw = 0 and pl = 0 then 1 when pl = 0 then pw + 0.1 when pw = 0 then 1 / (pl + 0.1) else pw / pl end", "likelihood")} from g""",
)
def a15(spark, sf):
    return rounded(D.conditional_likelihood(labels(spark, sf), "buy_signal"), "symbol", p_win="p_win", p_loss="p_loss", likelihood="likelihood")


@query("a16_shrunk_likelihood", f"select event_id, {q('case when user_id / 30.0 >= 1 then value / 20 when value / 20 > 1 then (value / 20 - 1) * user_id / 30.0 + 1 when value / 20 < 1 then 1 - (1 - value / 20) * user_id / 30.0 else value / 20 end', 'likelihood')} from events")
def a16(spark, sf):
    return T.table(spark, sf, "events").select("event_id", r(D.shrink(F.col("value") / 20, F.col("user_id"), F.lit(0))).alias("likelihood"))


@query("a17_discrete_posterior", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {q('l_quantity * l_tax / nullif(sum(l_quantity * l_tax) over (partition by l_orderkey), 0)', 'posterior')} from lineitem")
def a17(spark, sf):
    df = D.posterior(T.table(spark, sf, "lineitem"), "l_quantity", "l_tax", "l_orderkey")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("posterior").alias("posterior"))


@query(
    "a18_profit_histogram",
    f"""{KNOWN}, s as (select symbol, profit, case when profit < 0 then 'loss' else 'win' end as side from known where profit <> 0), e as (select symbol, min(case when side = 'loss' then profit end) as lo, max(case when side = 'win' then profit end) as hi from s group by symbol),
    b as (select s.symbol, side, greatest(least(ceil(round(case when side = 'loss' then (profit - lo) / (-lo / 49) else profit / (hi / 49) end, 9)), 49), 1) as bin from s join e using (symbol)) select symbol, side, cast(bin as bigint) as bin, count(*) as n from b group by symbol, side, bin""",
)
def a18(spark, sf):
    return D.profit_histogram(labels(spark, sf))


@query(
    "a19_capture_bins",
    f"""{LABELS}, g as (select symbol, pl, buy_signal from labels where pl >= 0), t as (select symbol, max(pl) as top from g group by symbol), sp as (select symbol, top, unnest(range(0, 10)) as bin from t),
    c as (select g.symbol, greatest(ceil(round(pl * 10 / nullif(top, 0), 9)) - 1, 0) as bin, count(*) as total, count(*) filter (buy_signal) as captured from g join t using (symbol) group by 1, 2)
    select sp.symbol, cast(sp.bin as integer) as bin, coalesce(total, 0) as total, coalesce(captured, 0) as captured, coalesce(captured / total, 0.0) as rate from sp left join c on sp.symbol = c.symbol and sp.bin = c.bin""",
)
def a19(spark, sf):
    return V.capture_bins(labels(spark, sf))


@query(
    "a20_backtest_indicators",
    f"""{LABELS}, g as (select symbol, coalesce((count(*) filter (pl > 3 and buy_signal))::double / nullif(count(*) filter (pl > 3), 0), 0) as cr, avg(case when buy_signal then 1.0 else 0.0 end) as cov, coalesce(avg((epoch(matured) - epoch(ts)) / 3600), 0) as hh,
    avg(case when pl > 0 then 1.0 else 0.0 end) as wr, coalesce(avg(case when pl > 0 then pl end), 0) as ag, coalesce(-avg(case when pl <= 0 then pl end), 0) as al from labels group by symbol)
    select symbol, {q("cr", "capture_rate")}, {q("cov", "coverage")}, {q("hh", "holding_hours", 4)}, {q("wr", "win_rate")}, {q("wr * ag - (1 - wr) * al", "expected", 4)}, {q("case when coalesce(ag / nullif(al, 0), 0) <> 0 then 1 / (1 + ag / al) else 0 end", "breakeven", 4)} from g""",
)
def a20(spark, sf):
    df = V.backtest_indicators(labels(spark, sf))
    return df.select("symbol", r("capture_rate").alias("capture_rate"), r("coverage").alias("coverage"), r("holding_hours", 4).alias("holding_hours"), r("win_rate").alias("win_rate"), r("expected", 4).alias("expected"), r("breakeven", 4).alias("breakeven"))


@query("a21_pair_frequency", f"{ACCELERATION}, n as (select *, row_number() over (partition by symbol order by ts desc) as rn from ac) select cast(sign(round(ca, 6)) as double) as price_acc, cast(sign(va) as double) as vol_acc, count(*) as n from n where rn > 5 and ca is not null group by 1, 2")
def a21(spark, sf):
    df = T.finished_bars(I.acceleration(T.candles(spark, sf)), 5).filter("close_acc is not null")
    return df.groupBy(F.signum(F.round("close_acc", 6)).alias("price_acc"), F.signum("vol_acc").alias("vol_acc")).agg(F.count("*").alias("n"))


@query("a22_acceleration_correlation", f"{ACCELERATION} select symbol, {q('corr(ca, va)', 'correlation')} from ac where ca is not null and va is not null group by symbol")
def a22(spark, sf):
    df = I.acceleration(T.candles(spark, sf)).filter("close_acc is not null and vol_acc is not null")
    return rounded(df.groupBy("symbol").agg(F.corr("close_acc", "vol_acc").alias("c")), "symbol", correlation="c")


@query("a23_modal_interval", f"{CANDLES}, g as (select symbol, cast(epoch(ts) - epoch(lag(ts) over ({BY})) as bigint) as gap from candles), c as (select symbol, gap, count(*) as n from g where gap is not null group by 1, 2) select symbol, gap as seconds from c qualify row_number() over (partition by symbol order by n desc, gap) = 1")
def a23(spark, sf):
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(I.prior("ts").cast("timestamp"))
    return T.candles(spark, sf).withColumn("gap", gap).groupBy("symbol").agg(F.mode("gap", True).alias("seconds"))


_CHAIN = ", ".join(f"{' and '.join(f'coalesce(lead(buy_signal, {j}) over ({BY}), false)' for j in range(1, k + 1))} and buy_signal as c{k}" for k in range(1, 10))


@query("a24_streak_odds", f"{LABELS}, ch as (select symbol, profit, {_CHAIN} from labels), f as ({' union all '.join(f'select symbol, {k} as k, profit, c{k} as c from ch' for k in range(1, 10))}), g as (select symbol, k, count(*) filter (c) as st, count(*) filter (c and profit > 0) as w, count(*) filter (c and profit <= 0) as l from f group by 1, 2) select symbol, k, {q('case when st = 0 then 1.0 else w / case when l = 0 then 1e-10 else l end end', 'odds', 4)} from g")
def a24(spark, sf):
    df = D.streak_odds(labels(spark, sf), "buy_signal")
    return df.select("symbol", "k", r("odds", 4).alias("odds"))


#: The cash account of signalled trades: pay-outs that are due wait in a list; what is left is paid at the end.
REPLAY = f"""{LABELS.replace("with ticks", "with recursive ticks", 1)}, sn as (select symbol, ts, profit, matured, row_number() over ({BY}) as rn from labels where buy_signal),
    cr as (select symbol, 0 as rn, null::timestamp as ts, 0.0::double as income, 0.0::double as invested, 1000.0::double as fund, []::struct(m timestamp, p double)[] as due from (select distinct symbol from sn)
    union all select symbol, rn, ts, income, stake, cash - stake, case when stake > 0 then list_append(due, struct_pack(m := matured, p := stake * (1 + profit))) else due end
      from (select *, case when cash >= 10 and matured is not null and profit is not null then least(1000, cash) * {{kelly}}::double else 0 end as stake
        from (select n.symbol, n.rn, n.ts, n.profit, n.matured, coalesce(list_sum(list_transform(list_filter(e.due, lambda x: x.m <= n.ts), lambda x: x.p)), 0) as income,
            e.fund + coalesce(list_sum(list_transform(list_filter(e.due, lambda x: x.m <= n.ts), lambda x: x.p)), 0) as cash, list_filter(e.due, lambda x: x.m > n.ts) as due
          from cr e join sn n on n.symbol = e.symbol and n.rn = e.rn + 1))),
    fin as (select symbol, list_max(list_transform(due, lambda x: x.m)) as ts, list_sum(list_transform(due, lambda x: x.p)) as income, 0.0::double as invested, fund + list_sum(list_transform(due, lambda x: x.p)) as fund
      from cr where len(due) > 0 qualify row_number() over (partition by symbol order by rn desc) = 1 and rn = (select max(s.rn) from sn s where s.symbol = cr.symbol)),
    cash as (select symbol, ts, income, invested, fund from cr where rn > 0 union all select * from fin)"""


@query(
    "a25_backtest_summary",
    f"""{REPLAY.format(kelly="0.2")}, cs as (select symbol, arg_max(fund, ts) as fund, sum(invested) as invested from cash group by symbol),
    tr as (select symbol, count(*) as trades, count(*) filter (profit > 0) as gains, avg(case when round(profit, 2) > 0 then 1.0 else 0.0 end) as pw, (epoch(max(ts)) - epoch(min(ts))) / 86400 / 365.25::double as years, avg(time_cost) as cost, min(profit) as worst,
      sum(case when time_cost > 0 then pow(1 + profit, 1.0 / time_cost) * time_cost end) / sum(case when time_cost > 0 then time_cost end) - 1 as weighted from labels where buy_signal and profit is not null group by symbol),
    yr as (select symbol, ln(1 + sum(coalesce(case when buy_signal then 0.2::double end * profit, 0))) / ((epoch(max(ts)) - epoch(min(ts))) / 60 / 525600) as grown from labels group by symbol)
    select c.symbol, {q("fund - 1000", "gain", 4)}, {q("invested", "invested", 4)}, trades, gains, {q("pw / (1 + exp(-(trades - years)))", "weighted_win")}, {q("cost", "mean_cost")}, {q("(fund - 1000) / trades", "mean_gain", 4)}, {q("worst", "drawdown")}, {q("weighted", "weighted_return")}, {q("grown", "log_growth", 4)}
    from cs c left join tr on tr.symbol = c.symbol left join yr on yr.symbol = c.symbol""",
)
def a25(spark, sf):
    """Cash account of each symbol's signalled trades with a fixed bet, summed up in one row."""
    every = labels(spark, sf)
    out = V.backtest_summary(every, A.cash_replay(every.filter("buy_signal").withColumn("kelly", F.lit(0.2))), 0.2)
    return out.select("symbol", r("gain", 4).alias("gain"), r("invested", 4).alias("invested"), "trades", "gains", r("weighted_win").alias("weighted_win"), r("mean_cost").alias("mean_cost"), r("mean_gain", 4).alias("mean_gain"), r("drawdown").alias("drawdown"), r("weighted_return").alias("weighted_return"), r("log_growth", 4).alias("log_growth"))


TRADES = f"{KNOWN}, tr as (select symbol, profit, row_number() over ({BY}) - 1 as i, count(*) over (partition by symbol) as n from known where buy_signal)"
BOOT = f"""{TRADES}, dr as (select distinct t.symbol, s.sim, p.step, ('0x' || substr(md5('draw-' || t.symbol || '-' || s.sim || '-' || p.step), 1, 8))::bigint % t.n as i from (select distinct symbol, n from tr) t, (select unnest(range(0, 40)) as sim) s, (select unnest(range(0, 12)) as step) p),
pa as (select dr.symbol, dr.sim, sum(case when 1 + 0.5 * profit > 0 then ln(1 + 0.5 * profit) end) as lg, min(1 + 0.5 * profit) as least from dr join tr on dr.symbol = tr.symbol and dr.i = tr.i group by 1, 2), bo as (select symbol, sim, case when least <= 0 then 0.0 else 10000 * exp(lg) end as capital from pa)"""


def _bootstrap(spark, sf):
    w = Window.partitionBy("symbol")
    trades = labels(spark, sf).filter(F.col("buy_signal") & F.col("profit").isNotNull())
    trades = trades.select("symbol", "profit", (F.row_number().over(w.orderBy("ts")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    return V.bootstrap(trades, 40, 12, bet=F.lit(0.5))


@query("g11_bootstrap", f"{BOOT} select symbol, sim, {q('ln(capital / 10000)', 'log_growth', 5)} from bo")
def g11(spark, sf):
    return _bootstrap(spark, sf).select("symbol", "sim", r(F.log(F.col("capital") / 10000), 5).alias("log_growth"))


@query("a26_bootstrap_summary", f"{BOOT} select symbol, {q('ln(avg(capital / 10000))', 'log_mean', 5)}, avg(case when capital > 10000 then 1.0 else 0.0 end) as win_rate, {q('ln(max(capital) / 10000)', 'best', 5)}, {q('ln(min(capital) / 10000)', 'worst', 5)} from bo group by symbol")
def a26(spark, sf):
    df = V.bootstrap_summary(_bootstrap(spark, sf))
    return df.select("symbol", r(F.log(F.col("mean_return") + 1), 5).alias("log_mean"), "win_rate", r(F.log(F.col("best") / 10000), 5).alias("best"), r(F.log(F.col("worst") / 10000), 5).alias("worst"))


def _paths(spark, sf):
    return V.bootstrap_counts(labels(spark, sf).filter("buy_signal").select("symbol", "profit"), bet=0.5)


@query("g11_bootstrap_paths")
def g11_paths(spark, sf):
    """1000 paths of 1260 trades a symbol, drawn as counts of its distinct profits."""
    return _paths(spark, sf)


@query("a26_path_summary")
def a26_paths(spark, sf):
    return V.bootstrap_summary(_paths(spark, sf))


WINDOW_S = 40 * 21600
TRAIL = f"""{LABELS}, tp as (select s.symbol, s.ts as today, b.ts, (case when b.matured <= s.ts then b.sell else s.close end) / b.buy - 1 as profit, coalesce(b.matured <= s.ts, false) as done
    from labels s join labels b on s.symbol = b.symbol and b.ts <= s.ts and b.ts >= s.ts - interval {WINDOW_S} seconds where s.buy_signal),
    lk as (select symbol, today, count(*) as n, avg(case when profit <= 0 then 1.0 when profit > 0 then 0.0 end) as pl, quantile_disc(profit, 0.05) as lower from tp group by 1, 2)"""


@query("j7_trailing_profits", f"{TRAIL} select symbol, today, ts, {q('profit', 'profit')}, case when done then 'matured' else 'open' end as state from tp")
def j7(spark, sf):
    df = D.trailing_profits(labels(spark, sf), "buy_signal", 40, 21600)
    return df.select("symbol", "today", "ts", r("profit").alias("profit"), "state")


@query(
    "j8_first_stop",
    f"""{TURTLE}, x as (select e.symbol, e.ts, l.ts as hit, l.close as sell from turtle e join turtle l on e.symbol = l.symbol and l.ts > e.ts and (l.atr > 1.5 * e.atr or l.close < l.turtle_l or l.close <= 0.5 * e.close)),
    m as (select symbol, ts, min(hit) as hit, arg_min(sell, hit) as sell from x group by 1, 2), n as (select *, row_number() over ({BY}) as rn from turtle)
    select n.symbol, n.ts, m.sell as stop_sell, o.rn - n.rn as stop_cost from n left join m on n.symbol = m.symbol and n.ts = m.ts left join n o on o.symbol = m.symbol and o.ts = m.hit""",
)
def j8(spark, sf):
    return L.barrier_labels(turtle(spark, sf), 1.5, 0.5, 1.5).select("symbol", "ts", "stop_sell", "stop_cost")


@query(
    "j9_first_gain",
    f"""{TURTLE}, n as (select *, row_number() over ({BY}) as rn from turtle), m as (select e.symbol, e.ts, min(l.rn - e.rn) as cost from n e join n l on e.symbol = l.symbol and l.rn > e.rn and l.high > 1.5 * e.close group by 1, 2)
    select n.symbol, n.ts, greatest(cast(m.cost as double), 0.5) as take_cost from n left join m on n.symbol = m.symbol and n.ts = m.ts""".replace("greatest(cast(m.cost as double), 0.5)", "case when m.cost is not null then greatest(cast(m.cost as double), 0.5) end"),
)
def j9(spark, sf):
    return L.barrier_labels(turtle(spark, sf), 1.5, 0.5, 1.5).select("symbol", "ts", "take_cost")


@query("g1_rolling_kalman", f"{FILTERED} select symbol, ts, {q('kalman', 'kalman')} from filtered")
def g1(spark, sf):
    return rounded(filtered(spark, sf), "symbol", "ts", kalman="kalman")


@query(
    "g2_trend_filter",
    f"""{RECURSIVE}, {adjusted_sql(f"(select symbol, ts, close, ({' + '.join(f'{10 - i} * lag(close, {i}) over ({BY})' for i in range(10))}) / 55 as wma from candles)", (10,))},
    tf as (select symbol, ts, rn, (ema10 + wma) / 2 as x0, 0.0::double as x1, 1.0::double as p00, 0.0::double as p01, 0.0::double as p10, 1.0::double as p11 from means where rn = 10
    union all select symbol, ts, rn, a0 + k0 * (seen - 2 * a0), a1 + k1 * (seen - 2 * a0), (1 - 2 * k0) * c00, (1 - 2 * k0) * c01, c10 - 2 * k1 * c00, c11 - 2 * k1 * c01
      from (select *, c00 / (2 * c00 + 0.01::double) as k0, c10 / (2 * c00 + 0.01::double) as k1
        from (select n.symbol, n.ts, n.rn, n.ema10 + n.wma as seen, e.x0 + e.x1 as a0, e.x1 as a1, e.p00 + e.p01 + e.p10 + e.p11 + 0.0001::double as c00, e.p01 + e.p11 as c01, e.p10 + e.p11 as c10, e.p11 + 0.0001::double as c11 from tf e join means n on n.symbol = e.symbol and n.rn = e.rn + 1)))
    select m.symbol, m.ts, {q("x0", "trend")} from means m left join tf on tf.symbol = m.symbol and tf.rn = m.rn""",
)
def g2(spark, sf):
    df = A.ewm_columns(I.weighted_mean(T.candles(spark, sf).select("symbol", "ts", "close")), {"ema": ("close", A.span(10), True)})
    return rounded(A.trend_filter(df), "symbol", "ts", trend="trend")


@query("g3_regimes")
def g3(spark, sf):
    features = ["kreturn_z", "kreturn_vol_z", "rvolume_z", "slope_z"]
    return A.regimes(I.regime_features(filtered(spark, sf)).select("symbol", "ts", "slope", *features), features).select("symbol", "ts", "up")


FEATURES = ["kreturn", "kreturn_vol", "rvolume", "slope"]


def _regimes(spark, sf):
    """Regimes fitted on the first half of each series; features and labels see no later bar."""
    df = I.regime_features(filtered(spark, sf), causal=True).select("symbol", "ts", *FEATURES)
    return R.causal_regimes(df, FEATURES).select("symbol", "ts", "up")


@query("g3_causal_regimes")
def g3_causal(spark, sf):
    return _regimes(spark, sf)


@query(
    "g4_win_updates",
    f"""{TRAIL.replace("with ticks", "with recursive ticks", 1)}, nm as (select *, 1 / (1 + exp(-(n - 3))) * (1 - pl) / greatest(pl, 1e-6) as lik, row_number() over (partition by symbol order by today) as rn from lk),
    mg as (select symbol, today, coalesce(abs(min(case when profit <= 0 then profit end)), 1.0) as loss, coalesce(avg(case when profit > 0 then profit end), 0.0) as gain from tp group by 1, 2),
    up as (select symbol, today, rn, 0.5 / (0.5 + 1e-10) * coalesce(lik, 1) as o from nm where rn = 1
    union all select n.symbol, n.today, n.rn, (case when u.o / (u.o + 1 + 1e-10) = 1 then 0.999999 else u.o / (u.o + 1 + 1e-10) end) / (1 - (case when u.o / (u.o + 1 + 1e-10) = 1 then 0.999999 else u.o / (u.o + 1 + 1e-10) end) + 1e-10) * coalesce(n.lik, 1) from up u join nm n on n.symbol = u.symbol and n.rn = u.rn + 1),
    bt as (select u.symbol, u.today, o / (o + 1 + 1e-10) as p, coalesce(nullif(m.loss, 0), 1e-30) as loss, coalesce(nullif(m.gain, 0), 1e-30) as gain from up u join mg m on m.symbol = u.symbol and m.today = u.today)
    select symbol, today, {q("p", "posterior")}, {q("case when p / loss > (1 - p) / gain then (p / loss - (1 - p) / gain) / (p / loss) else 0 end", "kelly", 4)}, {q("p * gain - (1 - p) * loss", "expected", 5)} from bt""",
)
def g4(spark, sf):
    likes = D.signal_likelihoods(labels(spark, sf), "buy_signal", 40, 21600)
    bets = D.with_bets(D.win_updates(likes))
    return bets.select("symbol", "today", r("posterior").alias("posterior"), r("kelly", 4).alias("kelly"), r("expected", 5).alias("expected"))


@query(
    "g5_multi_signal_updates",
    f"""{LABELS}, sg as (select *, buy_signal as s1, coalesce(close > turtle_h, false) as s2, row_number() over ({BY}) as rn from labels),
    vw as (select t.symbol, t.ts, t.s1, t.s2, coalesce(b.matured <= t.ts and b.profit > 0, false) as won, b.rn is not null as seen, b.s1 as b1, b.s2 as b2
      from sg t left join sg b on b.symbol = t.symbol and b.rn <= t.rn and b.rn > greatest(t.rn - 60, 1) where t.s1 or t.s2),
    ct as (select symbol, ts, s1, s2, {", ".join(f"count(*) filter (where seen and {c}) as {k}" for k, c in (("w", "won"), ("l", "not won"), ("w1", "won and b1"), ("l1", "not won and b1"), ("w2", "won and b2"), ("l2", "not won and b2")))} from vw group by all),
    pr as (select *, coalesce(w1 / nullif(w, 0), 0) as pw1, coalesce(l1 / nullif(l, 0), 0) as pl1, coalesce(w2 / nullif(w, 0), 0) as pw2, coalesce(l2 / nullif(l, 0), 0) as pl2, (w + l) / 30 as ev from ct),
    ra as (select *, {", ".join(f"case when pw{i} = 0 and pl{i} = 0 then 1.0 when pl{i} = 0 then pw{i} + 0.1 when pw{i} = 0 then 1 / (pl{i} + 0.1) else pw{i} / pl{i} end as r{i}" for i in (1, 2))} from pr),
    sh as (select *, {", ".join(f"case when not s{i} then 1.0 when ev >= 1 then r{i} when r{i} > 1 then (r{i} - 1) * ev + 1 when r{i} < 1 then 1 - (1 - r{i}) * ev else r{i} end as k{i}" for i in (1, 2))} from ra),
    od as (select symbol, ts, k1 * k2 as likelihood, exp(sum(ln(k1 * k2)) over ({BY})) as o from sh where s1 or s2)
    select symbol, ts, {q("likelihood", "likelihood", 5)}, {q("o / (o + 1 + 1e-10)", "posterior", 5)} from od""",
)
def g5(spark, sf):
    df = S.multi_signal_updates(labels(spark, sf), ("channel", "close_channel"), 60, D.shrink)
    return df.select("symbol", "ts", r("likelihood", 5).alias("likelihood"), r("posterior", 5).alias("posterior"))


CHAIN9 = ", ".join(f"({' and '.join(f'coalesce(lead(buy_signal, {j}) over ({BY}), false)' for j in range(1, k + 1))}) and buy_signal as c{k}, lead(ts, {k}) over ({BY}) as t{k}" for k in range(1, 10))


@query(
    "g6_streak_posterior",
    f"""{TRAIL}, ch as (select symbol, ts, profit, matured, buy_signal, {CHAIN9} from labels),
    kn as ({" union all ".join(f"select symbol, {k} as k, greatest(t{k}, matured) as at, case when profit > 0 then 1 when profit is not null then 0 end as win from ch where c{k}" for k in range(1, 10))}),
    il as (select symbol, ts, buy_signal, row_number() over ({BY}) - row_number() over (partition by symbol, buy_signal order by ts) as grp from labels),
    rw as (select symbol, ts, least(row_number() over (partition by symbol, grp order by ts), 9) as k, row_number() over ({BY}) as nth from il where buy_signal),
    cn as (select r.symbol, r.ts, r.nth, coalesce(sum(win), 0) as wins, count(win) as seen from rw r left join kn on kn.symbol = r.symbol and kn.k = r.k and kn.at <= r.ts group by 1, 2, 3),
    po as (select c.symbol, c.ts, case when nth <= 3 or seen = 0 then 1.0 else wins / greatest(seen - wins, 1e-10) end as prior, 1 / (1 + exp(-(n - 3))) * (1 - pl) / greatest(pl, 1e-6) as lik from cn c join lk on lk.symbol = c.symbol and lk.today = c.ts),
    pp as (select symbol, ts, prior, prior * lik / (prior * lik + 1 + 1e-10) as p from po)
    select symbol, ts, {q("prior", "prior", 4)}, {q("p", "posterior")}, {q("case when p / (1 - 0.9::double) > (1 - p) / (2 * (1 - 0.9::double)) then (p / (1 - 0.9::double) - (1 - p) / (2 * (1 - 0.9::double))) / (p / (1 - 0.9::double)) else 0 end", "kelly")} from pp""",
)
def g6(spark, sf):
    """Posterior of each signal bar: streak odds known by then, once there were over three signals, times the engine's
    likelihood of the trailing profits; the bet for margins of a cutoff of 0.9."""
    df = I.run_lengths(labels(spark, sf), "buy_signal", "streak")
    w = I.series()
    chain, starts = I.yes(F.col("buy_signal")), []
    for k in range(1, 10):
        chain = chain & I.yes(F.lead("buy_signal", k).over(w))
        starts.append(F.struct(F.lit(k).alias("k"), chain.alias("on"), F.greatest(F.lead("ts", k).over(w), F.col("matured")).alias("at")))
    flat = df.withColumn("all_", F.array(*starts)).select("symbol", "profit", F.explode("all_").alias("x")).filter("x.on and x.at is not null")
    known = flat.select("symbol", F.col("x.k").alias("k"), F.col("x.at").alias("ts"), (F.col("profit") > 0).cast("int").alias("win"), F.lit(0).alias("row"))
    nth = F.row_number().over(w)
    rows = df.filter("buy_signal").select("symbol", F.least(F.col("streak"), F.lit(9)).alias("k"), "ts", F.lit(None).cast("int").alias("win"), nth.alias("row"))
    sec = F.unix_micros(F.col("ts").cast("timestamp"))
    both = known.unionByName(rows).withColumn("us", sec)
    upto = Window.partitionBy("symbol", "k").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"wins": F.sum("win").over(upto), "seen": F.count("win").over(upto)}).filter("row > 0")
    odds = F.when((F.col("seen") == 0) | (F.col("row") <= 3), 1.0).otherwise(F.col("wins") / F.greatest(F.col("seen") - F.col("wins"), F.lit(1e-10)))
    like = D.signal_likelihoods(labels(spark, sf), "buy_signal", 40, 21600).select("symbol", F.col("today").alias("ts"), "likelihood")
    out = both.select("symbol", "ts", odds.alias("prior")).join(like, ["symbol", "ts"])
    o = F.col("prior") * F.col("likelihood")
    out = out.withColumn("p", o / (o + 1 + 1e-10))
    return out.select("symbol", "ts", r("prior", 4).alias("prior"), r("p").alias("posterior"), r(Fn.kelly(F.col("p"), F.lit(1 - 0.9), F.lit(2 * (1 - 0.9)))).alias("kelly"))


@query("g7_cash_replay", f"{REPLAY.format(kelly='0.25')} select symbol, ts, {q('income', 'income')}, {q('invested', 'invested')}, {q('fund', 'fund')} from cash")
def g7(spark, sf):
    rows = labels(spark, sf).filter("buy_signal").withColumn("kelly", F.lit(0.25))
    return rounded(A.cash_replay(rows), "symbol", "ts", income="income", invested="invested", fund="fund")


LEDGER = f"""{NET.replace("with fills", "with recursive fills", 1)}, num as (select *, row_number() over (partition by symbol order by time, order_id, line, symbol, suppkey, cash) as rn from net),
    led as (select symbol, rn, side, price, case when side = 'buy' then position else 0 end as held, case when side = 'buy' then price else 0 end as avg_cost, null::double as profit, case when side = 'buy' then -position * price else 0 end as cash from num where rn = 1
    union all select n.symbol, n.rn, n.side, n.price, case when n.side = 'buy' then e.held + n.position else e.held - least(n.position, e.held) end,
    case when n.side = 'buy' then (e.avg_cost * e.held + n.position * n.price) / (e.held + n.position) else e.avg_cost end, case when n.side = 'sell' and least(n.position, e.held) > 0 then n.price / e.avg_cost - 1 end,
    e.cash + case when n.side = 'buy' then -n.position * n.price else least(n.position, e.held) * n.price end from led e join num n on n.symbol = e.symbol and n.rn = e.rn + 1)"""


def ledger(spark, sf):
    return A.fill_ledger(A.net_fills(T.fills(spark, sf)))


@query("g8_fill_ledger", f"{LEDGER} select symbol, cast(rn as integer) as rn, side, {q('held', 'held', 4)}, {q('avg_cost', 'avg_cost', 4)}, {q('profit', 'profit', 4)}, {q('cash / 997', 'cash_share', 6)} from led")
def g8(spark, sf):
    return ledger(spark, sf).select("symbol", "rn", "side", r("held", 4).alias("held"), r("avg_cost", 4).alias("avg_cost"), r("profit", 4).alias("profit"), r(F.col("cash") / 997, 6).alias("cash_share"))


def _levels(spark, sf):
    return I.volume_hold(I.take_profit(turtle(spark, sf), 10, 3))


def _account(spark, sf):
    return A.paper_account(_levels(spark, sf))


#: The account fold in SQL, a bar a step: what is matched, at what price, then the orders that the bar sets.
ACCOUNT = f"""{TURTLE.replace("with ticks", "with recursive ticks", 1)}, br as (select *, ({roll("avg", "high", 10)}) + 3 * ({roll("stddev_samp", "high", 10)}) as tp, sum(vol) over ({BY} range between interval 18 hours preceding and current row) as day_vol, row_number() over ({BY}) as rn from turtle), bh as (select *, coalesce(day_vol / avg(day_vol) over (partition by symbol) < 0.6, false) as hold from br),
    ac as (select symbol, 0 as rn, null::timestamp as ts, null::varchar as reason, null::double as price, 1000.0::double as cash, 0.0::double as pos, 0.0::double as avg_cost, 0.0::double as cutoff, 0.0::double as aexit, 0.0::double as leave, 0.0::double as target from (select distinct symbol from br)
    union all select symbol, rn, ts, reason, price, cash, pos, avg_cost, case when pos > 0 then avg_cost * 0.9::double else cutoff end, coalesce(exit_price, aexit),
        case when pos > 0 then greatest(coalesce(tp, 0), avg_cost * (1 + (1 - 0.9::double) * 2.0::double)) else leave end, case when buy_signal and not hold and pos = 0 and cash > 10.01 and coalesce(close / nullif(case when avg_cost > 0 then least(exit_price, avg_cost * 0.9::double) else exit_price end, 0) >= 1.002::double, false) and exit_price is not null then close else 0 end
      from (select * exclude (cash, pos, avg_cost), case when reason = 'BUY' then cash - least(100, cash) when reason is not null then cash + pos * price else cash end as cash,
          case when reason = 'BUY' then least(100, cash) / price when reason is not null then 0 else pos end as pos, case when reason = 'BUY' then price else avg_cost end as avg_cost
        from (select *, case reason when 'CUTOFF' then cutoff when 'ATR_EXIT' then aexit when 'PROFIT_LEAVE' then leave when 'BUY' then target end as price
          from (select n.symbol, n.rn, n.ts, n.close, n.exit_price, n.tp, n.buy_signal, n.hold, e.cash, e.pos, e.avg_cost, e.cutoff, e.aexit, e.leave, e.target,
              case when e.pos > 0 then case when n.low <= e.cutoff then 'CUTOFF' when n.low <= e.aexit then 'ATR_EXIT' when n.high >= e.leave and e.leave > 0 then 'PROFIT_LEAVE' end
                when e.target > 0 and e.aexit < n.low and n.low <= e.target and least(100, e.cash) >= 10.01 then 'BUY' end as reason
            from ac e join bh n on n.symbol = e.symbol and n.rn = e.rn + 1))))"""
BAR_ACCOUNTS = f"""{ACCOUNT} select symbol, ts, reason, {q("price", "price")}, {q("cash", "cash", 4)}, {q("pos", "position")}, {q("avg_cost", "avg_cost")} from ac where rn > 0"""


@query("g9_paper_account", BAR_ACCOUNTS)
def g9(spark, sf):
    return _account(spark, sf).select("symbol", "ts", "reason", r("price").alias("price"), r("cash", 4).alias("cash"), r("position").alias("position"), r("avg_cost").alias("avg_cost"))


@query("a6_final_account", f"""{ACCOUNT}, fin as (select symbol, arg_max(cash, rn) as cash, arg_max(pos, rn) as pos, arg_max(avg_cost, rn) as avg_cost from ac where rn > 0 group by symbol), lc as (select symbol, arg_max(close, ts) as last_close from candles group by symbol)
    select symbol, {q("cash", "cash", 4)}, {q("pos", "position")}, {q("avg_cost", "avg_cost")}, {q("cash + pos * last_close - 1000", "profit", 4)} from fin join lc using (symbol)""")
def a6_final(spark, sf):
    out = V.final_account(_account(spark, sf), T.candles(spark, sf))
    return out.select("symbol", r("cash", 4).alias("cash"), r("position").alias("position"), r("avg_cost").alias("avg_cost"), r("profit", 4).alias("profit"))


@query("g9_regime_account")
def g9_regime(spark, sf):
    """The paper account behind the whole gate: a buy needs the upper regime too, and volume is held against its mean so far."""
    levels = I.volume_hold(I.take_profit(turtle(spark, sf), 10, 3), causal=True).join(_regimes(spark, sf), ["symbol", "ts"])
    out = A.paper_account(levels.withColumn("buy_signal", F.col("buy_signal") & F.coalesce("up", F.lit(False))))
    return out.select("symbol", "ts", "reason", r("price").alias("price"), r("cash", 4).alias("cash"), r("position").alias("position"), r("avg_cost").alias("avg_cost"))


LAST = f"{LEDGER}, la as (select symbol, arg_max(held, rn) as held, arg_max(avg_cost, rn) as avg_cost, arg_max(cash, rn) as cash, arg_max(price, rn) as last_price from led group by symbol)"


def _last_rows(spark, sf):
    return ledger(spark, sf).groupBy("symbol").agg(*[F.max_by(c, "rn").alias(c) for c in ("held", "avg_cost", "cash")], F.max_by("price", "rn").alias("last_price"))


@query("g10_portfolio_rows", f"{LAST} select symbol, {q('held * last_price', 'value', 3)}, {q('held * avg_cost', 'cost', 3)}, {q('held * (last_price - avg_cost)', 'pl', 3)}, {q('cash + held * last_price', 'equity', 3)} from la")
def g10(spark, sf):
    h, p = F.col("held"), F.col("last_price")
    return _last_rows(spark, sf).select("symbol", r(h * p, 3).alias("value"), r(h * F.col("avg_cost"), 3).alias("cost"), r(h * (p - F.col("avg_cost")), 3).alias("pl"), r(F.col("cash") + h * p, 3).alias("equity"))


@query("j12_portfolio_join", f"{LAST} select p_partkey as symbol, p_retailprice as fund, {q('held', 'held', 4)}, {q('last_price / p_retailprice - 1', 'change', 5)} from part left join la on la.symbol = p_partkey")
def j12(spark, sf):
    part = T.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("fund"))
    return part.join(_last_rows(spark, sf), "symbol", "left").select("symbol", "fund", r("held", 4).alias("held"), r(F.col("last_price") / F.col("fund") - 1, 5).alias("change"))


@query("g12_market_scan", f"{LABELS} select symbol, count(*) as bars, count(*) filter (buy_signal) as signals, {q('avg(profit) filter (buy_signal)', 'mean')}, {q('avg(case when profit > 0 then 1.0 else 0.0 end) filter (buy_signal and profit is not null)', 'win_rate')}, count(*) < 30 or min(close) <= 0 as suspect from labels group by symbol")
def g12(spark, sf):
    """The whole per-symbol pipeline as one job, a review row each; weak series are flagged, not skipped."""
    hit = F.col("buy_signal")
    return labels(spark, sf).groupBy("symbol").agg(
        F.count("*").alias("bars"), F.sum(hit.cast("int")).alias("signals"), r(F.avg(F.when(hit, F.col("profit")))).alias("mean"),
        r(F.avg(F.when(hit & F.col("profit").isNotNull(), (F.col("profit") > 0).cast("int")))).alias("win_rate"), ((F.count("*") < 30) | (F.min("close") <= 0)).alias("suspect"),
    )


@query("g13_haar_smooth", f"{CANDLES} select symbol, ts, {q('(' + ' + '.join(f'lag(close, {i}) over ({BY})' for i in range(2, 14)) + f') / 16 + (lag(close, 1) over ({BY}) + close) / 8', 'haar')} from candles")
def g13(spark, sf):
    return rounded(A.haar_smooth(T.candles(spark, sf).select("symbol", "ts", "close")), "symbol", "ts", haar="haar")


@query("g13_wavelet_smooth")
def g13_whole(spark, sf):
    return rounded(wavelets.wavelet_smooth(T.candles(spark, sf).select("symbol", "ts", "high")), "symbol", "ts", smooth="smooth")


def _tick_stream(spark, sf, files: int | None = None):
    """Ticks in four files of consecutive times, whatever their order inside a file."""
    path = T.scratch(spark, "ticks")
    B.write_in_order(_stamped(T.ticks(spark, sf)), path, "ts", 4, by=None)
    return B.replay(spark, path, B.TICK, files)


def _stamped(ticks):
    return ticks.withColumn("ts", F.col("ts").cast("timestamp"))


def _local(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t1_closed_bars", f"{CANDLES} select symbol, ts, open, high, low, close, vol, n from candles where ts + interval 6 hours <= (select max(ts) from events) - interval 5 seconds")
def t1(spark, sf):
    """One file a trigger; every bar that the watermark passes, and no other row: no tick is late."""
    return _local(B.drain(N.bars_and_late(_tick_stream(spark, sf, 1)), "closed-bars", typed=True)).drop("late")


#: Every 50th tick comes after all others: it is late where its bar was due by then.
LATE = """with t as (select event_type || '_' || (user_id % 4) as symbol, ts, time_bucket(interval 6 hours, ts) as bar, value + 1 as price, cast(json_extract_string(props, '$.k') as bigint) + 1 as qty, event_id % 50 = 0 as held from events),
m as (select *, held and bar + interval 6 hours <= (select max(ts) from t where not held) - interval 5 seconds as late from t)"""


def _held_stream(spark, sf):
    path = T.scratch(spark, "held-ticks")
    held = F.col("event_id") % 50 == 0
    events = T.table(spark, sf, "events")
    B.write_in_order(_stamped(T.ticks_of(events.filter(~held))), path, "ts", 4, by=None)
    _stamped(T.ticks_of(events.filter(held))).coalesce(1).write.mode("append").parquet(path)
    return B.replay(spark, path, B.TICK, 1)


@query(
    "t1_late_ticks",
    f"""{LATE}, b as (select symbol, bar as ts, arg_min(price, ts) as open, max(price) as high, min(price) as low, arg_max(price, ts) as close, cast(sum(qty) as double) as vol, count(*) as n from m where not late group by symbol, bar),
    l as (select symbol, bar as ts, count(*) as late from m where late group by symbol, bar)
    select symbol, ts, open, high, low, close, vol, n, coalesce(late, 0) as late from (select * from b where ts + interval 6 hours <= (select max(ts) from t) - interval 5 seconds) full join l using (symbol, ts)""",
)
def t1_late(spark, sf):
    """Bars of a stream in which every 50th tick comes last, and how many ticks each bar lost by that."""
    out = _local(B.drain(N.bars_and_late(_held_stream(spark, sf)), "late-bars", typed=True))
    bars = out.filter("late = 0").drop("late").join(N.late_ticks(out), ["symbol", "ts"], "full")
    return bars.na.fill(0, ["late"])


BAR_COLUMNS = "symbol string, ts timestamp, open double, high double, low double, close double, vol double"


def _bar_stream(spark, sf, files: int | None = None):
    """Bars in files by time, in whatever order they are listed, one a trigger if asked for."""
    path = T.scratch(spark, "bars")
    T.candles(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("symbol", "ts", "open", "high", "low", "close", "vol").repartitionByRange(3, "ts").write.parquet(path)
    return B.replay(spark, path, BAR_COLUMNS, files)


@query("t2_bar_updates", f"{TURTLE} select symbol, ts, turtle_h, turtle_l, {q('exit_price', 'exit_price')}, buy_signal from turtle")
def t2(spark, sf):
    """Three triggers; late bars inside the retained tail correct the bars after them, and the latest version counts."""
    df = B.latest(B.drain(B.bar_updates(_bar_stream(spark, sf, 1)), "bar-updates"))
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), clean("turtle_h").alias("turtle_h"), clean("turtle_l").alias("turtle_l"), r(clean("exit_price")).alias("exit_price"), "buy_signal")


@query("t3_unique_events", "select symbol, ts, price from (select event_type || '_' || (user_id % 4) as symbol, ts, value + 1 as price from events)")
def t3(spark, sf):
    ticks = _tick_stream(spark, sf)
    twice = ticks.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return B.drain(B.unique_events(twice, ["symbol", "ts"]), "unique").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "price")


@query(
    "t4_tick_exits",
    f"""{TURTLE}, lv as (select symbol, ts + interval 6 hours as ts, low * 0.6 as cutoff, exit_price as atr_exit, turtle_h as profit_leave from turtle),
    m as (select t.symbol, t.ts, t.price, lv.cutoff, lv.atr_exit, lv.profit_leave from ticks t asof join lv on t.symbol = lv.symbol and t.ts >= lv.ts where time_bucket(interval 6 hours, t.ts) + interval 6 hours <= (select max(ts) from ticks) - interval 5 seconds),
    x as (select symbol, ts, price, case when price <= cutoff * 1.0001 then 'CUTOFF' when price < atr_exit * 1.0001 then 'ATR_EXIT' when price >= profit_leave * 0.99 then 'PROFIT_LEAVE' end as reason from m)
    select symbol, ts, price, reason from x where reason is not null""",
)
def t4(spark, sf):
    """Each tick against the levels of its symbol's last closed bar, both as streams; no tick sees a later bar."""
    path = T.scratch(spark, "tick-levels")
    closed = (F.col("ts") + F.expr("interval 6 hours")).cast("timestamp")
    levels = turtle(spark, sf).select("symbol", closed.alias("ts"), (F.col("low") * 0.6).alias("cutoff"), F.col("exit_price").alias("atr_exit"), F.col("turtle_h").alias("profit_leave"))
    B.write_in_order(levels, path, "ts", 4, by=None)
    met = N.ticks_with_levels(_tick_stream(spark, sf, 1), B.replay(spark, path, "symbol string, ts timestamp, cutoff double, atr_exit double, profit_leave double", 1))
    return _local(B.drain(B.tick_exits(met), "exits", typed=True))


@query("t5_stream_accounts", BAR_ACCOUNTS)
def t5(spark, sf):
    """Order matching and account updates on a stream of bars with their levels, in several triggers; the batch fold of g9 gives the same rows."""
    path = T.scratch(spark, "levels")
    df = _levels(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close", "exit_price", "take_profit", "buy_signal", "hold")
    B.write_in_order(df, path, "ts", 3)
    out = B.drain(B.account_updates(B.replay(spark, path, "symbol string, ts timestamp, high double, low double, close double, exit_price double, take_profit double, buy_signal boolean, hold boolean", 1)), "accounts")
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "reason", r(F.when(~F.isnan("price"), F.col("price"))).alias("price"), r("cash", 4).alias("cash"), r("position").alias("position"), r("avg_cost").alias("avg_cost"))


@query("t6_order_updates", f"{LEDGER} select symbol, cast(rn as integer) as rn, side, {q('held', 'held', 4)}, {q('avg_cost', 'avg_cost', 4)}, {q('profit', 'profit', 4)} from led")
def t6(spark, sf):
    """A range of the fills a trigger, however many files it has."""
    path = T.scratch(spark, "order-updates")
    net = A.net_fills(T.fills(spark, sf)).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("seq")))
    files = B.write_in_order(net.select("symbol", "rn", "side", "position", "price"), path, "rn", 3)
    out = B.drain(B.ledger_updates(B.replay(spark, path, "symbol long, rn int, side string, position double, price double", files)), "ledger")
    return out.select("symbol", "rn", "side", r("held", 4).alias("held"), r("avg_cost", 4).alias("avg_cost"), r(F.when(~F.isnan("profit"), F.col("profit")), 4).alias("profit"))


@query(
    "t7_day_volume",
    """with t as (select event_type || '_' || (user_id % 4) as symbol, ts, cast(json_extract_string(props, '$.k') as bigint) + 1 as qty from events),
    s as (select symbol, time_bucket(interval 6 hours, ts) + k * interval 6 hours as ts, qty from t, (select unnest([1, 2, 3, 4]) as k)),
    d as (select symbol, ts, cast(sum(qty) as double) as day_vol from s where ts <= (select max(ts) from events) - interval 5 seconds group by symbol, ts)
    select symbol, ts, day_vol, day_vol / avg(day_vol) over (partition by symbol order by ts rows unbounded preceding) < 0.6 as hold from d""",
)
def t7(spark, sf):
    """The last day's volume every six hours, and whether it is under 0.6 of its mean so far; one file a trigger."""
    return _local(B.drain(N.volumes_and_late(_tick_stream(spark, sf, 1)), "day-volume", typed=True)).drop("late")


@query("t8_statements", f"{CANDLES} select symbol, ts, close from candles")
def t8(spark, sf):
    """Statements merged by symbol and bar, a file a trigger."""
    return _local(B.drain(_bar_stream(spark, sf, 1).select("symbol", "ts", "close"), "statements", statements=True))


@query("t9_replay", "select event_type || '_' || (user_id % 4) as symbol, ts, value + 1 as price, cast(json_extract_string(props, '$.k') as bigint) + 1 as qty from events")
def t9(spark, sf):
    return B.drain(_tick_stream(spark, sf, 1), "replay").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("d1_signal_function", f"{TURTLE} select symbol, ts, coalesce(close > turtle_h, false) as buy_signal from turtle")
def d1(spark, sf):
    return S.with_signal(turtle(spark, sf), "close_channel").select("symbol", "ts", "buy_signal")


@query("d2_signal_table", f"{TURTLE} select symbol, ts, 'channel' as signal from turtle where buy_signal union all select symbol, ts, 'close_channel' from turtle where close > turtle_h union all select symbol, ts, 'monthly' from turtle where day(ts) in (1, 5)")
def d2(spark, sf):
    return S.signal_table(turtle(spark, sf), ("channel", "close_channel", "monthly"))


@query("d3_exit_rules", f"{TURTLE}, fired as (select *, coalesce(low < exit_price, false) as fires from turtle), exits as (select *, min(case when fires then ts end) over ({BY} rows between current row and unbounded following) as at from fired) select e.symbol, e.ts, {q('case when e.exit_price is not null then f.exit_price / e.close - 1 end', 'profit')} from exits e left join fired f on e.symbol = f.symbol and e.at = f.ts")
def d3(spark, sf):
    return S.label_with(turtle(spark, sf), "low_below_stop").select("symbol", "ts", r("profit").alias("profit"))


FLAGSHIP = f"{LABELS} select symbol, count(*) as bars, count(*) filter (buy_signal) as signals, {q('avg(profit) filter (buy_signal)', 'mean_profit')}, {q('avg(case when profit > 0 then 1.0 else 0.0 end) filter (buy_signal and profit is not null)', 'win_rate')} from labels group by symbol"


@query("d4_stages", FLAGSHIP)
def flagship(spark, sf):
    """Sensor, scout, engine, report: plain functions chained by transform."""

    def report(df):
        hit = F.col("buy_signal")
        return df.groupBy("symbol").agg(F.count("*").alias("bars"), F.sum(hit.cast("int")).alias("signals"), r(F.avg(F.when(hit, F.col("profit")))).alias("mean_profit"), r(F.avg(F.when(hit & F.col("profit").isNotNull(), (F.col("profit") > 0).cast("int")))).alias("win_rate"))

    return T.candles(spark, sf).transform(I.turtle).transform(L.exit_labels).transform(report)
