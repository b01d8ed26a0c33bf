"""Two regimes of a series by a hidden Markov model: fitted once on early bars, then each later bar labelled from those up to it.

Chunks of a series are rows; a round of the fit sends each chunk its series' parameters and adds up sufficient statistics, a
row a series. Labels come from a forward filter, whose step over a chunk is a 2 x 2 matrix, so only these are scanned in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .chunks import SIZE, numbered

#: Added to each variance; and rounds of the fit.
FLOOR, ROUNDS = 1e-3, 12


def log_densities(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), 2))
    for s in (0, 1):
        diff = x - means[s]
        out[:, s] = -0.5 * (np.einsum("ij,ij->i", diff @ np.linalg.inv(covs[s]), diff) + np.linalg.slogdet(covs[s])[1] + x.shape[1] * np.log(2 * np.pi))
    return out


def statistics(x: np.ndarray, gamma: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """What a fit needs of a chunk, to be added up: first states, state changes, and each state's weight, sum and products."""
    products = np.einsum("ts,ti,tj->sij", gamma, x, x)
    return np.concatenate([gamma[0], pairs.ravel(), gamma.sum(0), (gamma.T @ x).ravel(), products.ravel()])


def expected(x: np.ndarray, start: np.ndarray, trans: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Statistics of a chunk under given parameters, by scaled forward and backward passes."""
    logs = log_densities(x, means, covs)
    b = np.exp(logs - logs.max(1, keepdims=True)) + 1e-300
    n = len(x)
    a, scale, back, pairs = np.empty((n, 2)), np.empty(n), np.ones((n, 2)), np.zeros((2, 2))
    for t in range(n):
        a[t] = (start if t == 0 else a[t - 1] @ trans) * b[t]
        scale[t] = a[t].sum()
        a[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        after = b[t + 1] * back[t + 1] / scale[t + 1]
        pairs += a[t][:, None] * trans * after
        back[t] = trans @ after
    gamma = a * back
    return statistics(x, gamma / gamma.sum(1, keepdims=True), pairs)


def maximised(s: np.ndarray, d: int) -> np.ndarray:
    """Parameters (start, trans, means, covs in a row) from added statistics."""
    start, pairs, weight = s[:2] / s[:2].sum(), s[2:6].reshape(2, 2), s[6:8]
    means = s[8 : 8 + 2 * d].reshape(2, d) / weight[:, None]
    covs = s[8 + 2 * d :].reshape(2, d, d) / weight[:, None, None] - np.einsum("si,sj->sij", means, means) + FLOOR * np.eye(d)
    return np.concatenate([start, (pairs / np.maximum(pairs.sum(1, keepdims=True), 1e-12)).ravel(), means.ravel(), covs.ravel()])


def parameters(row, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    p = np.asarray(row, float)
    return p[:2], p[2:6].reshape(2, 2), p[6 : 6 + 2 * d].reshape(2, d), p[6 + 2 * d :].reshape(2, d, d)


def first_guess(x: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Statistics of a chunk whose bars are thought to be in state 1 where ``high``."""
    gamma = np.where(high[:, None] == np.array([False, True]), 0.95, 0.05)
    return statistics(x, gamma, len(x) * np.array([[0.9, 0.1], [0.1, 0.9]]))


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit_regimes(df: DataFrame, features: list[str], slope: str, train: Column, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """(symbol, center, spread, model): each series' scaling and parameters, from its ``train`` bars with all features.

    Bars above the median slope start as one state. Chunks count as series of their own, so the state before a chunk's first
    bar is drawn anew. A series with ten such bars or fewer, or whose features do not vary, has no row.
    """
    d = len(features)
    known = F.coalesce(train, F.lit(False)) & F.lit(True)
    for c in {*features, slope}:
        known = known & F.col(c).isNotNull()
    rows = df.filter(known).select("symbol", "ts", F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(slope).cast("double").alias("s"))
    size_of = [F.avg(F.get("x", F.lit(i))) for i in range(d)], [F.stddev_pop(F.get("x", F.lit(i))) for i in range(d)]
    scale = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.median("s").alias("middle"), F.array(*size_of[0]).alias("center"), F.array(*size_of[1]).alias("spread"))
    scale = _kept(scale.filter("n > 10 and forall(spread, v -> v > 0)").select("symbol", "middle", "center", "spread"), "regime-scales")
    placed = numbered(rows, size).join(scale, "symbol").withColumn("x", F.expr("transform(x, (v, i) -> (v - center[i]) / spread[i])"))
    one = F.array_sort(F.collect_list(F.struct("idx_", "x", (F.col("s") > F.col("middle")).alias("high"))))
    chunks = placed.groupBy("symbol", "chunk_").agg(one.alias("bars"))
    chunks = _kept(chunks.select("symbol", F.expr("flatten(transform(bars, b -> b.x))").alias("x"), F.expr("transform(bars, b -> b.high)").alias("high")), "regime-chunks")

    def measure(with_model: bool):
        def run(batches):
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    x = np.asarray(row.x, float).reshape(-1, d)
                    out.append(expected(x, *parameters(row.model, d)) if with_model else first_guess(x, np.asarray(row.high, bool)))
                yield pd.DataFrame({"symbol": pdf["symbol"], "stats": out})

        return run

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "model": [maximised(np.sum(np.stack(pdf["stats"].to_numpy()), axis=0), d)]})

    kind = dict(df.dtypes)["symbol"]
    model = None
    for k in range(rounds + 1):
        given = chunks.join(model, "symbol") if k else chunks
        stats = given.mapInPandas(measure(k > 0), f"symbol {kind}, stats array<double>")
        # added by place before the shuffle, so that a series costs a row a task and not one a chunk
        flat = stats.select("symbol", F.posexplode("stats").alias("i", "v")).groupBy("symbol", "i").agg(F.sum("v").alias("v"))
        whole = flat.groupBy("symbol").agg(F.expr("transform(array_sort(collect_list(struct(i, v))), x -> x.v)").alias("stats"))
        model = _kept(whole.groupBy("symbol").applyInPandas(best, f"symbol {kind}, model array<double>"), f"regime-round-{k}")
    return scale.join(model, "symbol").select("symbol", "center", "spread", "model")


def filter_step(p: np.ndarray, b: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probabilities of the states after one more bar with densities ``b``."""
    q = (p @ trans) * b
    return q / q.sum()


def label_regimes(df: DataFrame, model: DataFrame, features: list[str], size: int = SIZE) -> DataFrame:
    """``df`` with ``p_high``, the probability of state 1 given the bars up to each; null without a model or with a null feature.

    A bar with a null feature does not move the filter. The first bar is met with the model's first probabilities.
    """
    d, kind, when = len(features), dict(df.dtypes)["symbol"], dict(df.dtypes)["ts"]
    known = F.lit(True)
    for c in features:
        known = known & F.col(c).isNotNull()
    rows = df.filter(known).select("symbol", "ts", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    rows = _kept(numbered(rows, size).join(model, "symbol").withColumn("x", F.expr("transform(x, (v, i) -> (v - center[i]) / spread[i])")).drop("center", "spread"), "regime-bars")

    def densities(pdf: pd.DataFrame):
        start, trans, means, covs = parameters(pdf["model"].iloc[0], d)
        logs = log_densities(np.stack(pdf["x"].to_numpy()), means, covs)
        return start, trans, np.exp(logs - logs.max(1, keepdims=True)) + 1e-300

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx_", ignore_index=True)
        start, trans, b = densities(pdf)
        m = np.eye(2)
        for t in range(len(b)):
            m = (m if pdf["idx_"].iloc[0] + t == 0 else m @ trans) * b[t]
            m = m / m.sum()
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "chunk_": [pdf["chunk_"].iloc[0]], "m": [m.ravel()], "start": [start]})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("chunk_", ignore_index=True), []
        p = np.asarray(pdf["start"].iloc[0], float)
        for m in pdf["m"]:
            out.append(p)
            p = p @ np.asarray(m, float).reshape(2, 2)
            p = p / p.sum()
        return pdf[["symbol", "chunk_"]].assign(came=out)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx_", ignore_index=True)
        _, trans, b = densities(pdf)
        p, out = np.asarray(pdf["came"].iloc[0], float), np.empty(len(pdf))
        for t in range(len(b)):
            p = filter_step(p, b[t], np.eye(2) if pdf["idx_"].iloc[0] + t == 0 else trans)
            out[t] = p[1]
        return pdf[["symbol", "ts"]].assign(p_high=out)

    ends = rows.groupBy("symbol", "chunk_").applyInPandas(step, f"symbol {kind}, chunk_ long, m array<double>, start array<double>")
    carries = ends.groupBy("symbol").applyInPandas(carry, f"symbol {kind}, chunk_ long, came array<double>")
    found = rows.join(carries, ["symbol", "chunk_"]).groupBy("symbol", "chunk_").applyInPandas(fill, f"symbol {kind}, ts {when}, p_high double")
    return df.join(found, ["symbol", "ts"], "left").select(*df.columns, "p_high")


def causal_regimes(df: DataFrame, features: list[str], slope: str = "slope", share: float = 0.5, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with ``up``: whether the bar's regime is the one of higher slope, null in the first ``share`` of a series' bars.

    Those early bars fit the model and decide by their median slope which state is the higher one; no label sees a later bar.
    """
    totals = df.groupBy("symbol").agg(F.count("*").alias("total_"))
    rows = _kept(numbered(df, size).join(totals, "symbol").withColumn("early_", F.col("idx_") < F.floor(F.col("total_") * share)).drop("idx_", "chunk_", "total_"), "regime-input")
    labelled = _kept(label_regimes(rows, fit_regimes(rows, features, slope, F.col("early_"), size, rounds), features, size), "regime-labels")
    state = F.col("p_high") > 0.5
    middle = labelled.filter("early_ and p_high is not null").groupBy("symbol").agg(F.median(F.when(state, F.col(slope))).alias("high_"), F.median(F.when(~state, F.col(slope))).alias("low_"))
    up = F.when(~F.col("early_"), state == F.coalesce(F.col("high_") > F.col("low_"), F.lit(True)))
    return labelled.join(middle, "symbol", "left").withColumn("up", up).select(*df.columns, "up")
