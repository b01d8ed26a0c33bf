"""Long series in chunks: numbering, windows with a halo, and recursions as scans of affine steps.

A chunk is so many bars of one series. It is a grouping key of its own, so one long series spreads over many tasks; what a
chunk hands to the next is a few numbers, and only those, a row a chunk, are scanned in one order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch

#: Bars of a chunk, and the days of bars that are numbered together.
SIZE, DAYS = 4096, 90


def schema_of(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], *more])


def numbered(df: DataFrame, size: int = SIZE, days: int = DAYS, keys: tuple = ("symbol",), order: tuple = ("ts",)) -> DataFrame:
    """``df`` with ``idx_``, a bar's place in its series from 0, and ``chunk_``, that by ``size``. The first column of
    ``order`` is a time.

    Two levels: bars are counted by spans of ``days``, these counts, a row a span, are summed up in order, and bars are
    numbered inside their span. No task holds a series.
    """
    df = df.withColumn("span_", F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / (86_400 * days)))
    counts = df.groupBy(*keys, "span_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*keys).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "span_", F.coalesce(before, F.lit(0)).alias("before_"))
    place = F.col("before_") + F.row_number().over(Window.partitionBy(*keys, "span_").orderBy(*order)) - 1
    out = df.join(starts, [*keys, "span_"]).withColumn("idx_", place)
    return out.drop("span_", "before_").withColumn("chunk_", F.expr(f"idx_ div {size}"))


def haloed(rows: DataFrame, halo: int, size: int) -> DataFrame:
    """Numbered rows with ``task_``: each in its chunk, and its last ``halo`` bars in the next one too."""
    also = F.when(F.col("idx_") % size >= size - halo, F.array(F.col("chunk_"), F.col("chunk_") + 1)).otherwise(F.array("chunk_"))
    return rows.withColumn("task_", F.explode(also))


def with_halo(df: DataFrame, halo: int, fill: Callable[[pd.DataFrame], pd.DataFrame], more: str, size: int = SIZE, keys: tuple = ("symbol",), order: tuple = ("ts",)) -> DataFrame:
    """``fill`` of each chunk of ``df`` and the ``halo`` bars before it, in order; only the chunk's own rows are kept.

    For columns ``more`` that depend on a bar and the ``halo`` bars before it. The halo must not be longer than a chunk.
    """
    size = max(size, halo)
    rows = haloed(numbered(df, size, keys=keys, order=order), halo, size)
    cols = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx_", ignore_index=True)
        own = pdf["chunk_"].to_numpy() == pdf["task_"].to_numpy()
        return fill(pdf[cols])[own]

    return rows.groupBy(*keys, "task_").applyInPandas(run, schema_of(df, more))


def local_mean(x: np.ndarray, alpha: float, adjust: bool) -> dict[str, np.ndarray]:
    """Exponential mean of one chunk as an affine step of what came before; NaNs age what they follow.

    Adjusted: ``y`` weighted sum, ``a`` sum of weights of the chunk alone. Else: ``y`` the mean begun at the chunk's first
    value, ``a`` how far a change of that beginning still counts, NaN before it. ``g`` counts the NaNs since the last value.
    """
    f, n = 1 - alpha, len(x)
    y, a, g = np.empty(n), np.empty(n), np.empty(n, np.int64)
    s, w, gap = (0.0, 0.0, 0) if adjust else (np.nan, np.nan, 0)
    for i, v in enumerate(x.tolist()):
        gap = gap + 1 if v != v else 0
        if adjust:
            s, w = (f * s, f * w) if gap else (f * s + v, f * w + 1)
        elif not gap:
            if w != w:
                s, w = v, 1.0
            else:
                o = f ** (1 + int(g[i - 1]))
                s, w = (o * s + alpha * v) / (o + alpha), w * o / (o + alpha)
        y[i], a[i], g[i] = s, w, gap
    return {"y": y, "a": a, "g": g}


def _carries(ends: pd.DataFrame, specs: dict, keys: list[str]) -> pd.DataFrame:
    """What each chunk of a series takes from those before it: a scan of their affine steps in order."""
    ends = ends.sort_values("chunk_", ignore_index=True)
    out = ends[[*keys, "chunk_"]].copy()
    for k, (_, alpha, adjust) in enumerate(specs.values()):
        f, took, shifts = 1 - alpha, [], []
        level, weight, gap = (0.0, 0.0, 0) if adjust else (np.nan, 0.0, 0)
        for n, end, a, g, first, lead in ends[["n", f"y{k}", f"a{k}", f"g{k}", f"first{k}", f"lead{k}"]].itertuples(index=False):
            took.append(level)
            if adjust:
                shifts.append(weight)
                level, weight = end + f**n * level, a + f**n * weight
            elif first != first:
                shifts.append(0.0)
                gap += n
            else:
                o = f ** (gap + int(lead) + 1)
                shift = 0.0 if level != level else (o * level + alpha * first) / (o + alpha) - first
                shifts.append(shift)
                level, gap = end + a * shift, g
        out[f"in{k}"], out[f"shift{k}"] = took, shifts
    return out


def exponential_means(df: DataFrame, specs: dict[str, tuple[str, float, bool]], size: int = SIZE, keys: tuple = ("symbol",)) -> DataFrame:
    """``df`` with exponential means, name -> (column, alpha, adjust): chunks alone, a scan of their ends, then each bar's own.

    A null leaves the mean as it is, but ages it by a step; before the first value the mean is null.
    """
    names = list(specs)
    rows = numbered(df, size, keys=keys)
    extra = ", ".join(f"y{k} double, a{k} double, g{k} long" for k in range(len(specs)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx_", ignore_index=True)
        new = {f"{c}{k}": v for k, (col, alpha, adjust) in enumerate(specs.values()) for c, v in local_mean(pdf[col].to_numpy(float), alpha, adjust).items()}
        return pdf.assign(**new)

    path = scratch(df.sparkSession, "chunk-means")
    rows.groupBy(*keys, "chunk_").applyInPandas(run, schema_of(rows, extra)).write.parquet(path)
    local = df.sparkSession.read.parquet(path)
    local = local.withColumns({f"{c}{k}": F.when(~F.isnan(f"{c}{k}"), F.col(f"{c}{k}")) for k in range(len(specs)) for c in "ya"})
    aggs = [F.count("*").alias("n")]
    for k, (col, _, adjust) in enumerate(specs.values()):
        begun = F.when(F.col(f"a{k}").isNotNull(), F.col("idx_"))
        aggs += [F.max_by(f"{c}{k}", "idx_").alias(f"{c}{k}") for c in "yag"]
        aggs += [F.min_by(F.col(col).cast("double"), begun).alias(f"first{k}"), (F.min(begun) - F.min("idx_")).alias(f"lead{k}")]
    ends = local.groupBy(*keys, "chunk_").agg(*aggs)
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "chunk_ long", *[f"in{k} double, shift{k} double" for k in range(len(specs))]])
    carries = ends.groupBy(*keys).applyInPandas(lambda pdf: _carries(pdf, specs, list(keys)), schema)
    carries = carries.withColumns({f"in{k}": F.when(~F.isnan(f"in{k}"), F.col(f"in{k}")) for k in range(len(specs))})
    out = local.join(carries, [*keys, "chunk_"])
    done = {}
    for k, (_, alpha, adjust) in enumerate(specs.values()):
        y, a, came, shift = (F.col(f"{c}{k}") for c in ("y", "a", "in", "shift"))
        aged = F.pow(F.lit(1 - alpha), F.expr(f"idx_ - chunk_ * {size} + 1"))
        done[names[k]] = F.try_divide(y + aged * came, a + aged * shift) if adjust else F.when(a.isNull(), came).otherwise(y + a * shift)
    return out.withColumns(done).select(*df.columns, *names)


def trend_gains(q: float, r: float, most: int = 10_000) -> np.ndarray:
    """Gains (to level, to trend) of the two-state filter at each observation after the first, until they stop changing.

    Both observations see the level with the same noise, so the filter needs their sum and one gain for both; the gains do
    not depend on what is observed.
    """
    p, out = np.eye(2), []
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0], [1.0, 0.0]])
    while len(out) < most:
        p = f @ p @ f.T + q * np.eye(2)
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r * np.eye(2))
        p = (np.eye(2) - k @ h) @ p
        out.append(k[:, 0])
        if len(out) > 1 and np.abs(out[-1] - out[-2]).max() < 1e-16:
            break
    return np.array(out)


def trend_levels(df: DataFrame, q: float, r: float, size: int = SIZE) -> DataFrame:
    """``df`` with ``trend``, the level of a (level, trend) filter over the observations (ema, wma); null where one is.

    With the gains known, an observation's step is affine in the two states: a chunk composes its steps, the chunks' are
    scanned, and each bar adds what its chunk took from those before.
    """
    gains = trend_gains(q, r)
    seen = numbered(df.filter("ema is not null and wma is not null").select("symbol", "ts", "ema", "wma"), size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx_", ignore_index=True)
        out, at = np.empty((len(pdf), 6)), int(pdf["idx_"].iloc[0])
        m, b = [1.0, 0.0, 0.0, 1.0], [0.0, 0.0]
        for i, z in enumerate((pdf["ema"] + pdf["wma"]).tolist()):
            if at + i == 0:
                m, b = [0.0] * 4, [z / 2, 0.0]
            else:
                k0, k1 = gains[min(at + i - 1, len(gains) - 1)].tolist()
                u, v, w = m[0] + m[2], m[1] + m[3], b[0] + b[1]  # the level foreseen from each part of the state
                m = [u - 2 * k0 * u, v - 2 * k0 * v, m[2] - 2 * k1 * u, m[3] - 2 * k1 * v]
                b = [w + k0 * (z - 2 * w), b[1] + k1 * (z - 2 * w)]
            out[i] = *m, *b
        return pdf.assign(**{c: out[:, j] for j, c in enumerate(("m00", "m01", "m10", "m11", "b0", "b1"))})[["symbol", "ts", "idx_", "chunk_", "m00", "m01", "m10", "m11", "b0", "b1"]]

    def carry(ends: pd.DataFrame) -> pd.DataFrame:
        ends, x, y, rows = ends.sort_values("chunk_"), 0.0, 0.0, []
        for chunk, *e in ends[["chunk_", "m00", "m01", "m10", "m11", "b0", "b1"]].itertuples(index=False):
            rows.append((ends["symbol"].iloc[0], chunk, x, y))
            x, y = e[0] * x + e[1] * y + e[4], e[2] * x + e[3] * y + e[5]
        return pd.DataFrame(rows, columns=["symbol", "chunk_", "x", "y"])

    path = scratch(df.sparkSession, "chunk-trends")
    kinds = dict(df.dtypes)
    steps = ", ".join(f"{c} double" for c in ("m00", "m01", "m10", "m11", "b0", "b1"))
    seen.groupBy("symbol", "chunk_").applyInPandas(run, f"symbol {kinds['symbol']}, ts {kinds['ts']}, idx_ long, chunk_ long, {steps}").write.parquet(path)
    local = df.sparkSession.read.parquet(path)
    ends = local.groupBy("symbol", "chunk_").agg(*[F.max_by(c, "idx_").alias(c) for c in ("m00", "m01", "m10", "m11", "b0", "b1")])
    carries = ends.groupBy("symbol").applyInPandas(carry, f"symbol {kinds['symbol']}, chunk_ long, x double, y double")
    level = F.col("b0") + F.col("m00") * F.col("x") + F.col("m01") * F.col("y")
    found = local.join(carries, ["symbol", "chunk_"]).select("symbol", "ts", level.alias("trend"))
    return df.join(found, ["symbol", "ts"], "left").select(*df.columns, "trend")
