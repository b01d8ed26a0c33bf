"""Wavelet smoothing of whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The Daubechies low-pass filter with four vanishing moments.
DB4 = np.array([0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278])
HIGH = DB4[::-1] * np.array([1, -1] * 4)


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (np.arange(0, len(x), 2)[:, None] + np.arange(8)[None, :]) % len(x)
    return x[at] @ DB4, x[at] @ HIGH


def _merge(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    n = 2 * len(a)
    at = (np.arange(0, n, 2)[:, None] + np.arange(8)[None, :]) % n
    x = np.zeros(n)
    np.add.at(x, at, a[:, None] * DB4 + d[:, None] * HIGH)
    return x


def soft_smooth(x: np.ndarray, levels: int = 3, threshold: float = 0.5) -> np.ndarray:
    """``x`` with its details at ``levels`` levels shrunk by ``threshold``; extended symmetrically to a multiple of 2^levels."""
    n, step = len(x), 1 << levels
    total = max(8 * step, -(-n // step) * step)
    ext = np.pad(x, (0, total - n), mode="symmetric") if n else x
    details = []
    for _ in range(levels if n else 0):
        ext, d = _split(ext)
        details.append(np.sign(d) * np.maximum(np.abs(d) - threshold, 0))
    for d in reversed(details):
        ext = _merge(ext, d)
    return ext[:n]


def wavelet_smooth(df: DataFrame, column: str = "high") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        return pdf.assign(smooth=soft_smooth(pdf[column].to_numpy(float)))

    return df.groupBy("symbol").applyInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", smooth double")
