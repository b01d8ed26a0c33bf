"""Discrete quantiles of long rolling windows, by ranks instead of a sort per row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import chunks


class RankIndex:
    """Order statistics of any slice of an array: ranks stored bit by bit, each level split stably into zeros and ones.

    A level keeps the running count of zeros; the k-th smallest of a slice follows its bits from the highest one, so a
    query costs as many steps as ranks have bits, and all queries take each step together.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values, ranks = np.unique(values, return_inverse=True)
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in range(max(1, int(len(self.values) - 1).bit_length()) - 1, -1, -1):
            zero = (ranks >> bit & 1) == 0
            self.levels.append((bit, np.concatenate(([0], np.cumsum(zero)))))
            ranks = np.concatenate((ranks[zero], ranks[~zero]))

    def smallest(self, k: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of each slice [start, stop), none of them empty."""
        k, start, stop, rank = k.copy(), start.copy(), stop.copy(), np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b, total = zeros[start], zeros[stop], zeros[-1]
            low = k < b - a
            rank += np.where(low, 0, 1 << bit)
            k = np.where(low, k, k - (b - a))
            start, stop = np.where(low, a, total + start - a), np.where(low, b, total + stop - b)
        return self.values[rank]


def rolling_quantiles(values: np.ndarray, n: int, shares: list[float]) -> list[np.ndarray]:
    """Discrete quantiles of the last ``n`` values at each place (fewer at the start): element ceil(share * count)."""
    index, stop = RankIndex(values), np.arange(1, len(values) + 1)
    start = np.maximum(stop - n, 0)
    return [index.smallest(np.maximum(np.ceil(np.round(p * (stop - start), 9)).astype(np.int64) - 1, 0), start, stop) for p in shares]


def rolling_credible_interval(df: DataFrame, n: int, mass: float = 0.9, value: str = "profit", order: tuple = ("matured", "ts"), keys: tuple = ("symbol",)) -> DataFrame:
    """``df``'s rows of known ``value`` with lower, upper and loss_margin of the last ``n`` of them, the row's included.

    In the order of maturing, so that no row sees a profit that was not known yet. A series spreads over its chunks, which
    bring the ``n`` rows before them along. Rows without ``value`` or without a time are left out; ``order`` settles ties.
    """
    edge = (1 - mass) / 2

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        lower, upper = rolling_quantiles(pdf[value].to_numpy(float), n, [edge, 1 - edge])
        return pdf.assign(lower=lower, upper=upper, loss_margin=np.abs(lower))

    known = df.filter(df[value].isNotNull() & df[order[0]].isNotNull())
    return chunks.with_halo(known, n, fill, "lower double, upper double, loss_margin double", keys=keys, order=order)
