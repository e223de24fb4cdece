"""Recursions that no bounded window expresses: exponential averages, RSI, Wilder's ADX.

Each runs as a grouped map over one key's ordered series; keys run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """Seeded by the mean of the first ``span`` values; NaN before."""
    out = np.full(len(x), np.nan)
    if len(x) < span:
        return out
    a, value = 2 / (span + 1), float(x[:span].mean())
    out[span - 1] = value
    for i in range(span, len(x)):
        value += a * (x[i] - value)
        out[i] = value
    return out


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    """Wilder's relative strength; without losses it is 100, or 50 if nothing moved."""
    out = np.full(len(close), np.nan)
    if len(close) <= n:
        return out
    change = np.diff(close)
    gain, loss = np.maximum(change, 0), np.maximum(-change, 0)
    g, l_ = gain[:n].mean(), loss[:n].mean()
    for i in range(n, len(close)):
        if i > n:
            g, l_ = (g * (n - 1) + gain[i - 1]) / n, (l_ * (n - 1) + loss[i - 1]) / n
        out[i] = 100 - 100 / (1 + g / l_) if l_ > 0 else (100.0 if g > 0 else 50.0)
    return out


def _wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's average, seeded by the mean of the first n values that are known; NaN before."""
    out, known = np.full(len(x), np.nan), np.flatnonzero(~np.isnan(x))
    if len(known) < n:
        return out
    at, value = known[n - 1], float(x[known[:n]].mean())
    out[at] = value
    for i in range(at + 1, len(x)):
        value += (x[i] - value) / n
        out[i] = value
    return out


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    """Wilder's average directional index; a series that does not move has 0."""
    if len(close) < 2:
        return np.full(len(close), np.nan)
    up, down = np.diff(high), -np.diff(low)
    moves = [np.where((a > b) & (a > 0), a, 0.0) for a, b in ((up, down), (down, up))]
    true_range = np.maximum.reduce([high[1:] - low[1:], np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])])
    plus, minus, size = (_wilder(np.concatenate(([np.nan], x)), n) for x in (*moves, true_range))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = plus / size, minus / size
        dx = np.where(np.isnan(size), np.nan, np.where((size > 0) & (a + b > 0), 100 * np.abs(a - b) / (a + b), 0.0))
    return _wilder(dx, n)


def indicators(bars: DataFrame, *, keys: list[str], order: str, close: str = "close") -> DataFrame:
    """EMA 12 and 26, MACD histogram over price, RSI 2 and 14, ADX 14; NULL until defined."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[close].to_numpy(dtype=float)
        fast, slow = ema(x, 12), ema(x, 26)
        macd = fast - slow
        signal = np.full(len(x), np.nan)
        if len(x) >= 26:
            signal[25:] = ema(macd[25:], 9)
        return pdf[[*keys, order]].assign(ema_12=fast, ema_26=slow, macd_hist=(macd - signal) / x, rsi_2=rsi(x, 2), rsi_14=rsi(x, 14), adx_14=adx(pdf["high"].to_numpy(dtype=float), pdf["low"].to_numpy(dtype=float), x, 14))

    types = dict(bars.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in [*keys, order]] + [f"{c} double" for c in ("ema_12", "ema_26", "macd_hist", "rsi_2", "rsi_14", "adx_14")])
    return bars.select(*keys, order, close, "high", "low").groupBy(*keys).applyInPandas(each, schema)
