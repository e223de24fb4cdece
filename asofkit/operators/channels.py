"""Pivot-anchored regression channels.

Swings are found natively: a high or low that no bar within ten on either side ties or exceeds, known ten bars later. The channel runs from its anchor to the bar at hand, and moves its anchor when
the close breaks out of its band, so it depends on its own past and is a grouped map. Between two breakouts the anchor stands still, so whole stretches are fitted at once.

Defined cases: fewer than three bars in a channel give zeros; a series without a swing has no channel; a fit without spread has z 0. No row sees a later bar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values
PIVOT_BARS, BAND, LEAST_FIT, LEAST_BARS, MOST_Z, MOST_BARS = 10, 1.96, 0.50, 5, 10.0, 250
STRETCH = 64


def confirmed_swings(bars: DataFrame, *, key: str, order: str, pivot: int = PIVOT_BARS) -> DataFrame:
    """Adds ``at`` (number of the bar), ``swing_high`` and ``swing_low``: the numbers of the latest swings that are known at the bar."""
    w = W.partitionBy(key).orderBy(order)
    around, upto = w.rowsBetween(-pivot, pivot), w.rowsBetween(W.unboundedPreceding, 0)
    x = bars.withColumn("at", (F.row_number().over(w) - 1).cast("int"))
    whole = F.count(F.lit(1)).over(around) == 2 * pivot + 1
    alone = lambda c, f: whole & (F.col(c) == f(c).over(around)) & (F.size(F.filter(F.collect_list(c).over(around), lambda v: v == F.col(c))) == 1)
    x = x.withColumns({"__high": F.when(alone("high", F.max), F.col("at")), "__low": F.when(alone("low", F.min), F.col("at"))})
    x = x.withColumns({"__high": F.lag("__high", pivot).over(w), "__low": F.lag("__low", pivot).over(w)})
    return x.withColumns({"swing_high": F.last("__high", ignorenulls=True).over(upto), "swing_low": F.last("__low", ignorenulls=True).over(upto)}).drop("__high", "__low")


def fits(close: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slope over the mean, correlation with time, deviations of the last close from the line) of ``close[first..last]``, side by side."""
    size = last - first + 1
    k = np.arange(MOST_BARS)  # one width for all, so that sums round alike wherever a stretch begins
    inside = k < size[:, None]
    y = np.where(inside, close[np.minimum(first[:, None] + k, len(close) - 1)], 0.0)
    mean = y.sum(axis=1) / size
    dx, dy = np.where(inside, k - (size[:, None] - 1) / 2, 0.0), np.where(inside, y - mean[:, None], 0.0)
    sxx, sxy, syy = (dx * dx).sum(axis=1), (dx * dy).sum(axis=1), (dy * dy).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(sxx > 0, sxy / sxx, 0.0)
        r = np.where((sxx > 0) & (syy > 0), sxy / np.sqrt(sxx * syy), 0.0)
        rest = dy - slope[:, None] * dx
        sigma = np.sqrt((rest * rest).sum(axis=1) / (size - 1))
        z = np.where(sigma > 0, (close[last] - mean - slope * (size - 1) / 2) / sigma, 0.0)
        return np.where(mean != 0, slope / mean, 0.0), r, np.clip(z, -MOST_Z, MOST_Z)


def channel(close: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Rows of (bars, slope, r, z, breakout); ``high`` and ``low`` are the latest known swings, -1 for none."""
    n, out = len(close), np.zeros((len(close), 5))
    known = np.maximum(high, low)
    at = int((known >= 0).argmax()) if (known >= 0).any() else n
    anchor, above, below = (int(known[at]) if at < n else 0), False, False
    while at < n:
        rows = np.arange(at, min(at + STRETCH, n))
        first = np.maximum(anchor, rows - MOST_BARS + 1)
        size = rows - first + 1
        slope, r, z = fits(close, first, rows)
        real = size >= 3
        sure = real & (size >= LEAST_BARS) & (np.abs(r) >= LEAST_FIT)
        up, down = sure & (z > BAND), sure & (z < -BAND)
        rises, falls = up & ~np.append(above, up[:-1]), down & ~np.append(below, down[:-1])
        breaks = np.where(rises, 1.0, np.where(falls, -1.0, 0.0))
        end = int((breaks != 0).argmax()) if breaks.any() else len(rows) - 1
        done = slice(0, end + 1)
        out[rows[done]] = np.where(real[done, None], np.stack((size, slope, r, z, breaks), axis=1)[done], 0.0)
        above, below = bool(up[end]), bool(down[end])
        if breaks[end]:
            # from the latest opposite swing, if it lies in the channel and has a fit of its own; else anew from here
            here, swing = int(rows[end]), int(low[rows[end]] if breaks[end] > 0 else high[rows[end]])
            inside = first[end] < swing < here
            good = inside and here - swing >= 2 and abs(fits(close, np.array([swing]), np.array([here]))[1][0]) >= LEAST_FIT
            anchor = swing if good else here
        at = int(rows[end]) + 1
    return out


def channels(bars: DataFrame, *, key: str = "symbol", order: str = "session") -> DataFrame:
    """``key, order, chan_bars, chan_slope, chan_r, chan_z, chan_breakout`` of every bar."""
    kinds, names = dict(bars.dtypes), ["chan_bars", "chan_slope", "chan_r", "chan_z", "chan_breakout"]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        swing = lambda c: pdf[c].fillna(-1).to_numpy(dtype=int)
        found = channel(pdf["close"].to_numpy(dtype=float), swing("swing_high"), swing("swing_low"))
        return pd.DataFrame(found, columns=names).assign(**{key: pdf[key].to_numpy(), order: pdf[order].to_numpy()})[[key, order, *names]]

    x = confirmed_swings(bars.select(key, order, "high", "low", "close"), key=key, order=order)
    return x.select(key, order, "close", "at", "swing_high", "swing_low").groupBy(key).applyInPandas(each, f"{key} {kinds[key]}, {order} {kinds[order]}, " + ", ".join(f"{c} double" for c in names))
