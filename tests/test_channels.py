"""Pivot-anchored channels: literal cases, a bar-by-bar version with a plain regression, and no look into the future."""

import datetime as dt

import numpy as np
import pytest

from asofkit.operators import channels as ch


def frame(spark, close, high=None, low=None):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("S", day(k), float(high[k] if high is not None else c), float(low[k] if low is not None else c), float(c)) for k, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, session date, high double, low double, close double")


def test_a_swing_is_known_ten_bars_later_and_a_tie_is_none(spark):
    close = [10 - abs(k - 15) * 0.1 for k in range(40)]
    got = [(r["at"], r["swing_high"], r["swing_low"]) for r in ch.confirmed_swings(frame(spark, close), key="symbol", order="session").orderBy("session").collect()]
    assert [g[1] for g in got] == [None] * 25 + [15] * 15 and all(g[2] is None for g in got)
    close[16] = close[15]
    assert all(r["swing_high"] is None for r in ch.confirmed_swings(frame(spark, close), key="symbol", order="session").collect())


def test_breakouts_are_edges_and_move_the_anchor():
    n = 60
    line = 100 + np.arange(n) * 1.0 + np.where(np.arange(n) % 2, 0.1, -0.1)
    line[40:43] += 2.0
    high, low = np.full(n, -1), np.full(n, -1)
    low[15:] = 5
    out = ch.channel(line, high, low)
    assert (out[:15] == 0).all() and out[15, 0] == 11 and out[39, 0] == 35
    assert np.flatnonzero(out[:, 4]).tolist()[:1] == [40] and out[40, 4] == 1.0  # above the band at 40
    assert out[41, 0] == 0 and out[42, 0] == 3  # no swing inside the channel, so it began anew at 40
    low[30:] = 20  # now there is one with a fit of its own
    assert ch.channel(line, high, low)[41, 0] == 22


def bar_by_bar(close, high, low):
    """The definition, one bar and one polynomial fit at a time."""
    out, anchor, was = np.zeros((len(close), 5)), None, 0
    for t in range(len(close)):
        if anchor is None and max(high[t], low[t]) >= 0:
            anchor = max(high[t], low[t])
        anchor = max(anchor, t - 249) if anchor is not None else None
        if anchor is None or t - anchor < 2:
            was = 0
            continue
        y = close[anchor : t + 1]
        slope, level = np.polyfit(np.arange(len(y)), y, 1)
        rest = y - (level + slope * np.arange(len(y)))
        sigma, r = np.sqrt((rest**2).sum() / (len(y) - 1)), np.corrcoef(np.arange(len(y)), y)[0, 1]
        z = np.clip(rest[-1] / sigma, -10, 10)
        now = (1 if z > 1.96 else -1 if z < -1.96 else 0) if len(y) >= 5 and abs(r) >= 0.5 else 0
        edge = now if now != was else 0
        out[t] = len(y), slope / y.mean(), r, z, edge
        was = now
        if edge:
            swing = low[t] if edge > 0 else high[t]
            anchor = swing if anchor < swing < t and abs(np.corrcoef(np.arange(t + 1 - swing), close[swing : t + 1])[0, 1]) >= 0.5 else t
    return out


@pytest.mark.parametrize("seed", range(4))
def test_stretches_equal_bar_by_bar(seed):
    rng = np.random.default_rng(seed)
    n = 900
    close = 100 + np.cumsum(rng.normal(0.02, 1, n)) + rng.normal(0, 0.3, n)
    high, low = (np.maximum.accumulate(np.where(rng.random(n) < 0.05, np.maximum(np.arange(n) - 10, -1), -1)) for _ in "hl")
    got, want = ch.channel(close, high, low), bar_by_bar(close, high, low)
    assert np.allclose(got, want, rtol=1e-7, atol=1e-7) and (got[:, 4] == 1).sum() > 3 and (got[:, 4] == -1).sum() > 3


def test_no_row_sees_later_bars(spark):
    rng = np.random.default_rng(1)
    close = 100 + np.cumsum(rng.normal(0, 1, 200))
    rows = lambda n: [tuple(r) for r in ch.channels(frame(spark, close[:n], close[:n] + 0.5, close[:n] - 0.5)).orderBy("session").collect()]
    whole = rows(200)
    assert rows(120) == whole[:120] and any(r[2] > 0 for r in whole)
