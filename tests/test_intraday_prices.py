"""Sessions at a fixed minute and adjusted prices on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofkit.operators import intraday, prices

BARS = "symbol string, session date, minute int, open double, high double, low double, close double, volume double, extra string"
DAILY = "symbol string, session date, open double, high double, low double, close double, volume bigint, vwap double, trade_count bigint"


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def session(k, close=None, minutes=(570, 595, 600, 625, 630, 955), volume=100.0, symbol="S"):
    """Prices rise by one a bar from 100 + k; the last close may be set."""
    rows = []
    for i, m in enumerate(minutes):
        o = 100.0 + k + i
        c = close if close is not None and i == len(minutes) - 1 else o + 1
        rows.append((symbol, day(k), m, o, max(o, c) + 0.5, min(o, c) - 0.5, c, volume, "x"))
    return rows


def snapshot(spark, rows, **more):
    return {r["session"]: r for r in intraday.intraday_snapshot(spark.createDataFrame(rows, BARS), 630, **more).collect()}


def test_a_session_at_half_past_ten(spark):
    rows = [r for k in range(24) for r in session(k)]
    got = snapshot(spark, rows + rows[:20])  # identical repeats count once
    assert sorted(got) == [day(20), day(21), day(22)]
    r = got[day(20)]
    assert r["session_ret_so_far"] == pytest.approx(124 / 120 - 1, abs=1e-8) and r["or_ret"] == pytest.approx(122 / 120 - 1, abs=1e-8)
    assert r["vwap_dist"] == pytest.approx(124 / ((121 + 122 + 123 + 124) / 4) - 1, abs=1e-8) and r["or_break"] == 1.0 and r["vol_ratio_open"] == 1.0
    assert r["prior_ret_1d"] == pytest.approx(125 / 124 - 1, abs=1e-8) and r["prior_ret_5d"] == pytest.approx(125 / 120 - 1, abs=1e-8) and r["gap_open"] == pytest.approx(120 / 125 - 1, abs=1e-8)
    assert r["next_open_to_close"] == pytest.approx(126 / 124 - 1, abs=1e-8) and r["next_close_to_close"] == pytest.approx(127 / 126 - 1, abs=1e-8) and r["day_of_week"] == day(20).weekday()


def test_later_bars_change_payoffs_alone(spark):
    rows = [r for k in range(24) for r in session(k)]
    other = [r for k in range(24) for r in session(k, close=300.0 if k == 20 else None)]
    a, b = snapshot(spark, rows)[day(20)].asDict(), snapshot(spark, other)[day(20)].asDict()
    assert {k for k in a if a[k] != b[k]} == {"next_open_to_close", "next_close_to_close"}


def test_partial_sessions_count_for_later_ones_but_have_no_row(spark):
    odd = {20: (575, 600, 630, 955), 21: (570, 630, 700), 22: (570, 600, 625, 955), 23: (300, 570, 600, 630, 955, 965)}
    got = snapshot(spark, [r for k in range(25) for r in session(k, minutes=odd.get(k, (570, 595, 600, 625, 630, 955)))])
    assert sorted(got) == [day(23)] and got[day(23)]["session_ret_so_far"] == pytest.approx(126 / 124 - 1, abs=1e-8)
    assert got[day(23)]["prior_ret_1d"] == pytest.approx(126 / 124 - 1, abs=1e-8)


def test_neutral_values_nulls_and_refusals(spark):
    rows = [(s, d, m, 100.0, 100.0, 100.0, 100.0, None, "x") for k in range(22) for s, d, m, *_ in session(k)]
    r = snapshot(spark, rows)[day(20)]
    assert (r["or_break"], r["vol_ratio_open"], r["vwap_dist"], r["rv_5d"]) == (0.5, 1.0, 0.0, 0.0)
    with pytest.raises(Exception, match="bars of one minute differ: S 2024-01-01"):
        snapshot(spark, rows + session(0))
    for bad in (599, 632, 960):
        with pytest.raises(ValueError):
            intraday.intraday_snapshot(spark.createDataFrame(rows, BARS), bad)
    assert snapshot(spark, []) == {}


def daily(k, close, volume=10, trades=5, symbol="S"):
    return (symbol, day(k), close, close, close, close, volume, close, trades)


def test_prices_and_their_audit(spark):
    adjusted = [daily(0, 10.0), daily(1, 10.0, 0, 0), daily(2, 10.1), daily(3, 15.0), daily(4, 15.0, 0, 3), daily(5, 15.1), daily(8, 15.0, 0, None), daily(0, 5.0, None, None, symbol="T")]
    raw = [daily(0, 20.0), daily(2, 20.2), daily(3, 15.0), daily(5, 15.1), daily(9, 1.0), daily(5, 15.0)]
    told = prices.adjusted_prices(spark.createDataFrame(adjusted, DAILY), spark.createDataFrame(raw, DAILY))
    rows = {(r["symbol"], r["session"]): r for r in told.collect()}
    assert len(rows) == 8 and [d for (s, d), r in sorted(rows.items()) if r["untraded"] and s == "S"] == [day(1), day(8)] and rows["T", day(0)]["untraded"]
    assert rows["S", day(0)]["adj_factor"] == 2.0 and rows["S", day(4)]["raw_close"] is None and rows["S", day(5)]["raw_close"] == 15.1
    calendar = spark.createDataFrame([(day(k),) for k in range(8) if k != 5], "day date")
    a = prices.price_audit(told, calendar, day(6)).collect()
    assert len(a) == 1
    a = a[0]
    assert (a["symbol"], a["sessions"], a["first_session"], a["last_session"], a["rows_without_raw_close"]) == ("S", 5, day(0), day(5), 1)
    assert a["missing_sessions"] == [day(1), day(6)] and a["bars_on_non_sessions"] == [day(5)] and (a["untraded"], a["untraded_first"], a["untraded_last"]) == (2, day(1), day(8))
    assert [(r["session"], r["factor_change"], r["raw_close_ratio"]) for r in a["factor_steps"]] == [(day(3), -0.5, 0.7426)]
    assert [r["session"] for r in a["outliers"]] == [day(3)]


def test_two_adjusted_bars_of_a_session_are_refused(spark):
    twice = spark.createDataFrame([daily(0, 10.0), daily(0, 10.0)], DAILY)
    with pytest.raises(Exception, match="more than one daily bar of S on 2024-01-01"):
        prices.adjusted_prices(twice, twice).collect()
    none = spark.createDataFrame([], DAILY)
    assert prices.price_audit(prices.adjusted_prices(none, none), spark.createDataFrame([], "day date")).count() == 0
    assert prices.adjusted_prices(none, twice).select(F.count(F.lit(1))).first()[0] == 0
