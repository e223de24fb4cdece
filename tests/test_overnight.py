"""Overnight structures: every reason for no trade, exits against hand-worked values, and signals that see nothing behind their entry."""

import math
from datetime import date, timedelta

import pytest

from asofkit.operators import overnight as on

CLOCK = on.Clock(latest_first=10, morning=30, settlement=40, floor=0)
ALWAYS = on.Candidate("always", 10, "call_debit", 10, 0, lambda v: v.price_at(10).isNotNull())
DAY = date(2024, 1, 1)


def bars(spark, days):
    rows = [("x", DAY + timedelta(days=k), m, float(p), p + 1.0, p - 1.0, float(p)) for k, prices in enumerate(days) for m, p in prices.items()]
    return spark.createDataFrame(rows, "symbol string, session date, minute int, open double, high double, low double, close double")


def run(spark, days, candidates, exits, decay=None):
    s = on.sessions(bars(spark, days), CLOCK, (0, 10, 30), window=2, decay=decay)
    rows = on.trades(s, candidates, exits, CLOCK, cost=0.05, premium=1.0, keep=["symbol", "session"]).collect()
    return {((r["session"] - DAY).days, r["label"], r["exit"]): r for r in rows}


FULL = {0: 100, 10: 102, 20: 101, 30: 103, 40: 106}


def less(*minutes):
    return {m: p for m, p in FULL.items() if m not in minutes}


def test_every_reason_for_no_trade_and_the_value_of_each_exit(spark):
    days = [FULL, FULL, less(40), FULL, less(10), less(30), FULL, less(0, 10)]
    got = run(spark, days, [ALWAYS], (on.SETTLEMENT, on.MORNING, on.NEXT))
    skips = {e: [got[k, "always", e]["skip"] for k in range(8)] for e in (on.SETTLEMENT, on.MORNING, on.NEXT)}
    assert skips[on.SETTLEMENT] == ["vol_warmup", "vol_warmup", "incomplete_session", None, "missing_entry_bar", None, None, "incomplete_session"]
    assert skips[on.MORNING][5] == "missing_morning_bar" and skips[on.MORNING][6] is None
    assert skips[on.NEXT][6] == "no_next_session" and skips[on.NEXT][3] is None
    r = got[3, "always", on.SETTLEMENT]
    # long 100, short 110: the entry of 102 lies on the grid at 100, the settlement of 106 pays 6
    assert r["net"] == pytest.approx((6 - r["debit"]) / 10 - 0.05) and 2 < r["debit"] < 4
    later = got[3, "always", on.NEXT]
    assert later["debit"] > 0 and later["net"] == pytest.approx((6 - later["debit"]) / 10 - 0.05)


def test_volatility_is_that_of_earlier_complete_sessions_and_the_latest_weighs_most(spark):
    calm, wild = FULL, FULL | {20: 130}
    square = lambda p: sum(math.log(p[b] / p[a]) ** 2 for a, b in ((10, 20), (20, 30), (30, 40)))
    for decay, weight in ((None, 1.0), (0.5, 0.5)):
        s = on.sessions(bars(spark, [calm, wild, less(40), FULL]), CLOCK, (10,), window=2, decay=decay)
        found = {(r["session"] - DAY).days: r["var_10"] for r in s.collect()}
        want = (square(wild) + weight * square(calm)) / (1 + weight)
        assert found[0] is None and found[1] is None
        assert found[2] == pytest.approx(want) and found[3] == pytest.approx(want)


def test_what_comes_after_the_entry_changes_neither_signal_nor_price(spark):
    peeks = [
        ALWAYS, on.Candidate("touch", 10, "put_credit", 5, 0, lambda v: v.first_touch(2.0, 0).isNotNull()), on.Candidate("later", 10, "put_debit", 5, 0, lambda v: v.price_at(20).isNotNull()),
        on.Candidate("prior", 10, "call_credit", 5, 0, lambda v: v.from_prior_close(10) < 0),
    ]
    base = run(spark, [FULL] * 4, peeks, (on.SETTLEMENT,))
    moved = run(spark, [FULL] * 3 + [FULL | {20: 150, 30: 60, 40: 90}], peeks, (on.SETTLEMENT,))
    for label in ("always", "touch", "later", "prior"):
        a, b = base[3, label, on.SETTLEMENT], moved[3, label, on.SETTLEMENT]
        assert (a["selected"], a["debit"]) == (b["selected"], b["debit"])
    assert [base[3, c, on.SETTLEMENT]["selected"] for c in ("always", "touch", "later", "prior")] == [True, True, False, True]


def test_a_structure_that_is_no_index_vertical_is_an_error(spark):
    with pytest.raises(Exception, match="no index vertical"):
        run(spark, [FULL] * 3, [on.Candidate("wide", 10, "call_debit", 60, 0, ALWAYS.signal)], (on.SETTLEMENT,))


def test_a_candidate_without_trades_is_rejected_with_every_gate(spark):
    rows = spark.createDataFrame([("x", "never", "discovery", DAY, False, 10.0, 3.0, 0.1, None), ("x", "never", "discovery", DAY, False, 10.0, None, None, "vol_warmup")], "symbol string, label string, split string, session date, selected boolean, width double, debit double, net double, skip string")
    r = on.evaluate(rows, ["symbol", "label", "split"], cost=0.05, seed="s", resamples=20).collect()[0]
    assert (r["eligible_sessions"], r["signal_trades"], r["signal_weeks"], r["net_mean"], r["control_mean"]) == (1, 0, 0, None, 0.1)
    assert (r["gate_penalty"], r["status"], r["score"], r["skipped"]) == (25.0, "rejected", -25.0, "vol_warmup:1") and not any(r[g] for g in on.GATES)
