"""The sweep of many rules and the ledgers on literal sessions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from asofkit.operators import ledgers, rules

KEYS = ["symbol", "session"]


def bars(spark, closes=None, n=3, skip=()):
    """Sessions of seven bars of an hour; the open of bar k of day i is 100 + i + k."""
    rows = []
    for i in range(n):
        for k in range(7):
            if (i, k) in skip:
                continue
            o = 100.0 + i + k
            close = closes[i] if closes and k == 6 else o + 0.5
            rows.append(("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), 570 + 60 * k, o, max(o, close) + 1, min(o, close) - 1, close, 1))
    return spark.createDataFrame(rows, "symbol string, session date, minute int, open double, high double, low double, close double, volume int")


def document(signal, entry=750, helper="call_debit_spread", width=5, offset=0):
    return json.dumps({"schema_version": 3, "entry_minute": entry, "signal": signal, "structure": {"helper": helper, "width": width, "otm_offset": offset}})


def up(value, minute=690):
    return {"op": "gt", "observation": {"obs": "return_from_open", "minute": minute}, "value": value}


def swept(spark, days, documents):
    judged = rules.judge_proposals(spark.createDataFrame(list(enumerate(documents)), "attempt int, document string"))
    return ledgers.sweep(ledgers.sessions(days, reaches=930), ledgers.frozen_rules(judged), keep=[*KEYS, "bars", "open", "close", "full_day", "sigma"])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_500_rules_in_one_job_need_the_shuffles_of_one(spark):
    days = bars(spark)
    documents = [document({"op": "and", "args": [up(k / 100), up(k / 200, 630)]} if k % 2 else up(k / 100), entry=750 + 60 * (k % 2)) for k in range(500)]
    many, one = (ledgers.fires(swept(spark, days, d), KEYS) for d in (documents, documents[:1]))
    assert exchanges(many) == exchanges(one)
    got = {(r["attempt"], r["session"].day): r["selected"] for r in many.collect()}
    assert len(got) == 1500
    for k in range(500):
        for i in range(3):
            at = lambda m: ((100.0 + i + (m - 570) // 60) / (100.0 + i) - 1) * 100  # noqa: E731, B023
            assert got[k, i + 1] == (at(690) > k / 100 and (k % 2 == 0 or at(630) > k / 200))


def test_what_is_unknown_does_not_fire_and_touches_lie_between(spark):
    days = bars(spark, skip={(1, 2)})
    touch = lambda after, off: {"op": "observed", "observation": {"obs": "first_touch_before_entry", "after_minute": after, "open_offset": off}}
    between = {"op": "gte", "observation": {"obs": "return_between", "start_minute": 630, "end_minute": 690}, "value": 0}
    feature = {"op": "gt", "observation": {"obs": "feature", "family": "portfolio_signal", "metric": "m"}, "value": 0}
    judged = rules.judge_proposals(spark.createDataFrame(list(enumerate([document(s) for s in (up(-50), {"op": "not", "arg": up(-50)}, between, touch(570, 3.4), touch(570, 3.6), touch(690, -1), feature)])), "attempt int, document string"))
    table = ledgers.sessions(days, reaches=930).withColumn("features", F.when(F.dayofmonth("session") == 3, F.create_map(F.lit("portfolio_signal.m"), F.lit(1.0))))
    got = {}
    for r in ledgers.fires(ledgers.sweep(table, ledgers.frozen_rules(judged), keep=KEYS), KEYS).collect():
        got.setdefault(r["attempt"], {})[r["session"].day] = r["selected"]
    assert got[0] == {1: True, 2: False, 3: True} and got[1] == {1: False, 2: True, 3: False} and got[2] == {1: True, 2: False, 3: True}
    assert got[3] == {1: True, 2: False, 3: True}  # the bar at 690 reaches 103.5, and its day 2 has none
    assert not any(got[4].values()) and not any(got[5].values()) and got[6] == {1: False, 2: False, 3: True}


def quotes(spark, rows):
    return spark.createDataFrame([("S", dt.date(2024, 1, d), "C", float(k), m, b, a) for d, k, m, b, a in rows], "symbol string, session date, cp string, strike double, minute int, bid double, ask double")


def test_executable_side_skip_reasons_and_all_legs_or_none(spark):
    days = bars(spark, closes=[200.0, 104.0, 0.5, 200.0, 200.0, 200.0], n=6)
    trades = ledgers.with_structures(swept(spark, days, [document(up(-50))]))
    strikes = {r["session"].day: [g["strike"] for g in r["legs"]] for r in trades.collect()}
    assert strikes[1] == [103.0, 108.0]
    book = [(d, strikes[d][k], 745, 2.0 - k, 2.2 - k) for d in (1, 2) for k in (0, 1)]
    book += [(3, strikes[3][0], 745, 2.0, 2.2), (3, strikes[3][1], 700, 1.0, 1.2)]  # the second leg is old
    book += [(4, strikes[4][0], 745, 2.0, 2.2), (4, strikes[4][1], 745, 1.3, 1.2), (4, strikes[4][1], 755, 1.0, 1.2)]  # crossed; later quotes are not seen
    book += [(5, strikes[5][0], 750, 9.0, 9.2), (5, strikes[5][1], 740, 1.0, 1.2)]  # debit over the width
    evidence = ledgers.leg_evidence(trades, quotes(spark, book), keys=KEYS)
    assert {(r["session"].day, r["at"]): r["chosen"] for r in evidence.collect() if r["chosen"] is not None and r["session"].day == 1} == {(1, 0): 2.2, (1, 1): 1.0}
    rows = {r["session"].day: r for r in ledgers.ledger(ledgers.executable(trades, evidence, keys=KEYS), KEYS).collect()}
    assert (rows[1]["debit"], rows[1]["settlement"], rows[1]["pnl"]) == (pytest.approx(1.2), 5.0, pytest.approx(3.8)) and rows[2]["settlement"] == 0.0
    assert [rows[d]["skip_reason"] for d in range(1, 7)] == [None, None, ledgers.TOO_OLD, ledgers.CROSSED, ledgers.DEGENERATE, ledgers.NO_QUOTE]
    assert all(rows[d][c] is None for d in range(3, 7) for c in ("debit", "pnl", "width", "settlement"))


def test_trades_need_both_legs_within_15_minutes_and_within_the_payoff(spark):
    days = bars(spark, n=4)
    trades = ledgers.with_structures(swept(spark, days, [document(up(-50)), document(up(50))]))
    p = [(d, k, m, b, b) for d, k, m, b in [(1, 103, 735, 2.0), (1, 103, 700, 9.0), (1, 108, 750, 1.0), (2, 104, 734, 2.0), (2, 109, 750, 1.0), (3, 105, 750, 1.0), (3, 110, 750, 2.0)]]
    prints = quotes(spark, p).withColumnRenamed("bid", "price").drop("ask")
    got = {(r["attempt"], r["session"].day): r for r in ledgers.ledger(ledgers.quoted(trades, prints, keys=KEYS), KEYS).collect()}
    assert got[0, 1]["debit"] == 1.0 and got[0, 1]["selected"] and not got[1, 1]["selected"] and got[1, 1]["priced"]
    assert [got[0, d]["skip_reason"] for d in (2, 3, 4)] == [ledgers.NO_TRADE, ledgers.NO_BOUNDS, ledgers.NO_TRADE]
    assert got[1, 2]["skip_reason"] is None and got[1, 2]["control_reason"] == ledgers.NO_TRADE  # a control keeps its denominator


def test_states_of_the_evidence(spark):
    def outcomes(attempt, n, pnl, priced=lambda i: True):
        first = dt.date(2024, 1, 1)
        return [(attempt, first + dt.timedelta(days=3 * i), True, priced(i), 1.0, 5.0 if priced(i) else None, pnl if priced(i) else None, 5.0, 0.0, 5.0 if pnl > 0 else 0.0) for i in range(n)]

    rows = outcomes(1, 40, 2.0) + outcomes(2, 40, -1.0) + outcomes(3, 29, 2.0) + outcomes(4, 60, 2.0, lambda i: i % 2 == 0) + outcomes(5, 40, 2.0) + outcomes(6, 40, 0.05)
    df = spark.createDataFrame(rows, "attempt int, session date, selected boolean, priced boolean, debit double, width double, pnl double, best_settlement double, worst_settlement double, settlement double")
    got = {r["attempt"]: r for r in ledgers.evidence_block(df, entitled=F.col("attempt") != 5, resamples=50).collect()}
    assert {a: r["state"] for a, r in got.items()} == {1: "passed", 2: "failed", 3: "insufficient", 4: "insufficient", 5: "unavailable", 6: "failed"}
    assert got[1]["base_lower_bound"] == pytest.approx(37) and got[1]["coverage"] == 1 and got[3]["base_lower_bound"] is None


def test_no_rules_and_too_many(spark):
    days = bars(spark)
    assert ledgers.fires(swept(spark, days, ["{}"]), KEYS).collect() == []
    judged = rules.judge_proposals(spark.createDataFrame([(k, document(up(k))) for k in range(3)], "attempt int, document string"))
    with pytest.raises(ValueError):
        ledgers.frozen_rules(judged, most=2)
