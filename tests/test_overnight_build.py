"""Stitched overnight sessions on literal bars."""

import datetime as dt

import pytest

from asofkit.operators import overnight_build as ob

BARS = "contract string, session date, minute int, open double, high double, low double, close double, volume double, ts string"
D = dt.date(2024, 3, 5)


def bar(contract, minute, volume=1.0, price=10.0, session=D):
    return (contract, session, minute, price, price, price, price, None if volume is None else float(volume), "x")


def judged(spark, rows):
    return sorted((str(r["session"]), r["contract"], r["minute"], r["reason"]) for r in ob.judged_bars(spark.createDataFrame(rows, BARS)).collect())


def test_clock_of_sessions(spark):
    stamps = ["2024-03-04 22:59:00", "2024-03-04 23:00:00", "2024-03-05 20:55:00", "2024-03-05 21:00:00", "2024-03-08 23:30:00", "2024-03-10 22:05:00", "2024-07-01 22:00:00", None]
    rows = ob.session_minutes(spark.createDataFrame([(dt.datetime.fromisoformat(s) if s else None,) for s in stamps], "ts timestamp")).collect()
    assert [(str(r["session"]), r["minute"]) for r in rows] == [("2024-03-05", 0), ("2024-03-05", 1315), ("2024-03-11", 30), ("2024-03-11", 5), ("2024-07-02", 0)]


def test_the_contract_that_trades_most_gives_the_session(spark):
    rows = [bar("H", 0, 5), bar("H", 1315, 5), bar("M", 0, 4), bar("M", 700, 9), bar("M", 1315, None), bar("M", 1316, 500)]
    assert judged(spark, rows) == [("2024-03-05", "M", m, None) for m in (0, 700, 1315)]
    tie = [bar("M", 0, 5), bar("M", 1315, 5), bar("H", 0, 5), bar("H", 1315, 5), bar("H", 0, 5)]
    assert judged(spark, tie) == [("2024-03-05", "H", 0, None), ("2024-03-05", "H", 1315, None)]  # a repeat adds no volume


def test_reasons_and_refusals(spark):
    later, last = D + dt.timedelta(1), D + dt.timedelta(2)
    rows = [bar("H", 61), bar("H", 1315), bar("H", 60, session=later), bar("H", 1310, session=later), bar("H", 60, session=last), bar("H", 1315, session=last)]
    told = ob.session_verdicts(ob.judged_bars(spark.createDataFrame(rows, BARS))).collect()
    assert {str(r["session"]): (r["reason"], r["bars"]) for r in told} == {"2024-03-05": ("evening missing", 2), "2024-03-06": ("no settlement bar", 2), "2024-03-07": (None, 2)}
    assert len(judged(spark, [*rows, bar("H", 1310, price=11.0, session=later)])) == 6  # differing repeats of a dropped session do not matter
    with pytest.raises(Exception, match="bars of one minute differ: 2024-03-07 H"):
        ob.judged_bars(spark.createDataFrame([*rows, bar("H", 60, price=11.0, session=last)], BARS)).collect()
    assert judged(spark, []) == []


def test_one_shuffle_and_the_splits(spark):
    plan = ob.judged_bars(spark.createDataFrame([bar("H", 0)], BARS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    days = lambda n: spark.createDataFrame([(D + dt.timedelta(k),) for k in range(n)], "session date")
    assert [(r["stage"], r["sessions"]) for r in ob.require_sessions(days(60)).collect()] == [("discovery", 36), ("validation", 15), ("holdout", 9)]
    with pytest.raises(Exception, match="too few complete sessions: 59"):
        ob.require_sessions(days(59)).collect()
