"""Quarter plans and vintages on literal filings."""

import datetime as dt

import pytest

from asofkit.operators import vintages

FACTS = "symbol string, start date, end date, value double, form string, accession string, filed date"


def day(text):
    return dt.date.fromisoformat(text)


def facts(spark, *rows):
    return spark.createDataFrame([("x", day(s), day(e), float(v), form, a, day(f)) for s, e, v, form, a, f in rows], FACTS)


Y = "2023-01-01"
YEAR = [
    (Y, "2023-03-31", 10, "10-Q", "q1", "2023-05-01"), (Y, "2023-06-30", 30, "10-Q", "q2", "2023-08-01"), (Y, "2023-09-30", 60, "10-Q", "q3", "2023-11-01"), (Y, "2023-12-31", 100, "10-K", "k", "2024-02-01"),
]


def test_chain_of_a_year(spark):
    got = {(r["fiscal_year"], r["fiscal_quarter"]): r for r in vintages.quarterly_vintages(facts(spark, *YEAR)).collect()}
    assert {k: (r["value"], r["method"], r["inputs"], r["filed"]) for k, r in got.items()} == {
        (2023, 1): (10.0, "direct", ["q1"], day("2023-05-01")), (2023, 2): (20.0, "ytd_diff", ["q1", "q2"], day("2023-08-01")),
        (2023, 3): (30.0, "ytd_diff", ["q2", "q3"], day("2023-11-01")), (2023, 4): (40.0, "fy_minus_9m", ["q3", "k"], day("2024-02-01")),
    }


def test_a_gap_is_not_bridged(spark):
    plans = vintages.quarter_plans(facts(spark, YEAR[0], *YEAR[2:])).collect()
    assert sorted((str(r["start"]), r["fiscal_quarter"]) for r in plans) == [("2023-01-01", 1), ("2023-10-01", 4)]


def test_the_shorter_leg_alone_gives_no_new_value(spark):
    again = (Y, "2023-09-30", 70, "10-Q/A", "q3a", "2024-03-01")
    rows = vintages.quarterly_vintages(facts(spark, *YEAR, again)).filter("fiscal_quarter = 4").collect()
    assert [(r["vintage"], r["value"]) for r in rows] == [(0, 40.0)]
    longer = (Y, "2023-12-31", 100, "10-K/A", "ka", "2024-04-01")  # now both legs are read anew
    rows = vintages.quarterly_vintages(facts(spark, *YEAR, again, longer)).filter("fiscal_quarter = 4").orderBy("vintage").collect()
    assert [(r["vintage"], r["value"], r["accession"]) for r in rows] == [(0, 40.0, "k"), (1, 30.0, "ka")]


def test_confirmations_and_mismatch(spark):
    direct = ("2023-04-01", "2023-06-30", 25, "10-Q", "d", "2023-09-01")
    repeat = (Y, "2023-03-31", 10, "10-Q", "q1b", "2023-08-02")
    got = vintages.quarterly_vintages(facts(spark, *YEAR, direct, repeat)).orderBy("start", "vintage").collect()
    assert got[0]["confirmed_by"] == ["q1", "q1b"] and got[0]["vintage"] == 0
    assert [(r["value"], r["method"], r["flag"]) for r in got[1:3]] == [(20.0, "ytd_diff", None), (25.0, "direct", "direct_vs_ytd_diff_mismatch_0.200")]


def test_a_trailing_year_in_a_quarterly_report_starts_no_fiscal_year(spark):
    trailing = ("2022-07-01", "2023-06-30", 90, "10-Q", "t", "2023-08-01")
    assert {str(r[0]) for r in vintages.fiscal_year_starts(facts(spark, *YEAR, trailing)).select("fy_start").collect()} == {"2023-01-01", "2024-01-01"}


def test_acceleration_waits_for_the_next_quarter(spark):
    quarters = [("2022-01-01", "2022-03-31"), ("2022-04-01", "2022-06-30"), ("2023-01-01", "2023-03-31"), ("2023-04-01", "2023-06-30")]
    rows = [(s, e, v, "10-Q", f"a{k}", str(day(e) + dt.timedelta(40))) for k, ((s, e), v) in enumerate(zip(quarters, (10, 10, 20, 40)))]
    ask = spark.createDataFrame([("x", day("2023-06-01")), ("x", day("2024-01-01")), ("y", day("2023-06-01"))], "symbol string, decision date")
    got = {(r["symbol"], str(r["decision"])): r for r in vintages.next_quarter_acceleration(ask, facts(spark, *rows)).collect()}
    assert got["x", "2023-06-01"]["acceleration"] == pytest.approx(0.6931471805599453) and str(got["x", "2023-06-01"]["known_on"]) == "2023-08-09"
    assert got["x", "2024-01-01"]["acceleration"] is None and got["y", "2023-06-01"]["last_end"] is None


def test_annual_vintages(spark):
    again = (Y, "2023-12-31", 100, "10-K/A", "ka", "2024-04-01")
    other = (Y, "2023-12-31", 110, "10-K/A", "kb", "2024-06-01")
    rows = vintages.annual_vintages(facts(spark, *YEAR, again, other)).orderBy("vintage").collect()
    assert [(r["vintage"], r["value"], r["accession"], r["confirmed_by"], r["fiscal_year"]) for r in rows] == [(0, 100.0, "k", ["k", "ka"], 2023), (1, 110.0, "kb", ["kb"], 2023)]
