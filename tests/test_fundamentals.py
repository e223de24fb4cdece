"""The store of filed facts: appends give what one build gives, tags, reruns, and plans that stay small."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from asofkit.operators import fundamentals as fu

FILED = "symbol string, tag string, start date, end date, value double, form string, accession string, filed date, note string"


def day(text):
    return dt.date.fromisoformat(text)


def year(symbol, y, factor=1.0, tag="A", mark=""):
    periods = [("03-31", 10, "10-Q", f"{y}-05-01"), ("06-30", 30, "10-Q", f"{y}-08-01"), ("09-30", 60, "10-Q", f"{y}-11-01"), ("12-31", 100, "10-K", f"{y + 1}-02-01")]
    return [(symbol, tag, day(f"{y}-01-01"), day(f"{y}-{end}"), value * factor, form, f"{symbol}{y}{k}{mark}", day(filed), "n") for k, (end, value, form, filed) in enumerate(periods)]


ROWS = [r for s in "xyz" for k, y in enumerate((2021, 2022, 2023)) for r in year(s, y, 1.1**k)] + [("x", "A", day("2022-01-01"), day("2022-12-31"), 120.0, "10-K/A", "again", day("2023-04-01"), "n")]


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def filings(spark, rows):
    return spark.createDataFrame(rows, FILED)


def series(spark, *rows):
    return spark.createDataFrame(rows or [(s, ["A", "B"], True, True) for s in "xyz"], "symbol string, tags array<string>, quarterly boolean, annual boolean")


def content(spark, path):
    return {t: sorted(map(str, (r.asDict() for r in fu.stored(spark, path, t).collect()))) for t in ("chosen", "vintages", "growth")}


def test_appends_in_any_order_equal_one_build(spark, store):
    fu.append_filings(filings(spark, ROWS), series(spark), store, "all", buckets=4)
    parts = store + "-parts"
    late, early = [r for r in ROWS if r[7] >= day("2023-03-01")], [r for r in ROWS if r[7] < day("2023-03-01")]
    for name, rows in (("late", late), ("early", early), ("again", ROWS[:5])):
        fu.append_filings(filings(spark, rows), series(spark), parts, name, buckets=4)
    assert content(spark, parts) == content(spark, store)
    fu.append_filings(filings(spark, early), series(spark), parts, "early", buckets=4)  # run again
    assert content(spark, parts) == content(spark, store)


def test_an_append_rewrites_only_its_own_buckets(spark, store):
    fu.append_filings(filings(spark, ROWS), series(spark), store, "a", buckets=64)
    files = lambda: {r["f"]: r["symbol"] for r in spark.read.parquet(f"{store}/growth").select(F.input_file_name().alias("f"), "symbol").distinct().collect()}
    before = files()
    touched = fu.append_filings(filings(spark, year("x", 2024)), series(spark), store, "b", buckets=64)
    assert len(touched) == 1 and {s for f, s in before.items() if f not in files()} == {"x"}
    assert fu.append_filings(filings(spark, []), series(spark), store, "c", buckets=64) == []


def test_the_first_tag_of_a_filing_wins_and_floor_kinds_and_nulls_hold(spark, store):
    rows = year("x", 2022) + [(*r[:1], "B", *r[2:4], r[4] * 7, *r[5:]) for r in year("x", 2022)] + year("x", 2023, tag="B") + year("x", 2020) + year("y", 2022) + year("w", 2022)
    rows += [("x", "A", None, day("2022-12-31"), 1.0, "10-K", "p", day("2023-02-01"), "n"), ("x", "A", day("2022-01-01"), day("2022-12-31"), None, "10-K", "q", day("2023-02-01"), "n"), (None, "A", day("2022-01-01"), day("2022-12-31"), 1.0, "10-K", "r", day("2023-02-01"), "n")]
    kinds = series(spark, ("x", ["A", "B"], True, True), ("y", ["A"], False, True))
    fu.append_filings(filings(spark, rows), kinds, store, "a", since="2021-06-30", buckets=4)
    chosen = {(r["symbol"], str(r["end"])): (r["tag"], r["value"]) for r in fu.stored(spark, store, "chosen").collect()}
    assert chosen["x", "2022-12-31"] == ("A", 100.0) and chosen["x", "2023-12-31"] == ("B", 100.0) and len(chosen) == 12
    told = fu.stored(spark, store, "vintages")
    assert {(r["symbol"], r["period_type"], r["n"]) for r in told.groupBy("symbol", "period_type").agg(F.count(F.lit(1)).alias("n")).collect()} == {("x", "Q", 8), ("x", "FY", 2), ("y", "FY", 1)}
    assert {r["method"] for r in told.filter("period_type = 'Q'").collect()} == {"direct", "ytd_diff", "fy_minus_9m"}
    cover = {(r["symbol"], r["period_type"]): (r["periods"], r["restated"], r["flagged"], r["methods"]) for r in fu.coverage(told).collect()}
    assert cover["x", "FY"] == (2, 0, 0, ["annual"]) and cover["x", "Q"] == (8, 0, 0, ["direct", "fy_minus_9m", "ytd_diff"])


def test_each_table_comes_from_the_written_one_with_few_exchanges(spark, store):
    fu.append_filings(filings(spark, ROWS), series(spark), store, "a", buckets=4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert plan(fu.period_vintages(fu.stored(spark, store, "chosen"))) < 30
    assert plan(fu.period_growth(fu.stored(spark, store, "vintages"))) < 30


def test_names_of_batches(spark, store):
    for bad in ("", "../x", "a=b"):
        with pytest.raises(ValueError):
            fu.append_filings(filings(spark, ROWS), series(spark), store, bad)
