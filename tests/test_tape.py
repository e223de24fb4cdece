"""The index signal against a plain walk over one series."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from asofkit.operators import tape

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([(DAY + dt.timedelta(k), k + 1) for k in range(60)], "day date, session_no int")


def walked(series, no, lookback, tolerance, coverage, stale):
    known = [x for x in series if x[0] <= no]
    if not known:
        return "no_data", None
    n, last, version = known[-1]
    run = []
    for x in reversed(known):
        if x[2] != version:
            break
        run.insert(0, x)
    if no - n > stale:
        return "stale", None
    if n - run[0][0] < lookback:
        return "insufficient_history", None
    near = [x for x in run if n - lookback - tolerance <= x[0] <= n - lookback]
    if not near or sum(x[0] >= near[-1][0] for x in run) / (n - near[-1][0] + 1) < coverage:
        return "insufficient_coverage", None
    return "live", math.log(last / near[-1][1])


def test_readings_equal_a_walk(spark, calendar):
    rng = random.Random(4)
    series = [(k, rng.uniform(1, 2), int(k > 35)) for k in range(4, 56) if rng.random() < 0.8 and not 22 < k < 28]
    fixings = spark.createDataFrame([("x", DAY + dt.timedelta(k - 1), v, m) for k, v, m in series], "index_code string, index_date date, value double, methodology int")
    asks = calendar.select(F.lit("x").alias("index_code"), F.col("day").alias("session"))
    options = (8, 2, 0.75, 3)
    got = {(r["session"] - DAY).days + 1: r for r in tape.tape_readings(asks, fixings, calendar, lookback=8, tolerance=2, least_coverage=0.75, most_stale=3).collect()}
    want = {no: walked(series, no, *options) for no in range(1, 61)}
    assert {no: r["status"] for no, r in got.items()} == {no: s for no, (s, _) in want.items()}
    assert {s for s, _ in want.values()} == {"no_data", "stale", "insufficient_history", "insufficient_coverage", "live"}
    for no, (_, value) in want.items():
        assert got[no]["value"] == (None if value is None else pytest.approx(value))
    first = next(k for k, _, m in series if m == 1)
    assert tape.earliest_live(fixings, calendar, lookback=8).first()["earliest"] == DAY + dt.timedelta(first + 7)
    assert tape.earliest_live(fixings, calendar, lookback=40).first()["earliest"] is None
    assert tape.tape_readings(asks, fixings.limit(0), calendar).filter("status <> 'no_data'").count() == 0


def test_a_fixing_without_value_is_refused(spark, calendar):
    fixings = spark.createDataFrame([("x", DAY, None, 0)], "index_code string, index_date date, value double, methodology int")
    with pytest.raises(Exception, match="no positive value"):
        tape.version_runs(fixings, calendar).collect()
