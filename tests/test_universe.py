"""The daily snapshot: what each row may see, benchmark, ranks, refusals, two shuffles of the bars, and the written manifest."""

import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from asofkit.operators import channels, indicators, universe

BARS = "symbol string, session date, open double, high double, low double, close double, volume bigint, rank int"
START = dt.date(2024, 1, 1)


def day(k):
    return START + dt.timedelta(days=k)


def bars(symbols="ABM", n=90, skip=()):
    """Random walks; ``skip``: (symbol, place) pairs without a bar. Volume 0 and a flat bar occur; ``rank`` is a column that nobody asked for."""
    rng, rows = random.Random(5), []
    for s in symbols:
        close = 100.0
        for k in range(n):
            o = close * (1 + rng.gauss(0, 0.004))
            close = o * (1 + rng.gauss(0, 0.01))
            low, high = (min(o, close) * 0.998, max(o, close) * 1.002)
            row = (s, day(k), close, close, close, close, 0, 1) if k == 70 else (s, day(k), o, high, low, close, None if k == 71 else 1000 + rng.randrange(500), 1)
            if (s, k) not in skip:
                rows.append(row)
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(day(65),), (day(65),), (day(80),), (None,)], "day date")


@pytest.fixture(scope="module")
def snapshot(spark, events):
    x = universe.daily_snapshot(spark.createDataFrame(bars(skip={("M", 75)}), BARS), events, benchmark="M").cache()
    return {(r["symbol"], r["session"]): r for r in x.collect()}


def test_rows_need_a_history_and_a_next_bar(snapshot):
    assert {s for s, _ in snapshot} == {"A", "B", "M"} and len(snapshot) == 28 * 2 + 27
    assert min(d for s, d in snapshot if s == "A") == day(61) and max(d for s, d in snapshot if s == "A") == day(88)
    assert all(v is not None for r in snapshot.values() for k, v in r.asDict().items() if not k.endswith("_rel"))


def test_flat_bars_events_and_payoffs(snapshot):
    flat = snapshot["A", day(70)]
    assert (flat["range_pos"], flat["k_body"], flat["k_upper"], flat["oc_ret"]) == (0.5, 0.0, 0.0, 0.0)
    assert [d for s, d in snapshot if s == "A" and snapshot[s, d]["event_today"]] == [d for s, d in snapshot if s == "A" and d in (day(65), day(80))]
    assert {d for s, d in snapshot if s == "A" and snapshot[s, d]["event_next_session"]} == {day(64), day(79)}
    rows = {(r[0], r[1]): r for r in bars()}
    now, then = rows["A", day(66)], rows["A", day(67)]
    got = snapshot["A", day(66)]
    assert got["next_open_to_close"] == pytest.approx(then[5] / then[2] - 1, abs=1e-8) and got["next_close_to_close"] == pytest.approx(then[5] / now[5] - 1, abs=1e-8)
    assert got["next_close_to_close_rel"] == pytest.approx(got["next_close_to_close"] - snapshot["M", day(66)]["next_close_to_close"], abs=2e-8)
    assert snapshot["A", day(75)]["next_open_to_close_rel"] is None and snapshot["M", day(66)]["next_open_to_close_rel"] == 0


def test_ranks_are_of_the_session(snapshot):
    for name in universe.RANKED:
        order = sorted("ABM", key=lambda s: (snapshot[s, day(66)][name], s))
        assert [snapshot[s, day(66)][f"xs_rank_{name}"] for s in order] == [0.0, 0.5, 1.0]
    assert {snapshot[s, day(75)]["xs_rank_ret_1d"] for s in "AB"} == {0.0, 1.0}


def test_recursions_are_those_of_their_operators(spark, snapshot):
    b = spark.createDataFrame(bars(skip={("M", 75)}), BARS)
    own = indicators.indicators(b, keys=["symbol"], order="session").join(channels.channels(b), ["symbol", "session"])
    for r in own.collect():
        if got := snapshot.get((r["symbol"], r["session"])):
            for mine, theirs in zip(universe.RECURSIVE, ("rsi_2", "rsi_14", "macd_hist", "adx_14", "chan_bars", "chan_slope", "chan_r", "chan_z", "chan_breakout")):
                assert got[mine] == pytest.approx(r[theirs], abs=1e-7), mine


def test_no_row_sees_later_bars_and_closed_markets_may_count_as_zero(spark, events, snapshot):
    cut = [r for r in bars(skip={("M", 75)}) if r[1] <= day(77)]
    random.Random(1).shuffle(cut)
    x = universe.daily_snapshot(spark.createDataFrame(cut, BARS).repartition(5), events, benchmark="M", closed_zero=True)
    rows = x.collect()
    assert len(rows) == 16 * 2 + 15
    for r in rows:
        told, full = r.asDict(), snapshot[r["symbol"], r["session"]].asDict()
        if r["session"] == day(75):
            assert told["next_open_to_close_rel"] == told["next_open_to_close"]
            told = {k: v for k, v in told.items() if not k.endswith("_rel")}
        assert told == {k: full[k] for k in told}


def test_bars_cross_twice(spark, events, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame(bars("A", 3), BARS).write.parquet(path)
    plan = universe.daily_snapshot(spark.read.parquet(path), events, benchmark="A")._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("hashpartitioning(symbol" in x for x in lines) == 1 and sum("hashpartitioning(session" in x for x in lines) == 1
    assert len(lines) == 4 and sum("hashpartitioning(day" in x for x in lines) == 2  # the days of events, twice


def test_the_prepared_universe(spark, events, tmp_path):
    b = spark.createDataFrame(bars(), BARS)
    path = str(tmp_path / uuid.uuid4().hex)
    with pytest.raises(ValueError, match="no bars for Z"):
        universe.prepare_universe(b, events, path, ["A", "Z"])
    told = universe.prepare_universe(b, events, path, ["A", "B"], benchmark="M").first()
    assert (told["rows"], told["first"], told["last"], told["benchmark_sessions"], told["symbols"], told["warmup"]) == (84, day(61), day(88), 28, ["A", "B"], 61)
    splits = {r["stage"]: (r["first"], r["last"], r["sessions"]) for r in spark.read.parquet(f"{path}/splits").collect()}
    assert splits == {"discovery": (day(61), day(76), 16), "validation": (day(77), day(82), 6), "holdout": (day(83), day(88), 6)}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        universe.prepare_universe(b, events, path, ["A", "B"], benchmark="M")


def test_repeated_bars_and_short_histories_are_refused(spark, events):
    twice = spark.createDataFrame([*bars("A"), bars("A")[5]], BARS)
    with pytest.raises(Exception, match="more than one bar of A"):
        universe.daily_snapshot(twice, events).count()
    with pytest.raises(Exception, match="too few sessions: 14"):
        universe.suggested_splits(spark.createDataFrame([(day(k),) for k in range(14)], "session date")).collect()
    empty = universe.daily_snapshot(spark.createDataFrame([], BARS), events, benchmark="M")
    assert empty.count() == 0 and json.loads(empty.schema.json())["fields"][0]["name"] == "session"
