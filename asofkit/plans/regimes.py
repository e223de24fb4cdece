"""Queries on regimes and streams. Walks and fits have no SQL form; tests hold them against literal cases and against each other."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators import channels, regimes
from asofkit.plans.market import r6
from asofkit.sources import tables as src
from asofkit.sources.files import work_folder
from asofkit.sources.tables import daily_bars, table, with_sql
from asofkit.streaming import jobs

QUERIES, ORACLES = {}, {}
X = ["ret", "rvol"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _once(spark, d, name, make):
    """A table of the shared folder, written once a session, which every query on regimes reads."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _WRITTEN:
        path = work_folder(spark, name)
        make().write.parquet(path)
        _WRITTEN[at] = path
    return spark.read.parquet(_WRITTEN[at])


def _features(spark, d):
    def make():
        x = regimes.regime_features(daily_bars(spark, d)).withColumn("stale", regimes.staleness("session", W.partitionBy("symbol").orderBy("session")))
        return x.dropna(subset=[*X, "trend"])

    return _once(spark, d, "regime-features", make)


def _grid(spark, d):
    return _once(spark, d, "regime-models", lambda: regimes.fit_grid(_features(spark, d), X, key="symbol", order="session"))


def _models(spark, d):
    return regimes.choose(_grid(spark, d), "symbol")


_WS = "PARTITION BY symbol ORDER BY session"
_FRAME = f"({_WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_PRIOR = f"({_WS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(with_sql("daily").replace("WITH", "WITH RECURSIVE") + f""", n AS (SELECT *, row_number() OVER ({_WS}) AS rn, ln(close / lag(close) OVER ({_WS})) AS ret FROM daily),
e AS (SELECT symbol, rn, close AS a, close AS b FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.rn, e.a + 2 / 21.0 * (n.close - e.a), e.b + 2 / 101.0 * (n.close - e.b) FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
f AS (SELECT *, CASE WHEN count(ret) OVER {_FRAME} = 20 THEN stddev_pop(ret) OVER {_FRAME} END AS rvol, CASE WHEN count(volume) OVER {_PRIOR} = 20 THEN volume / avg(volume) OVER {_PRIOR} END AS vr FROM n)
SELECT f.symbol, session, round(ret, 6) AS ret, round(rvol, 6) AS rvol, round((high - low) / close, 6) AS span, round(vr, 6) AS volume_ratio, round((a - b) / close / nullif(rvol, 0), 6) AS trend FROM f JOIN e ON e.symbol = f.symbol AND e.rn = f.rn""")
def win24_regime_features(spark, d):
    x = regimes.regime_features(daily_bars(spark, d))
    return x.select("symbol", "session", *[r6(c).alias(c) for c in ("ret", "rvol", "span", "volume_ratio", "trend")])


@query()
def win22_channels(spark, d):
    """Bars, slope, fit, deviation and breakouts of the pivot-anchored channel of every series."""
    x = channels.channels(daily_bars(spark, d))
    return x.select("symbol", "session", F.col("chan_bars").cast("int").alias("chan_bars"), *[r6(c).alias(c) for c in ("chan_slope", "chan_r", "chan_z")], F.col("chan_breakout").cast("int").alias("chan_breakout"))


@query()
def ml1_ml2_regime_models(spark, d):
    """All fits of the grid, with the chosen model of each series marked."""
    grid = _grid(spark, d)
    chosen = regimes.choose(grid, "symbol").select("symbol", "k", F.lit(True).alias("chosen"))
    return grid.join(chosen, ["symbol", "k"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


@query()
def str5_str8_walk(spark, d):
    """ML3 and the batch form of the filter, the switching, the book and the limits."""
    return regimes.walk_history(_features(spark, d), _models(spark, d), X, key="symbol", order="session")


@query()
def str5_str8_streamed_walk(spark, d):
    stream = jobs.replay(regimes.with_models(_features(spark, d), _models(spark, d), "symbol"), "session", "features")
    return jobs.finish(jobs.walk_stream(stream, X, key="symbol", order="session"), "walk")


@query()
def ml4_state_report(spark, d):
    x = _features(spark, d)
    return regimes.state_report(str5_str8_walk(spark, d), x, key="symbol", order="session")


@query()
def win38_state_calibration(spark, d):
    return regimes.calibration_rows(str5_str8_walk(spark, d), key="symbol", order="session")


@query()
def win40_refit_drift(spark, d):
    """Fits of the first half against fits of everything, for every number of states."""
    x = _features(spark, d)
    middle = x.groupBy("symbol").agg(F.percentile_approx(F.unix_date("session"), 0.5).alias("middle"))
    half = x.join(middle, "symbol").filter(F.unix_date("session") <= F.col("middle")).drop("middle")
    fit = lambda df: regimes.fit_grid(df, X, key="symbol", order="session")
    return regimes.refit_drift(fit(half), _grid(spark, d), key="symbol", d=len(X))


def _forward(spark, d):
    features = _features(spark, d)
    cut = features.withColumn("__p", F.percent_rank().over(W.partitionBy("symbol").orderBy("session"))).filter("__p < 0.8").drop("__p")
    models = regimes.choose(regimes.fit_grid(cut, X, key="symbol", order="session", tail=0.25), "symbol")
    track = regimes.regime_track(regimes.with_models(features, models, "symbol"), X, key="symbol", order="session")
    return regimes.arm_rows(track, regimes.base_odds(features, key="symbol", order="session"), key="symbol", order="session", cost=0.0015)


@query()
def ev20_walk_forward(spark, d):
    """Four arms over the last fifth of every series, with refits every 30 sessions, and the six gates."""
    return regimes.arm_metrics(_forward(spark, d), key="symbol", order="session", per_year=252.0, cost=0.0015)


@query()
def ev20_agg27_arms_by_state_and_year(spark, d):
    """What every arm earned in each state and year."""
    rows = _forward(spark, d)
    return rows.groupBy("symbol", "arm", F.year("session").alias("year"), "active").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.sum("costs").alias("costs"), F.avg((F.col("position") > 0).cast("double")).alias("in_market"))


# --- streams -------------------------------------------------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _closed(window: str, seconds: int) -> str:
    return f"epoch(w) + {window} <= (SELECT max(epoch(ts)) FROM events) - {seconds}"


@query(f"""SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS w, max(value) AS high, min(value) AS low, count(*) AS volume FROM events GROUP BY 1, 2) WHERE {_closed('300', 600)}""".replace("SELECT *", "SELECT event_type, w AS start, high, low, volume", 1))
def str3_streamed_bars(spark, d):
    stream = jobs.replay(_events(spark, d).select("event_type", "ts", "value"), "ts", "events")
    out = jobs.finish(jobs.window_bars(stream, key="event_type", ts="ts", value="value", size="5 minutes", late="10 minutes"), "bars")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(with_sql("flow") + """SELECT event_id FROM flow WHERE available_at <= date_trunc('hour', event_time) + INTERVAL 1 HOUR AND ingested_at <= date_trunc('hour', event_time) + INTERVAL 1 HOUR""")
def str2_seen_in_time(spark, d):
    f = src.flow_records(spark, d)
    f = f.select("event_id", *[F.col(c).cast("timestamp").alias(c) for c in ("event_time", "available_at", "ingested_at")])
    f = f.withColumn("decision", F.date_trunc("hour", "event_time") + F.expr("INTERVAL 1 HOUR"))
    stream = jobs.replay(f, "event_time", "flow")
    return jobs.finish(jobs.seen_in_time(stream, event="event_time", clocks=["available_at", "ingested_at"], decision="decision", late="1 hour").select("event_id"), "seen")


@query("""SELECT a.event_id AS purchase_id, b.event_id AS print_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 900 SECOND WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase'""")
def str4_prints_before_decisions(spark, d):
    e = _events(spark, d)
    bought = jobs.replay(e.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("at")), "at", "decisions")
    seen = jobs.replay(e.filter("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("print_id")), "ts", "prints")
    # the two replays run side by side, a file each at a time, so the lateness covers a file
    met = jobs.prints_before(bought, seen, key="user_id", at="at", ts="ts", seconds=900, late="30 days")
    return jobs.finish(met.select("purchase_id", "print_id"), "met")


@query("""SELECT event_id AS decision, print FROM (SELECT a.event_id, a.ts, max_by(b.event_id, (b.ts, b.event_id)) AS print FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type <> 'purchase' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 900 SECOND
WHERE a.event_type = 'purchase' GROUP BY 1, 2) WHERE epoch_us(ts) < (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 600000000""")
def str4_join5_latest_print(spark, d):
    """A stream with state: each purchase with the latest other event of its user in the 15 minutes before, given out when the watermark has passed it."""
    e = _events(spark, d).select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("decides"))
    stream = jobs.replay(e, "ts", "events")
    return jobs.finish(jobs.latest_before(stream, key="user_id", ts="ts", row_id="event_id", decides="decides", seconds=900, late="10 minutes"), "latest").select("decision", "print")


@query("""SELECT CASE WHEN event_id % 13 > 10 THEN 'late capture' WHEN event_id % 23 > 15 THEN 'stale' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1""")
def str9_capture_ledger(spark, d):
    """Captures up to 12 minutes after their decision, which show what is up to 22 minutes old; 600 and 900 seconds are allowed."""
    e = _events(spark, d)
    minutes = lambda n: F.make_dt_interval(mins=(F.col("event_id") % n).cast("int"))
    f = e.select("event_id", F.col("ts").alias("event_time"), (F.col("ts") + minutes(13)).alias("ingested_at"), (F.col("ts") + minutes(13) - minutes(23)).alias("available_at"))
    stream = jobs.captured(jobs.replay(f, "event_time", "captures"), at="event_time", captured_at="ingested_at", observed_at="available_at", most_lag=600, most_stale=900)
    return jobs.finish(stream, "captured").groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY 1""")
def str10_idempotent_append(spark, d):
    """Every event is sent three times: twice at once and once at the end."""
    e = _events(spark, d).select("event_id", "event_type", "ts")
    late = e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    _, store = jobs.append_once(jobs.replay(e.unionAll(e).unionAll(late), "ts", "sent"), "event_id", "store")
    return spark.read.parquet(store).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("keys"))


@query(f"""SELECT event_type, w AS opened, w + INTERVAL 1 DAY AS matured, n, total FROM (SELECT event_type, date_trunc('day', ts) AS w, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE {_closed('86400', 3600)}""")
def str11_closed_outcomes(spark, d):
    stream = jobs.replay(_events(spark, d).select("event_type", "ts", "value"), "ts", "events")
    out = jobs.finish(jobs.closed_outcomes(stream, key="event_type", ts="ts", value="value", horizon="1 day", late="1 hour"), "outcomes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened", "matured")} | {"total": F.round("total", 4)})
