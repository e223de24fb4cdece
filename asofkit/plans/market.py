"""Queries on calendars, bars, ordered-series features and scalar functions, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.functions import scalars as fn
from asofkit.operators import calendar as cal
from asofkit.operators import windows as win
from asofkit.sources.tables import daily_bars, intraday_bars, table, with_sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c):
    return F.round(c, 6)


WS = "PARTITION BY symbol ORDER BY session"


@query(with_sql("daily") + "SELECT symbol, session, open, high, low, close, volume FROM daily")
def bar7_daily_rollup(spark, d):
    return daily_bars(spark, d)


@query(with_sql("hourly") + "SELECT symbol, session, minute, open, high, low, close, volume FROM hourly")
def str3_batch_hourly_bars(spark, d):
    return intraday_bars(spark, d)


@query("""SELECT event_type AS symbol, CAST(ts AS DATE) AS session, count(*) AS n FROM events
WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960 AND isodow(ts) < 6 GROUP BY 1, 2""")
def bar1_regular_hours(spark, d):
    e = table(spark, d, "events")
    m = F.hour("ts") * 60 + F.minute("ts")
    kept = e.filter((m >= 570) & (m < 960) & (F.weekday("ts") < 5))
    return kept.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("hourly") + """SELECT symbol, session, min(minute) AS first_minute, max(minute) AS last_minute, min(minute) <= 60 AND max(minute) >= 1320 AS complete FROM hourly GROUP BY 1, 2""")
def bar2_complete_sessions(spark, d):
    g = intraday_bars(spark, d).groupBy("symbol", "session").agg(F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))
    return g.withColumn("complete", (F.col("first_minute") <= 60) & (F.col("last_minute") >= 1320))


@query("""WITH t AS (SELECT event_id, CAST(ts AS DATE) AS day, hour(ts) AS h, (hour(ts) * 60 + minute(ts)) AS m FROM events),
s AS (SELECT event_id, CASE WHEN h >= 18 THEN day + 1 ELSE day END AS sday, (m - 1080 + 1440) % 1440 AS minute FROM t WHERE h < 16 OR h >= 18)
SELECT CASE isodow(sday) WHEN 6 THEN sday + 2 WHEN 7 THEN sday + 1 ELSE sday END AS session, count(*) AS n, CAST(min(minute) AS INTEGER) AS first_minute, CAST(max(minute) AS INTEGER) AS last_minute FROM s GROUP BY 1""")
def bar3_overnight_sessions(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.hour("ts").alias("h"), (F.hour("ts") * 60 + F.minute("ts")).alias("m")).filter("h < 16 or h >= 18")
    day = F.when(F.col("h") >= 18, F.date_add("day", 1)).otherwise(F.col("day"))
    s = e.select(day.alias("sday"), ((F.col("m") - 1080 + 1440) % 1440).alias("minute"))
    session = F.when(F.weekday("sday") == 5, F.date_add("sday", 2)).when(F.weekday("sday") == 6, F.date_add("sday", 1)).otherwise(F.col("sday"))
    return s.groupBy(session.alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min("minute").cast("int").alias("first_minute"), F.max("minute").cast("int").alias("last_minute"))


@query("""WITH v AS (SELECT CAST(ts AS DATE) AS day, event_type AS ticker, count(*) AS volume FROM events GROUP BY 1, 2)
SELECT day, ticker, volume FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY volume DESC, ticker) AS r FROM v) WHERE r = 1""")
def bar4_front_contract(spark, d):
    v = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("ticker")).agg(F.count(F.lit(1)).alias("volume"))
    return v.withColumn("r", F.row_number().over(W.partitionBy("day").orderBy(F.desc("volume"), "ticker"))).filter("r = 1").drop("r")


@query(with_sql("hourly") + """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN min(minute) > 60 THEN 'late open' WHEN max(minute) < 1320 THEN 'early close' WHEN count(*) < 22 THEN 'gaps' ELSE 'complete' END AS reason FROM hourly GROUP BY symbol, session) GROUP BY 1""")
def bar6_incomplete_audit(spark, d):
    g = intraday_bars(spark, d).groupBy("symbol", "session").agg(F.min("minute").alias("a"), F.max("minute").alias("z"), F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("a") > 60, "late open").when(F.col("z") < 1320, "early close").when(F.col("n") < 22, "gaps").otherwise("complete")
    return g.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("daily") + "SELECT symbol, session, open, high, low, close, volume FROM daily WHERE volume <> 1")
def bar8_untraded_dropped(spark, d):
    return daily_bars(spark, d).filter(F.coalesce("volume", F.lit(0)) != 1)


@query(with_sql("daily") + """SELECT symbol, count(*) AS sessions, count(DISTINCT session) AS distinct_sessions, (SELECT count(DISTINCT session) FROM daily) - count(DISTINCT session) AS missing FROM daily GROUP BY 1""")
def bar9_universe_completeness(spark, d):
    b = daily_bars(spark, d)
    every = b.agg(F.count_distinct("session").alias("every"))  # one row
    g = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("session").alias("distinct_sessions"))
    return g.join(every).select("symbol", "sessions", "distinct_sessions", (F.col("every") - F.col("distinct_sessions")).alias("missing"))


@query(with_sql("hourly") + """SELECT g.symbol, g.session, g.minute, CASE WHEN g.minute - b.bar_minute <= 15 THEN b.close END AS price FROM
(SELECT s.symbol, s.session, CAST(m.minute AS INTEGER) AS minute FROM (SELECT DISTINCT symbol, session FROM hourly) s, (SELECT unnest(range(0, 1440, 120)) AS minute) m) g
ASOF LEFT JOIN (SELECT symbol, session, minute + 60 AS bar_minute, close FROM hourly) b ON g.symbol = b.symbol AND g.session = b.session AND g.minute >= b.bar_minute""")
def bar10_grid_prices(spark, d):
    bars = intraday_bars(spark, d).select("symbol", "session", (F.col("minute") + 60).alias("at"), "close", F.lit(None).cast("int").alias("minute"))
    grid = bars.select("symbol", "session").distinct().withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(1320), F.lit(120))))
    both = bars.unionByName(grid.select("symbol", "session", F.col("minute").alias("at"), F.lit(None).cast("double").alias("close"), "minute"))
    w = W.partitionBy("symbol", "session").orderBy("at", F.col("minute").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("bar", F.last(F.when(F.col("close").isNotNull(), F.struct("at", "close")), ignorenulls=True).over(w)).filter("minute is not null")
    return seen.select("symbol", "session", "minute", F.when(F.col("minute") - F.col("bar.at") <= 15, F.col("bar.close")).alias("price"))


@query("""SELECT o_orderkey, o_orderpriority[1:1] || strftime(o_orderdate, '%y%m%d') || 'C' || lpad(CAST(CAST(round_even(o_totalprice / 5000, 0) * 5000 AS BIGINT) AS VARCHAR), 8, '0') AS symbol FROM orders""")
def bar11_option_symbols(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", fn.occ_symbol(F.substring("o_orderpriority", 1, 1), "o_orderdate", F.lit("C"), F.rint(F.col("o_totalprice") / 5000) * 5).alias("symbol"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders) SELECT CAST(isoyear(session) * 100 + weekofyear(session) AS INTEGER) AS iso_week, max(session) AS session FROM d GROUP BY 1""")
def cal3_last_session_of_week(spark, d):
    return cal.last_session_of_week(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session")).distinct())


@query("""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, min(CAST(o_orderdate AS DATE)) AS session FROM orders GROUP BY 1""")
def cal4_first_session_of_month(spark, d):
    return cal.first_session_of_month(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session")))


@query("""SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(date_trunc('month', ts) + INTERVAL 3 MONTH AS DATE) AS later, CAST(isoyear(ts) * 100 + weekofyear(ts) AS INTEGER) AS iso_week, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST((hour(ts) * 60 + minute(ts)) // 30 * 30 AS INTEGER) AS bucket FROM events""")
def cal5_cal6_fn24_date_parts(spark, d):
    e = table(spark, d, "events")
    month = F.trunc("ts", "month")
    return e.select("event_id", month.alias("month"), F.add_months(month, 3).alias("later"), cal.iso_week(F.to_date("ts")).alias("iso_week"), F.weekday("ts").alias("weekday"), (F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30) * 30).cast("int").alias("bucket"))


@query()
def cal1_cal2_event_sessions(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    calendar = cal.sessions(spark, "2023-12-01", "2024-12-31")
    return cal.session_distance(days.withColumn("start", F.to_date(F.lit("2024-01-02"))), calendar, "start", "day").withColumn("is_session", F.col("sessions_between").isNotNull()).drop("start")


@query()
def cal7_front_contract_of_day(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    contracts = F.broadcast(cal.quarterly_contracts(spark, 2023, 2025))  # twelve rows
    return days.join(contracts, (F.col("day") >= F.col("front_from")) & (F.col("day") <= F.col("front_to"))).select("day", "n", "contract", "expiry")


@query("""SELECT l_orderkey, l_linenumber, CAST(year(m) AS INTEGER) AS y, CAST(quarter(m) AS INTEGER) AS q FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) + CAST(floor((l_quantity * 7) / 2) AS INTEGER) AS m FROM lineitem)""")
def cal8_midpoint_quarter(spark, d):
    start = F.to_date("l_shipdate")
    y, q = cal.midpoint_quarter(start, F.date_add(start, (F.col("l_quantity") * 7).cast("int")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", y.alias("y"), q.alias("q"))


@query(with_sql("daily") + f"""SELECT symbol, session, round(close / lag(close, 1) OVER w - 1, 6) AS ret_1, round(close / lag(close, 5) OVER w - 1, 6) AS ret_5, round(close / lag(close, 10) OVER w - 1, 6) AS ret_10, round(close / lag(close, 20) OVER w - 1, 6) AS ret_20, round(close / lag(close, 60) OVER w - 1, 6) AS ret_60,
round(close / open - 1, 6) AS open_close, round(open / lag(close, 1) OVER w - 1, 6) AS gap FROM daily WINDOW w AS ({WS})""")
def win1_returns(spark, d):
    w = win.series()
    rets = {k: r6(v) for k, v in win.k_returns("close", (1, 5, 10, 20, 60), w).items()}
    return daily_bars(spark, d).withColumns(rets | {"open_close": r6(F.col("close") / F.col("open") - 1), "gap": r6(F.col("open") / F.lag("close").over(w) - 1)}).drop("open", "high", "low", "close", "volume")


RET = "r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY session) AS rn FROM daily)"


def _ret(spark, d):
    w = win.series()
    return daily_bars(spark, d).withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1).withColumn("rn", F.row_number().over(w)), w


def _full(expr: str, of: str, n: int) -> str:
    frame = f"({WS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) OVER {frame} = {n} THEN round({expr.replace('@', frame)}, 6) END"


@query(with_sql("daily") + f", {RET} SELECT symbol, session, {_full('stddev_samp(ret) OVER @', 'ret', 5)} AS vol_5, {_full('stddev_samp(ret) OVER @', 'ret', 20)} AS vol_20, {_full('stddev_samp(ret) OVER @', 'ret', 60)} AS vol_60 FROM r")
def win2_realized_vol(spark, d):
    b, w = _ret(spark, d)
    return b.select("symbol", "session", *[r6(win.realized_vol("ret", n, w)).alias(f"vol_{n}") for n in (5, 20, 60)])


@query(with_sql("daily") + f"SELECT symbol, session, {_full('avg(close) OVER @', 'close', 5)} AS ma_5, {_full('avg(close) OVER @', 'close', 20)} AS ma_20, {_full('avg(close) OVER @', 'close', 60)} AS ma_60, {_full('close / avg(close) OVER @ - 1', 'close', 60)} AS dist_60, CASE WHEN count(close) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN round(avg(close) OVER ({WS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(close) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1, 6) END AS spread_5_20 FROM daily")
def win3_moving_averages(spark, d):
    w = win.series()
    return daily_bars(spark, d).select("symbol", "session", r6(win.moving_average("close", 5, w)).alias("ma_5"), r6(win.moving_average("close", 20, w)).alias("ma_20"), r6(win.moving_average("close", 60, w)).alias("ma_60"), r6(F.col("close") / win.moving_average("close", 60, w) - 1).alias("dist_60"), r6(win.moving_average("close", 5, w) / win.moving_average("close", 20, w) - 1).alias("spread_5_20"))


@query(with_sql("daily") + f"""SELECT symbol, session, {_full('close / max(close) OVER @ - 1', 'close', 20)} AS from_high, {_full('close / min(close) OVER @ - 1', 'close', 20)} AS from_low,
{_full('coalesce((close - min(low) OVER @) / nullif(max(high) OVER @ - min(low) OVER @, 0), 0.5)', 'close', 20)} AS position FROM daily""")
def win4_range_position(spark, d):
    w = win.series()
    f = w.rowsBetween(-19, 0)
    return daily_bars(spark, d).select("symbol", "session", r6(win.full(F.col("close") / F.max("close").over(f) - 1, "close", f, 20)).alias("from_high"), r6(win.full(F.col("close") / F.min("close").over(f) - 1, "close", f, 20)).alias("from_low"), r6(win.range_position("close", "high", "low", 20, w)).alias("position"))


@query(with_sql("daily") + f"""SELECT symbol, session, {_full("(list_position(list(high) OVER @, max(high) OVER @) - 1) / 19.0", 'high', 20)} AS high_recency, {_full("(list_position(list(low) OVER @, min(low) OVER @) - 1) / 19.0", 'low', 20)} AS low_recency FROM daily""")
def win5_extreme_recency(spark, d):
    w = win.series()
    return daily_bars(spark, d).select("symbol", "session", r6(win.extreme_recency("high", 20, w, True)).alias("high_recency"), r6(win.extreme_recency("low", 20, w, False)).alias("low_recency"))


@query(with_sql("daily") + f", {RET} SELECT symbol, session, {_full('regr_slope(close, rn) OVER @ / avg(close) OVER @', 'close', 20)} AS slope_20, {_full('regr_r2(close, rn) OVER @', 'close', 20)} AS r2_20, {_full('regr_slope(close, rn) OVER @ / avg(close) OVER @', 'close', 60)} AS slope_60, {_full('regr_r2(close, rn) OVER @', 'close', 60)} AS r2_60 FROM r")
def win6_trend_fit(spark, d):
    b, w = _ret(spark, d)
    fits = {n: win.trend("close", "rn", n, w) for n in (20, 60)}
    return b.select("symbol", "session", *[r6(c).alias(f"{name}_{n}") for n, fit in fits.items() for name, c in zip(("slope", "r2"), fit)])


@query(with_sql("daily") + f"""SELECT symbol, session, round(avg(volume) OVER ({WS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(volume) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS volume_ratio, {_full('stddev_samp(volume) OVER @ / avg(volume) OVER @', 'volume', 20)} AS volume_cv FROM daily""")
def win7_volume(spark, d):
    w = win.series()
    f = w.rowsBetween(-19, 0)
    return daily_bars(spark, d).select("symbol", "session", r6(F.avg("volume").over(w.rowsBetween(-4, 0)) / F.avg("volume").over(f)).alias("volume_ratio"), r6(win.full(F.stddev_samp("volume").over(f) / F.avg("volume").over(f), "volume", f, 20)).alias("volume_cv"))


@query(with_sql("daily") + f", {RET} SELECT symbol, session, {_full('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER @', 'ret', 20)} AS up_fraction, {_full('coalesce(sum(greatest(ret, 0)) OVER @ / nullif(sum(abs(ret)) OVER @, 0), 0.5)', 'ret', 20)} AS gain_share FROM r")
def win8_up_fraction(spark, d):
    b, w = _ret(spark, d)
    f = w.rowsBetween(-19, 0)
    up = F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).over(f)
    share = F.coalesce(F.try_divide(F.sum(F.greatest("ret", F.lit(0.0))).over(f), F.sum(F.abs("ret")).over(f)), F.lit(0.5))
    return b.select("symbol", "session", r6(win.full(up, "ret", f, 20)).alias("up_fraction"), r6(win.full(share, "ret", f, 20)).alias("gain_share"))


@query(with_sql("daily") + f""", {RET}, l AS (SELECT symbol, session, list(ret) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v, count(ret) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM r)
SELECT symbol, session, CASE WHEN n = 20 THEN round(list_avg([(x - list_avg(v)) * (x - list_avg(v)) * (x - list_avg(v)) FOR x IN v]) / pow(list_avg([(x - list_avg(v)) * (x - list_avg(v)) FOR x IN v]), 1.5), 6) END AS skew_20 FROM l""")
def win9_skewness(spark, d):
    b, w = _ret(spark, d)
    return b.select("symbol", "session", r6(win.skew("ret", 20, w)).alias("skew_20"))


@query(with_sql("daily") + f""", {RET}, v AS (SELECT *, volume / lag(volume) OVER ({WS}) - 1 AS dv FROM r) SELECT symbol, session, {_full('coalesce(covar_pop(ret, dv) OVER @ / nullif(stddev_pop(ret) OVER @ * stddev_pop(dv) OVER @, 0), 0)', 'ret', 19)} AS corr_19 FROM v""")
def win10_return_volume_correlation(spark, d):
    b, w = _ret(spark, d)
    b = b.withColumn("dv", F.col("volume") / F.lag("volume").over(w) - 1)
    return b.select("symbol", "session", r6(win.correlation("ret", "dv", 19, w)).alias("corr_19"))


@query(with_sql("daily") + f""", {RET}, s AS (SELECT *, sign(ret) AS sg, CASE WHEN sign(ret) = lag(sign(ret)) OVER ({WS}) THEN 0 ELSE 1 END AS nw FROM r), q AS (SELECT *, sum(nw) OVER ({WS}) AS run FROM s)
SELECT symbol, session, CAST(coalesce(sg, 0) * least(row_number() OVER (PARTITION BY symbol, run ORDER BY session), 10) AS INTEGER) AS streak FROM q""")
def win11_signed_streak(spark, d):
    b, w = _ret(spark, d)
    return win.signed_streak(b, "ret", w, ("symbol",)).select("symbol", "session", "streak")


#: The features that are ranked across the universe, in SQL; their order is that of ``_ranked_features``.
_RANKED = {
    "ret_1": "ret", "ret_5": "close / lag(close, 5) OVER w - 1", "ret_20": "close / lag(close, 20) OVER w - 1", "ret_60": "close / lag(close, 60) OVER w - 1",
    "vol_20": _full("stddev_samp(ret) OVER @", "ret", 20), "dist_20": _full("close / avg(close) OVER @ - 1", "close", 20),
    "volume_ratio": f"round(avg(volume) OVER ({WS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(volume) OVER ({WS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6)",
    "from_high": _full("close / max(close) OVER @ - 1", "close", 20),
}
_RANK_SQL = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN round(CASE WHEN count(*) OVER (PARTITION BY session, {c} IS NULL) < 2 THEN 0.5 ELSE (row_number() OVER (PARTITION BY session, {c} IS NULL ORDER BY {c}, symbol) - 1.0) / (count(*) OVER (PARTITION BY session, {c} IS NULL) - 1) END, 6) END AS rank_{c}"
    for c in _RANKED
)


@query(with_sql("daily") + f", {RET}, x AS (SELECT symbol, session, {', '.join(f'round({e}, 6) AS {c}' for c, e in _RANKED.items())} FROM r WINDOW w AS ({WS})) SELECT symbol, session, {_RANK_SQL} FROM x")
def win12_cross_rank(spark, d):
    """Features are rounded before they are ranked, so that ties are ties in every engine."""
    b, w = _ret(spark, d)
    f = w.rowsBetween(-19, 0)
    features = {f"ret_{k}": F.col("close") / F.lag("close", k).over(w) - 1 for k in (1, 5, 20, 60)} | {
        "vol_20": win.realized_vol("ret", 20, w), "dist_20": F.col("close") / win.moving_average("close", 20, w) - 1,
        "volume_ratio": F.avg("volume").over(w.rowsBetween(-4, 0)) / F.avg("volume").over(f), "from_high": win.full(F.col("close") / F.max("close").over(f) - 1, "close", f, 20),
    }
    b = b.select("symbol", "session", *[r6(c).alias(name) for name, c in features.items()])
    return win.cross_ranks(b, list(_RANKED)).select("symbol", "session", *[r6(f"rank_{c}").alias(f"rank_{c}") for c in _RANKED])


@query(with_sql("daily") + f"SELECT symbol, session, round(lead(close) OVER w / lead(open) OVER w - 1, 6) AS next_open_to_close, round(lead(close) OVER w / close - 1, 6) AS next_close_to_close FROM daily WINDOW w AS ({WS})")
def win13_next_payoffs(spark, d):
    w = win.series()
    nc = F.lead("close").over(w)
    return daily_bars(spark, d).select("symbol", "session", r6(nc / F.lead("open").over(w) - 1).alias("next_open_to_close"), r6(nc / F.col("close") - 1).alias("next_close_to_close"))


@query(with_sql("daily") + f"SELECT symbol, session, round(last_value(CASE WHEN volume >= 2 THEN close END IGNORE NULLS) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prior_settlement FROM daily")
def win14_prior_settlement(spark, d):
    b = daily_bars(spark, d).withColumn("settled", F.when(F.col("volume") >= 2, F.col("close")))
    return b.select("symbol", "session", r6(win.carried("settled", win.series())).alias("prior_settlement"))


@query(with_sql("daily") + f""", x AS (SELECT symbol, session, ln(close / lag(close) OVER ({WS})) AS lr FROM daily), v AS (SELECT symbol, session, {_full('stddev_samp(lr) OVER @', 'lr', 20)} AS vol FROM x)
SELECT symbol, session, lag(vol) OVER ({WS}) AS vol_known FROM v""")
def win15_log_vol_previous_session(spark, d):
    w = win.series()
    b = daily_bars(spark, d).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(w))).withColumn("vol", r6(win.realized_vol("lr", 20, w)))
    return b.select("symbol", "session", F.lag("vol").over(w).alias("vol_known"))


@query(with_sql("hourly") + """, x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol, session ORDER BY minute)) AS lr FROM hourly)
SELECT symbol, session, minute, round(coalesce(sum(lr * lr) OVER (PARTITION BY symbol, session ORDER BY minute ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6) AS remaining_variance FROM x""")
def win16_remaining_variance(spark, d):
    w = W.partitionBy("symbol", "session").orderBy("minute")
    b = intraday_bars(spark, d).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(w))).withColumn("sq", F.col("lr") * F.col("lr"))
    return b.select("symbol", "session", "minute", r6(win.reverse_sum("sq", w)).alias("remaining_variance"))


_TRAIL = """, x AS (SELECT symbol, session, minute, ln(close / lag(close) OVER (PARTITION BY symbol, session ORDER BY minute)) AS lr FROM hourly),
y AS (SELECT symbol, session, minute, coalesce(sum(lr * lr) OVER (PARTITION BY symbol, session ORDER BY minute ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rv FROM x)"""


def _remaining(spark, d):
    w = W.partitionBy("symbol", "session").orderBy("minute")
    b = intraday_bars(spark, d).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(w))).withColumn("sq", F.col("lr") * F.col("lr"))
    return b.withColumn("rv", win.reverse_sum("sq", w))


_BEFORE = "(PARTITION BY symbol, minute ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(with_sql("hourly") + _TRAIL + f"SELECT symbol, session, minute, CASE WHEN count(rv) OVER {_BEFORE} = 20 THEN round(avg(rv) OVER {_BEFORE}, 6) END AS trailing FROM y")
def win17_trailing_profile(spark, d):
    f = W.partitionBy("symbol", "minute").orderBy("session").rowsBetween(-20, -1)
    return _remaining(spark, d).select("symbol", "session", "minute", r6(win.full(F.avg("rv").over(f), "rv", f, 20)).alias("trailing"))


_DECAY = " + ".join(f"{0.85 ** k!r} * v[{20 - k}]" for k in range(20))


@query(with_sql("hourly") + _TRAIL + f""", z AS (SELECT *, list(rv) OVER {_BEFORE} AS v FROM y) SELECT symbol, session, minute, CASE WHEN len(v) = 20 THEN round(({_DECAY}) / {sum(0.85 ** k for k in range(20))!r}, 6) END AS trailing FROM z""")
def win18_trailing_profile_ewma(spark, d):
    w = W.partitionBy("symbol", "minute").orderBy("session")
    return _remaining(spark, d).select("symbol", "session", "minute", r6(win.ewma_of_last("rv", 20, 0.85, w)).alias("trailing"))


@query(with_sql("daily") + f"SELECT symbol, session, {_full('coalesce((close - (avg(close) OVER @ - 2 * stddev_pop(close) OVER @)) / nullif(4 * stddev_pop(close) OVER @, 0), 0.5)', 'close', 20)} AS pct_b, {_full('4 * stddev_pop(close) OVER @ / avg(close) OVER @', 'close', 20)} AS bandwidth FROM daily")
def win21_bollinger(spark, d):
    pct, width = win.bollinger("close", 20, 2.0, win.series())
    return daily_bars(spark, d).select("symbol", "session", r6(pct).alias("pct_b"), r6(width).alias("bandwidth"))


@query(with_sql("hourly") + """, s AS (SELECT symbol, session, max(CASE WHEN o = 1 THEN open END) AS open, max(high) FILTER (minute < 720) AS or_high, min(low) FILTER (minute < 720) AS or_low, sum(close * volume) / sum(volume) AS vwap, max(CASE WHEN z = 1 THEN close END) AS close, coalesce(sum(volume) FILTER (minute < 720), 0) AS first_volume
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY minute) AS o, row_number() OVER (PARTITION BY symbol, session ORDER BY minute DESC) AS z FROM hourly) GROUP BY 1, 2)
SELECT symbol, session, round(or_high, 6) AS or_high, round(or_low, 6) AS or_low, round(vwap, 6) AS vwap, round(close / open - 1, 6) AS so_far, round(first_volume / nullif(avg(first_volume) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 6) AS volume_ratio FROM s""")
def win23_intraday_features(spark, d):
    early = F.col("minute") < 720
    s = intraday_bars(spark, d).groupBy("symbol", "session").agg(
        F.min_by("open", "minute").alias("open"), F.max(F.when(early, F.col("high"))).alias("or_high"), F.min(F.when(early, F.col("low"))).alias("or_low"),
        (F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("vwap"), F.max_by("close", "minute").alias("close"), F.sum(F.when(early, F.col("volume")).otherwise(0)).alias("fv"),
    )
    before = win.series().rowsBetween(-20, -1)
    return s.select("symbol", "session", r6("or_high").alias("or_high"), r6("or_low").alias("or_low"), r6("vwap").alias("vwap"), r6(F.col("close") / F.col("open") - 1).alias("so_far"), r6(F.try_divide(F.col("fv"), F.avg("fv").over(before))).alias("volume_ratio"))


@query(with_sql("daily") + f", {RET} SELECT symbol, session, CASE WHEN count(ret) OVER b = 500 AND stddev_pop(ret) OVER b > 0 THEN round((ret - avg(ret) OVER b) / stddev_pop(ret) OVER b, 6) END AS z FROM r WINDOW b AS ({WS} ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)")
def win25_past_zscore(spark, d):
    b, w = _ret(spark, d)
    return b.select("symbol", "session", r6(win.past_zscore("ret", 500, w)).alias("z"))


@query(with_sql("daily") + f", {RET}, e AS (SELECT symbol, session, sum(ln(1 + ret / 10)) OVER ({WS}) AS s FROM r) SELECT symbol, session, round(exp(s), 6) AS equity, round(exp(s) / exp(max(s) OVER ({WS})) - 1, 6) AS drawdown FROM e")
def win34_drawdown(spark, d):
    b, w = _ret(spark, d)
    e = win.drawdown(b, F.ln(1 + F.col("ret") / 10), w)
    return e.select("symbol", "session", r6("equity").alias("equity"), r6("drawdown").alias("drawdown"))


@query(with_sql("daily") + """, n AS (SELECT session, row_number() OVER (ORDER BY session) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM daily))
SELECT stage, count(*) AS sessions, min(session) AS first, max(session) AS last FROM (SELECT session, CASE WHEN r <= floor(n * 0.6) THEN 'discovery' WHEN r <= floor(n * 0.8) THEN 'validation' ELSE 'holdout' END AS stage FROM n) GROUP BY 1""")
def win36_chronological_split(spark, d):
    days = daily_bars(spark, d).select("session").distinct()
    s = win.chronological_split(days, "session", {"discovery": 0.6, "validation": 0.8, "holdout": 1.0})
    return s.groupBy("stage").agg(F.count(F.lit(1)).alias("sessions"), F.min("session").alias("first"), F.max("session").alias("last"))


@query("""SELECT o_orderkey, round(o_totalprice / (o_custkey % 7 + 1), 6) AS x, CASE WHEN o_custkey % 7 = 0 THEN 0.0 ELSE round_even(o_totalprice / (o_custkey % 7), 8) END AS safe FROM orders""")
def prj7_safe_numbers(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", r6(F.col("o_totalprice") / (F.col("o_custkey") % 7 + 1)).alias("x"), fn.safe(F.try_divide("o_totalprice", F.col("o_custkey") % 7)).alias("safe"))


_V = "(l_discount + 0.05)"


@query(f"""SELECT l_orderkey, l_linenumber, round({fn.sql_norm_cdf('(l_discount * 40 - 2)')}, 6) AS cdf, round({fn.sql_bs_call('100.0', '(80 + l_quantity)', _V)}, 6) AS call, round({fn.sql_bs_call('100.0', '(80 + l_quantity)', _V)} - 100.0 + (80 + l_quantity), 6) AS put FROM lineitem""")
def fn1_fn2_option_prices(spark, d):
    li = table(spark, d, "lineitem").withColumns({"k": F.col("l_quantity") + 80, "v": F.col("l_discount") + 0.05})
    li = fn.with_option_price(li, "call", F.lit("C"), F.lit(100.0), F.col("k"), F.col("v"))
    li = li.withColumn("put", F.col("call") - 100.0 + F.col("k"))  # parity
    return li.select("l_orderkey", "l_linenumber", r6(fn.norm_cdf(F.col("l_discount") * 40 - 2)).alias("cdf"), r6("call").alias("call"), r6("put").alias("put"))


@query("""SELECT l_orderkey, l_linenumber, greatest(l_extendedprice / 100 - 300, 0) - greatest(l_extendedprice / 100 - 305, 0) AS call_spread, round_even(l_extendedprice / 500, 0) * 5 AS strike FROM lineitem""")
def fn3_fn5_payoffs_and_strikes(spark, d):
    li = table(spark, d, "lineitem")
    s = F.col("l_extendedprice") / 100
    return li.select("l_orderkey", "l_linenumber", (fn.settle(F.lit("C"), F.lit(300.0), s) - fn.settle(F.lit("C"), F.lit(305.0), s)).alias("call_spread"), fn.snap(s).alias("strike"))


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS w FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, n, round((w / n + 3.8416 / (2 * n) - 1.96 * sqrt(w / n * (1 - w / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((w / n + 3.8416 / (2 * n) + 1.96 * sqrt(w / n * (1 - w / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS hi, round(2.8 * sqrt(0.5 * 0.5 * (1.0 / n + 1.0 / n)), 6) AS mde FROM g""")
def fn7_fn8_intervals(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("w"))
    lo, hi = fn.wilson("w", "n")
    return g.select("l_returnflag", "l_linestatus", "n", r6(lo).alias("lo"), r6(hi).alias("hi"), r6(fn.minimum_detectable_effect(0.5, "n", "n")).alias("mde"))


@query("""SELECT part.p_partkey, round(least(0.25 * greatest(0, p - (1 - p) / b), 1.0) * p * (1 - 0.3) * 0.5, 6) AS cap, round(b, 6) AS b FROM part, LATERAL (SELECT 0.4 + p_size / 100.0 AS p, p_retailprice / 1000 AS b) t""")
def fn12_kelly_size(spark, d):
    x = table(spark, d, "part").select("p_partkey", (0.4 + F.col("p_size") / 100.0).alias("p"), (F.col("p_retailprice") / 1000).alias("b"))
    return x.select("p_partkey", r6(fn.size_cap("p", "b", F.lit(0.3), F.lit(0.5))).alias("cap"), r6("b").alias("b"))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT day, n / sum(n) OVER (PARTITION BY day) AS p, count(*) OVER (PARTITION BY day) AS k FROM c) SELECT day, round(-sum(p * ln(p)) / ln(max(k)), 6) AS entropy FROM p GROUP BY 1""")
def fn13_entropy(spark, d):
    c = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("day").agg(F.collect_list("n").alias("ns"), F.sum("n").alias("total"))
    return g.select("day", r6(fn.entropy(F.transform("ns", lambda x: x / F.col("total")))).alias("entropy"))


@query(with_sql("daily") + f"SELECT symbol, session, CASE WHEN lag(close) OVER w > 0 THEN round(ln(close / lag(close) OVER w), 6) END AS lg, CAST(nullif(sign(close - lag(close) OVER w), 0) AS INTEGER) AS side FROM daily WINDOW w AS ({WS})")
def fn14_fn15_growth_and_sign(spark, d):
    w = win.series()
    before = F.lag("close").over(w)
    return daily_bars(spark, d).select("symbol", "session", r6(fn.log_growth(F.col("close"), before)).alias("lg"), fn.sign_position(F.col("close"), before).alias("side"))


@query("""SELECT p_partkey, round(-2 * p_retailprice + ((p_size - 1) + p_size * (p_size - 1) + p_size * 3 + p_size * 3 * 4 / 2.0) * ln(1000.0), 6) AS bic, upper(trim(p_type)) AS name FROM part""")
def fn16_fn23_bic_and_names(spark, d):
    x = table(spark, d, "part")
    return x.select("p_partkey", r6(fn.bic("p_retailprice", "p_size", F.lit(3), F.lit(1000))).alias("bic"), fn.symbol_name("p_type").alias("name"))


@query("""SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_mktsegment) AS digest FROM customer""")
def fn17_seed_digest(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws(chr(31), F.col("c_custkey").cast("string"), "c_mktsegment"), 256).alias("digest"))


@query("""SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS digest FROM region""")
def fn26_canonical_hash(spark, d):
    return table(spark, d, "region").select("r_regionkey", fn.canonical_hash("r_regionkey", "r_name").alias("digest"))


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ';') AS priorities, count(*) AS n FROM orders GROUP BY 1""")
def fn27_array_join(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("o_orderpriority"))), ";").alias("priorities"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('second', ts) AS back, date_trunc('second', ts) AS back_ns, CASE WHEN event_id % 7 > 0 THEN round(value * (event_id % 7) / (event_id % 7), 6) END AS vwap FROM events""")
def fn22_epoch_timestamps(spark, d):
    """Milliseconds and nanoseconds of the same moments, and the mean price of a bar from turnover and volume (none without volume)."""
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value", (F.col("event_id") % 7).alias("volume"))
    second = lambda x: F.date_trunc("second", fn.epoch_timestamp(x)).cast("timestamp_ntz")
    return e.select("event_id", "ms", second("ms").alias("back"), second(F.col("ms") * 1_000_000).alias("back_ns"), r6(F.try_divide(F.col("value") * F.col("volume"), F.col("volume"))).alias("vwap"))
