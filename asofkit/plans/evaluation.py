"""Queries on rule projections, multi-clock joins, ledgers, gates and audits, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators import gates, resampling
from asofkit.operators.asof import asof, nearest_prior
from asofkit.operators.calendar import iso_week
from asofkit.operators.windows import series
from asofkit.plans.market import r6
from asofkit.sources import tables as src
from asofkit.sources.tables import daily_bars, intraday_bars, table, with_sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- projections ---------------------------------------------------------------------------------------------------


@query(with_sql("hourly") + """, p AS (SELECT symbol, session, min_by(open, minute) AS o, max(CASE WHEN minute = 600 THEN open END) AS a, max(CASE WHEN minute = 840 THEN open END) AS b, max_by(close, minute) AS c FROM hourly GROUP BY 1, 2)
SELECT symbol, session, a AS price_600, round((a / o - 1) * 100, 6) AS from_open, round((b / a - 1) * 100, 6) AS between_minutes, round((a / lag(c) OVER (PARTITION BY symbol ORDER BY session) - 1) * 100, 6) AS from_prior_close FROM p""")
def prj1_prj4_minute_returns(spark, d):
    at = lambda m: F.max(F.when(F.col("minute") == m, F.col("open")))
    p = intraday_bars(spark, d).groupBy("symbol", "session").agg(F.min_by("open", "minute").alias("o"), at(600).alias("a"), at(840).alias("b"), F.max_by("close", "minute").alias("c"))
    change = lambda x, y: r6((F.try_divide(x, y) - 1) * 100)
    return p.select("symbol", "session", F.col("a").alias("price_600"), change(F.col("a"), F.col("o")).alias("from_open"), change(F.col("b"), F.col("a")).alias("between_minutes"), change(F.col("a"), F.lag("c").over(series())).alias("from_prior_close"))


@query(with_sql("hourly") + """, o AS (SELECT symbol, session, min_by(open, minute) AS o FROM hourly GROUP BY 1, 2)
SELECT h.symbol, h.session, min(CASE WHEN minute > 300 AND minute <= 1200 AND high >= o + 50 THEN minute END) AS touch_up, min(CASE WHEN minute > 300 AND minute <= 1200 AND low <= o - 20 THEN minute END) AS touch_down
FROM hourly h JOIN o ON h.symbol = o.symbol AND h.session = o.session GROUP BY 1, 2""")
def prj5_first_touch(spark, d):
    bars = intraday_bars(spark, d)
    # the session's open comes with the bars' own grouping, so bars are shuffled once
    o = F.first("open").over(series(("symbol", "session"), "minute"))
    inside = F.col("minute").between(301, 1200)
    touch = lambda hit: F.min(F.when(inside & hit, F.col("minute")))
    return bars.withColumn("o", o).groupBy("symbol", "session").agg(touch(F.col("high") >= F.col("o") + 50).alias("touch_up"), touch(F.col("low") <= F.col("o") - 20).alias("touch_down"))


@query(with_sql("flow") + """SELECT coalesce(CASE WHEN premium <= 0 THEN 'premium' WHEN available_at < date_trunc('second', event_time) THEN 'clock order' WHEN ingested_at > available_at + INTERVAL 1 MINUTE THEN 'capture lag' WHEN dte > 90 THEN 'dte' END, 'valid') AS reason, count(*) AS n FROM flow GROUP BY 1""")
def prj14_clock_quarantine(spark, d):
    lag = F.unix_timestamp("ingested_at") - F.unix_timestamp("available_at")
    reason = gates.first_reason((F.col("premium") <= 0, "premium"), (F.col("available_at") < F.date_trunc("second", "event_time"), "clock order"), (lag > 60, "capture lag"), (F.col("dte") > 90, "dte"))
    return src.flow_records(spark, d).groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("trades") + """SELECT coalesce(CASE WHEN width <= 0 THEN 'width' WHEN debit >= width * 0.45 THEN 'debit' WHEN settlement < 0 OR settlement > width THEN 'settlement' WHEN selected AND NOT priced THEN 'not priced' END, 'valid') AS reason, count(*) AS n FROM trades GROUP BY 1""")
def prj15_prj18_trade_invariants(spark, d):
    reason = gates.first_reason(
        (F.col("width") <= 0, "width"), (F.col("debit") >= F.col("width") * 0.45, "debit"), ((F.col("settlement") < 0) | (F.col("settlement") > F.col("width")), "settlement"), (F.col("selected") & ~F.col("priced"), "not priced")
    )
    return src.trades(spark, d).groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("daily") + """SELECT symbol, count(*) AS sessions FROM daily WHERE session BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND symbol IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1""")
def prj13_universe_and_split(spark, d):
    universe = ["1-URGENT", "2-HIGH", "5-LOW"]
    # filters on the grouping columns reach the scan
    return daily_bars(spark, d).filter(F.col("symbol").isin(universe) & F.col("session").between("1996-01-01", "1998-12-31")).groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"))


# --- joins ---------------------------------------------------------------------------------------------------------


def _snapshots(spark, d):
    end = F.timestamp_seconds(F.unix_timestamp(F.col("session").cast("timestamp")) + (F.col("minute") + 60) * 60)
    return intraday_bars(spark, d).select("symbol", end.alias("snapshot_time"), F.col("close").alias("spot"), F.col("high").alias("call_wall"), F.col("low").alias("put_wall"))


@query(with_sql("hourly", "windows", "decisions") + """, snap AS (SELECT symbol, CAST(session AS TIMESTAMP) + to_minutes(CAST(minute + 60 AS INTEGER)) AS t, close AS spot, high AS cw, low AS pw FROM hourly),
ok AS (SELECT s.* FROM snap s SEMI JOIN (SELECT symbol, observed_at FROM obs WHERE event_count > 0) o ON s.symbol = o.symbol AND s.t = o.observed_at),
j AS (SELECT d.symbol, d.decision, max_by(ok, t) AS m FROM decisions d LEFT JOIN ok ON ok.symbol = d.symbol AND ok.t <= d.decision AND ok.t >= d.decision - INTERVAL 30 MINUTE GROUP BY 1, 2)
SELECT symbol, decision, m.spot AS spot, round((m.cw - m.spot) / m.spot, 6) AS call_wall_distance, round((m.spot - m.pw) / m.spot, 6) AS put_wall_distance FROM j""")
def join8_agg3_exposure_snapshot(spark, d):
    seen = src.observation_windows(spark, d).filter("event_count > 0").select("symbol", F.col("observed_at").alias("snapshot_time"))
    ok = _snapshots(spark, d).join(seen, ["symbol", "snapshot_time"], "left_semi")
    near = asof(src.decisions(spark, d), ok, keys=["symbol"], left_ts="decision", right_ts="snapshot_time", values=["spot", "call_wall", "put_wall"], tolerance_seconds=1800)
    away = lambda x: r6(F.try_divide(x, F.col("spot")))
    return near.select("symbol", "decision", "spot", away(F.col("call_wall") - F.col("spot")).alias("call_wall_distance"), away(F.col("spot") - F.col("put_wall")).alias("put_wall_distance"))


@query(with_sql("decisions") + """, levels AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS lday, floor(value / 25) * 25 AS level, sum(value) AS premium FROM events GROUP BY 1, 2, 3),
spot AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS lday, avg(value) AS spot FROM events GROUP BY 1, 2),
fam AS (SELECT l.symbol, l.lday, count(*) AS levels, min(abs(level - spot)) AS nearest, sum(premium * abs(level - spot)) / sum(premium) AS mean_distance, max(premium) / sum(premium) AS concentration FROM levels l JOIN spot s ON l.symbol = s.symbol AND l.lday = s.lday GROUP BY 1, 2),
j AS (SELECT d.symbol, d.decision, max_by(fam, lday) AS m FROM decisions d LEFT JOIN fam ON fam.symbol = d.symbol AND fam.lday < d.day AND fam.lday >= d.day - 4 GROUP BY 1, 2)
SELECT symbol, decision, m.levels AS levels, round(m.nearest, 6) AS nearest, round(m.mean_distance, 6) AS mean_distance, round(m.concentration, 6) AS concentration, m.levels IS NOT NULL AS covered FROM j""")
def join9_join10_agg2_agg4_closed_levels(spark, d):
    """The family of the latest closed day before the decision day, at most four days old; without one, not covered."""
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("lday"), "value")
    levels = e.groupBy("symbol", "lday", (F.floor(F.col("value") / 25) * 25).alias("level")).agg(F.sum("value").alias("premium"), F.count(F.lit(1)).alias("c"))
    day = W.partitionBy("symbol", "lday")
    spot = F.sum("premium").over(day) / F.sum("c").over(day)
    gap = F.abs(F.col("level") - F.col("spot"))
    fam = levels.withColumn("spot", spot).groupBy("symbol", "lday").agg(
        F.count(F.lit(1)).alias("levels"), F.min(gap).alias("nearest"), (F.sum(F.col("premium") * gap) / F.sum("premium")).alias("mean_distance"), (F.max("premium") / F.sum("premium")).alias("concentration")
    )
    got = asof(src.decisions(spark, d), fam, keys=["symbol"], left_ts="day", right_ts="lday", values=["levels", "nearest", "mean_distance", "concentration"], strict=True, tolerance_seconds=4 * 86400)
    return got.select("symbol", "decision", "levels", r6("nearest").alias("nearest"), r6("mean_distance").alias("mean_distance"), r6("concentration").alias("concentration"), F.col("levels").isNotNull().alias("covered"))


@query(with_sql("tape") + """, wk AS (SELECT DISTINCT index_code, date_trunc('week', index_date)::DATE + 7 AS decision FROM tape),
est AS (SELECT index_code, index_date AS as_of, max_by(value, revision) AS consensus FROM tape GROUP BY 1, 2)
SELECT w.index_code, w.decision, max(as_of) AS as_of, max_by(consensus, as_of) AS consensus FROM wk w LEFT JOIN est e ON e.index_code = w.index_code AND e.as_of BETWEEN w.decision - 6 AND w.decision GROUP BY 1, 2""")
def join11_fresh_consensus(spark, d):
    t = src.tape(spark, d)
    est = t.groupBy("index_code", F.col("index_date").alias("as_of")).agg(F.max_by("value", "revision").alias("consensus"))
    weeks = t.select("index_code", F.date_add(F.trunc("index_date", "week"), 7).alias("decision")).distinct()
    return asof(weeks, est, keys=["index_code"], left_ts="decision", right_ts="as_of", values=["consensus"], tolerance_seconds=6 * 86400)


@query(with_sql("facts") + """, base AS (SELECT symbol, "start", "end", value FROM facts WHERE accession LIKE '%-a')
SELECT a.symbol, a."end", a.value AS ytd, max_by(b.value, b."end") AS prior_ytd, round(a.value - max_by(b.value, b."end"), 2) AS discrete
FROM base a LEFT JOIN base b ON a.symbol = b.symbol AND a."start" = b."start" AND date_diff('day', b."end", a."end") BETWEEN 80 AND 100 GROUP BY 1, 2, 3""")
def join14_prior_year_to_date(spark, d):
    base = src.ytd_facts(spark, d).filter("accession like '%-a'").select("symbol", "start", "end", "value")
    got = nearest_prior(base, keys=["symbol", "start"], end="end", value="value", low=80, high=100)
    return got.select("symbol", "end", F.col("value").alias("ytd"), F.col("prior_value").alias("prior_ytd"), F.round(F.col("value") - F.col("prior_value"), 2).alias("discrete"))


@query(with_sql("facts") + """, base AS (SELECT symbol, "end", value, form FROM facts WHERE accession LIKE '%-a')
SELECT a.symbol, a."end", round(ln(a.value / min_by(b.value, abs(date_diff('day', b."end", a."end") - 365))), 6) AS log_growth
FROM base a LEFT JOIN base b ON a.symbol = b.symbol AND date_diff('day', b."end", a."end") BETWEEN 355 AND 375 GROUP BY a.symbol, a."end", a.value""")
def join13_year_ago(spark, d):
    base = src.ytd_facts(spark, d).filter("accession like '%-a'").select("symbol", "end", "value")
    days = F.datediff("end", F.to_date(F.lit("1970-01-01")))
    left = base.withColumn("b", F.explode(F.array_distinct(F.array(F.floor((days - 375) / 400), F.floor((days - 355) / 400)))))
    right = base.select("symbol", F.floor(days / 400).alias("b"), F.col("end").alias("then"), F.col("value").alias("was"))
    gap = F.datediff("end", "then")
    best = left.join(right, ["symbol", "b"]).filter(gap.between(355, 375)).groupBy("symbol", "end").agg(F.min_by("was", F.abs(gap - 365)).alias("was"))
    return base.join(best, ["symbol", "end"], "left").select("symbol", "end", r6(F.ln(F.col("value") / F.col("was"))).alias("log_growth"))


@query(with_sql("daily") + """, g AS (SELECT symbol, date_trunc('month', session)::DATE AS m, min_by(close, session) AS p FROM daily GROUP BY 1, 2),
r AS (SELECT a.symbol, a.m, b.p / a.p - 1 AS r FROM g a JOIN g b ON a.symbol = b.symbol AND b.m = a.m + INTERVAL 1 MONTH)
SELECT m AS month, count(*) AS names, CASE WHEN count(*) >= 3 THEN round(avg(r.r) - max(b.r), 6) END AS excess FROM r JOIN (SELECT m, r FROM r WHERE symbol = '1-URGENT') b USING (m) WHERE symbol <> '1-URGENT' GROUP BY 1""")
def join15_basket_excess(spark, d):
    """Mean return of the basket between two grid ends over the benchmark's; both need it, and at least three names."""
    g = daily_bars(spark, d).groupBy("symbol", F.trunc("session", "month").alias("month")).agg(F.min_by("close", "session").alias("p"))
    later = F.lead(F.struct("month", "p")).over(series("symbol", "month"))
    r = g.withColumn("next", later).filter(F.col("next.month") == F.add_months("month", 1)).select("symbol", "month", (F.col("next.p") / F.col("p") - 1).alias("r"))
    bench = F.col("symbol") == "1-URGENT"
    out = r.groupBy("month").agg(F.count(F.when(~bench, 1)).alias("names"), F.avg(F.when(~bench, F.col("r"))).alias("mean"), F.max(F.when(bench, F.col("r"))).alias("b"))
    return out.filter("b is not null and names > 0").select("month", "names", F.when(F.col("names") >= 3, r6(F.col("mean") - F.col("b"))).alias("excess"))


@query(with_sql("flow", "windows") + """, z AS (SELECT symbol, observed_at, event_count FROM obs)
SELECT z.symbol, count(*) FILTER (event_count = 0) AS zero_windows, count(*) FILTER (event_count = 0 AND f.n > 0) AS contradicted, count(*) FILTER (event_count <> coalesce(f.n, 0)) AS other_count
FROM z LEFT JOIN (SELECT symbol, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS observed_at, count(*) AS n FROM flow GROUP BY 1, 2) f ON z.symbol = f.symbol AND z.observed_at = f.observed_at GROUP BY 1""")
def join17_window_contradictions(spark, d):
    hour = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("hour", "event_time")) + 3600)
    rows = src.flow_records(spark, d).groupBy("symbol", hour.alias("observed_at")).agg(F.count(F.lit(1)).alias("n"))
    z = src.observation_windows(spark, d).join(rows, ["symbol", "observed_at"], "left")
    return z.groupBy("symbol").agg(F.count_if(F.col("event_count") == 0).alias("zero_windows"), F.count_if((F.col("event_count") == 0) & (F.col("n") > 0)).alias("contradicted"), F.count_if(F.col("event_count") != F.coalesce("n", F.lit(0))).alias("other_count"))


@query("""SELECT p_partkey FROM part n WHERE p_size > 25 AND EXISTS (SELECT 1 FROM part h WHERE h.p_size <= 25 AND h.p_type = n.p_type AND h.p_brand = n.p_brand)""")
def join19_known_duplicates(spark, d):
    keyed = table(spark, d, "part").withColumn("h", F.sha2(F.concat_ws("|", "p_type", "p_brand"), 256))
    return keyed.filter("p_size > 25").join(keyed.filter("p_size <= 25").select("h"), "h", "left_semi").select("p_partkey")


@query(with_sql("daily") + """, need AS (SELECT s.symbol, c.session FROM (SELECT DISTINCT symbol FROM daily) s, (SELECT DISTINCT session FROM daily) c)
SELECT n.symbol, count(*) AS needed, count(d.close) AS met, CASE WHEN count(d.close) >= ceil(0.9 * count(*)) THEN 'met' WHEN count(d.close) > 0 THEN 'partial' ELSE 'missing' END AS status
FROM need n LEFT JOIN daily d ON d.symbol = n.symbol AND d.session = n.session GROUP BY 1""")
def join25_ev14_requirement_status(spark, d):
    """Every symbol needs every observed session, so the needed cells need not be made: their number is known."""
    bars = daily_bars(spark, d).select("symbol", "session")
    needed = bars.agg(F.count_distinct("session").alias("needed"))  # one row
    got = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("met")).crossJoin(needed)
    return got.withColumn("status", F.when(F.col("met") >= F.ceil(F.col("needed") * 0.9), "met").when(F.col("met") > 0, "partial").otherwise("missing"))


# --- aggregations and evaluators -----------------------------------------------------------------------------------

WEEKS = """, r AS (SELECT symbol, session, close / lag(close) OVER w - 1 AS r FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY session)),
wk AS (SELECT symbol, isoyear(session) * 100 + week(session) AS week, avg(r) AS r FROM r WHERE r IS NOT NULL GROUP BY 1, 2),
arm AS (SELECT symbol, week, pos, pos * r / 100 - 0.0003 * abs(pos - coalesce(lag(pos) OVER w, 0)) AS base, pos * r / 100 - 0.0006 * abs(pos - coalesce(lag(pos) OVER w, 0)) AS elevated
  FROM (SELECT *, CASE WHEN lag(r) OVER v > 0.5 THEN 1 WHEN lag(r) OVER v IS NULL THEN 0 ELSE -1 END AS pos FROM wk WINDOW v AS (PARTITION BY symbol ORDER BY week)) WINDOW w AS (PARTITION BY symbol ORDER BY week))
"""


def _arm(spark, d):
    """Weekly outcomes of a momentum position, after turnover costs (3 and 6 basis points a unit)."""
    w = series("symbol", "week")
    r = daily_bars(spark, d).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(series())) - 1).filter("r is not null")
    wk = r.groupBy("symbol", iso_week("session").alias("week")).agg(F.avg("r").alias("r"))
    wk = wk.withColumn("pos", F.when(F.lag("r").over(w) > 0.5, 1).when(F.lag("r").over(w).isNull(), 0).otherwise(-1))
    turn = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0)))
    net = lambda c: F.col("pos") * F.col("r") / 100 - c * turn
    return wk.select("symbol", "week", "pos", net(0.0003).alias("base"), net(0.0006).alias("elevated"))


@query(with_sql("daily") + WEEKS + "SELECT symbol, week, pos, round(base, 8) AS base, round(elevated, 8) AS elevated FROM arm")
def win33_turnover_costs(spark, d):
    return _arm(spark, d).withColumns({"base": F.round("base", 8), "elevated": F.round("elevated", 8)})


@query(with_sql("daily") + WEEKS + """, e AS (SELECT *, exp(sum(ln(greatest(1 + base, 1e-6))) OVER (PARTITION BY symbol ORDER BY week)) AS eq FROM arm),
f AS (SELECT *, 1 - eq / greatest(1, max(eq) OVER (PARTITION BY symbol ORDER BY week)) AS dd FROM e)
SELECT symbol, count(*) AS periods, round(exp(sum(ln(greatest(1 + base, 1e-6)))) - 1, 6) AS total, round(avg(base) / stddev_samp(base) * sqrt(52), 6) AS sharpe, round(avg(base) / stddev_samp(base) * sqrt(count(*)), 6) AS t_stat,
round(max(dd), 6) AS max_drawdown, round(avg(CASE WHEN pos <> 0 THEN CAST(base > 0 AS INTEGER) END), 6) AS hit_rate, round(avg(CAST(pos <> 0 AS INTEGER)), 6) AS in_market, round(sum(base - elevated), 6) AS costs FROM f GROUP BY 1""")
def agg26_arm_metrics(spark, d):
    """A period can lose all but a millionth of the equity, so that a total loss counts and is not skipped as NULL."""
    upto = series("symbol", "week").rowsBetween(W.unboundedPreceding, 0)
    e = _arm(spark, d).withColumn("eq", F.exp(F.sum(F.ln(F.greatest(1 + F.col("base"), F.lit(1e-6)))).over(upto)))
    e = e.withColumn("dd", 1 - F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(upto)))
    ratio = F.try_divide(F.avg("base"), F.stddev_samp("base"))
    return e.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("periods"), r6(F.exp(F.sum(F.ln(F.greatest(1 + F.col("base"), F.lit(1e-6))))) - 1).alias("total"), r6(ratio * F.sqrt(F.lit(52.0))).alias("sharpe"), r6(ratio * F.sqrt(F.count(F.lit(1)))).alias("t_stat"),
        r6(F.max("dd")).alias("max_drawdown"), r6(F.avg(F.when(F.col("pos") != 0, (F.col("base") > 0).cast("int")))).alias("hit_rate"), r6(F.avg((F.col("pos") != 0).cast("int"))).alias("in_market"), r6(F.sum(F.col("base") - F.col("elevated"))).alias("costs"),
    )


@query(with_sql("daily") + WEEKS + """SELECT symbol, CAST(floor(week / 100) AS INTEGER) AS year, pos AS state, count(*) AS n, round(sum(base), 6) AS pnl, round(sum(base - elevated), 6) AS costs FROM arm GROUP BY 1, 2, 3""")
def agg27_snk6_state_year_table(spark, d):
    return _arm(spark, d).groupBy("symbol", F.floor(F.col("week") / 100).cast("int").alias("year"), F.col("pos").alias("state")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("base")).alias("pnl"), r6(F.sum(F.col("base") - F.col("elevated"))).alias("costs"))


@query(with_sql("daily") + WEEKS + """, s AS (SELECT *, coalesce(CAST(pos <> lag(pos) OVER (PARTITION BY symbol ORDER BY week) AS INTEGER), 1) AS new FROM arm)
SELECT symbol, pos AS state, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share, round(avg(base), 8) AS mean, round(stddev_pop(base), 8) AS vol, round(count(*) * 1.0 / sum(new), 6) AS duration, CAST(sum(new) AS BIGINT) AS runs FROM s GROUP BY 1, 2""")
def agg28_win39_agg32_state_statistics(spark, d):
    s = _arm(spark, d).withColumn("new", F.coalesce((F.col("pos") != F.lag("pos").over(series("symbol", "week"))).cast("int"), F.lit(1)))
    g = s.groupBy("symbol", F.col("pos").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.avg("base").alias("m"), F.stddev_pop("base").alias("v"), F.sum("new").alias("runs"))
    return g.select("symbol", "state", r6(F.col("n") / F.sum("n").over(W.partitionBy("symbol"))).alias("share"), F.round("m", 8).alias("mean"), F.round("v", 8).alias("vol"), r6(F.col("n") / F.col("runs")).alias("duration"), "runs")


@query(with_sql("daily") + WEEKS + """, m AS (SELECT symbol, week, base, pos, row_number() OVER (PARTITION BY symbol ORDER BY week) AS i FROM arm)
SELECT a.symbol, a.week, CASE WHEN count(b.base) >= 13 THEN round(a.base - avg(b.base), 8) END AS capture FROM m a LEFT JOIN m b ON a.symbol = b.symbol AND b.i <= a.i - 4 GROUP BY a.symbol, a.week, a.base""")
def win32_matured_capture(spark, d):
    """Against the mean of the outcomes that had matured (four periods back), after a warm-up of 13 of them."""
    old = series("symbol", "week").rowsBetween(W.unboundedPreceding, -4)
    return _arm(spark, d).select("symbol", "week", F.when(F.count("base").over(old) >= 13, F.round(F.col("base") - F.avg("base").over(old), 8)).alias("capture"))


@query(with_sql("daily") + WEEKS + """, n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS k FROM arm WINDOW w AS (PARTITION BY symbol ORDER BY week)),
st AS (SELECT symbol, count(*) AS periods, avg(base) AS m, avg(elevated) AS el, (sum(base) - max(base)) / (count(*) - 1) AS wb, avg(CASE WHEN i <= greatest(1, k // 2) THEN base END) AS h1, avg(CASE WHEN i > greatest(1, k // 2) THEN base END) AS h2, avg(CAST(pos = 1 AS INTEGER)) AS ls FROM n GROUP BY 1),
b AS (SELECT symbol, (i - 1) // 4 AS block, sum(base) AS s, count(*) AS c FROM n GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS kk FROM b),
dr AS (SELECT symbol, r, CAST(('0x' || substr(md5('stage|' || r || '|' || idx), 1, 8)) AS BIGINT) % kk AS idx FROM q, range(2000) t(r)),
lb AS (SELECT symbol, quantile_cont(m, 0.05) AS lb FROM (SELECT dr.symbol, r, sum(s) / sum(c) AS m FROM dr JOIN q ON dr.symbol = q.symbol AND dr.idx = q.idx GROUP BY 1, 2) GROUP BY 1)
SELECT st.symbol, periods, round(m, 8) AS mean, round(el, 8) AS elevated_mean, round(wb, 8) AS without_best, round(h1, 8) AS first_half, round(h2, 8) AS second_half, round(ls, 6) AS long_share, round(lb, 8) AS lower_bound,
CASE WHEN periods < 100 OR least(ls, 1 - ls) < 0.1 THEN 'UNTESTABLE' WHEN m > 0 AND el > 0 AND wb > 0 AND h1 > 0 AND h2 > 0 AND lb > 0 THEN 'PASSED' ELSE 'FAILED' END AS verdict FROM st JOIN lb ON st.symbol = lb.symbol""")
def ev11_res3_stage_gates(spark, d):
    out = gates.stage_gates(_arm(spark, d), ["symbol"], "week", "base", "elevated", "pos", min_periods=100, min_share=0.1)
    eight = ("mean", "elevated_mean", "without_best", "first_half", "second_half", "lower_bound")
    return out.withColumns({c: F.round(c, 8) for c in eight} | {"long_share": r6("long_share")})


@query(with_sql("trades") + """, t AS (SELECT *, settlement - debit - 0.03 * width AS net, settlement - debit - 0.045 * width AS hard FROM trades WHERE priced AND selected),
y AS (SELECT year(date) AS year, count(*) AS n, count(DISTINCT isoyear(date) * 100 + week(date)) AS weeks, avg(net / width) * 100 AS base, avg(hard / width) * 100 AS elevated, avg(CAST(settlement >= width - 1e-9 AS INTEGER) - debit / width) * 100 AS edge FROM t GROUP BY 1),
o AS (SELECT count(*) AS n, count(DISTINCT isoyear(date) * 100 + week(date)) AS weeks, avg(net / width) * 100 AS base, avg(hard / width) * 100 AS elevated, avg(CAST(settlement >= width - 1e-9 AS INTEGER) - debit / width) * 100 AS edge FROM t)
SELECT o.n, o.weeks, round(o.base, 6) AS base, round(o.elevated, 6) AS elevated, round(o.edge, 6) AS edge, round(min(y.base), 6) AS worst_year, count(*) FILTER (y.n >= 15 AND y.weeks >= 8) AS years_over_floor, round(least(o.edge, o.elevated, min(y.base)), 6) AS ranking
FROM o, y GROUP BY o.n, o.weeks, o.base, o.elevated, o.edge""")
def ev7_agg33_top5_staged_ledger(spark, d):
    """One scan: years and the whole are grouping sets over the same rows."""
    t = src.trades(spark, d).filter("priced and selected").withColumn("year", F.year("date")).withColumn("week", iso_week("date"))
    net = lambda c: F.avg((F.col("settlement") - F.col("debit") - c * F.col("width")) / F.col("width")) * 100
    edge = F.avg((F.col("settlement") >= F.col("width") - 1e-9).cast("int") - F.col("debit") / F.col("width")) * 100
    g = t.rollup("year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("week").alias("weeks"), net(0.03).alias("base"), net(0.045).alias("elevated"), edge.alias("edge"))
    whole = lambda c: F.max(F.when(F.col("year").isNull(), F.col(c))).alias(c)
    yearly = F.col("year").isNotNull()
    out = g.agg(*[whole(c) for c in ("n", "weeks", "base", "elevated", "edge")], F.min(F.when(yearly, F.col("base"))).alias("worst_year"), F.count_if(yearly & (F.col("n") >= 15) & (F.col("weeks") >= 8)).alias("years_over_floor"))
    return out.withColumn("ranking", F.least("edge", "elevated", "worst_year")).withColumns({c: r6(c) for c in ("base", "elevated", "edge", "worst_year")} | {"ranking": r6("ranking")})


@query("""WITH t AS (SELECT o_custkey, count(*) >= 10 AS enough, avg(o_totalprice) > 150000 AS mean_ok, max(o_totalprice) / sum(o_totalprice) < 0.2 AS spread_ok FROM orders GROUP BY 1),
l AS (SELECT unnest(['enough', 'mean_ok', 'spread_ok']) AS gate, unnest([enough, mean_ok, spread_ok]) AS ok FROM t)
SELECT gate, count(*) AS trials, round(avg(CAST(NOT ok AS INTEGER)), 6) AS failed_share, CASE WHEN avg(CAST(NOT ok AS INTEGER)) >= 0.8 THEN 'dominant' WHEN avg(CAST(NOT ok AS INTEGER)) >= 0.5 THEN 'common' ELSE 'rare' END AS label FROM l GROUP BY 1""")
def agg29_gate_failures(spark, d):
    p = F.col("o_totalprice")
    t = table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) >= 10).alias("enough"), (F.avg(p) > 150000).alias("mean_ok"), (F.max(p) / F.sum(p) < 0.2).alias("spread_ok"))
    return gates.failure_histogram(t, ["enough", "mean_ok", "spread_ok"]).withColumn("failed_share", r6("failed_share"))


@query(with_sql("trades") + """SELECT year(date) AS year, CASE WHEN count(*) >= 10 THEN round(avg(CAST(settlement > debit AS INTEGER)), 6) END AS p, CASE WHEN count(*) >= 10 THEN round(avg(CASE WHEN settlement > debit THEN settlement - debit END) / avg(CASE WHEN settlement <= debit THEN debit - settlement END), 6) END AS b
FROM trades WHERE priced GROUP BY 1""")
def agg31_win_rate_and_payoff(spark, d):
    gain = F.col("settlement") - F.col("debit")
    known = F.count(F.lit(1)) >= 10
    b = F.try_divide(F.avg(F.when(gain > 0, gain)), F.avg(F.when(gain <= 0, -gain)))
    return src.trades(spark, d).filter("priced").groupBy(F.year("date").alias("year")).agg(F.when(known, r6(F.avg((gain > 0).cast("int")))).alias("p"), F.when(known, r6(b)).alias("b"))


@query(with_sql("daily") + """, s AS (SELECT symbol, session, CASE WHEN lag(close) OVER w < 100000 THEN 1 WHEN lag(close) OVER w > 250000 THEN -1 ELSE 0 END AS decision, close / open - 1 AS payoff FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY session)),
p AS (SELECT session, count(*) FILTER (decision <> 0) AS trades, avg(CASE WHEN decision <> 0 THEN decision * payoff END) AS m FROM s GROUP BY 1)
SELECT CAST(sum(trades) AS BIGINT) AS fires, round(sum(trades * m) / sum(trades), 6) AS trade_mean, round(avg(m), 6) AS session_mean, round(sum(trades) * 1.0 / count(m), 6) AS trades_per_session, round(sum(trades * m) / sum(trades) - avg(m), 6) AS correlated FROM p""")
def agg18_agg19_firing_diagnostics(spark, d):
    before = F.lag("close").over(series())
    s = daily_bars(spark, d).select("session", F.when(before < 100000, 1).when(before > 250000, -1).otherwise(0).alias("decision"), (F.col("close") / F.col("open") - 1).alias("payoff"))
    p = s.filter("decision <> 0").groupBy("session").agg(F.count(F.lit(1)).alias("t"), F.avg(F.col("decision") * F.col("payoff")).alias("m"))
    mean = F.sum(F.col("t") * F.col("m")) / F.sum("t")
    return p.agg(F.sum("t").alias("fires"), r6(mean).alias("trade_mean"), r6(F.avg("m")).alias("session_mean"), r6(F.sum("t") / F.count("m")).alias("trades_per_session"), r6(mean - F.avg("m")).alias("correlated"))


@query(with_sql("facts") + """SELECT "end", count(*) AS names, CASE WHEN count(*) >= 20 THEN round(avg(value), 2) END AS mean, max(filed) AS known_on FROM facts WHERE accession LIKE '%-a' GROUP BY 1""")
def agg20_basket_mean(spark, d):
    f = src.ytd_facts(spark, d).filter("accession like '%-a'")
    return f.groupBy("end").agg(F.count(F.lit(1)).alias("names"), F.when(F.count(F.lit(1)) >= 20, F.round(F.avg("value"), 2)).alias("mean"), F.max("filed").alias("known_on"))


@query(with_sql("trades") + """, p AS (SELECT trade_id, list_transform([0, 100, 100 + width, 2 * (100 + width)], lambda x: greatest(x - 100, 0) - greatest(x - 100 - width, 0) - debit) AS v FROM trades)
SELECT trade_id, round(list_min(v), 6) AS worst, round(list_max(v), 6) AS best FROM p""")
def agg24_payoff_bounds(spark, d):
    """A long call at 100 and a short one a width above, less the debit, over its kinks and one point beyond."""
    upper = F.col("width") + 100
    pay = lambda x: F.greatest(x - 100, F.lit(0.0)) - F.greatest(x - upper, F.lit(0.0)) - F.col("debit")
    v = F.transform(F.array(F.lit(0.0), F.lit(100.0), upper.cast("double"), (upper * 2).cast("double")), pay)
    return src.trades(spark, d).select("trade_id", r6(F.array_min(v)).alias("worst"), r6(F.array_max(v)).alias("best"))


# --- top, sets and audits ------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority AS family, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS finalist, max(o_totalprice) AS score FROM orders WHERE o_totalprice < 400000 GROUP BY 1""")
def top2_top4_top6_finalists(spark, d):
    best = F.max(F.struct(F.col("o_totalprice").alias("score"), (-F.col("o_orderkey")).alias("k"))).alias("m")
    g = table(spark, d, "orders").filter("o_totalprice < 400000").groupBy(F.col("o_orderpriority").alias("family")).agg(best)
    return g.select("family", (-F.col("m.k")).alias("finalist"), F.col("m.score").alias("score"))


@query("""SELECT o_orderkey, o_custkey % 7 = 3 AS same_universe, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_custkey % 7 = 3 DESC, o_orderdate DESC, o_orderkey LIMIT 12""")
def top7_prior_evidence(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7 == 3).alias("same_universe"), F.to_date("o_orderdate").alias("day"))
    return o.orderBy(F.col("same_universe").desc(), F.col("day").desc(), "o_orderkey").limit(12)


@query("""SELECT 'orders' AS series, count(*) AS days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders) UNION ALL SELECT 'shipments', count(*) FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem)
UNION ALL SELECT 'either', count(*) FROM (SELECT CAST(o_orderdate AS DATE) FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)""")
def set1_set4_series_union(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("series", F.lit("orders"))
    s = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct().withColumn("series", F.lit("shipments"))
    both = o.unionByName(s)
    either = both.select("day").distinct().withColumn("series", F.lit("either"))
    return both.unionByName(either).groupBy("series").agg(F.count(F.lit(1)).alias("days"))


@query("""WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, turn) AS n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, count(*) AS turns, CAST(max(n) AS BIGINT) AS most_per_turn, count(*) FILTER (before IS NOT NULL AND turn <> before + 1) AS gaps, count(*) FILTER (prev = role) AS bad_transitions FROM c GROUP BY 1""")
def set5_int3_ledger_audit(spark, d):
    """Turns are unique and contiguous, and no role follows itself."""
    w = series("conv_id", "turn")
    c = table(spark, d, "conversations").withColumns({"before": F.lag("turn").over(w), "prev": F.lag("role").over(w), "n": F.count(F.lit(1)).over(W.partitionBy("conv_id", "turn"))})
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("n").alias("most_per_turn"), F.count_if(F.col("turn") != F.col("before") + 1).alias("gaps"), F.count_if(F.col("prev") == F.col("role")).alias("bad_transitions"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'opened' WHEN 'purchase' THEN 'verdict' ELSE 'other' END AS kind FROM events),
p AS (SELECT *, coalesce(sum(CAST(kind = 'opened' AS INTEGER)) OVER w, 0) AS opened FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, count(*) FILTER (kind = 'opened' AND opened > 0) AS reopened, count(*) FILTER (kind = 'verdict' AND opened = 0) AS verdict_before_opening FROM p GROUP BY 1""")
def int4_receipt_audit(spark, d):
    kind = F.when(F.col("event_type") == "signup", "opened").when(F.col("event_type") == "purchase", "verdict").otherwise("other")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    p = table(spark, d, "events").withColumn("kind", kind).withColumn("opened", F.coalesce(F.sum((F.col("kind") == "opened").cast("int")).over(w), F.lit(0)))
    return p.groupBy("user_id").agg(F.count_if((F.col("kind") == "opened") & (F.col("opened") > 0)).alias("reopened"), F.count_if((F.col("kind") == "verdict") & (F.col("opened") == 0)).alias("verdict_before_opening"))


@query("""SELECT conv_id, turn, regexp_extract_all(text, '[A-Z]{2,5}') AS symbols, coalesce(regexp_matches(text, '(?i)\\b(password|secret|token|api_key)\\b'), false) AS forbidden FROM conversations""")
def fn20_int6_text_extraction(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all(t, F.lit("[A-Z]{2,5}"), F.lit(0)).alias("symbols"), F.coalesce(t.rlike(r"(?i)\b(password|secret|token|api_key)\b"), F.lit(False)).alias("forbidden"))
