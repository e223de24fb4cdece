"""Queries on point-in-time joins, aggregates, resampling, evaluators, fundamentals, admission and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.functions import scalars as fn
from asofkit.operators import indicators, integrity, resampling, rules, vintages
from asofkit.operators import windows as win
from asofkit.operators.asof import asof, latest_per_key, live_at, nearest_prior, visible_rows
from asofkit.operators.calendar import iso_week
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


# --- joins ---------------------------------------------------------------------------------------------------------


@query(with_sql("daily") + """SELECT d.symbol, d.session, CASE WHEN b.close IS NOT NULL THEN round(d.close / d.open - b.close / b.open, 6) END AS relative, round(d.close / d.open - coalesce(b.close / b.open, 1), 6) AS closed_zero
FROM daily d LEFT JOIN daily b ON b.symbol = '1-URGENT' AND b.session = d.session""")
def join2_benchmark_relative(spark, d):
    bars = daily_bars(spark, d)
    bench = bars.filter("symbol = '1-URGENT'").select("session", (F.col("close") / F.col("open")).alias("b"))
    x = F.col("close") / F.col("open")
    return bars.join(bench, "session", "left").select("symbol", "session", r6(x - F.col("b")).alias("relative"), r6(x - F.coalesce("b", F.lit(1.0))).alias("closed_zero"))


@query(with_sql("daily") + """SELECT a.symbol, a.session, round(a.close / r.close, 6) AS factor FROM daily a LEFT JOIN daily r ON r.symbol = '5-LOW' AND r.session = a.session""")
def join1_adjustment_factor(spark, d):
    bars = daily_bars(spark, d)
    raw = bars.filter("symbol = '5-LOW'").select("session", F.col("close").alias("raw"))
    return bars.join(raw, "session", "left").select("symbol", "session", r6(F.try_divide("close", "raw")).alias("factor"))


@query("""WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 480000), s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders), n AS (SELECT session, lead(session) OVER (ORDER BY session) AS nxt FROM s)
SELECT session, session IN (SELECT day FROM e) AS event_today, coalesce(nxt IN (SELECT day FROM e), false) AS event_next FROM n""")
def join3_event_flags(spark, d):
    o = table(spark, d, "orders")
    days = o.filter("o_totalprice > 480000").select(F.to_date("o_orderdate").alias("day")).distinct()
    s = o.select(F.to_date("o_orderdate").alias("session")).distinct().withColumn("nxt", F.lead("session").over(W.orderBy("session")))  # one row per session
    a, b = days.withColumn("event_today", F.lit(True)), days.withColumnRenamed("day", "d2").withColumn("event_next", F.lit(True))
    out = s.join(a, s["session"] == a["day"], "left").join(b, s["nxt"] == b["d2"], "left")
    return out.select("session", F.coalesce("event_today", F.lit(False)).alias("event_today"), F.coalesce("event_next", F.lit(False)).alias("event_next"))


_DECISION_DAYS = "dd AS (SELECT DISTINCT symbol, filed AS d FROM facts)"


@query(with_sql("facts") + f""", {_DECISION_DAYS} SELECT symbol, d, "end", value, accession FROM (SELECT dd.symbol, dd.d, f."end", f.value, f.accession, row_number() OVER (PARTITION BY dd.symbol, dd.d, f."end" ORDER BY f.filed DESC, CAST(f.form LIKE '%/A' AS INTEGER) DESC, f.accession DESC) AS r
FROM dd JOIN facts f ON f.symbol = dd.symbol AND f.filed <= dd.d AND f."end" BETWEEN dd.d - 400 AND dd.d) WHERE r = 1""")
def join4_point_in_time_values(spark, d):
    facts = src.ytd_facts(spark, d)
    days = facts.select("symbol", F.col("filed").alias("d")).distinct()
    # periods lie in the bucket of the day or in the one before, so a day meets no older facts
    bucket = lambda c: F.floor(F.unix_date(c) / 401)
    days = days.withColumn("b", F.explode(F.array(bucket("d"), bucket("d") - 1)))
    met = days.join(facts.withColumn("b", bucket("end")), ["symbol", "b"]).filter((F.col("filed") <= F.col("d")) & F.datediff("d", "end").between(0, 400))
    order = [F.desc("filed"), F.col("form").endswith("/A").desc(), F.desc("accession")]
    return latest_per_key(met, ["symbol", "d", "end"], order).select("symbol", "d", "end", "value", "accession")


_PRINTS = """p AS (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2),
l AS (SELECT event_id AS purchase_id, user_id, ts FROM events WHERE event_type = 'purchase')"""


@query(f"""WITH {_PRINTS} SELECT l.purchase_id, CASE WHEN epoch(l.ts) - epoch(p.ts) <= 900 THEN p.event_id END AS print_id, CASE WHEN epoch(l.ts) - epoch(p.ts) <= 900 THEN p.value END AS price FROM l ASOF LEFT JOIN p ON l.user_id = p.user_id AND l.ts >= p.ts""")
def join5_freshest_print(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    left = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("at"))
    right = e.filter("event_type <> 'purchase'").select("user_id", "ts", "event_id", "value")
    out = asof(left, right, keys=["user_id"], left_ts="at", right_ts="ts", values=["event_id", "value"], tie=["event_id"], tolerance_seconds=900)
    return out.select("purchase_id", F.col("event_id").alias("print_id"), F.col("value").alias("price"))


@query(with_sql("tape") + """SELECT index_code, index_date, revision, value FROM tape WHERE published_at <= index_date + INTERVAL 23 HOUR AND (superseded_at IS NULL OR superseded_at > index_date + INTERVAL 23 HOUR)""")
def join6_live_revisions(spark, d):
    t = src.tape(spark, d)
    at = F.timestamp_seconds(F.unix_timestamp(F.col("index_date").cast("timestamp")) + 23 * 3600)
    return live_at(t, at).select("index_code", "index_date", "revision", "value")


@query(with_sql("decisions", "windows") + """SELECT d.symbol, d.day, d.decision, CASE WHEN o.observed_at >= d.decision - INTERVAL 2 HOUR THEN o.event_count END AS event_count FROM decisions d ASOF LEFT JOIN obs o ON d.symbol = o.symbol AND d.day = o.day AND d.decision >= o.observed_at""")
def join7_latest_window(spark, d):
    out = asof(src.decisions(spark, d), src.observation_windows(spark, d), keys=["symbol", "day"], left_ts="decision", right_ts="observed_at", values=["event_count"], tolerance_seconds=7200)
    return out.select("symbol", "day", F.col("decision").cast("timestamp_ntz").alias("decision"), "event_count")


@query(with_sql("daily") + """SELECT a.symbol, a.session, max(b.session) AS prior_session, max_by(b.close, b.session) AS prior_close FROM daily a LEFT JOIN daily b ON a.symbol = b.symbol AND a.session - b.session BETWEEN 80 AND 100 GROUP BY 1, 2""")
def join12_prior_period(spark, d):
    bars = daily_bars(spark, d).select("symbol", "session", "close")
    out = nearest_prior(bars, keys=["symbol"], end="session", value="close", low=80, high=100)
    return out.select("symbol", "session", F.col("prior_end").alias("prior_session"), F.col("prior_value").alias("prior_close"))


@query(with_sql("daily") + """SELECT symbol, session FROM (SELECT DISTINCT s.symbol, x.session FROM (SELECT DISTINCT symbol FROM daily) s, (SELECT DISTINCT session FROM daily) x) EXCEPT SELECT symbol, session FROM daily""")
def join16_missing_sessions(spark, d):
    b = daily_bars(spark, d).select("symbol", "session")
    every = b.agg(F.collect_set("session").alias("every"))  # one row: the days of the calendar
    seen = b.groupBy("symbol").agg(F.collect_set("session").alias("seen"))
    return seen.join(every).select("symbol", F.explode(F.array_except("every", "seen")).alias("session"))


@query(with_sql("trades") + """SELECT date, count(*) AS n, sum(CASE WHEN selected THEN 1 ELSE 0 END)::BIGINT AS signal, round(avg(CASE WHEN selected THEN settlement - debit END), 6) AS signal_pnl, round(avg(settlement - debit), 6) AS control_pnl FROM trades WHERE priced GROUP BY 1""")
def join21_signal_and_control(spark, d):
    t = src.trades(spark, d).filter("priced")
    pnl = F.col("settlement") - F.col("debit")
    return t.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("selected"), 1).otherwise(0)).alias("signal"), r6(F.avg(F.when(F.col("selected"), pnl))).alias("signal_pnl"), r6(F.avg(pnl)).alias("control_pnl"))


@query("""SELECT accession, "end", value FROM (SELECT *, row_number() OVER (PARTITION BY accession, "end" ORDER BY pri, value) AS r FROM (SELECT l_returnflag AS tag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS pri, l_orderkey AS accession, CAST(l_shipdate AS DATE) AS "end", l_extendedprice AS value FROM lineitem)) WHERE r = 1""")
def join24_first_tag_wins(spark, d):
    li = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("pri"), F.col("l_orderkey").alias("accession"), F.to_date("l_shipdate").alias("end"), F.col("l_extendedprice").alias("value"))
    return latest_per_key(li, ["accession", "end"], [F.col("pri"), F.col("value")]).select("accession", "end", "value")


# --- aggregates ----------------------------------------------------------------------------------------------------


_FLOW_SQL = """SELECT d.symbol, d.day, d.decision, round(coalesce(sum(premium) FILTER (side = 'buy'), 0), 4) AS buy, round(coalesce(sum(premium) FILTER (side = 'sell'), 0), 4) AS sell, round(coalesce(sum(premium) FILTER (option_type = 'C'), 0), 4) AS calls,
round(coalesce(sum(premium) FILTER (option_type = 'P'), 0), 4) AS puts, round(coalesce(sum(premium) FILTER (dte <= 7), 0), 4) AS short_dated, coalesce(sum(CASE WHEN is_sweep THEN 1 ELSE 0 END), 0)::BIGINT AS sweeps, coalesce(sum(CASE WHEN is_block THEN 1 ELSE 0 END), 0)::BIGINT AS blocks, count(f.event_id) AS prints,
round(coalesce(max(premium) / nullif(sum(premium), 0), 0), 6) AS top_share
FROM decisions d LEFT JOIN flow f ON f.symbol = d.symbol AND epoch_us(f.event_time) // 1000000 <= epoch(d.decision) AND f.available_at <= d.decision AND f.ingested_at <= d.decision AND epoch(d.decision) - epoch_us(f.event_time) // 1000000 <= 14400 AND f.event_time <= d.decision GROUP BY 1, 2, 3"""


@query(with_sql("decisions", "flow") + _FLOW_SQL)
def agg1_flow_family(spark, d):
    """Only prints whose three clocks lie before the decision, at most four hours old; a decision without prints has zeros."""
    at, flow = src.decisions(spark, d), src.flow_records(spark, d)
    met = visible_rows(at, flow, keys=["symbol"], at="decision", clocks=["event_time", "available_at", "ingested_at"], horizon_seconds=14400)
    s = lambda cond: F.sum(F.when(cond, F.col("premium")).otherwise(0.0))
    g = met.groupBy("symbol", "day", "decision").agg(
        s(F.col("side") == "buy").alias("buy"), s(F.col("side") == "sell").alias("sell"), s(F.col("option_type") == "C").alias("calls"), s(F.col("option_type") == "P").alias("puts"), s(F.col("dte") <= 7).alias("short_dated"),
        F.sum(F.col("is_sweep").cast("long")).alias("sweeps"), F.sum(F.col("is_block").cast("long")).alias("blocks"), F.count(F.lit(1)).alias("prints"), F.try_divide(F.max("premium"), F.sum("premium")).alias("top_share"),
    )
    out = at.join(g, ["symbol", "day", "decision"], "left")
    money = ["buy", "sell", "calls", "puts", "short_dated"]
    return out.select("symbol", "day", F.col("decision").cast("timestamp_ntz").alias("decision"), *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in money], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sweeps", "blocks", "prints")], r6(F.coalesce("top_share", F.lit(0.0))).alias("top_share"))


@query(with_sql("decisions", "windows") + """, c AS (SELECT d.symbol, d.day, d.decision, o.observed_at IS NOT NULL AND o.observed_at >= d.decision - INTERVAL 1 HOUR AS covered FROM decisions d ASOF LEFT JOIN obs o ON d.symbol = o.symbol AND d.day = o.day AND d.decision >= o.observed_at)
SELECT symbol, count(*) AS decisions, sum(CASE WHEN covered THEN 1 ELSE 0 END)::BIGINT AS covered, round(sum(CASE WHEN covered THEN 1 ELSE 0 END) / count(*), 6) AS ratio, count(DISTINCT isoyear(day) * 100 + weekofyear(day)) AS weeks,
CASE WHEN sum(CASE WHEN covered THEN 1 ELSE 0 END) = 0 THEN 'unavailable' WHEN sum(CASE WHEN covered THEN 1 ELSE 0 END) / count(*) >= 0.9 AND count(DISTINCT isoyear(day) * 100 + weekofyear(day)) >= 4 THEN 'ready' ELSE 'insufficient' END AS state FROM c GROUP BY 1""")
def agg5_coverage_report(spark, d):
    c = asof(src.decisions(spark, d), src.observation_windows(spark, d), keys=["symbol", "day"], left_ts="decision", right_ts="observed_at", values=["event_count"], tolerance_seconds=3600)
    g = c.groupBy("symbol").agg(F.count(F.lit(1)).alias("decisions"), F.count("observed_at").alias("covered"), F.count_distinct(iso_week("day")).alias("weeks")).withColumn("ratio", r6(F.col("covered") / F.col("decisions")))
    return g.withColumn("state", F.when(F.col("covered") == 0, "unavailable").when((F.col("covered") / F.col("decisions") >= 0.9) & (F.col("weeks") >= 4), "ready").otherwise("insufficient"))


@query(with_sql("trades") + """SELECT structure, sum(CASE WHEN selected THEN 1 ELSE 0 END)::BIGINT AS selected, sum(CASE WHEN selected AND priced THEN 1 ELSE 0 END)::BIGINT AS priced, round(sum(CASE WHEN selected AND priced THEN 1 ELSE 0 END) / sum(CASE WHEN selected THEN 1 ELSE 0 END), 6) AS coverage FROM trades GROUP BY 1""")
def agg6_ledger_counts(spark, d):
    t = src.trades(spark, d).groupBy("structure").agg(F.sum(F.col("selected").cast("long")).alias("selected"), F.sum((F.col("selected") & F.col("priced")).cast("long")).alias("priced"))
    return t.withColumn("coverage", r6(F.try_divide("priced", "selected")))


@query(with_sql("trades") + """SELECT structure, round(100 * avg(CASE WHEN abs(settlement - width) <= 1e-9 THEN 1.0 ELSE 0.0 END - (least(greatest(debit / width, 0), 1) + 0.03)), 6) AS edge_pp, round(100 * avg((settlement - debit - 0.03 * width) / width), 6) AS base_mean, round(100 * avg((settlement - debit - 0.045 * width) / width), 6) AS elevated_mean FROM trades WHERE priced AND selected GROUP BY 1""")
def agg7_agg8_edge_and_costs(spark, d):
    t = src.trades(spark, d).filter("priced and selected")
    won = (F.abs(F.col("settlement") - F.col("width")) <= 1e-9).cast("double")
    cost = lambda c: r6(100 * F.avg((F.col("settlement") - F.col("debit") - c * F.col("width")) / F.col("width")))
    return t.groupBy("structure").agg(r6(100 * F.avg(won - (F.least(F.greatest(F.col("debit") / F.col("width"), F.lit(0.0)), F.lit(1.0)) + 0.03))).alias("edge_pp"), cost(0.03).alias("base_mean"), cost(0.045).alias("elevated_mean"))


@query(with_sql("trades") + """SELECT selected, y, count(*) AS n, round(avg(CASE WHEN settlement >= width THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg((settlement - debit) / width), 6) AS mean_dw FROM (SELECT *, CAST(year(date) AS INTEGER) AS y FROM trades WHERE priced) GROUP BY GROUPING SETS ((selected), (selected, y))""")
def agg9_agg10_summary_by_year(spark, d):
    t = src.trades(spark, d).filter("priced").withColumn("y", F.year("date"))
    g = t.groupingSets([["selected"], ["selected", "y"]], "selected", "y")
    return g.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("settlement") >= F.col("width")).cast("double"))).alias("win_rate"), r6(F.avg((F.col("settlement") - F.col("debit")) / F.col("width"))).alias("mean_dw"))


_NET = "t AS (SELECT symbol, session, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS net FROM daily)"


@query(with_sql("daily") + f""", {_NET}, p AS (SELECT session, avg(net) AS m FROM t WHERE net IS NOT NULL GROUP BY 1) SELECT count(*) AS days, round(avg(m) / stddev_samp(m) * sqrt(252), 6) AS sharpe, round((sum(m) - max(m)) / (count(*) - 1), 6) AS without_best FROM p""")
def agg11_agg13_portfolio_sharpe(spark, d):
    w = win.series()
    t = daily_bars(spark, d).withColumn("net", F.col("close") / F.lag("close").over(w) - 1).filter("net is not null")
    p = t.groupBy("session").agg(F.avg("net").alias("m"))
    return p.agg(F.count(F.lit(1)).alias("days"), r6(F.coalesce(F.try_divide(F.avg("m"), F.stddev_samp("m")) * 252**0.5, F.lit(0.0))).alias("sharpe"), r6(F.try_divide(F.sum("m") - F.max("m"), F.count(F.lit(1)) - 1)).alias("without_best"))


@query(with_sql("daily") + f""", {_NET}, s AS (SELECT symbol, count(*) AS n, avg(net) AS m FROM t WHERE net IS NOT NULL GROUP BY 1) SELECT count(*) AS symbols, round(max(n) / sum(n), 6) AS concentration, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM s WHERE n >= 5""")
def agg12_symbol_breadth(spark, d):
    t = daily_bars(spark, d).withColumn("net", F.col("close") / F.lag("close").over(win.series()) - 1).filter("net is not null")
    s = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("m")).filter("n >= 5")
    return s.agg(F.count(F.lit(1)).alias("symbols"), r6(F.max("n") / F.sum("n")).alias("concentration"), r6(F.avg((F.col("m") > 0).cast("double"))).alias("positive"))


@query(with_sql("daily") + f""", {_NET} SELECT symbol, CAST(isoyear(session) * 100 + weekofyear(session) AS INTEGER) AS week, round(avg(net), 6) AS mean, count(net) AS n FROM t WHERE net IS NOT NULL GROUP BY 1, 2""")
def agg14_weekly_means(spark, d):
    t = daily_bars(spark, d).withColumn("net", F.col("close") / F.lag("close").over(win.series()) - 1).filter("net is not null")
    return t.groupBy("symbol", iso_week("session").alias("week")).agg(r6(F.avg("net")).alias("mean"), F.count("net").alias("n"))


@query(with_sql("daily") + f""", {_NET}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM t WHERE net IS NOT NULL) SELECT symbol, round(avg(net) FILTER (k <= n // 2), 6) AS first_half, round(avg(net) FILTER (k > n // 2), 6) AS second_half FROM r GROUP BY 1""")
def agg16_halves(spark, d):
    t = daily_bars(spark, d).withColumn("net", F.col("close") / F.lag("close").over(win.series()) - 1).filter("net is not null")
    r = t.withColumn("k", F.row_number().over(win.series())).withColumn("h", F.floor(F.count(F.lit(1)).over(W.partitionBy("symbol")) / 2))
    return r.groupBy("symbol").agg(r6(F.avg(F.when(F.col("k") <= F.col("h"), F.col("net")))).alias("first_half"), r6(F.avg(F.when(F.col("k") > F.col("h"), F.col("net")))).alias("second_half"))


@query("""WITH m AS (SELECT 'quantity' AS feature, l_quantity AS x, l_orderkey * 10 + l_linenumber AS id FROM lineitem UNION ALL SELECT 'price', l_extendedprice, l_orderkey * 10 + l_linenumber FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x, id) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM m)
SELECT feature, min(x) AS low, max(x) FILTER (k = CAST(round_even(0.1 * (n - 1), 0) AS BIGINT)) AS p10, max(x) FILTER (k = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, max(x) FILTER (k = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT)) AS p90, max(x) AS high FROM r GROUP BY 1""")
def agg17_feature_ranges(spark, d):
    return resampling.nearest_rank_summary(table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")), ["quantity", "price"])


@query(with_sql("tape") + """, live AS (SELECT * FROM tape WHERE superseded_at IS NULL), c AS (SELECT date_trunc('month', index_date) AS m, count(DISTINCT index_date) AS days FROM tape GROUP BY 1)
SELECT index_code, CAST(date_trunc('month', index_date) AS DATE) AS month, CASE WHEN count(*) >= 0.9 * max(c.days) AND count(DISTINCT methodology) = 1 THEN round(avg(value), 4) END AS value FROM live JOIN c ON date_trunc('month', index_date) = c.m GROUP BY 1, 2""")
def agg21_tape_month_value(spark, d):
    t = src.tape(spark, d).withColumn("month", F.trunc("index_date", "month"))
    days = t.groupBy("month").agg(F.count_distinct("index_date").alias("days"))
    live = t.filter("superseded_at is null").groupBy("index_code", "month").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("methodology").alias("k"), F.avg("value").alias("v"))
    return live.join(days, "month").select("index_code", "month", F.when((F.col("n") >= 0.9 * F.col("days")) & (F.col("k") == 1), F.round("v", 4)).alias("value"))


@query(with_sql("facts") + """SELECT symbol, count(DISTINCT "end") AS periods, min("end") AS first, max("end") AS last, count(*) AS vintages, array_to_string(list_sort(list_distinct(list(form))), ';') AS forms FROM facts GROUP BY 1""")
def agg22_fundamentals_coverage(spark, d):
    f = src.ytd_facts(spark, d)
    return f.groupBy("symbol").agg(F.count_distinct("end").alias("periods"), F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("vintages"), F.array_join(F.array_sort(F.collect_set("form")), ";").alias("forms"))


@query(with_sql("daily") + """, x AS (SELECT symbol, abs(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session))) AS a FROM daily) SELECT symbol, count(a) AS returns, sum(CASE WHEN a > ln(1.4) THEN 1 ELSE 0 END)::BIGINT AS outliers FROM x GROUP BY 1""")
def agg23_price_audit(spark, d):
    b = daily_bars(spark, d).withColumn("a", F.abs(F.ln(F.col("close") / F.lag("close").over(win.series()))))
    return b.groupBy("symbol").agg(F.count("a").alias("returns"), F.sum(F.when(F.col("a") > F.ln(F.lit(1.4)), 1).otherwise(0)).alias("outliers"))


@query("""WITH x AS (SELECT l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS c, avg(p) AS mp, avg(y) AS my FROM x GROUP BY 1)
SELECT bin, c, round(mp, 6) AS mean_p, round(my, 6) AS rate, round((SELECT avg((p - y) * (p - y)) FROM x), 6) AS brier, round(sum(abs(mp - my) * c) OVER () / sum(c) OVER (), 6) AS ece FROM b""")
def agg25_calibration(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return resampling.calibration(x, "p", "y")


# --- resampling ----------------------------------------------------------------------------------------------------


_WEEKS = """t AS (SELECT symbol, session, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS x FROM daily), c AS (SELECT symbol, isoyear(session) * 100 + weekofyear(session) AS wk, sum(x) AS s, count(x) AS n FROM t WHERE x IS NOT NULL GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY wk) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS k FROM c)"""


@query(with_sql("daily") + f""", {_WEEKS}, dr AS (SELECT k.symbol, k.k, r, slot, CAST('0x' || left(md5('7|' || r || '|' || slot), 8) AS BIGINT) % k.k AS idx FROM (SELECT DISTINCT symbol, k FROM i) k, (SELECT unnest(range(2000)) AS r) r, (SELECT unnest(range(1000)) AS slot) s WHERE slot < k.k),
m AS (SELECT dr.symbol, r, sum(i.s) / sum(i.n) AS mean FROM dr JOIN i ON i.symbol = dr.symbol AND i.idx = dr.idx GROUP BY 1, 2) SELECT symbol, round(quantile_cont(mean, 0.05), 6) AS lower_bound FROM m GROUP BY 1""")
def res1_weekly_cluster_bootstrap(spark, d):
    t = daily_bars(spark, d).withColumn("x", F.col("close") / F.lag("close").over(win.series()) - 1).filter("x is not null")
    out = resampling.cluster_bootstrap(t.withColumn("wk", iso_week("session")), ["symbol"], "wk", "x", resamples=2000, seed="7", alpha=0.05)
    return out.select("symbol", r6("lower_bound").alias("lower_bound"))


# --- evaluators ----------------------------------------------------------------------------------------------------


_EV1 = with_sql("hourly") + f"""
, s AS (SELECT symbol, session, max(CASE WHEN minute = 600 THEN open END) AS entry, max(CASE WHEN o = 1 THEN open END) AS open, max(CASE WHEN z = 1 THEN close END) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY minute) AS o, row_number() OVER (PARTITION BY symbol, session ORDER BY minute DESC) AS z FROM hourly) GROUP BY 1, 2),
v AS (SELECT *, ln(close / lag(close) OVER w) AS lr FROM s WINDOW w AS (PARTITION BY symbol ORDER BY session)),
u AS (SELECT *, CASE WHEN count(lr) OVER f = 20 THEN stddev_samp(lr) OVER f END AS vol FROM v WINDOW f AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, lag(vol) OVER (PARTITION BY symbol ORDER BY session) AS dv FROM u),
x AS (SELECT symbol, session, entry, close, coalesce(entry / open - 1 < 0, false) AS selected, round_even(entry / 5, 0) * 5 AS k1, round_even(entry / 5, 0) * 5 + 5 AS k2, dv * 1.1 * sqrt((1440 - 600) / 840.0) AS sv FROM q WHERE dv > 0 AND entry IS NOT NULL AND round_even(entry / 5, 0) > 0),
p AS (SELECT *, {fn.sql_bs_call('entry', 'k1', 'sv')} - {fn.sql_bs_call('entry', 'k2', 'sv')} AS debit, greatest(close - k1, 0) - greatest(close - k2, 0) AS settled FROM x)
SELECT selected, y, count(*) AS n, round(avg(CASE WHEN settled >= 5 - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(debit / 5), 6) AS implied, round(100 * avg((settled - debit - 0.15) / 5), 6) AS mean_dw FROM (SELECT *, CAST(year(session) AS INTEGER) AS y FROM p WHERE debit > -5 AND debit < 5) GROUP BY GROUPING SETS ((selected), (selected, y))"""


@query(_EV1)
def ev1_options_backtest(spark, d):
    """Sessions -> rule -> call debit spread -> settlement -> costs, signal and control in one pass."""
    bars = intraday_bars(spark, d)
    s = bars.groupBy("symbol", "session").agg(F.max(F.when(F.col("minute") == 600, F.col("open"))).alias("entry"), F.min_by("open", "minute").alias("open"), F.max_by("close", "minute").alias("close"))
    w = win.series()
    s = s.withColumn("lr", F.ln(F.col("close") / F.lag("close").over(w))).withColumn("vol", win.realized_vol("lr", 20, w)).withColumn("dv", F.lag("vol").over(w))
    rule = rules.compile_rule({"op": "lt", "observation": {"obs": "return_from_open", "minute": 600}, "value": 0.0}, lambda o: F.col("entry") / F.col("open") - 1)
    k1 = fn.snap(F.col("entry"))
    x = s.filter((F.col("dv") > 0) & F.col("entry").isNotNull() & (k1 > 0)).withColumns({"selected": rule, "k1": k1, "k2": k1 + 5, "sv": fn.session_vol("dv", F.lit(600), 1440, 840)})
    for name, k in (("long", "k1"), ("short", "k2")):
        x = fn.with_option_price(x, name, F.lit("C"), "entry", k, "sv")
    debit = F.col("long") - F.col("short")
    settled = fn.settle(F.lit("C"), "k1", "close") - fn.settle(F.lit("C"), "k2", "close")
    p = x.withColumns({"debit": debit, "settled": settled, "y": F.year("session")}).filter("debit > -5 and debit < 5")
    g = p.groupingSets([["selected"], ["selected", "y"]], "selected", "y")
    won = fn.full_win("settled", "debit", F.lit(5.0)).cast("double")
    return g.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(won)).alias("win_rate"), r6(F.avg(F.col("debit") / 5)).alias("implied"), r6(100 * F.avg((F.col("settled") - F.col("debit") - 0.15) / 5)).alias("mean_dw"))


# --- fundamentals --------------------------------------------------------------------------------------------------


@query(with_sql("facts") + """, o AS (SELECT *, lag(value) OVER (PARTITION BY symbol, "end" ORDER BY filed, accession) AS before FROM facts), c AS (SELECT *, CASE WHEN before IS NULL OR before <> value THEN 1 ELSE 0 END AS nw FROM o), v AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, "end" ORDER BY filed, accession) AS vintage FROM c)
SELECT symbol, "end", CAST(vintage AS BIGINT) AS vintage, min(filed) AS filed, max(value) AS value, count(*) - 1 AS confirmations FROM v GROUP BY 1, 2, 3""")
def win27_vintages(spark, d):
    return vintages.vintages(src.ytd_facts(spark, d)).select("symbol", "end", "vintage", "filed", "value", F.size("confirmed_by").cast("long").alias("confirmations"))


@query(with_sql("facts") + """, f AS (SELECT symbol, "start", "end", min_by(value, filed) AS value FROM facts WHERE form NOT LIKE '%/A' GROUP BY 1, 2, 3), p AS (SELECT *, lag("end") OVER w AS pe, lag(value) OVER w AS pv FROM f WINDOW w AS (PARTITION BY symbol, "start" ORDER BY "end"))
SELECT symbol, "end", CASE WHEN pe IS NULL AND "end" - "start" + 1 BETWEEN 80 AND 100 THEN 'direct' WHEN "end" - pe BETWEEN 80 AND 100 THEN 'ytd_diff' END AS method, CASE WHEN pe IS NULL AND "end" - "start" + 1 BETWEEN 80 AND 100 THEN round(value, 2) WHEN "end" - pe BETWEEN 80 AND 100 THEN round(value - pv, 2) END AS value FROM p""")
def win28_quarter_plans(spark, d):
    f = src.ytd_facts(spark, d).filter(~F.col("form").endswith("/A")).groupBy("symbol", "start", "end").agg(F.min_by("value", "filed").alias("value"))
    return vintages.discrete_quarters(f)


@query(with_sql("facts") + """, f AS (SELECT symbol, "start", "end", min_by(value, filed) AS value FROM facts WHERE form NOT LIKE '%/A' GROUP BY 1, 2, 3) SELECT a.symbol, a."end", CASE WHEN max_by(b.value, b."end") > 0 THEN round(a.value / max_by(b.value, b."end") - 1, 6) END AS yoy FROM f a LEFT JOIN f b ON a.symbol = b.symbol AND a."end" - b."end" BETWEEN 350 AND 380 AND abs((a."end" - a."start") - (b."end" - b."start")) <= 10 GROUP BY a.symbol, a."start", a."end", a.value""")
def win30_growth(spark, d):
    f = src.ytd_facts(spark, d).filter(~F.col("form").endswith("/A")).groupBy("symbol", "start", "end").agg(F.min_by("value", "filed").alias("value"))
    return vintages.year_growth(f).select("symbol", "end", r6("yoy").alias("yoy"))


# --- sets and top-k ------------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority AS cluster, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN r > 1 THEN 1 ELSE 0 END, o_totalprice DESC, o_orderkey) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)) WHERE k <= 8""")
def top1_shortlist(spark, d):
    return rules.shortlist(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "cluster"), "cluster", "o_totalprice", "o_orderkey", 8).select("cluster", "o_orderkey", "o_totalprice")


@query("""SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) WHERE r <= 5""")
def top3_family_quota(spark, d):
    return table(spark, d, "part").withColumn("r", F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))).filter("r <= 5").select("p_type", "p_partkey")


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def set3_except(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem""")
def set2_intersect(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).intersect(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")))


@query("""SELECT o_orderstatus, sha256(string_agg(d, '' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderstatus, h[1:3] AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM
(SELECT o_orderstatus, sha256(o_orderkey || chr(31) || o_custkey || chr(31) || CAST(round(o_totalprice * 100) AS BIGINT) || chr(31) || strftime(o_orderdate, '%Y-%m-%d') || chr(31) || o_orderpriority) AS h FROM orders) GROUP BY 1, 2) GROUP BY 1""")
def int1_table_digest(spark, d):
    """Row digests, digests of their sorted runs by hash prefix, and one digest of those per partition value."""
    o = table(spark, d, "orders").select("o_orderstatus", *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderpriority")], F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("cents"))
    return integrity.table_digest(o, ["o_orderstatus"], ["o_orderkey", "o_custkey", "cents", "day", "o_orderpriority"])


# --- paths that depend on their own past -----------------------------------------------------------------------------


@query()
def win19_win20_indicators(spark, d):
    return indicators.indicators(daily_bars(spark, d), keys=["symbol"], order="session")
