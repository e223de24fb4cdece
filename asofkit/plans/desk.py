"""Queries on structures, gated scores, audits and the small rules of the desk."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.functions import scalars as fn
from asofkit.operators import integrity, scores, structures
from asofkit.operators import windows as win
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


# --- structures ----------------------------------------------------------------------------------------------------

_HELPERS = [(h, step) for h in structures.VERTICALS for step in (1.0, 5.0)]
_SIGN = {h: (side, beyond) for h, (_, side, beyond) in structures.VERTICALS.items()}


def _structure_sql() -> str:
    one = []
    for h, step in _HELPERS:
        side, beyond = _SIGN[h]
        anchor = f"round_even((e + {beyond} * o) / {step}, 0) * {step}"
        one.append(f"SELECT p_partkey, '{h}' AS helper, {step} AS step, {anchor} AS anchor, {anchor} + {beyond} * w AS other, {side} AS side, '{structures.VERTICALS[h][0]}' AS cp, w FROM p")
    return f"""WITH p AS (SELECT p_partkey, p_retailprice AS e, (p_size % 13) * 5.0 AS w, p_size % 3 * 1.0 AS o FROM part), x AS ({' UNION ALL '.join(one)})
SELECT p_partkey, helper, step, CASE WHEN side > 0 THEN anchor ELSE other END AS long_strike, CASE WHEN side > 0 THEN other ELSE anchor END AS short_strike, CASE WHEN cp = 'C' THEN CASE WHEN side > 0 THEN other ELSE anchor END END AS short_call,
CASE WHEN w < 5 OR w > 50 THEN 'width' WHEN anchor <= 0 OR other <= 0 OR anchor % 5 <> 0 OR other % 5 <> 0 THEN 'off the grid' END AS refusal FROM x"""


@query(_structure_sql())
def fn4_fn6_udf4_structures(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("e"), ((F.col("p_size") % 13) * 5.0).alias("w"), (F.col("p_size") % 3 * 1.0).alias("o"))
    made = [F.struct(F.lit(h).alias("helper"), F.lit(step).alias("step"), structures.vertical(h, F.col("e"), F.col("w"), F.col("o"), step).alias("legs")) for h, step in _HELPERS]
    x = p.select("p_partkey", F.explode(F.array(*made)).alias("s")).select("p_partkey", "s.*")
    at = lambda side: F.get(F.filter("legs", lambda g: g["qty"] == side), F.lit(0))["strike"]
    return x.select("p_partkey", "helper", "step", at(1).alias("long_strike"), at(-1).alias("short_strike"), structures.short_strike(F.col("legs"), "C").alias("short_call"), structures.refusal(F.col("legs")).alias("refusal"))


@query("""WITH p AS (SELECT p_partkey, round_even(p_retailprice, 0) AS k FROM part) SELECT p_partkey, CAST(i AS INTEGER) AS leg, CASE i WHEN 0 THEN k ELSE k + 5 END AS strike, CASE i WHEN 0 THEN 1 ELSE -1 END AS qty, CASE i WHEN 0 THEN greatest(k + 3 - k, 0.0) ELSE 0.0 END AS payoff FROM p, range(2) t(i)""")
def udf7_legs_of_structures(spark, d):
    p = table(spark, d, "part").select("p_partkey", structures.vertical("call_debit", F.col("p_retailprice"), F.lit(5.0), F.lit(0.0)).alias("legs"))
    rows = p.select("p_partkey", F.posexplode("legs").alias("leg", "g"), (F.rint(F.get("legs", F.lit(0))["strike"]) + 3).alias("s"))
    return rows.select("p_partkey", "leg", "g.strike", "g.qty", fn.settle(F.col("g.cp"), F.col("g.strike"), F.col("s")).alias("payoff"))


@query(with_sql("hourly") + """, e AS (SELECT symbol, session, round_even(open, 0) + 5 AS k, close FROM (SELECT symbol, session, max(CASE WHEN minute = 600 THEN open END) AS open, max_by(close, minute) AS close FROM hourly GROUP BY 1, 2) WHERE open IS NOT NULL),
t AS (SELECT e.symbol, e.session, e.k, e.close, min(h.minute) AS touch FROM e LEFT JOIN hourly h ON h.symbol = e.symbol AND h.session = e.session AND h.minute > 600 AND h.high >= e.k GROUP BY 1, 2, 3, 4)
SELECT t.symbol, t.session, k AS target, CAST(touch AS INTEGER) AS touch, round_even(h.open, 0) AS hedge_strike, CASE WHEN touch IS NOT NULL THEN round(greatest(round_even(h.open, 0) - t.close, 0), 6) ELSE 0 END AS hedge_payoff FROM t LEFT JOIN hourly h ON h.symbol = t.symbol AND h.session = t.session AND h.minute = t.touch""")
def fn10_hedge_on_touch(spark, d):
    """On the first touch of the short call after entry, an at-the-money put at the spot of that bar."""
    w = W.partitionBy("symbol", "session")
    b = intraday_bars(spark, d).withColumns({"entry": F.max(F.when(F.col("minute") == 600, F.col("open"))).over(w), "last": F.max_by("close", "minute").over(w)}).filter("entry is not null")
    legs = structures.vertical("call_debit", F.col("entry"), F.lit(5.0), F.lit(0.0))
    b = b.withColumn("target", structures.short_strike(legs, "C"))
    touched = (F.col("minute") > 600) & (F.col("high") >= F.col("target"))
    g = b.groupBy("symbol", "session", "target", "last").agg(F.min(F.when(touched, F.struct("minute", "open"))).alias("t"))
    k = F.rint("t.open")
    return g.select("symbol", "session", "target", F.col("t.minute").alias("touch"), k.alias("hedge_strike"), r6(F.when(F.col("t").isNotNull(), structures.settle(structures.long_put(k), F.col("last"))).otherwise(0.0)).alias("hedge_payoff"))


# --- scores --------------------------------------------------------------------------------------------------------

_GATES = ("positive_net_mean", "positive_both_halves", "survives_without_best", "survives_double_cost")


@query(with_sql("trades") + """, t AS (SELECT structure, isoyear(date) * 100 + week(date) AS wk, (settlement - debit) / width - 0.03 AS net FROM trades WHERE priced AND selected),
wk AS (SELECT structure, wk, avg(net) AS net, count(*) AS n, avg(net) - 0.03 AS hard, row_number() OVER (PARTITION BY structure ORDER BY wk) AS i, count(*) OVER (PARTITION BY structure) AS k FROM t GROUP BY 1, 2),
st AS (SELECT structure, count(*) AS periods, CAST(sum(n) AS BIGINT) AS trades, avg(net) AS mean, avg(hard) AS hard_mean, CASE WHEN count(*) > 1 THEN (sum(net) - max(net)) / (count(*) - 1) END AS wb, avg(net) FILTER (i <= greatest(1, k // 2)) AS h1, avg(net) FILTER (i > greatest(1, k // 2)) AS h2, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52.0), 0) AS sharpe FROM wk GROUP BY 1),
dr AS (SELECT structure, r, CAST('0x' || left(md5('week|' || r || '|' || (i - 1)), 8) AS BIGINT) % k AS idx FROM wk, range(1000) q(r) WHERE k > 1),
m AS (SELECT dr.structure, r, avg(net) AS m FROM dr JOIN wk ON wk.structure = dr.structure AND wk.i - 1 = dr.idx GROUP BY 1, 2),
lb AS (SELECT structure, m AS lb FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY m) AS place FROM m) WHERE place = 51),
g AS (SELECT st.*, lb, trades >= 40 AS g1, periods >= 20 AS g2, mean > 0 AS g3, coalesce(periods >= 4 AND h1 > 0 AND h2 > 0, false) AS g4, coalesce(wb > 0, false) AS g5, hard_mean > 0 AS g6, coalesce(lb > 0, false) AS g7 FROM st LEFT JOIN lb USING (structure)),
p AS (SELECT *, (CASE WHEN g1 THEN 0 ELSE 10 END + CASE WHEN g2 THEN 0 ELSE 10 END + CASE WHEN g3 THEN 0 ELSE 1 END + CASE WHEN g4 THEN 0 ELSE 1 END + CASE WHEN g5 THEN 0 ELSE 1 END + CASE WHEN g6 THEN 0 ELSE 1 END + CASE WHEN g7 THEN 0 ELSE 1 END) * 1.0 AS gate_penalty FROM g)
SELECT structure, trades, periods, round(mean, 6) AS mean, round(lb, 6) AS lower_bound, g1 AS minimum_trades, g2 AS minimum_weeks, g3 AS positive_net_mean, g4 AS positive_both_halves, g5 AS survives_without_best, g6 AS survives_double_cost, g7 AS weekly_bootstrap_positive, CAST(gate_penalty AS DOUBLE) AS gate_penalty,
CASE WHEN gate_penalty = 0 THEN 'passed' ELSE 'rejected' END AS status, round(CASE WHEN gate_penalty = 0 THEN sharpe ELSE least(sharpe, 1.5 - 0.000001) - gate_penalty END, 6) AS score FROM p""")
def ev3_res2_gated_options_score(spark, d):
    t = src.trades(spark, d).filter("priced and selected").select("structure", iso_week("date").alias("wk"), ((F.col("settlement") - F.col("debit")) / F.col("width") - 0.03).alias("net"))
    s = scores.weekly_options_score(t, ["structure"], week="wk", net="net", cost=0.03, least_trades=40, least_weeks=20, target=1.5, seed="week")
    return s.select("structure", "trades", "periods", r6("mean").alias("mean"), r6("lower_bound").alias("lower_bound"), "minimum_trades", "minimum_weeks", *_GATES, "weekly_bootstrap_positive", "gate_penalty", "status", r6("score").alias("score"))


@query(with_sql("daily") + """, r AS (SELECT symbol, session, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS net FROM daily), s AS (SELECT *, lag(net) OVER (PARTITION BY symbol ORDER BY session) AS prev FROM r),
t AS (SELECT symbol, session, sign(-prev) * net - 0.0005 AS net FROM s WHERE net IS NOT NULL AND prev IS NOT NULL AND prev <> 0),
dy AS (SELECT session, avg(net) AS net, avg(net) - 0.0005 AS hard, row_number() OVER (ORDER BY session) AS i, count(*) OVER () AS k FROM t GROUP BY 1),
st AS (SELECT count(*) AS periods, avg(net) AS mean, avg(hard) AS hard_mean, (sum(net) - max(net)) / (count(*) - 1) AS wb, avg(net) FILTER (i <= greatest(1, k // 2)) AS h1, avg(net) FILTER (i > greatest(1, k // 2)) AS h2, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0), 0) AS sharpe FROM dy),
sy AS (SELECT CAST(sum(n) AS BIGINT) AS trades, CAST(sum(CAST(n >= 5 AS INTEGER)) AS BIGINT) AS active, max(n) / sum(n) AS conc, avg(CAST(m > 0 AS DOUBLE)) AS pos FROM (SELECT symbol, count(*) AS n, avg(net) AS m FROM t GROUP BY 1)),
g AS (SELECT *, trades >= 80 AS g1, periods >= 20 AS g2, active >= 5 AS g3, conc <= 0.35 AS g4, mean > 0 AS g5, periods >= 4 AND h1 > 0 AND h2 > 0 AS g6, wb > 0 AS g7, hard_mean > 0 AS g8, pos >= 0.4 AS g9 FROM st, sy),
p AS (SELECT *, CASE WHEN g1 THEN 0 ELSE 10 END + CASE WHEN g2 THEN 0 ELSE 10 END + CASE WHEN g3 THEN 0 ELSE 10 END + CASE WHEN g4 THEN 0 ELSE 1 END + CASE WHEN g5 THEN 0 ELSE 1 END + CASE WHEN g6 THEN 0 ELSE 1 END + CASE WHEN g7 THEN 0 ELSE 1 END + CASE WHEN g8 THEN 0 ELSE 1 END + CASE WHEN g9 THEN 0 ELSE 1 END AS pen FROM g)
SELECT trades, periods, active AS active_symbols, round(conc, 6) AS concentration, round(pos, 6) AS positive_symbols, round(mean, 6) AS mean, g1 AS minimum_trades, g2 AS minimum_sessions, g3 AS symbol_breadth, g4 AS symbol_concentration, g5 AS positive_net_mean, g6 AS positive_both_halves, g7 AS survives_without_best, g8 AS survives_double_cost, g9 AS positive_symbol_fraction,
CAST(pen AS DOUBLE) AS gate_penalty, CASE WHEN pen = 0 THEN 'passed' ELSE 'rejected' END AS status, round(CASE WHEN pen = 0 THEN sharpe ELSE least(sharpe, 1.5 - 0.000001) - pen END, 6) AS score FROM p""")
def ev6_universe_portfolio(spark, d):
    w = win.series()
    t = daily_bars(spark, d).withColumn("x", F.col("close") / F.lag("close").over(w) - 1).withColumn("prev", F.lag("x").over(w)).filter("x is not null and prev is not null and prev <> 0")
    t = t.select(F.lit("reversal").alias("rule"), "symbol", "session", (F.signum(-F.col("prev")) * F.col("x") - 0.0005).alias("net"))
    s = scores.portfolio_score(t, ["rule"], day="session", symbol="symbol", net="net", cost=0.0005, least_trades=80, least_sessions=20, least_symbols=5, most_concentration=0.35, target=1.5)
    return s.select("trades", "periods", "active_symbols", r6("concentration").alias("concentration"), r6("positive_symbols").alias("positive_symbols"), r6("mean").alias("mean"), "minimum_trades", "minimum_sessions", "symbol_breadth", "symbol_concentration", *_GATES, "positive_symbol_fraction", "gate_penalty", "status", r6("score").alias("score"))


@query(with_sql("trades") + """, t AS (SELECT *, year(date) AS y, settlement >= width - 1e-9 AS won, debit / width AS implied FROM trades WHERE priced)
SELECT structure, CAST(count(*) FILTER (selected) AS BIGINT) AS trades, round(100 * (avg(CAST(won AS DOUBLE) - implied) FILTER (selected) - avg(CAST(won AS DOUBLE) - implied)), 6) AS edge_pp, count(*) FILTER (selected) >= 50 AS enough,
(SELECT count(DISTINCT y) FROM t u WHERE u.structure = t.structure AND u.selected) AS years FROM t GROUP BY 1""")
def ev2_control_relative_score(spark, d):
    """The edge of the selected trades over that of every session's control, and whether there are 50 of them."""
    t = src.trades(spark, d).filter("priced")
    edge = (F.col("settlement") >= F.col("width") - 1e-9).cast("double") - F.col("debit") / F.col("width")
    g = t.groupBy("structure").agg(F.count(F.when(F.col("selected"), 1)).alias("trades"), r6(100 * (F.avg(F.when(F.col("selected"), edge)) - F.avg(edge))).alias("edge_pp"), F.count_distinct(F.when(F.col("selected"), F.year("date"))).alias("years"))
    return g.withColumn("enough", F.col("trades") >= 50)


# --- audits --------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT coalesce(CASE WHEN seq = 1 AND conv_id % 4 = 1 THEN 'sequence gap' WHEN seq = 1 AND conv_id % 4 = 2 THEN 'event hash' WHEN conv_id % 4 = 3 AND n > 1 THEN 'repeated key' END, 'good') AS reason, count(*) AS n FROM c WHERE NOT (conv_id % 4 = 1 AND seq > 1) GROUP BY 1""")
def int2_hash_chain(spark, d):
    """Chains over conversations, audited: in some an event is missing, in some one was changed, in some a key repeats."""
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    c = table(spark, d, "conversations").select("conv_id", seq.alias("seq"), F.coalesce("text", F.lit("")).alias("body"))
    kind, at = F.col("conv_id") % 4, F.col("seq")
    ledger = integrity.chained(c, "conv_id", "seq", "body").filter((kind != 1) | (at < 2))
    ledger = ledger.withColumns({
        "seq": F.when((kind == 1) & (at == 1), F.lit(2)).otherwise(at), "body": F.when((kind == 2) & (at == 1), F.concat("body", F.lit("!"))).otherwise(F.col("body")),
        "idem": F.when(kind == 3, F.lit(0)).otherwise(at),
    })
    return integrity.audit_chain(ledger, "conv_id", "seq", "idem").groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS family, sha256(string_agg(d, '' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, h[1:3] AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM (SELECT event_type, sha256(strftime(ts, '%Y-%m-%d') || chr(31) || count(*)) AS h FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d')) GROUP BY 1, 2) GROUP BY 1""")
def int5_coverage_digest(spark, d):
    cover = table(spark, d, "events").groupBy(F.col("event_type").alias("family"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return integrity.table_digest(cover, ["family"], ["day", "events"])


@query(with_sql("trades") + """, g AS (SELECT structure, year(date) AS y, count(*) AS selected, CAST(sum(CAST(priced AS INTEGER)) AS BIGINT) AS priced FROM trades WHERE selected GROUP BY 1, 2)
SELECT structure, y, CASE WHEN y % 3 = 0 THEN 'coverage' WHEN y % 3 = 1 AND selected > 0 THEN 'reasons' END AS reason FROM g""")
def int7_claim_consistency(spark, d):
    """Claims of a summary against each other: coverage is priced over selected, and the reasons add up to what is unpriced. Some claims are wrong."""
    g = src.trades(spark, d).filter("selected").groupBy("structure", F.year("date").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("selected"), F.sum(F.col("priced").cast("int")).alias("priced"))
    wrong = F.col("y") % 3
    claims = g.withColumns({"coverage": F.col("priced") / F.col("selected") + F.when(wrong == 0, 0.01).otherwise(0.0), "reasons": F.create_map(F.lit("stale"), F.col("selected") - F.col("priced") + F.when(wrong == 1, 1).otherwise(0))})
    total = F.aggregate(F.map_values("reasons"), F.lit(0).cast("long"), lambda a, b: a + b)
    reason = F.when(F.abs(F.col("coverage") - F.col("priced") / F.col("selected")) > 1e-9, "coverage").when(total != F.col("selected") - F.col("priced"), "reasons").when(F.col("priced") > F.col("selected"), "counts")
    return claims.select("structure", "y", reason.alias("reason"))


# --- small rules ---------------------------------------------------------------------------------------------------


@query("""SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' END AS reason, min(event_type) AS kept FROM events GROUP BY 1, 2, 3""")
def bar5_minute_dedupe(spark, d):
    """One row per slot: identical repeats are one, different values a conflict."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "event_type").dropDuplicates()
    return e.groupBy("user_id", "day", "hour").agg(F.when(F.count(F.lit(1)) > 1, "conflict").alias("reason"), F.min("event_type").alias("kept"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, CAST(NULL AS DOUBLE) AS other, 'k=' || json_extract_string(props, '$.k') || ';volume=' || CAST(event_id % 5 AS VARCHAR) AS entries FROM events""")
def prj6_fn28_metric_lookup(spark, d):
    """A metric of a family's map where the family is covered, NULL otherwise; and the entries in order."""
    metrics = F.create_map(F.lit("volume"), (F.col("event_id") % 5).cast("double"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    e = table(spark, d, "events").select("event_id", metrics.alias("m"), (F.col("event_id") % 3 > 0).alias("covered"))
    read = lambda name: F.when(F.col("covered"), F.try_element_at("m", F.lit(name)))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("long").cast("string"))), ";")
    return e.select("event_id", read("k").alias("k"), read("other").alias("other"), entries.alias("entries"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN 'width' WHEN l_extendedprice / 1000 > l_quantity * 2 THEN 'price above the width' WHEN l_receiptdate < l_shipdate THEN 'clock' WHEN l_discount > 0.09 THEN 'crossed quote' END AS reason FROM (SELECT *, l_shipdate + CAST(CAST(l_quantity AS INTEGER) % 5 - 1 AS INTEGER) * INTERVAL 1 DAY AS l_receiptdate FROM lineitem)""")
def prj16_leg_invariants(spark, d):
    """Evidence of a leg: a width, a price within it, clocks in order, a quote that is not crossed. The first broken rule is the reason."""
    li = table(spark, d, "lineitem").withColumn("received", F.date_add(F.to_date("l_shipdate"), (F.col("l_quantity").cast("int") % 5 - 1)))
    reason = (
        F.when(F.col("l_quantity") <= 0, "width").when(F.col("l_extendedprice") / 1000 > F.col("l_quantity") * 2, "price above the width")
        .when(F.col("received") < F.to_date("l_shipdate"), "clock").when(F.col("l_discount") > 0.09, "crossed quote")
    )
    return li.select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query(with_sql("facts") + """SELECT symbol, "start", "end", accession FROM facts WHERE "start" IS NOT NULL AND "end" >= DATE '1995-01-01'""")
def prj17_facts_kept(spark, d):
    return src.ytd_facts(spark, d).filter(F.col("start").isNotNull() & (F.col("end") >= F.to_date(F.lit("1995-01-01")))).select("symbol", "start", "end", "accession")


@query(with_sql("hourly") + """, s AS (SELECT symbol, session, max_by(close, minute) AS settlement, min(minute) <= 60 AND max(minute) >= 1320 AS complete, max(CASE WHEN minute = 600 THEN open END) AS entry FROM hourly GROUP BY 1, 2),
n AS (SELECT *, lead(settlement) OVER w AS ns, lead(complete) OVER w AS nc FROM s WINDOW w AS (PARTITION BY symbol ORDER BY session)) SELECT symbol, session, CASE WHEN complete AND nc THEN round(ns / entry - 1, 6) END AS held FROM n""")
def win35_next_session_hold(spark, d):
    w = win.series()
    s = intraday_bars(spark, d).groupBy("symbol", "session").agg(F.max_by("close", "minute").alias("settlement"), ((F.min("minute") <= 60) & (F.max("minute") >= 1320)).alias("complete"), F.max(F.when(F.col("minute") == 600, F.col("open"))).alias("entry"))
    return s.select("symbol", "session", r6(F.when(F.col("complete") & F.lead("complete").over(w), F.lead("settlement").over(w) / F.col("entry") - 1)).alias("held"))


@query(with_sql("daily") + """, m AS (SELECT DISTINCT symbol, CAST(date_trunc('month', session) AS DATE) AS month FROM daily), x AS (SELECT *, CASE WHEN month < DATE '1995-01-01' THEN 'discovery' WHEN month >= DATE '1995-04-01' AND month < DATE '1997-01-01' THEN 'validation' WHEN month >= DATE '1997-04-01' THEN 'holdout' END AS stage FROM m)
SELECT symbol, month, stage FROM (SELECT *, row_number() OVER (PARTITION BY symbol, stage ORDER BY month) AS k FROM x WHERE stage IS NOT NULL) WHERE stage <> 'holdout' OR k <= 12""")
def win37_stage_assignment(spark, d):
    """Periods by stage with three months of embargo between stages; the holdout is its first twelve periods."""
    stages = [("discovery", "0001-01-01", "1995-01-01"), ("validation", "1995-04-01", "1997-01-01"), ("holdout", "1997-04-01", "9999-01-01")]
    stage = F.coalesce(*[F.when((F.col("month") >= F.to_date(F.lit(a))) & (F.col("month") < F.to_date(F.lit(b))), name) for name, a, b in stages])
    m = daily_bars(spark, d).select("symbol", F.trunc("session", "month").alias("month")).distinct().withColumn("stage", stage).filter("stage is not null")
    place = F.row_number().over(W.partitionBy("symbol", "stage").orderBy("month"))
    return m.withColumn("k", place).filter("stage <> 'holdout' or k <= 12").select("symbol", "month", "stage")


@query("""SELECT o_custkey AS run, count(*) AS trials, count(CASE WHEN o_orderkey % 4 > 0 THEN 1 END) AS evaluated, CASE WHEN count(*) < 5 THEN 'halted early' WHEN max(CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END) >= 300000 THEN 'complete' ELSE 'refuted' END AS verdict FROM orders GROUP BY 1""")
def agg30_run_verdicts(spark, d):
    """A run below its trials is halted early; one that reached the target is complete, any other is refuted."""
    metric = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice"))
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("trials"), F.count(metric).alias("evaluated"), F.max(metric).alias("best"))
    return g.select("run", "trials", "evaluated", F.when(F.col("trials") < 5, "halted early").when(F.col("best") >= 300000, "complete").otherwise("refuted").alias("verdict"))


@query("""WITH a AS (SELECT p_partkey, p_size / 50.0 AS conf, (p_partkey % 10) / 10.0 AS chaotic, (p_partkey % 7) / 7.0 AS trending, (p_partkey % 11) / 11.0 AS clean, (p_partkey % 6) / 2.0 AS risk FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 0.0 WHEN conf < 0.8 THEN 0.0 WHEN chaotic >= 0.5 OR risk >= 2.5 THEN 0.0 WHEN clean < 0.4 THEN 0.0 WHEN trending >= 0.6 THEN 1.0 ELSE 0.5 END AS multiplier FROM a""")
def fn18_udf5_answer_gate(spark, d):
    """A gate reads a table of cached answers by key; without an answer it is closed."""
    p = table(spark, d, "part")
    c = F.col
    answers = p.filter("p_partkey % 13 <> 0").select("p_partkey", F.struct((c("p_size") / 50.0).alias("confidence"), ((c("p_partkey") % 10) / 10.0).alias("chaotic"), ((c("p_partkey") % 7) / 7.0).alias("trending"), ((c("p_partkey") % 11) / 11.0).alias("clean"), ((c("p_partkey") % 6) / 2.0).alias("risk")).alias("answer"))
    return p.select("p_partkey").join(answers, "p_partkey", "left").select("p_partkey", fn.answer_multiplier("answer").alias("multiplier"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN 0.5 WHEN 'HOUSEHOLD' THEN 0.25 ELSE 0.0 END AS multiplier, CASE c_mktsegment WHEN 'BUILDING' THEN 0.75 WHEN 'MACHINERY' THEN 0.4 WHEN 'HOUSEHOLD' THEN 0.2 ELSE 0.0 END AS cap FROM customer""")
def fn19_state_maps(spark, d):
    """Multiplier and cap of a state; an unknown state has none."""
    from asofkit.operators.regimes import STATE_CAP, STATE_MULTIPLIER

    state = F.when(F.col("c_mktsegment") == "BUILDING", "CALM_UP").when(F.col("c_mktsegment") == "MACHINERY", "CHOP").when(F.col("c_mktsegment") == "HOUSEHOLD", "STRESS").otherwise("other")
    look = lambda m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), state), F.lit(0.0))
    return table(spark, d, "customer").select("c_custkey", look(STATE_MULTIPLIER).alias("multiplier"), look(STATE_CAP).alias("cap"))


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 40 ELSE 80 END AS discovery_trades, CASE WHEN p_size = 1 THEN 15 ELSE 35 END AS holdout_trades, CASE WHEN p_size = 1 THEN 1 ELSE least(6, p_size) END AS min_symbols, CASE WHEN p_size = 1 THEN 1.0 ELSE greatest(0.35, round_even(1.5 / p_size, 2)) END AS max_concentration FROM part""")
def fn21_sample_gates(spark, d):
    """Defaults of the sample gates by the size of the universe."""
    n = F.col("p_size")
    pick = lambda one, more: F.when(n == 1, one).otherwise(more)
    return table(spark, d, "part").select("p_partkey", pick(F.lit(40), F.lit(80)).alias("discovery_trades"), pick(F.lit(15), F.lit(35)).alias("holdout_trades"), pick(F.lit(1), F.least(F.lit(6), n)).alias("min_symbols"), pick(F.lit(1.0), F.greatest(F.lit(0.35), F.bround(1.5 / n, 2))).alias("max_concentration"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN (CAST(round(o_totalprice * 100) AS BIGINT) + 500) // 1000 / 100 END AS metric, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS trades FROM orders""")
def fn29_last_metric(spark, d):
    """The last metric line of an output, and a number out of its last JSON line; NULL where there is none."""
    hundredths = F.floor((F.round(F.col("o_totalprice") * 100).cast("long") + 500) / 1000)
    x = F.format_string("%d.%02d", F.floor(hundredths / 100), hundredths % 100)
    text = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit('metric=0.1\n{"trades": 1}\nmetric='), x, F.lit('\n{"trades": '), F.col("o_custkey").cast("string"), F.lit("}\ndone"))).otherwise("no figures")
    o = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    last = lambda p: F.try_element_at(F.regexp_extract_all("t", F.lit(p), 1), F.lit(-1))
    return o.select("o_orderkey", F.round(last(r"(?m)^metric=(-?\d+(?:\.\d+)?)$").cast("double"), 2).alias("metric"), F.get_json_object(last(r"(?m)^(\{.*\})$"), "$.trades").cast("long").alias("trades"))


@query("""SELECT a.l_orderkey AS decision, round(sum(a.l_extendedprice), 2) AS capex FROM lineitem a WHERE a.l_returnflag = 'A' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R') GROUP BY 1""")
def join22_both_captured(spark, d):
    """Decisions on which both measures were captured."""
    li = table(spark, d, "lineitem")
    part = lambda flag, name: li.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("decision")).agg(F.round(F.sum("l_extendedprice"), 2).alias(name))
    return part("A", "capex").join(part("R", "revenue"), "decision").select("decision", "capex")


@query(with_sql("daily") + """, r AS (SELECT symbol, session, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS ret, volume FROM daily) SELECT symbol, session, CASE WHEN ret IS NULL THEN 0 WHEN ret < -0.2 AND volume > 1 THEN 1 WHEN ret > 0.2 THEN -1 ELSE 0 END AS side FROM r""")
def udf1_row_signal(spark, d):
    """A user's rule as a vectorised function of named features; it must answer -1, 0 or 1, and asks only for features that exist."""
    w = win.series()
    x = daily_bars(spark, d).select("symbol", "session", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), "volume")

    def rule(f):
        return ((f["ret"] < -0.2) & (f["volume"] > 1)).astype(int) - (f["ret"] > 0.2).astype(int)

    from asofkit.functions.signals import row_signal

    return x.select("symbol", "session", row_signal(rule, x, ["ret", "volume"]).alias("side"))


@query(with_sql("hourly") + """SELECT symbol, session, coalesce(max(CASE WHEN minute = 600 THEN open END) < min_by(open, minute) AND max(CASE WHEN minute < 600 THEN high END) > min_by(open, minute), false) AS fires FROM hourly WHERE minute <= 600 GROUP BY 1, 2""")
def udf2_session_signal(spark, d):
    """A user's rule over the bars of a session up to the entry minute; later bars are not handed to it."""
    from asofkit.functions.signals import session_signal

    def rule(view) -> bool:
        now = view.price_at(600)
        return now is not None and now < view.open and view.high_before(600) > view.open

    return session_signal(intraday_bars(spark, d), rule, entry=600)


@query()
def udf6_res4_cluster_bound(spark, d):
    """The weekly-cluster bound as a user-defined aggregate, at the level divided by the size of the shortlist."""
    from asofkit.functions.signals import cluster_bound

    t = daily_bars(spark, d).withColumn("x", F.col("close") / F.lag("close").over(win.series()) - 1).filter("x is not null")
    shortlist = 3
    return t.groupBy("symbol").agg(cluster_bound(alpha=0.05 / shortlist, resamples=2000, seed=7)("x", iso_week("session")).alias("lower_bound"))
