"""Queries on many rules at once: the sweep over all sessions, ledgers from three sources of prices, leg evidence and its verdicts.

Proposals are one per kind and size of part, with five shapes of signals; sessions are hourly bars over years.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import scalars as fn
from asofkit.operators import ledgers, rules
from asofkit.plans.market import r6
from asofkit.sources import tables as src
from asofkit.sources.tables import table, with_sql

QUERIES, ORACLES = {}, {}
KEYS = ["symbol", "session"]


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def proposals(spark, d):
    """``attempt, document``: the first part of every kind and size gives a rule its numbers."""
    a = F.col("attempt")
    p = table(spark, d, "part").groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("attempt")).select("attempt")
    n = lambda x: x.cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    at = text('{"obs":"return_from_open","minute":', n(a % 3 * 60 + 570), "}")
    between = text('{"obs":"return_between","start_minute":', n(a % 2 * 60 + 570), ',"end_minute":690}')
    touch = text('{"op":"observed","observation":{"obs":"first_touch_before_entry","after_minute":', n(a % 2 * 60 + 570), ',"open_offset":', n((a % 21 - 10) * 5), "}}")
    v, w = n((a % 41 - 20) * 2), n((a % 37 - 18) * 3)
    leaf = lambda op, o, x: text(f'{{"op":"{op}","observation":', o, ',"value":', x, "}")
    pair = lambda op, x, y: text(f'{{"op":"{op}","args":[', x, ",", y, "]}")
    negated = lambda x: text('{"op":"not","arg":', x, "}")
    signal = (
        F.when(a % 5 == 0, leaf("lt", at, v)).when(a % 5 == 1, pair("and", leaf("gt", between, w), leaf("lte", at, v))).when(a % 5 == 2, pair("or", negated(leaf("lt", at, v)), touch))
        .when(a % 5 == 3, negated(pair("and", leaf("gte", at, v), leaf("lt", between, w)))).otherwise(touch)
    )
    helper = F.when(F.floor(a / 2) % 2 == 0, "call_debit_spread").otherwise("put_credit_spread")
    structure = text(',"structure":{"helper":"', helper, '","width":', n(F.floor(a / 4) % 2 * 5 + 5), ',"otm_offset":', n(F.floor(a / 8) % 2 * 5), "}}")
    return p.select("attempt", text('{"schema_version":3,"entry_minute":', n(a % 2 * 60 + 750), ',"signal":', signal, structure).alias("document"))


_TOUCH = ", ".join(f"max(high) FILTER (minute > {a} AND minute < {e}) AS h{a}_{e}, min(low) FILTER (minute > {a} AND minute < {e}) AS l{a}_{e}" for a in (570, 630) for e in (750, 810))
_PRICES = ", ".join(f"max(open) FILTER (minute = {m}) AS p{m}" for m in (570, 630, 690, 750, 810))
_CASE = lambda name, of: "CASE " + " ".join(f"WHEN {cond} THEN {col}" for cond, col in of) + f" END AS {name}"
_RULES = f"""rules AS (SELECT min(p_partkey) AS attempt FROM part GROUP BY p_type, p_size),
spec AS (SELECT attempt, attempt % 5 AS shape, attempt % 3 * 60 + 570 AS m, attempt % 2 * 60 + 570 AS s, attempt % 2 * 60 + 750 AS entry_minute, (attempt % 21 - 10) * 5 AS off, (attempt % 41 - 20) * 2 AS v, (attempt % 37 - 18) * 3 AS w,
 attempt // 2 % 2 = 0 AS is_call, attempt // 4 % 2 * 5 + 5 AS width, attempt // 8 % 2 * 5 AS otm FROM rules),
days AS (SELECT symbol, session, min_by(open, minute) AS open, max_by(close, minute) AS close, max(minute) >= 930 AS full_day, {_PRICES}, {_TOUCH} FROM bars GROUP BY 1, 2),
seen AS (SELECT *, ({_CASE('x', [('m = 570', 'p570'), ('m = 630', 'p630'), ('m = 690', 'p690')])[:-5]} / open - 1) * 100 AS r1, (p690 / {_CASE('x', [('s = 570', 'p570'), ('s = 630', 'p630')])[:-5]} - 1) * 100 AS r2,
 coalesce(CASE WHEN off >= 0 THEN {_CASE('x', [(f's = {a} AND entry_minute = {e}', f'h{a}_{e}') for a in (570, 630) for e in (750, 810)])[:-5]} >= open + off
  ELSE {_CASE('x', [(f's = {a} AND entry_minute = {e}', f'l{a}_{e}') for a in (570, 630) for e in (750, 810)])[:-5]} <= open + off END, false) AS touch,
 CASE WHEN entry_minute = 750 THEN p750 ELSE p810 END AS entry FROM days, spec),
fired AS (SELECT *, CASE shape WHEN 0 THEN coalesce(r1 < v, false) WHEN 1 THEN coalesce(r2 > w, false) AND coalesce(r1 <= v, false) WHEN 2 THEN NOT coalesce(r1 < v, false) OR touch
 WHEN 3 THEN NOT (coalesce(r1 >= v, false) AND coalesce(r2 < w, false)) ELSE touch END AS selected FROM seen)"""
_TRADES = """trades2 AS (SELECT *, greatest(close - k1, 0) - greatest(close - k2, 0) AS call_pay, greatest(k2 - close, 0) - greatest(k1 - close, 0) AS put_pay FROM
 (SELECT *, CASE WHEN is_call THEN round_even((entry + otm) / 5, 0) * 5 ELSE round_even((entry - otm) / 5, 0) * 5 END AS k1, CASE WHEN is_call THEN round_even((entry + otm) / 5, 0) * 5 + width ELSE round_even((entry - otm) / 5, 0) * 5 - width END AS k2
  FROM fired WHERE full_day AND entry > 0)),
traded AS (SELECT *, CASE WHEN is_call THEN call_pay ELSE put_pay END AS settled, CASE WHEN is_call THEN 0 ELSE -width END AS worst, CASE WHEN is_call THEN width ELSE 0 END AS best, CASE WHEN is_call THEN 'C' ELSE 'P' END AS cp, CASE WHEN is_call THEN 1 ELSE -1 END AS q1 FROM trades2)"""
_LEDGER = """SELECT attempt, symbol, session, selected, skip IS NULL AS priced, CASE WHEN skip IS NULL THEN debit END AS debit, CASE WHEN skip IS NULL THEN settled - debit END AS pnl, CASE WHEN selected THEN skip END AS skip_reason FROM priced"""
#: The rules with half of their ledgers: all pairs of rules and sessions are summed up per rule and year.
_SUMMED = "SELECT attempt, CAST(year(session) AS INTEGER) AS year, coalesce(skip_reason, 'none') AS skip_reason, count(*) AS n, count(*) FILTER (selected) AS selected, count(*) FILTER (priced) AS priced, round(sum(debit), 4) AS debit, round(sum(pnl), 4) AS pnl FROM ({}) GROUP BY 1, 2, 3"


def _swept(spark, d):
    days = ledgers.sessions(src.session_bars(spark, d), reaches=930)
    judged = rules.judge_proposals(proposals(spark, d))
    return ledgers.sweep(days, ledgers.frozen_rules(judged), keep=[*KEYS, "bars", "open", "close", "full_day", "sigma"])


def _summed(rows):
    g = rows.groupBy("attempt", F.year("session").alias("year"), F.coalesce("skip_reason", F.lit("none")).alias("skip_reason"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("selected"), F.count_if("priced").alias("priced"), F.round(F.sum("debit"), 4).alias("debit"), F.round(F.sum("pnl"), 4).alias("pnl"))


@query(with_sql("bars") + f""", {_RULES} SELECT attempt, symbol, count(*) AS sessions, count(*) FILTER (selected) AS fires, min(session) FILTER (selected) AS first, max(session) FILTER (selected) AS last, coalesce(sum(session - DATE '1995-01-01') FILTER (selected), 0)::BIGINT AS days FROM fired GROUP BY 1, 2""")
def ev22_rule_sweep(spark, d):
    """All proposals over all sessions in one job."""
    f = ledgers.fires(_swept(spark, d), KEYS)
    hit = F.when(F.col("selected"), F.col("session"))
    return f.groupBy("attempt", "symbol").agg(F.count(F.lit(1)).alias("sessions"), F.count_if("selected").alias("fires"), F.min(hit).alias("first"), F.max(hit).alias("last"), F.coalesce(F.sum(F.datediff(hit, F.lit("1995-01-01").cast("date"))), F.lit(0)).alias("days"))


_CALLS = f"{fn.sql_bs_call('entry', 'k1', 'sv')} AS c1, {fn.sql_bs_call('entry', 'k2', 'sv')} AS c2"


@query(with_sql("bars") + f""", {_RULES}, {_TRADES}, lr AS (SELECT symbol, session, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session)) AS lr FROM days),
vol AS (SELECT symbol, session, CASE WHEN count(lr) OVER f = 20 THEN stddev_samp(lr) OVER f END AS vol FROM lr WINDOW f AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sig AS (SELECT symbol, session, lag(vol) OVER (PARTITION BY symbol ORDER BY session) AS sigma FROM vol),
m AS (SELECT *, {_CALLS} FROM (SELECT t.*, sigma * 1.1 * sqrt((960 - entry_minute) / 390.0) AS sv FROM traded t JOIN sig USING (symbol, session) WHERE sigma IS NOT NULL)),
priced AS (SELECT *, CASE WHEN isnan(debit) OR debit IS NULL THEN 'modeled economics unavailable' END AS skip FROM (SELECT *, CASE WHEN is_call THEN c1 - c2 ELSE -(c1 - entry + k1) + (c2 - entry + k2) END AS debit FROM m)) """ + _SUMMED.format(_LEDGER))
def ev8_modelled_ledgers(spark, d):
    """Signal and control ledgers of all rules with modelled prices, summed up per rule, year and reason."""
    rows = ledgers.ledger(ledgers.modelled(ledgers.with_structures(_swept(spark, d), step=5.0)), KEYS)
    return _summed(rows)


_PRINTS = """latest AS (SELECT t.symbol, t.session, t.attempt, max_by(a.price, a.minute) AS price1 FROM traded t JOIN quotes a ON a.symbol = t.symbol AND a.session = t.session AND a.cp = t.cp AND a.strike = t.k1 AND a.minute BETWEEN t.entry_minute - 15 AND t.entry_minute GROUP BY 1, 2, 3),
latest2 AS (SELECT t.symbol, t.session, t.attempt, max_by(a.price, a.minute) AS price2 FROM traded t JOIN quotes a ON a.symbol = t.symbol AND a.session = t.session AND a.cp = t.cp AND a.strike = t.k2 AND a.minute BETWEEN t.entry_minute - 15 AND t.entry_minute GROUP BY 1, 2, 3)"""


@query(with_sql("bars", "quotes") + f""", {_RULES}, {_TRADES}, {_PRINTS}, q AS (SELECT t.*, q1 * price1 - q1 * price2 AS debit FROM traded t LEFT JOIN latest USING (symbol, session, attempt) LEFT JOIN latest2 USING (symbol, session, attempt)),
priced AS (SELECT *, CASE WHEN debit IS NULL THEN '{ledgers.NO_TRADE}' WHEN NOT debit BETWEEN worst - 1e-9 AND best + 1e-9 THEN '{ledgers.NO_BOUNDS.replace("'", "''")}' END AS skip FROM q) """ + _SUMMED.format(_LEDGER))
def ev8_join5_quoted_ledgers(spark, d):
    """The same ledgers from the last trade of each leg within 15 minutes, all legs or none."""
    prints = src.option_quotes(spark, d).select(*KEYS, "cp", "strike", "minute", "price")
    rows = ledgers.ledger(ledgers.quoted(ledgers.with_structures(_swept(spark, d), step=5.0), prints, keys=KEYS), KEYS)
    return _summed(rows)


def _leg(k: int) -> str:
    return f"""leg{k} AS (SELECT *, CASE WHEN minute IS NULL THEN '{ledgers.NO_QUOTE}' WHEN entry_minute - minute > 15 THEN '{ledgers.TOO_OLD}' WHEN bid > ask THEN '{ledgers.CROSSED}' END AS skip FROM
(SELECT t.symbol, t.session, t.entry_minute, t.is_call, t.width, t.otm, t.q1, max(a.minute) AS minute, max_by(a.bid, a.minute) AS bid, max_by(a.ask, a.minute) AS ask FROM (SELECT DISTINCT symbol, session, entry_minute, is_call, width, otm, q1, cp, k1, k2 FROM traded) t
 LEFT JOIN quotes a ON a.symbol = t.symbol AND a.session = t.session AND a.cp = t.cp AND a.strike = t.k{k} AND a.minute <= t.entry_minute GROUP BY ALL))"""


_LEGS = f"{_leg(1)}, {_leg(2)}"
_PAY = "CASE WHEN skip IS NULL THEN CASE WHEN {} > 0 THEN ask ELSE bid END END"


@query(with_sql("bars", "quotes") + f""", {_RULES}, {_TRADES}, {_LEGS}, x AS (SELECT symbol, session, qty, coalesce(skip, 'none') AS skip, CASE WHEN skip IS NULL THEN CASE WHEN qty > 0 THEN ask ELSE bid END END AS chosen, CASE WHEN skip IS NULL THEN entry_minute - minute END AS age
 FROM (SELECT *, q1 AS qty FROM leg1 UNION ALL SELECT *, -q1 AS qty FROM leg2)) SELECT symbol, CAST(year(session) AS INTEGER) AS year, qty, skip, count(*) AS legs, round(sum(chosen), 4) AS chosen, CAST(sum(age) AS BIGINT) AS age FROM x GROUP BY 1, 2, 3, 4""")
def ev10_leg_evidence(spark, d):
    """The price that each leg would have got: the ask for a long one, the bid for a short one, or the reason why there is none."""
    e = ledgers.leg_evidence(ledgers.with_structures(_swept(spark, d), step=5.0), src.option_quotes(spark, d), keys=KEYS)
    g = e.groupBy("symbol", F.year("session").alias("year"), F.col("qty").cast("int").alias("qty"), F.coalesce("skip", F.lit("none")).alias("skip"))
    return g.agg(F.count(F.lit(1)).alias("legs"), F.round(F.sum("chosen"), 4).alias("chosen"), F.sum(F.col("entry_minute") - F.col("quoted_at")).alias("age"))


@query(with_sql("bars", "quotes") + f""", {_RULES}, {_TRADES}, {_LEGS}, both2 AS (SELECT a.symbol, a.session, a.entry_minute, a.is_call, a.width, a.otm, array_to_string(list_sort(list_distinct([x FOR x IN [a.skip, b.skip] IF x IS NOT NULL])), ';') AS missing,
  a.q1 * CASE WHEN a.q1 > 0 THEN a.ask ELSE a.bid END - a.q1 * CASE WHEN a.q1 < 0 THEN b.ask ELSE b.bid END AS debit FROM leg1 a JOIN leg2 b USING (symbol, session, entry_minute, is_call, width, otm)),
l AS (SELECT t.attempt, t.session, t.selected, t.width, t.settled, t.best, t.worst, b.debit, CASE WHEN missing <> '' THEN missing WHEN NOT abs(debit) < t.width THEN 'degenerate entry' END AS skip FROM traded t JOIN both2 b USING (symbol, session, entry_minute, is_call, width, otm)),
s AS (SELECT attempt, count(*) FILTER (selected) AS selected, count(*) FILTER (selected AND skip IS NULL) AS priced, count(DISTINCT isoyear(session) * 100 + weekofyear(session)) FILTER (selected AND skip IS NULL) AS weeks, avg((settled - debit - 0.03 * width) / width) FILTER (selected AND skip IS NULL) * 100 AS base_mean,
 avg((settled - debit - 0.045 * width) / width) FILTER (selected AND skip IS NULL) * 100 AS elevated_mean FROM l GROUP BY 1),
ok AS (SELECT * FROM s WHERE attempt % 11 <> 0 AND priced >= 0.7 * selected AND priced >= 30 AND weeks >= 12),
c AS (SELECT attempt, isoyear(session) * 100 + weekofyear(session) AS wk, sum((settled - debit - 0.03 * width) / width) AS s, count(*) AS n FROM l JOIN ok USING (attempt) WHERE l.selected AND skip IS NULL GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY wk) - 1 AS idx, count(*) OVER (PARTITION BY attempt) AS k FROM c),
dr AS (SELECT r, slot, CAST('0x' || left(md5('evidence|' || r || '|' || slot), 8) AS BIGINT) AS h FROM (SELECT unnest(range(200)) AS r), (SELECT unnest(range(1000)) AS slot) WHERE slot < (SELECT max(k) FROM i)),
bs AS (SELECT attempt, r, sum(i.s) / sum(i.n) AS mean FROM (SELECT attempt, r, h % k AS idx FROM (SELECT DISTINCT attempt, k FROM i), dr WHERE slot < k) JOIN i USING (attempt, idx) GROUP BY 1, 2),
lb AS (SELECT attempt, quantile_cont(mean, 0.05) * 100 AS bound FROM bs GROUP BY 1)
SELECT s.attempt, s.selected, s.priced, s.weeks, round(base_mean, 6) AS base_mean, round(elevated_mean, 6) AS elevated_mean, round(bound, 6) AS base_lower_bound,
CASE WHEN s.attempt % 11 = 0 THEN 'unavailable' WHEN bound IS NULL THEN 'insufficient' WHEN base_mean > 0 AND elevated_mean > 0 AND bound > 0 THEN 'passed' ELSE 'failed' END AS state FROM s LEFT JOIN lb USING (attempt)""")
def ev9_evidence_block(spark, d):
    """Verdicts on executable prices: coverage of 70 %, 30 sessions, 12 weeks; every eleventh rule has no right to its prices. 200 resamples, as the number of rules multiplies them."""
    trades = ledgers.with_structures(_swept(spark, d), step=5.0)
    evidence = ledgers.leg_evidence(trades, src.option_quotes(spark, d), keys=KEYS)
    rows = ledgers.ledger(ledgers.executable(trades, evidence, keys=KEYS), KEYS)
    out = ledgers.evidence_block(rows, entitled=F.col("attempt") % 11 != 0, resamples=200)
    return out.select("attempt", "selected", "priced", "weeks", r6("base_mean").alias("base_mean"), r6("elevated_mean").alias("elevated_mean"), r6("base_lower_bound").alias("base_lower_bound"), "state")
