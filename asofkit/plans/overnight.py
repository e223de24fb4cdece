"""Queries on overnight structures: three candidates over sessions of hourly bars, with equal weights at a flat cost, and with decaying weights, a declared cost and three exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import scalars as fn
from asofkit.operators import overnight as on
from asofkit.operators.windows import chronological_split
from asofkit.sources import tables as src
from asofkit.sources.files import work_folder
from asofkit.sources.tables import with_sql

QUERIES, ORACLES = {}, {}
CLOCK = on.Clock(latest_first=630, morning=750, settlement=930, floor=570)
CANDIDATES = [
    on.Candidate("fade_rise", 630, "call_credit", 10, 5, lambda v: (v.from_evening_open(630) > 5) & (v.price_at(630) > v.prior_low)),
    on.Candidate("buy_dip", 690, "call_debit", 20, 0, lambda v: v.from_prior_close(690) < -10),
    on.Candidate("after_touch", 690, "put_debit", 20, 5, lambda v: v.first_touch(-20.0, 570).isNotNull() & (v.day_of_week < 4)),
]
SPLITS = {"discovery": 0.6, "validation": 0.8, "holdout": 1.0}
KEYS = ["symbol", "label", "exit", "split"]
FIGURES = ("net_mean", "control_mean", "mean_debit", "weekly_mean", "lower_bound", "sharpe", "score")


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _evaluate(spark, d, exits, *, cost: float, premium: float, decay: float | None, seed: str):
    days = on.sessions(src.session_bars(spark, d), CLOCK, (570, 630, 690, 750), decay=decay)
    days = chronological_split(days, "session", SPLITS).withColumnRenamed("stage", "split")
    rows = on.trades(days, CANDIDATES, exits, CLOCK, cost=cost, premium=premium, keep=["symbol", "session", "split"])
    folder = work_folder(spark, "overnight")  # the score reads the trades several times, so they are priced once
    rows.write.parquet(folder)
    out = on.evaluate(spark.read.parquet(folder), KEYS, cost=cost, seed=seed)
    return out.withColumns({c: F.round(c, 6) for c in FIGURES})


def _price(cp: str, spot: str, strike: str, vol: str) -> str:
    """A call by the model, a put by parity."""
    call = fn.sql_bs_call(spot, strike, vol)
    return f"({call})" if cp == "C" else f"({call} - ({spot}) + ({strike}))"


def _sql(exits, *, cost: float, premium: float, decay: float | None, seed: str) -> str:
    minutes = (570, 630, 690, 750)
    total = sum((decay or 1.0) ** k for k in range(20))
    weighted = lambda m: "(" + " + ".join(f"{(decay or 1.0) ** k!r} * l{m}[{20 - k}]" for k in range(20)) + f") / {total!r}"
    at = ", ".join(f"max(open) FILTER (minute = {m}) AS p{m}, coalesce(sum(sq) FILTER (since >= {m}), 0) AS v{m}" for m in minutes)
    # label, entry, width, cp, strike and quantity of both legs, signal
    call_strike, put_strike = "round_even((p630 + 5) / 5, 0) * 5", "round_even((p690 - 5) / 5, 0) * 5"
    spec = [
        ("fade_rise", 630, 10, "C", call_strike, -1, f"({call_strike} + 10)", "(p630 / evening_open - 1) * 100 > 5 AND p630 > prior_low"),
        ("buy_dip", 690, 20, "C", "round_even(p690 / 5, 0) * 5", 1, "(round_even(p690 / 5, 0) * 5 + 20)", "(p690 / prior_close - 1) * 100 < -10"),
        ("after_touch", 690, 20, "P", put_strike, 1, f"({put_strike} - 20)", "low690 <= evening_open - 20 AND isodow(session) < 5"),
    ]
    rows = " UNION ALL ".join(f"""SELECT symbol, session, complete, settlement, next_settlement, p750, m750, m570, '{label}' AS label, coalesce({signal}, false) AS selected, {float(width)} AS width, p{entry} AS entry, m{entry} AS entry_var, '{cp}' AS cp, {qty} AS qty, {anchor} AS k0, {other} AS k1 FROM days"""
                              for label, entry, width, cp, anchor, qty, other, signal in spec)
    pair = lambda spot, vol: f"qty * (CASE WHEN cp = 'C' THEN {_price('C', spot, 'k0', vol)} - {_price('C', spot, 'k1', vol)} ELSE {_price('P', spot, 'k0', vol)} - {_price('P', spot, 'k1', vol)} END)"
    pay = lambda k, s: f"greatest(CASE WHEN cp = 'C' THEN {s} - {k} ELSE {k} - {s} END, 0)"
    floor = lambda by: "CASE split " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in by.items()) + " END"
    keys = "symbol, label, exit, split"
    return with_sql("bars") + f""", stp AS (SELECT *, lag(minute) OVER w AS since, ln(close / lag(close) OVER w) * ln(close / lag(close) OVER w) AS sq, row_number() OVER w AS place FROM bars WINDOW w AS (PARTITION BY symbol, session ORDER BY minute)),
s AS (SELECT symbol, session, max(open) FILTER (place = 1) AS evening_open, min(minute) AS first_minute, max(close) FILTER (minute = 930) AS settlement, max(high) FILTER (minute BETWEEN 750 AND 930) AS dh, min(low) FILTER (minute BETWEEN 750 AND 930) AS dl, min(low) FILTER (minute > 570 AND minute <= 690) AS low690, {at} FROM stp GROUP BY 1, 2),
f AS (SELECT *, first_minute <= 630 AND settlement IS NOT NULL AS complete FROM s),
t AS (SELECT *, {', '.join(f'list(v{m}) OVER w AS l{m}' for m in minutes)} FROM f WINDOW w AS (PARTITION BY symbol, complete ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, {', '.join(f'CASE WHEN complete AND len(l{m}) = 20 THEN {weighted(m)} END AS w{m}' for m in minutes)} FROM t),
days AS (SELECT *, {', '.join(f'last_value(w{m} IGNORE NULLS) OVER b AS m{m}' for m in minutes)}, last_value(settlement IGNORE NULLS) OVER b AS prior_close, last_value(dl IGNORE NULLS) OVER b AS prior_low, lead(CASE WHEN complete THEN settlement END) OVER (PARTITION BY symbol ORDER BY session) AS next_settlement FROM u
  WINDOW b AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT c.*, exit, sqrt(entry_var + CASE WHEN exit = 'next_session' THEN m570 ELSE 0 END) * {premium} AS ev, sqrt(m750) * {premium} AS mv FROM ({rows}) c, (SELECT unnest({list(exits)}) AS exit)),
pr AS (SELECT *, {pair('entry', 'ev')} AS debit, CASE WHEN exit = 'morning' THEN {pair('p750', 'mv')} WHEN exit = 'next_session' THEN qty * ({pay('k0', 'next_settlement')} - {pay('k1', 'next_settlement')}) ELSE qty * ({pay('k0', 'settlement')} - {pay('k1', 'settlement')}) END AS value FROM r),
sk AS (SELECT *, CASE WHEN NOT complete THEN 'incomplete_session' WHEN entry_var IS NULL THEN 'vol_warmup' WHEN exit = 'next_session' AND next_settlement IS NULL THEN 'no_next_session' WHEN entry IS NULL THEN 'missing_entry_bar'
  WHEN NOT coalesce(abs(debit) < width, false) THEN 'degenerate_entry' WHEN exit = 'morning' AND p750 IS NULL THEN 'missing_morning_bar' END AS skip FROM pr),
dy AS (SELECT session, row_number() OVER (ORDER BY session) AS no, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM f)),
x AS (SELECT sk.* EXCLUDE (debit), CASE WHEN no <= floor(n * 0.6) THEN 'discovery' WHEN no <= floor(n * 0.8) THEN 'validation' ELSE 'holdout' END AS split, CASE WHEN skip IS NULL THEN debit END AS debit, CASE WHEN skip IS NULL THEN (value - debit - {cost} * width) / width END AS net, selected AND skip IS NULL AS chosen FROM sk JOIN dy USING (session)),
wh AS (SELECT {keys}, count(*) FILTER (skip IS NULL) AS eligible_sessions, count(*) FILTER (chosen) AS signal_trades, avg(net) FILTER (chosen) AS net_mean, avg(net) AS control_mean, avg(debit / width) FILTER (chosen) AS mean_debit FROM x GROUP BY ALL),
re AS (SELECT {keys}, string_agg(skip || ':' || n, ',' ORDER BY skip) AS skipped FROM (SELECT {keys}, skip, count(*) AS n FROM x WHERE skip IS NOT NULL GROUP BY ALL) GROUP BY ALL),
wk AS (SELECT *, net - {cost} AS hard, row_number() OVER (PARTITION BY {keys} ORDER BY week) AS i, count(*) OVER (PARTITION BY {keys}) AS k FROM (SELECT {keys}, isoyear(session) * 100 + week(session) AS week, avg(net) AS net, count(*) AS n FROM x WHERE chosen GROUP BY ALL)),
st AS (SELECT {keys}, count(*) AS periods, avg(net) AS mean, avg(hard) AS hard_mean, (sum(net) - max(net)) / nullif(count(*) - 1, 0) AS wb, avg(net) FILTER (i <= greatest(1, k // 2)) AS h1, avg(net) FILTER (i > greatest(1, k // 2)) AS h2, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52.0), 0) AS sharpe, sum(n) AS trades FROM wk GROUP BY ALL),
dr AS (SELECT {keys}, r, CAST('0x' || left(md5('{seed}|' || r || '|' || (i - 1)), 8) AS BIGINT) % k AS idx FROM wk, range(1000) q(r) WHERE k > 1),
mm AS (SELECT {', '.join('dr.' + c for c in KEYS)}, r, avg(net) AS m FROM dr JOIN wk ON {' AND '.join(f'dr.{c} = wk.{c}' for c in KEYS)} AND wk.i - 1 = dr.idx GROUP BY ALL),
lb AS (SELECT {keys}, m AS lb FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY m) AS place FROM mm) WHERE place = 51),
g AS (SELECT wh.*, coalesce(skipped, '') AS skipped, coalesce(periods, 0) AS signal_weeks, mean, lb, coalesce(sharpe, 0) AS sharpe, coalesce(trades >= {floor(on.LEAST_TRADES)}, false) AS g1, coalesce(periods >= {floor(on.LEAST_WEEKS)}, false) AS g2, coalesce(mean > 0, false) AS g3,
  coalesce(periods >= 4 AND h1 > 0 AND h2 > 0, false) AS g4, coalesce(wb > 0, false) AS g5, coalesce(hard_mean > 0, false) AS g6, coalesce(lb > 0, false) AS g7 FROM wh LEFT JOIN st USING ({keys}) LEFT JOIN lb USING ({keys}) LEFT JOIN re USING ({keys})),
p AS (SELECT *, CAST(25 - 10 * (g1::INT + g2::INT) - (g3::INT + g4::INT + g5::INT + g6::INT + g7::INT) AS DOUBLE) AS gate_penalty FROM g)
SELECT {keys}, eligible_sessions, signal_trades, round(net_mean, 6) AS net_mean, round(control_mean, 6) AS control_mean, round(mean_debit, 6) AS mean_debit, signal_weeks, round(mean, 6) AS weekly_mean, round(lb, 6) AS lower_bound, round(sharpe, 6) AS sharpe,
{', '.join(f'g{k + 1} AS {name}' for k, name in enumerate(on.GATES))}, gate_penalty, CASE WHEN gate_penalty = 0 THEN 'passed' ELSE 'rejected' END AS status, round(CASE WHEN gate_penalty = 0 THEN sharpe ELSE least(sharpe, {on.TARGET} - 0.000001) - gate_penalty END, 6) AS score, skipped FROM p"""


_FLAT = {"cost": 0.05, "premium": 1.10, "decay": None, "seed": "overnight-1"}
_DECLARED = {"cost": 0.02, "premium": 1.20, "decay": 0.85, "seed": "overnight-2"}
_EXITS = (on.SETTLEMENT, on.MORNING, on.NEXT)


@query(_sql((on.SETTLEMENT,), **_FLAT))
def ev4_overnight_flat_cost(spark, d):
    """Settlement only, every one of the twenty sessions alike, five percent of the width."""
    return _evaluate(spark, d, (on.SETTLEMENT,), **_FLAT)


@query(_sql(_EXITS, **_DECLARED))
def ev5_overnight_exits(spark, d):
    """Three exits, weights that fall by 0.85 a session, the cost and the premium declared."""
    return _evaluate(spark, d, _EXITS, **_DECLARED)
