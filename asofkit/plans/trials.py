"""Queries on campaigns: rules tried on weekly series, stage by stage, each stage opened only for those that passed the one before.

A series is the weekly mean of the orders of a priority. A rule goes with or against the distance of a week from the twelve weeks before it. The first campaign captures the
change over four weeks against the mean of matured changes; the second, sealed until the first has passed, trades next week's change over the market's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators import campaigns as cp
from asofkit.sources.files import work_folder
from asofkit.sources.tables import table

QUERIES, ORACLES = {}, {}
KEYS = ["rule", "symbol"]
LEAST_WEEKS = {"discovery": 104, "validation": 52, "holdout": 52}
FIRST = cp.StageRules(LEAST_WEEKS, 0.2, 4, False, {"validation": ["volume"], "holdout": ["market", "volume"]})
SECOND = cp.StageRules(LEAST_WEEKS, 0.2, 1, True, {s: ["always_long"] + (["market"] if s == "holdout" else []) for s in cp.STAGES})


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _signal(v: str, keys: list[str]):
    """1 above the mean of the twelve weeks before, -1 below; NULL with fewer than eight of them or at the mean."""
    past = W.partitionBy(*keys).orderBy("i").rangeBetween(-12, -1)
    return F.when(F.count(v).over(past) >= 8, F.nullif(F.signum(F.col(v) - F.avg(v).over(past)), F.lit(0.0)).cast("int"))


def _weeks(spark, d):
    """``rule, symbol, week, i, direction, v, n, position, market, y4, volume4, excess`` for both rules."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), cp.week_of(F.to_date("o_orderdate")).alias("week"), "o_totalprice")
    by = o.groupBy("symbol", "week").agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n")).withColumn("v", F.col("s") / F.col("n"))
    x = cp.numbered(by, by.agg(F.min("week").alias("first")))
    own = ["symbol"]
    x = x.withColumns({"reading": _signal("v", own), "y4": F.ln(cp.ahead("v", 4, own) / F.col("v")), "volume4": F.ln(cp.ahead("n", 4, own) / F.col("n")), "y1": F.ln(cp.ahead("v", 1, own) / F.col("v"))})
    # one row a week
    market = x.groupBy("week", "i").agg((F.sum("s") / F.sum("n")).alias("mv"), F.when(F.count("y1") >= 3, F.avg("y1")).alias("bench")).withColumn("all", F.lit(1)).withColumn("market_reading", _signal("mv", ["all"]))
    x = x.join(market.select("i", "market_reading", "bench"), "i").withColumn("excess", F.col("y1") - F.col("bench"))
    rules = F.explode(F.array(F.struct(F.lit("momentum").alias("rule"), F.lit(1).alias("direction")), F.struct(F.lit("reversal").alias("rule"), F.lit(-1).alias("direction"))))
    x = x.withColumn("r", rules).select("*", "r.*").drop("r")
    return x.withColumns({"position": F.col("reading") * F.col("direction"), "market": F.col("market_reading") * F.col("direction")})


def _bounds(weeks):
    """The first half of the grid, a quarter of it and the rest, with four weeks between that belong to no stage."""
    n = weeks.agg((F.max("i") + 1).alias("n"))
    half, late = F.floor(F.col("n") * 0.5), F.floor(F.col("n") * 0.75)
    rows = [(cp.STAGES[0], F.lit(0), half - 1), (cp.STAGES[1], half + 4, late - 1), (cp.STAGES[2], late + 4, F.col("n"))]
    return n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), a.cast("int").alias("first_i"), z.cast("int").alias("last_i")) for s, a, z in rows])).alias("b")).select("b.*")


def _long(parts):
    """``rule, symbol, week, check, value`` of several checks."""
    return reduce(lambda a, b: a.unionByName(b), [df.filter(F.col(c).isNotNull()).select(*KEYS, "week", F.lit(name).alias("check"), F.col(c).alias("value")) for name, df, c in parts])


def _gates_sql(campaign: int, rules: cp.StageRules, spec: str) -> str:
    """The tables of one campaign: reports of all stages as if all were opened, from its captures c{k} and checks k{k}."""
    k = campaign
    need = ", ".join(f"('{s}', {n})" for s, n in rules.least_weeks.items())
    asked = ", ".join(f"('{s}', '{c}')" for s in cp.STAGES for c in rules.checks.get(s, ()))
    gates = ["m", "h1", "h2", "wb", "lb"] + (["el"] if rules.traded else [])
    names = dict(zip(("m", "h1", "h2", "wb", "lb", "el"), cp.FIGURES))
    broken = ", ".join(f"CASE WHEN coalesce({g} > 0, false) THEN NULL ELSE '{names[g]}' END" for g in gates)
    ok = f"NOT coalesce(weeks < need OR least(ls, 1 - ls) < {rules.least_share}, true)"
    return f"""n{k} AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY rule, symbol, stage) AS k FROM c{k} WINDOW w AS (PARTITION BY rule, symbol, stage ORDER BY week)),
st{k} AS (SELECT rule, symbol, stage, count(*) AS weeks, avg(base) AS m, avg(elevated) AS el, (sum(base) - max(base)) / nullif(count(*) - 1, 0) AS wb, avg(base) FILTER (place <= greatest(1, k // 2)) AS h1, avg(base) FILTER (place > greatest(1, k // 2)) AS h2, avg(CAST(position = 1 AS DOUBLE)) AS ls FROM n{k} GROUP BY ALL),
b{k} AS (SELECT *, row_number() OVER (PARTITION BY rule, symbol, stage ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY rule, symbol, stage) AS kk FROM (SELECT rule, symbol, stage, (place - 1) // {rules.block} AS block, sum(base) AS s, count(*) AS c FROM n{k} GROUP BY ALL)),
d{k} AS (SELECT rule, symbol, stage, r, CAST(('0x' || substr(md5('{spec}|' || stage || '|' || r || '|' || idx), 1, 8)) AS BIGINT) % kk AS idx FROM b{k}, range(2000) t(r)),
lb{k} AS (SELECT rule, symbol, stage, quantile_cont(m, 0.05) AS lb FROM (SELECT d{k}.rule, d{k}.symbol, d{k}.stage, r, sum(s) / sum(c) AS m FROM d{k} JOIN b{k} USING (rule, symbol, stage, idx) GROUP BY ALL) GROUP BY ALL),
ck{k} AS (SELECT e.rule, e.symbol, a.stage, list(a.name ORDER BY a.name) FILTER (NOT coalesce(v > 0, false)) AS bad FROM e{k} e, (VALUES {asked}) a(stage, name)
  LEFT JOIN (SELECT rule, symbol, stage, name, avg(value) AS v FROM k{k} JOIN c{k} USING (rule, symbol, week) GROUP BY ALL) x ON x.rule = e.rule AND x.symbol = e.symbol AND x.stage = a.stage AND x.name = a.name GROUP BY ALL),
j{k} AS (SELECT e.rule, e.symbol, q.stage, coalesce(weeks, 0) AS weeks, m, h1, h2, wb, lb, {'el' if rules.traded else 'NULL::DOUBLE AS el'}, {ok} AS ok, need,
  CASE WHEN {ok} THEN list_concat(list_filter([{broken}], lambda x: x IS NOT NULL), coalesce(bad, [])) ELSE [] END AS failed
  FROM e{k} e CROSS JOIN (VALUES {need}) q(stage, need) LEFT JOIN st{k} USING (rule, symbol, stage) LEFT JOIN lb{k} USING (rule, symbol, stage) LEFT JOIN ck{k} USING (rule, symbol, stage)),
v{k} AS (SELECT *, CASE WHEN NOT ok THEN 'UNTESTABLE' WHEN len(failed) > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict, CASE stage WHEN 'discovery' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS no FROM j{k}),
o{k} AS (SELECT * FROM v{k} a WHERE NOT EXISTS (SELECT 1 FROM v{k} b WHERE b.rule = a.rule AND b.symbol = a.symbol AND b.no < a.no AND b.verdict <> 'PASSED')),
r{k} AS (SELECT rule, symbol, stage, weeks, {', '.join(f'round(CASE WHEN ok THEN {g} END, 8) AS {c}' for g, c in names.items())}, CASE WHEN NOT ok OR NOT {rules.traded} THEN 'NOT_APPLICABLE' WHEN el > 0 THEN 'PASSED' ELSE 'FAILED' END AS double_cost, array_to_string(failed, ',') AS failed,
  CASE WHEN NOT ok THEN CASE WHEN weeks < need THEN 'weeks' ELSE 'state share' END END AS reason, verdict, arg_max(verdict, no) OVER (PARTITION BY rule, symbol) AS campaign_verdict FROM o{k})"""


_PAST = "OVER (PARTITION BY {} ORDER BY i RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)"
_AHEAD = "max({}) OVER (PARTITION BY symbol ORDER BY i RANGE BETWEEN {} FOLLOWING AND {} FOLLOWING)"


def _signal_sql(v: str, keys: str) -> str:
    past = _PAST.format(keys)
    return f"CASE WHEN count({v}) {past} >= 8 THEN nullif(sign({v} - avg({v}) {past}), 0) END"


def _matured_sql(position: str, y: str) -> str:
    old = "OVER (PARTITION BY rule, symbol ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)"
    return f"CASE WHEN count({y}) {old} >= 13 THEN {position} * ({y} - avg({y}) {old}) END"


def _turnover_sql(position: str, bps: int) -> str:
    held = f"CASE WHEN excess IS NOT NULL THEN {position} END"
    return f"{position} * excess - {bps} * abs({position} - coalesce(max({held}) OVER (PARTITION BY rule, symbol ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0)) * 2 / 10000.0"


_STAGED = """(SELECT *, row_number() OVER (PARTITION BY rule, symbol, stage ORDER BY i) AS t FROM {} JOIN bounds ON i BETWEEN first_i AND last_i WHERE base IS NOT NULL) WHERE stage <> 'holdout' OR t <= 60"""

_SQL = f"""WITH by_ AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, sum(o_totalprice) AS s, count(*) AS n, sum(o_totalprice) / count(*) AS v FROM orders GROUP BY 1, 2),
num AS (SELECT *, CAST((week - min(week) OVER ()) // 7 AS INTEGER) AS i FROM by_),
sig AS (SELECT *, {_signal_sql('v', 'symbol')} AS reading, ln({_AHEAD.format('v', 4, 4)} / v) AS y4, ln({_AHEAD.format('n', 4, 4)} / n) AS volume4, ln({_AHEAD.format('v', 1, 1)} / v) AS y1 FROM num),
mk AS (SELECT i, sum(s) / sum(n) AS mv, CASE WHEN count(y1) >= 3 THEN avg(y1) END AS bench FROM sig GROUP BY 1), mks AS (SELECT *, {_signal_sql('mv', '1')} AS market_reading FROM mk),
wk AS (SELECT rule, symbol, week, i, reading * direction AS position, market_reading * direction AS market, y4, volume4, y1 - bench AS excess FROM sig JOIN mks USING (i), (VALUES ('momentum', 1), ('reversal', -1)) r(rule, direction)),
bounds AS (SELECT unnest([{{'stage': 'discovery', 'first_i': 0, 'last_i': floor(n * 0.5) - 1}}, {{'stage': 'validation', 'first_i': floor(n * 0.5) + 4, 'last_i': floor(n * 0.75) - 1}}, {{'stage': 'holdout', 'first_i': floor(n * 0.75) + 4, 'last_i': n}}], recursive := true) FROM (SELECT max(i) + 1 AS n FROM wk)),
a1 AS (SELECT *, {_matured_sql('position', 'y4')} AS base, {_matured_sql('market', 'y4')} AS other, {_matured_sql('position', 'volume4')} AS volume FROM wk),
e1 AS (SELECT DISTINCT rule, symbol FROM wk), c1 AS (SELECT rule, symbol, week, stage, position, base, base AS elevated FROM {_STAGED.format('a1')}),
k1 AS (SELECT rule, symbol, week, 'market' AS name, other AS value FROM a1 UNION ALL SELECT rule, symbol, week, 'volume', volume FROM a1),
{_gates_sql(1, FIRST, 'weekly|1')},
a2 AS (SELECT *, {_turnover_sql('position', 10)} AS base, {_turnover_sql('position', 20)} AS elevated, {_turnover_sql('market', 10)} AS other FROM wk),
e2 AS (SELECT DISTINCT rule, symbol FROM r1 WHERE campaign_verdict = 'PASSED' AND stage = 'holdout'), c2 AS (SELECT rule, symbol, week, stage, position, base, elevated FROM {_STAGED.format('a2')} AND (rule, symbol) IN (SELECT (rule, symbol) FROM e2)),
k2 AS (SELECT rule, symbol, week, 'market' AS name, other AS value FROM a2 UNION ALL SELECT rule, symbol, week, 'always_long', base - excess FROM a2),
{_gates_sql(2, SECOND, 'weekly|2')}
SELECT 1 AS campaign, * FROM r1 UNION ALL SELECT 2, * FROM r2
UNION ALL SELECT 2, rule, symbol, 'sealed', 0, NULL, NULL, NULL, NULL, NULL, NULL, 'NOT_APPLICABLE', '', 'sealed', 'SEALED', 'SEALED' FROM e1 WHERE (rule, symbol) NOT IN (SELECT (rule, symbol) FROM e2)"""


@query(_SQL)
def ev12_campaign_stages(spark, d):
    """Two campaigns over all rules and series; the second is opened only for those that passed the first."""
    folder = work_folder(spark, "campaign")
    _weeks(spark, d).write.parquet(f"{folder}/weeks")
    weeks = spark.read.parquet(f"{folder}/weeks")
    bounds, entrants = _bounds(weeks), weeks.select(*KEYS).distinct()
    captured = lambda p, y: cp.matured_captures(weeks, KEYS, position=p, outcome=y, horizon=4)
    one = captured("position", "y4")
    checks = _long([("market", captured("market", "y4"), "base"), ("volume", captured("position", "volume4"), "base")])
    first = cp.run_stages(spark, f"{folder}/1", f"{folder}/receipts", cp.with_stage(one, bounds, KEYS, closes_after=60), checks, entrants, keys=KEYS, rules=FIRST, spec="weekly|1")
    passed = first.filter("stage = 'holdout' and campaign_verdict = 'PASSED'").select(*KEYS)
    sealed = entrants.join(passed, KEYS, "left_anti").withColumns({"stage": F.lit("sealed"), "weeks": F.lit(0).cast("long"), "double_cost": F.lit("NOT_APPLICABLE"), "failed": F.array().cast("array<string>"), "reason": F.lit("sealed"), "verdict": F.lit("SEALED"), "campaign_verdict": F.lit("SEALED")})
    out = first.withColumn("campaign", F.lit(1)).unionByName(sealed.withColumn("campaign", F.lit(2)), allowMissingColumns=True)
    if not passed.isEmpty():
        traded = lambda p: cp.turnover_captures(weeks, KEYS, position=p, outcome="excess", base_bps=10, elevated_bps=20)
        two = traded("position").join(passed, KEYS, "left_semi")
        checks = _long([("market", traded("market"), "base"), ("always_long", two.withColumn("margin", F.col("base") - F.col("excess")), "margin")])
        second = cp.run_stages(spark, f"{folder}/2", f"{folder}/receipts", cp.with_stage(two, bounds, KEYS, closes_after=60), checks, passed, keys=KEYS, rules=SECOND, spec="weekly|2")
        out = out.unionByName(second.withColumn("campaign", F.lit(2)))
    return out.withColumns({c: F.round(c, 8) for c in cp.FIGURES} | {"failed": F.array_join("failed", ",")})
