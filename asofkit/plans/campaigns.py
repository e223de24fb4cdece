"""Queries on the index tape and on filed quarters: readings of the signal by session, quarters as they were known, growth of the next one.

The fixings of the tape are the live revisions of the tape, averaged over the urgent and the other priorities, so that there are two dense indexes.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators import tape, vintages
from asofkit.sources import tables as src
from asofkit.sources.tables import with_sql

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


_RUNS = with_sql("tape") + """, fix AS (SELECT CASE WHEN index_code < '3' THEN 'urgent' ELSE 'other' END AS index_code, index_date, avg(value) AS value, min(methodology) AS methodology FROM tape WHERE superseded_at IS NULL GROUP BY 1, 2),
cal AS (SELECT day, row_number() OVER (ORDER BY day) AS no FROM (SELECT CAST(unnest(generate_series(CAST(min(index_date) - 7 AS TIMESTAMP), CAST(max(index_date) + 14 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM tape) WHERE isodow(day) < 6),
onday AS (SELECT fix.*, no, lag(methodology) OVER (PARTITION BY index_code ORDER BY no) AS before FROM fix JOIN cal ON index_date = day),
islands AS (SELECT *, sum(CASE WHEN before = methodology THEN 0 ELSE 1 END) OVER (PARTITION BY index_code ORDER BY no) AS run FROM onday),
runs AS (SELECT *, min(no) OVER (PARTITION BY index_code, run) AS s FROM islands)"""


def _fixings(spark, d):
    live = src.tape(spark, d).filter("superseded_at is null")
    return live.groupBy(F.when(F.col("index_code") < "3", "urgent").otherwise("other").alias("index_code"), "index_date").agg(F.avg("value").alias("value"), F.min("methodology").alias("methodology"))


def _calendar(spark, d):
    return tape.weekday_calendar(src.table(spark, d, "orders"), F.to_date("o_orderdate"), 7, 14)


@query(_RUNS + """, asks AS (SELECT index_code, day, no FROM (SELECT DISTINCT index_code FROM fix), cal),
last AS (SELECT a.index_code, a.day, a.no, max(r.no) AS n FROM asks a LEFT JOIN runs r ON a.index_code = r.index_code AND r.no <= a.no GROUP BY 1, 2, 3),
seen AS (SELECT l.*, r.index_date, r.methodology, r.s, r.run, r.value FROM last l LEFT JOIN runs r ON l.index_code = r.index_code AND l.n = r.no),
anch AS (SELECT l.index_code, l.day, max(r.no) AS a FROM seen AS l JOIN runs r ON r.index_code = l.index_code AND r.run = l.run AND r.no BETWEEN l.n - 66 AND l.n - 63 GROUP BY 1, 2),
present AS (SELECT l.index_code, l.day, anch.a, max(CASE WHEN r.no = anch.a THEN r.index_date END) AS anchor, max(CASE WHEN r.no = anch.a THEN r.value END) AS av, count(*) / (max(l.n) - anch.a + 1) AS coverage
  FROM seen AS l JOIN anch ON l.index_code = anch.index_code AND l.day = anch.day JOIN runs r ON r.index_code = l.index_code AND r.run = l.run AND r.no BETWEEN anch.a AND l.n GROUP BY 1, 2, 3),
out AS (SELECT l.*, anchor, av, coverage, CASE WHEN n IS NULL THEN 'no_data' WHEN no - n > 3 THEN 'stale' WHEN n - s + 1 < 64 THEN 'insufficient_history' WHEN anchor IS NULL OR coverage < 0.9 THEN 'insufficient_coverage' ELSE 'live' END AS status
  FROM seen AS l LEFT JOIN present p ON l.index_code = p.index_code AND l.day = p.day)
SELECT index_code, day AS session, status, index_date AS latest_fixing, methodology, coalesce(no - s + 1, 0) AS history_sessions, CASE WHEN status IN ('insufficient_coverage', 'live') THEN coverage END AS window_coverage,
CASE WHEN status IN ('insufficient_coverage', 'live') THEN anchor END AS anchor, CASE WHEN status = 'live' THEN ln(value / av) END AS value FROM out""")
def win26_tape_readings(spark, d):
    fixings, calendar = _fixings(spark, d), _calendar(spark, d)
    days = calendar.agg(F.sort_array(F.collect_list("day")).alias("days"))  # one row: at most 262 days a year
    asks = fixings.select("index_code").distinct().withColumn("one", F.lit(1)).join(days.withColumn("one", F.lit(1)), "one").select("index_code", F.explode("days").alias("session"))
    return tape.tape_readings(asks, fixings, calendar)


@query(_RUNS + """SELECT index_code, day AS earliest FROM (SELECT index_code, max_by(s, no) + 63 AS no FROM runs GROUP BY 1) LEFT JOIN cal USING (no)""")
def win26_earliest_live(spark, d):
    return tape.earliest_live(_fixings(spark, d), _calendar(spark, d))


#: Facts without every seventh one, so that quarters are missing; half of the second quarters are also filed directly, with another value.
_FACTS = with_sql("facts") + """, kept AS (SELECT * FROM facts WHERE (day(filed) + year("end")) % 7 <> 0 UNION ALL
  SELECT symbol, make_date(CAST(year("end") AS INTEGER), 4, 1), "end", value * 0.4, form, filed + 9, accession || 'd' FROM facts WHERE month("end") = 6 AND day(filed) % 2 = 0)"""


def _facts(spark, d):
    f = src.ytd_facts(spark, d)
    direct = f.filter("month(end) = 6 and day(filed) % 2 = 0").withColumns({
        "start": F.make_date(F.year("end"), F.lit(4), F.lit(1)), "value": F.col("value") * 0.4, "filed": F.date_add("filed", 9), "accession": F.concat("accession", F.lit("d")),
    })
    return f.filter("(day(filed) + year(end)) % 7 <> 0").unionByName(direct)


#: Quarters by (symbol, moment), from the facts filed up to it, told anew for each moment of ``ask``.
_QUARTERS = """lat AS (SELECT symbol, moment, "start", "end", arg_max(value, CAST(filed AS VARCHAR) || accession) AS value FROM kept JOIN ask USING (symbol) WHERE filed <= moment GROUP BY 1, 2, 3, 4),
direct AS (SELECT symbol, moment, "end", arg_max(value, "start") AS value FROM lat WHERE "end" - "start" BETWEEN 80 AND 100 GROUP BY 1, 2, 3),
diffs AS (SELECT a.symbol, a.moment, a."end", arg_max(a.value - p.value, -10000000 * datediff('day', DATE '1970-01-01', a."start") + datediff('day', DATE '1970-01-01', p."end")) AS value FROM lat a JOIN lat p ON a.symbol = p.symbol AND a.moment = p.moment AND a."start" = p."start"
  WHERE a."end" - a."start" > 100 AND a."end" - p."end" BETWEEN 80 AND 100 GROUP BY 1, 2, 3),
q AS (SELECT *, 'direct' AS method FROM direct UNION ALL SELECT *, 'ytd_diff' FROM diffs ANTI JOIN direct USING (symbol, moment, "end"))"""


@query(_FACTS + """, ask AS (SELECT DISTINCT symbol, filed AS moment FROM kept), """ + _QUARTERS + """, steps AS (SELECT *, lag(value) OVER w AS pv, lag(method) OVER w AS pm FROM q WINDOW w AS (PARTITION BY symbol, "end" ORDER BY moment))
SELECT symbol, "end", min(moment) AS first_known, count(*) FILTER (pv IS NOT NULL AND (value <> pv OR method <> pm)) AS changes, arg_max(method, moment) AS method, round(arg_min(value, moment), 2) AS first_value, round(arg_max(value, moment), 2) AS value FROM steps GROUP BY 1, 2""")
def win31_quarters_as_known(spark, d):
    s = vintages.quarter_states(_facts(spark, d))
    w = W.partitionBy("symbol", "end").orderBy("known_from")
    changed = F.lag("value").over(w).isNotNull() & ((F.lag("value").over(w) != F.col("value")) | (F.lag("method").over(w) != F.col("method")))
    return s.withColumn("changed", changed).groupBy("symbol", "end").agg(
        F.min("known_from").alias("first_known"), F.count_if("changed").alias("changes"), F.max_by("method", "known_from").alias("method"),
        F.round(F.min_by("value", "known_from"), 2).alias("first_value"), F.round(F.max_by("value", "known_from"), 2).alias("value"),
    )


@query(_FACTS + """, days AS (SELECT symbol, CAST(unnest(generate_series(CAST(date_trunc('month', min(filed)) AS TIMESTAMP), CAST(max(filed) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) + 14 AS decision FROM kept GROUP BY 1),
ask AS (SELECT symbol, decision - 1 AS moment FROM days UNION SELECT symbol, filed FROM kept), """ + _QUARTERS + """, fk AS (SELECT symbol, "end", min(moment) AS first_known, arg_min(value, moment) AS first_value FROM q SEMI JOIN (SELECT symbol, filed AS moment FROM kept) USING (symbol, moment) GROUP BY 1, 2),
bases AS (SELECT t.symbol, t.moment, t.e, arg_min(b.value, abs(t.e - 365 - b."end") * 100000 + (b."end" - DATE '1970-01-01')) AS base FROM (SELECT a.symbol, a.moment, x."end" AS e FROM ask a JOIN (SELECT DISTINCT symbol, "end" FROM kept) x USING (symbol)) t
  JOIN q b ON t.symbol = b.symbol AND t.moment = b.moment AND abs(t.e - 365 - b."end") <= 10 GROUP BY 1, 2, 3),
grown AS (SELECT q.symbol, q.moment, max(q."end") AS last_end, arg_max(ln(q.value / base), q."end") AS g FROM q JOIN bases b ON q.symbol = b.symbol AND q.moment = b.moment AND q."end" = b.e WHERE base > 0 AND q.value > 0 GROUP BY 1, 2),
ends AS (SELECT *, "end" - lag("end") OVER (PARTITION BY symbol ORDER BY "end") BETWEEN 80 AND 100 AS linked FROM (SELECT DISTINCT symbol, "end" FROM kept) LEFT JOIN fk USING (symbol, "end")),
halt AS (SELECT d.symbol, d.decision, g.last_end, g.g, min(e."end") AS next_end FROM days d LEFT JOIN grown g ON d.symbol = g.symbol AND d.decision - 1 = g.moment LEFT JOIN ends e ON e.symbol = d.symbol AND e."end" > g.last_end AND (NOT linked OR first_known IS NULL OR first_known >= d.decision) GROUP BY 1, 2, 3, 4),
full_ AS (SELECT h.*, e.first_known, e.linked AND e.first_known IS NOT NULL AND b.base > 0 AND e.first_value > 0 AS ok, e.first_value, b.base FROM halt h LEFT JOIN ends e ON h.symbol = e.symbol AND h.next_end = e."end"
  LEFT JOIN bases b ON b.symbol = h.symbol AND b.moment = h.decision - 1 AND b.e = h.next_end)
SELECT symbol, decision, last_end, CASE WHEN ok THEN next_end END AS next_end, CASE WHEN ok THEN first_known END AS known_on, round(CASE WHEN ok THEN ln(first_value / base) - g END, 6) AS acceleration FROM full_""")
def win31_acceleration(spark, d):
    f = _facts(spark, d)
    months = f.groupBy("symbol").agg(F.trunc(F.min("filed"), "month").alias("a"), F.max("filed").alias("z")).select("symbol", F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("m"))
    return vintages.next_quarter_acceleration(months.select("symbol", F.date_add("m", 14).alias("decision")), f).withColumn("acceleration", F.round("acceleration", 6))


#: Quarter plans in SQL, and the vintages read anew for each day on which one of the three reports of a plan was filed.
_PLANS = _FACTS + """, fy AS (SELECT DISTINCT symbol, unnest(["start", "end" + 1]) AS fy FROM kept WHERE form IN ('10-K', '10-K/A') AND "end" - "start" + 1 BETWEEN 350 AND 380),
periods AS (SELECT DISTINCT symbol, "start", "end" FROM kept),
chain AS (SELECT symbol, fy, "end", coalesce(lag("end") OVER (PARTITION BY symbol, fy ORDER BY "end"), fy - 1) AS before FROM periods JOIN fy USING (symbol) WHERE "start" = fy AND "end" - "start" + 1 <= 380),
steps AS (SELECT symbol, before + 1 AS "start", "end", max(fy) AS fy, arg_max(before, fy) AS before FROM chain WHERE "end" - before BETWEEN 80 AND 100 GROUP BY 1, 2, 3),
bare AS (SELECT symbol, "start", "end", CASE WHEN "start" <> fy THEN fy END AS long_start, CASE WHEN "start" <> fy THEN before END AS short_end FROM steps
  UNION ALL SELECT symbol, "start", "end", NULL, NULL FROM periods ANTI JOIN steps USING (symbol, "start", "end") WHERE "end" - "start" + 1 BETWEEN 80 AND 100),
owned AS (SELECT b.*, (SELECT max(fy) FROM fy WHERE fy.symbol = b.symbol AND fy.fy <= b."start" AND b."end" - fy.fy + 1 <= 380) AS fy FROM bare b),
plans AS (SELECT symbol, "start", "end", long_start, short_end, year(fy + 360) AS fiscal_year, CASE WHEN fy IS NOT NULL THEN greatest(1, round_even(("end" - fy + 1) / 91.3, 0))::INTEGER END AS fiscal_quarter FROM owned)
"""


@query(_PLANS + "SELECT * FROM plans")
def win28_fiscal_quarters(spark, d):
    return vintages.quarter_plans(_facts(spark, d))


_ORDER = "CAST(filed AS VARCHAR) || CASE WHEN form LIKE '%/A' THEN '1' ELSE '0' END || accession"


@query(_PLANS + f""", legs AS (SELECT p.*, k.filed AS day, k."start" = p."start" OR k."end" = p."end" AS asks FROM plans p JOIN kept k ON p.symbol = k.symbol AND ((k."start" = p."start" AND k."end" = p."end") OR (k."start" = p.long_start AND k."end" IN (p."end", p.short_end)))),
days AS (SELECT symbol, "start", "end", long_start, short_end, fiscal_year, fiscal_quarter, day, bool_or(asks) AS asks FROM legs GROUP BY ALL),
seen AS (SELECT y.*, {', '.join(f'''(SELECT arg_max({{'v': value, 'a': accession, 'f': form, 'o': CAST(filed AS VARCHAR) || accession}}, {_ORDER}) FROM kept k WHERE k.symbol = y.symbol AND k."start" = y.{s} AND k."end" = y.{e} AND k.filed <= y.day) AS {n}''' for n, s, e in (('d', '"start"', '"end"'), ('l', 'long_start', '"end"'), ('s', 'long_start', 'short_end')))} FROM days y),
told AS (SELECT *, CASE WHEN d IS NOT NULL THEN d.v ELSE l.v - s.v END AS value, CASE WHEN "end" - long_start + 1 BETWEEN 350 AND 380 THEN 'fy_minus_9m' ELSE 'ytd_diff' END AS way,
  CASE WHEN d IS NOT NULL THEN d WHEN s.o > l.o THEN s ELSE l END AS source, CASE WHEN d IS NOT NULL THEN d.a ELSE s.a || ';' || l.a END AS inputs, abs(d.v - (l.v - s.v)) / CASE WHEN d.v = 0 THEN 1.0 ELSE abs(d.v) END AS gap FROM seen WHERE d IS NOT NULL OR (l IS NOT NULL AND s IS NOT NULL)),
asked AS (SELECT *, row_number() OVER (PARTITION BY symbol, "start", "end" ORDER BY day) AS place FROM told),
marked AS (SELECT *, lag(value) OVER (PARTITION BY symbol, "start", "end" ORDER BY day) AS pv FROM asked WHERE asks OR place = 1),
numbered AS (SELECT *, sum(CASE WHEN pv = value THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, "start", "end" ORDER BY day) - 1 AS vintage FROM marked),
once AS (SELECT *, row_number() OVER (PARTITION BY symbol, "start", "end", vintage, source.a ORDER BY day) AS time FROM numbered)
SELECT symbol, "start", "end", CAST(vintage AS INTEGER) AS vintage, min(day) AS filed, long_start, short_end, fiscal_year, fiscal_quarter, round(arg_min(value, day), 2) AS value, arg_min(CASE WHEN d IS NOT NULL THEN 'direct' ELSE way END, day) AS method,
arg_min(inputs, day) AS inputs, coalesce(arg_min(CASE WHEN d IS NOT NULL AND gap > 0.01 THEN 'direct_vs_' || way || '_mismatch_' || printf('%.3f', gap) ELSE '' END, day), '') AS flag, arg_min(source.f, day) AS form, arg_min(source.a, day) AS accession,
string_agg(source.a, ';' ORDER BY day) FILTER (time = 1) AS confirmed_by FROM once GROUP BY symbol, "start", "end", vintage, long_start, short_end, fiscal_year, fiscal_quarter""")
def win29_quarterly_vintages(spark, d):
    joined = {c: F.array_join(c, ";") for c in ("inputs", "confirmed_by")}
    return vintages.quarterly_vintages(_facts(spark, d)).withColumns({**joined, "flag": F.coalesce("flag", F.lit("")), "value": F.round("value", 2)})


_PRIOR = """SELECT a.symbol, a."start", a."end", arg_max({{'s': b."start", 'e': b."end"}}, (b."end" - DATE '1970-01-01') * 1000000 - (b."start" - DATE '1970-01-01')) AS p FROM g_periods a JOIN g_periods b ON a.symbol = b.symbol
  AND a."end" - b."end" BETWEEN {} AND {} AND abs((a."end" - a."start") - (b."end" - b."start")) <= 10 GROUP BY 1, 2, 3"""
_ROLES = {"c": ('g."start"', 'g."end"'), "pq": ("g.pq.s", "g.pq.e"), "py": ("g.py.s", "g.py.e"), "pqy": ("g.pqy.s", "g.pqy.e")}


@query(f"""WITH vint AS ({ORACLES['win29_quarterly_vintages']}), g_periods AS (SELECT symbol, "start", "end", min(filed) AS first FROM vint GROUP BY 1, 2, 3),
g_pq AS ({_PRIOR.format(80, 100)}), g_py AS ({_PRIOR.format(350, 380)}),
links AS (SELECT a.*, q.p AS pq, y.p AS py, z.p AS pqy FROM g_periods a LEFT JOIN g_pq q ON a.symbol = q.symbol AND a."start" = q."start" AND a."end" = q."end" LEFT JOIN g_py y ON a.symbol = y.symbol AND a."start" = y."start" AND a."end" = y."end"
  LEFT JOIN g_py z ON a.symbol = z.symbol AND q.p.s = z."start" AND q.p.e = z."end"),
g_days AS (SELECT DISTINCT g.*, v.filed AS day FROM links g JOIN vint v ON g.symbol = v.symbol AND v.filed >= g.first AND ({' OR '.join(f'(v."start" = {s} AND v."end" = {e})' for s, e in _ROLES.values())})),
g_seen AS (SELECT g.symbol, g."start", g."end", g.day, {', '.join(f'''(SELECT arg_max({{'filed': v.filed, 'value': v.value, 'a': v.accession, 'o': CAST(v.filed AS VARCHAR) || v.accession, 'by': v.confirmed_by}}, CAST(v.filed AS VARCHAR) || v.vintage) FROM vint v WHERE v.symbol = g.symbol AND v."start" = {s} AND v."end" = {e} AND v.filed <= g.day) AS v{r}''' for r, (s, e) in _ROLES.items())} FROM g_days g),
signed AS (SELECT *, concat_ws('|', vc.value, coalesce(vpq.value::VARCHAR, '-'), coalesce(vpy.value::VARCHAR, '-'), coalesce(vpqy.value::VARCHAR, '-')) AS sig FROM g_seen),
lagged AS (SELECT *, lag(sig) OVER (PARTITION BY symbol, "start", "end" ORDER BY day) AS before FROM signed),
grown AS (SELECT *, CASE WHEN vpq.value > 0 THEN vc.value / vpq.value - 1 END AS qoq, CASE WHEN vpy.value > 0 THEN vc.value / vpy.value - 1 END AS yoy, CASE WHEN vpqy.value > 0 THEN vpq.value / vpqy.value - 1 END AS yoy_prev, greatest(vc.o, vpq.o, vpy.o, vpqy.o) AS o FROM lagged WHERE before IS NULL OR before <> sig)
SELECT symbol, "start", "end", day AS filed, substr(o, 11) AS accession, vc.value AS value, vpq.value AS prior_quarter_value, vpy.value AS prior_year_value, round(qoq, 8) AS qoq, round(yoy, 8) AS yoy, round(yoy_prev, 8) AS yoy_prev, CAST(left(o, 10) AS DATE) AS inputs_max_filed,
CASE WHEN vpy IS NOT NULL THEN list_contains(string_split(vpy.by, ';'), vc.a) END AS same_filing, round(yoy - yoy_prev, 8) AS yoy_accel FROM grown""")
def win30_growth_rows(spark, d):
    told = vintages.quarterly_vintages(_facts(spark, d)).withColumn("value", F.round("value", 2))
    return vintages.growth_rows(told).withColumns({c: F.round(c, 8) for c in ("qoq", "yoy", "yoy_prev", "yoy_accel")})
