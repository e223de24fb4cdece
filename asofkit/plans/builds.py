"""Queries on snapshots that a user starts from: the store of filed facts, the daily universe, sessions at a fixed minute, and adjusted prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import fundamentals, intraday, overnight_build, prices, tape, universe, vintages
from asofkit.plans import campaigns, market
from asofkit.plans.campaigns import _FACTS, _PRIOR, _facts
from asofkit.plans.market import RET, WS
from asofkit.sources import files
from asofkit.sources.tables import daily_bars, intraday_bars, table, with_sql

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


# --- filed facts -----------------------------------------------------------------------------------------------------

SINCE = "1993-01-01"
_YEARS = """y_daily AS (SELECT symbol, "start", "end", filed, arg_max({'v': value, 'f': form, 'a': accession}, CASE WHEN form LIKE '%/A' THEN '1' ELSE '0' END || accession) AS r FROM kept WHERE "end" - "start" + 1 BETWEEN 350 AND 380 GROUP BY 1, 2, 3, 4),
y_marked AS (SELECT *, lag(r.v) OVER (PARTITION BY symbol, "start", "end" ORDER BY filed) AS before FROM y_daily),
y_numbered AS (SELECT *, sum(CASE WHEN before = r.v THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, "start", "end" ORDER BY filed) - 1 AS vintage FROM y_marked),
y_vint AS (SELECT symbol, "start", "end", CAST(vintage AS INTEGER) AS vintage, min(filed) AS filed, round(arg_min(r.v, filed), 2) AS value, arg_min(r.f, filed) AS form, arg_min(r.a, filed) AS accession, year("start" + 360) AS fiscal_year, string_agg(r.a, ';' ORDER BY filed) AS confirmed_by
  FROM y_numbered GROUP BY symbol, "start", "end", vintage)"""


@query(_FACTS + ", " + _YEARS + " SELECT * FROM y_vint")
def win29_annual_vintages(spark, d):
    joined = F.array_join("confirmed_by", ";")
    return vintages.annual_vintages(_facts(spark, d)).withColumns({"confirmed_by": joined, "value": F.round("value", 2)})


def _since(sql: str) -> str:
    """The SQL over the facts that the store keeps."""
    return sql.replace("FROM facts WHERE", f"""FROM (SELECT * FROM facts WHERE "end" >= DATE '{SINCE}') AS facts WHERE""")


def _store(spark, d, days: tuple[str, ...]) -> str:
    """The store after one append for each stretch between the days of ``days``.

    Sales are filed under either of two tags; each filing also gives a third tag, with another value, which the series only takes where the first two are missing.
    """
    facts = _facts(spark, d)
    tag = F.when(F.month("filed") % 2 == 0, "Revenues").otherwise("SalesRevenueNet")
    filed = facts.withColumn("tag", tag).unionByName(facts.withColumns({"tag": F.lit("OtherIncome"), "value": F.col("value") * 3}))
    tags = F.array(F.lit("Revenues"), F.lit("SalesRevenueNet"), F.lit("OtherIncome"))
    series = facts.select("symbol").distinct().select("symbol", tags.alias("tags"), F.lit(True).alias("quarterly"), F.lit(True).alias("annual"))
    path = files.work_folder(spark, "fundamentals")
    for k, (a, z) in enumerate(zip(("0001-01-01", *days), (*days, "9999-12-31"))):
        part = filed.filter((F.col("filed") >= F.to_date(F.lit(a))) & (F.col("filed") < F.to_date(F.lit(z))))
        fundamentals.append_filings(part, series, path, f"b{k}", since=SINCE, buckets=8)
    return path


_YEAR_ROLES = {"c": ('g."start"', 'g."end"'), "py": ("g.py.s", "g.py.e"), "pqy": ("g.pqy.s", "g.pqy.e")}
_YEAR_GROWTH = (
    f"""WITH y_all AS ({ORACLES['win29_annual_vintages']}), g_periods AS (SELECT symbol, "start", "end", min(filed) AS first FROM y_all GROUP BY 1, 2, 3), g_py AS ({_PRIOR.format(350, 380)}),
links AS (SELECT a.*, y.p AS py, z.p AS pqy FROM g_periods a LEFT JOIN g_py y ON a.symbol = y.symbol AND a."start" = y."start" AND a."end" = y."end" LEFT JOIN g_py z ON a.symbol = z.symbol AND y.p.s = z."start" AND y.p.e = z."end"),
g_days AS (SELECT DISTINCT g.*, v.filed AS day FROM links g JOIN y_all v ON g.symbol = v.symbol AND v.filed >= g.first AND ({' OR '.join(f'(v."start" = {s} AND v."end" = {e})' for s, e in _YEAR_ROLES.values())})),
g_seen AS (SELECT g.symbol, g."start", g."end", g.day, {', '.join(f'''(SELECT arg_max({{'filed': v.filed, 'value': v.value, 'a': v.accession, 'o': CAST(v.filed AS VARCHAR) || v.accession, 'by': v.confirmed_by}}, CAST(v.filed AS VARCHAR) || v.vintage) FROM y_all v WHERE v.symbol = g.symbol AND v."start" = {s} AND v."end" = {e} AND v.filed <= g.day) AS v{r}''' for r, (s, e) in _YEAR_ROLES.items())} FROM g_days g),
signed AS (SELECT *, concat_ws('|', vc.value, coalesce(vpy.value::VARCHAR, '-'), coalesce(vpqy.value::VARCHAR, '-')) AS sig FROM g_seen), lagged AS (SELECT *, lag(sig) OVER (PARTITION BY symbol, "start", "end" ORDER BY day) AS before FROM signed),
grown AS (SELECT *, CASE WHEN vpy.value > 0 THEN vc.value / vpy.value - 1 END AS yoy, CASE WHEN vpqy.value > 0 THEN vpy.value / vpqy.value - 1 END AS yoy_prev, greatest(vc.o, vpy.o, vpqy.o) AS o FROM lagged WHERE before IS NULL OR before <> sig)
SELECT 'FY' AS period_type, symbol, "start", "end", day AS filed, substr(o, 11) AS accession, vc.value AS value, CAST(NULL AS DOUBLE) AS prior_quarter_value, vpy.value AS prior_year_value, CAST(NULL AS DOUBLE) AS qoq, round(yoy, 8) AS yoy, round(yoy_prev, 8) AS yoy_prev,
CAST(left(o, 10) AS DATE) AS inputs_max_filed, CASE WHEN vpy IS NOT NULL THEN list_contains(string_split(vpy.by, ';'), vc.a) END AS same_filing, round(yoy - yoy_prev, 8) AS yoy_accel FROM grown"""
)


@query(_since(f"SELECT 'Q' AS period_type, * FROM ({campaigns.ORACLES['win30_growth_rows']}) UNION ALL BY NAME SELECT * FROM ({_YEAR_GROWTH})"))
def ev15_fundamentals_by_appends(spark, d):
    """Growth of quarters and years out of a store that got its filings in three appends."""
    path = _store(spark, d, ("1995-01-01", "1997-01-01"))
    return fundamentals.stored(spark, path, "growth").withColumns({c: F.round(c, 8) for c in ("qoq", "yoy", "yoy_prev", "yoy_accel")})


@query(_since(f"""WITH cov_v AS (SELECT 'Q' AS period_type, symbol, "start", "end", flag <> '' AS flagged, method FROM ({campaigns.ORACLES['win29_quarterly_vintages']}) UNION ALL SELECT 'FY', symbol, "start", "end", false, 'annual' FROM ({ORACLES['win29_annual_vintages']})),
cov_p AS (SELECT symbol, period_type, "start", "end", count(*) AS n FROM cov_v GROUP BY ALL)
SELECT symbol, period_type, periods, "first", "last", vintages, restated, flagged, methods FROM (SELECT symbol, period_type, count(*) AS periods, min("end") AS "first", max("end") AS "last", sum(n)::BIGINT AS vintages, count(*) FILTER (n > 1) AS restated FROM cov_p GROUP BY 1, 2)
JOIN (SELECT symbol, period_type, count(*) FILTER (flagged) AS flagged, array_to_string(list_sort(list_distinct(list(method))), ';') AS methods FROM cov_v GROUP BY 1, 2) USING (symbol, period_type)"""))
def ev15_agg22_coverage(spark, d):
    """What a store built at once holds of each company, with flagged vintages and methods."""
    path = _store(spark, d, ())
    return fundamentals.coverage(fundamentals.stored(spark, path, "vintages")).withColumn("methods", F.array_join("methods", ";"))


# --- the daily universe ----------------------------------------------------------------------------------------------

BENCHMARK = "1-URGENT"
#: The features in SQL, over windows named by their length.
_OWN = {
    **{f"ret_{k}d": f"close / lag(close, {k}) OVER w - 1" for k in (1, 5, 10, 20, 60)}, "gap_open": "open / lag(close) OVER w - 1", "oc_ret": "close / open - 1",
    "range_pos": "coalesce((close - low) / nullif(high - low, 0), 0.5)", "k_body": "coalesce((close - open) / nullif(high - low, 0), 0)",
    "k_upper": "coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)", "k_lower": "coalesce((least(open, close) - low) / nullif(high - low, 0), 0)",
    **{f"rv_{n}d": f"stddev_samp(ret) OVER f{n}" for n in (5, 20, 60)}, "rv_ratio_5_20": "coalesce(stddev_samp(ret) OVER f5 / nullif(stddev_samp(ret) OVER f20, 0), 1)",
    **{f"dist_ma_{n}": f"close / avg(close) OVER f{n} - 1" for n in (5, 20, 60)}, "ma_5_20_spread": "avg(close) OVER f5 / avg(close) OVER f20 - 1",
    "dist_high_20": "close / max(close) OVER f20 - 1", "dist_low_20": "close / min(close) OVER f20 - 1", "rsv_20": "coalesce((close - min(low) OVER f20) / nullif(max(high) OVER f20 - min(low) OVER f20, 0), 0.5)",
    "high_recency_20": "(list_position(list(high) OVER f20, max(high) OVER f20) - 1) / 19.0", "low_recency_20": "(list_position(list(low) OVER f20, min(low) OVER f20) - 1) / 19.0",
    **{f"trend_slope_{n}": f"regr_slope(close, rn) OVER f{n} / avg(close) OVER f{n}" for n in (20, 60)}, **{f"trend_r2_{n}": f"regr_r2(close, rn) OVER f{n}" for n in (20, 60)},
    "bb_pctb": "coalesce((close - avg(close) OVER f20 + 2 * stddev_pop(close) OVER f20) / nullif(4 * stddev_pop(close) OVER f20, 0), 0.5)", "bb_bandwidth": "4 * stddev_pop(close) OVER f20 / avg(close) OVER f20",
    "up_frac_20": "avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER f20", "gain_share_20": "coalesce(sum(greatest(ret, 0)) OVER f20 / nullif(sum(abs(ret)) OVER f20, 0), 0.5)",
    "vol_ratio_5_20": "avg(volume) OVER f5 / avg(volume) OVER f20", "vol_cv_20": "stddev_samp(volume) OVER f20 / avg(volume) OVER f20",
    "corr_ret_vol_20": "coalesce(covar_pop(ret, volume) OVER f19 / nullif(stddev_pop(ret) OVER f19 * stddev_pop(volume) OVER f19, 0), 0)", "day_of_week": "isodow(session) - 1.0",
    "next_open_to_close": "lead(close) OVER w / lead(open) OVER w - 1", "next_close_to_close": "lead(close) OVER w / close - 1",
}
_FRAMES = ", ".join([f"w AS ({WS})", *[f"f{n} AS ({WS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 19, 20, 60)]])
_SNAPSHOT = (
    with_sql("daily") + f""", {RET}, ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 480000),
u_own AS (SELECT symbol, session, rn, lead(session) OVER w AS next_session, {', '.join(f'round({e}, 6) AS {c}' for c, e in _OWN.items())} FROM r WINDOW {_FRAMES}),
u_rows AS (SELECT o.* EXCLUDE (rn, next_session), s.streak::DOUBLE AS streak, coalesce(k.skew_20, 0) AS ret_skew_20, CASE WHEN session IN (SELECT day FROM ev) THEN 1.0 ELSE 0.0 END AS event_today, CASE WHEN next_session IN (SELECT day FROM ev) THEN 1.0 ELSE 0.0 END AS event_next_session
  FROM u_own AS o JOIN ({market.ORACLES['win11_signed_streak']}) AS s USING (symbol, session) JOIN ({market.ORACLES['win9_skewness']}) AS k USING (symbol, session) WHERE rn > 61 AND next_session IS NOT NULL)
"""
)
_XS = ", ".join(f"CASE WHEN count(*) OVER s < 2 THEN 0.5 ELSE round((row_number() OVER (PARTITION BY session ORDER BY {c}, symbol) - 1.0) / (count(*) OVER s - 1), 6) END AS xs_rank_{c}" for c in universe.RANKED)


def _event_days(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 480000").select(F.to_date("o_orderdate").alias("day"))


@query(_SNAPSHOT + f"SELECT *, {_XS}, {', '.join(f'round({c} - max(CASE WHEN symbol = {BENCHMARK!r} THEN {c} END) OVER s, 6) AS {c}_rel' for c in universe.PAYOFFS)} FROM u_rows WINDOW s AS (PARTITION BY session)")
def ev17_universe_snapshot(spark, d):
    """All columns of the snapshot but the recursions, which SQL cannot express and ``ev17_universe_recursions`` gives. Features are rounded before they are ranked."""
    x = universe.daily_snapshot(daily_bars(spark, d), _event_days(spark, d), benchmark=BENCHMARK, decimals=6)
    return x.drop(*universe.RECURSIVE)


def ev17_universe_recursions(spark, d):
    x = universe.daily_snapshot(daily_bars(spark, d), _event_days(spark, d), benchmark=BENCHMARK)
    return x.select("session", "symbol", *universe.RECURSIVE)


QUERIES["ev17_universe_recursions"] = ev17_universe_recursions


@query(_SNAPSHOT + f""", u_days AS (SELECT session, row_number() OVER (ORDER BY session) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM u_rows)),
u_cut AS (SELECT *, CASE WHEN i <= floor(n * 0.6) THEN 'discovery' WHEN i <= floor(n * 0.8) THEN 'validation' ELSE 'holdout' END AS stage FROM u_days)
SELECT stage, min(session) AS stage_first, max(session) AS stage_last, count(*) AS sessions, t.* FROM u_cut, (SELECT count(*) AS rows, min(session) AS first, max(session) AS last, count(*) FILTER (symbol = '{BENCHMARK}') AS benchmark_sessions FROM u_rows) AS t GROUP BY ALL""")
def ev17_prepared_universe(spark, d):
    """The written snapshot: its manifest next to each suggested stage, after a check of the content against the digest."""
    path = files.work_folder(spark, "universe")
    bars = daily_bars(spark, d)
    about = universe.prepare_universe(bars, _event_days(spark, d), path, [r["symbol"] for r in bars.select("symbol").distinct().collect()], benchmark=BENCHMARK)  # five order priorities
    files.verify(spark, path)
    splits = spark.read.parquet(f"{path}/splits").withColumnsRenamed({"first": "stage_first", "last": "stage_last"})
    return splits.join(about.select("rows", "first", "last", "benchmark_sessions"), how="inner", on=F.lit(True))  # one row


# --- sessions at a fixed minute --------------------------------------------------------------------------------------

_CLOCK = {"session_open": 0, "opening_end": 480, "first_end": 480, "session_close": 1440, "step": 240}
_LONG = with_sql("hourly").replace("CAST(hour(ts) * 60 AS INTEGER)", "CAST(hour(ts) // 4 * 240 AS INTEGER)")


@query(_LONG + f""", i_s AS (SELECT symbol, session, min(minute) AS a, max(minute) AS z, arg_min(open, minute) AS open, arg_max(close, minute) AS close, max(open) FILTER (minute = 720) AS price, max(high) FILTER (minute < 480) AS hi, min(low) FILTER (minute < 480) AS lo,
  arg_max(close, minute) FILTER (minute < 480) AS oc, sum(close * volume) FILTER (minute < 720) / sum(volume) FILTER (minute < 720) AS vwap, coalesce(sum(volume) FILTER (minute < 480), 0) AS fv FROM hourly GROUP BY 1, 2),
i_n AS (SELECT *, row_number() OVER ({WS}) AS no, close / lag(close) OVER ({WS}) - 1 AS ret FROM i_s),
i_x AS (SELECT session, symbol, no, a, z, price, lead(close) OVER w AS after, isodow(session) - 1.0 AS day_of_week, price / open - 1 AS session_ret_so_far, price / vwap - 1 AS vwap_dist, oc / open - 1 AS or_ret,
  CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (price - lo) / (hi - lo))) ELSE 0.5 END AS or_break, lag(close) OVER w / lag(close, 2) OVER w - 1 AS prior_ret_1d, lag(close) OVER w / lag(close, 6) OVER w - 1 AS prior_ret_5d, open / lag(close) OVER w - 1 AS gap_open,
  stddev_samp(ret) OVER ({WS} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rv_5d, coalesce(fv / nullif(avg(fv) OVER ({WS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 1) AS vol_ratio_open, close / price - 1 AS next_open_to_close, lead(close) OVER w / close - 1 AS next_close_to_close FROM i_n WINDOW w AS ({WS}))
SELECT session, symbol, {', '.join(f'round({c}, 6) AS {c}' for c in ('day_of_week', 'session_ret_so_far', 'vwap_dist', 'or_ret', 'or_break', 'prior_ret_1d', 'prior_ret_5d', 'gap_open', 'rv_5d', 'vol_ratio_open', 'next_open_to_close', 'next_close_to_close'))} FROM i_x WHERE no > 20 AND a = 0 AND z = 1200 AND price > 0 AND after > 0""")
def ev18_intraday_snapshot(spark, d):
    """Bars of four hours, those of even days twice; the decision is at noon."""
    bars = intraday_bars(spark, d, 240)
    return intraday.intraday_snapshot(bars.unionByName(bars.filter("day(session) % 2 = 0")), 720, decimals=6, **_CLOCK)


# --- adjusted prices -------------------------------------------------------------------------------------------------

_ADJUSTED = with_sql("daily") + """, p_rows AS (SELECT symbol, session, open, high, low, close, CASE WHEN day(session) % 11 = 0 THEN 0 ELSE volume END AS volume, CASE WHEN day(session) % 11 = 0 THEN 0 ELSE volume END AS trade_count, (open + close) / 2 AS vwap,
  CASE WHEN day(session) % 13 <> 0 THEN close * CASE WHEN year(session) < 1998 THEN 2 ELSE 1 END END AS raw_close FROM daily)
"""


def _prices(spark, d):
    bars = daily_bars(spark, d)
    volume = F.when(F.dayofmonth("session") % 11 == 0, 0).otherwise(F.col("volume"))
    adjusted = bars.withColumns({"vwap": (F.col("open") + F.col("close")) / 2, "volume": volume, "trade_count": volume})
    raw = bars.filter("day(session) % 13 <> 0").withColumn("close", F.col("close") * F.when(F.year("session") < 1998, 2).otherwise(1))
    return prices.adjusted_prices(adjusted, raw)


@query(_ADJUSTED + "SELECT symbol, session, open, high, low, close, volume, round(vwap, 4) AS vwap, trade_count, raw_close, round(raw_close / close, 6) AS adj_factor FROM p_rows WHERE volume > 0")
def ev16_adjusted_prices(spark, d):
    """Prices split two to one in 1998 whose raw close is missing on some days, without placeholders."""
    return _prices(spark, d).filter("not untraded").drop("untraded").withColumns({"vwap": F.round("vwap", 4), "adj_factor": F.round("adj_factor", 6)})


@query(_ADJUSTED + """, p_x AS (SELECT *, raw_close / close AS f, lag(close) OVER w AS pc, lag(raw_close) OVER w AS pr, lag(raw_close / close) OVER w AS pf FROM p_rows WHERE volume > 0 WINDOW w AS (PARTITION BY symbol ORDER BY session)),
p_cal AS (SELECT day FROM (SELECT CAST(unnest(generate_series(CAST(min(session) AS TIMESTAMP), CAST(max(session) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM daily) WHERE isodow(day) < 6),
p_s AS (SELECT symbol, count(*) AS sessions, min(session) AS first_session, max(session) AS last_session, count(*) FILTER (raw_close IS NULL) AS rows_without_raw_close, coalesce(string_agg(CAST(session AS VARCHAR), ';' ORDER BY session) FILTER (isodow(session) > 5), '') AS bars_on_non_sessions,
  coalesce(string_agg(CAST(session AS VARCHAR), ';' ORDER BY session) FILTER (abs(ln(close / pc)) > ln(1.4)), '') AS outliers, coalesce(string_agg(CAST(session AS VARCHAR), ';' ORDER BY session) FILTER (abs(f / pf - 1) > 0.02), '') AS factor_steps FROM p_x GROUP BY 1),
p_m AS (SELECT s.symbol, string_agg(CAST(day AS VARCHAR), ';' ORDER BY day) AS missing_sessions FROM p_s AS s JOIN p_cal ON day BETWEEN s.first_session AND s.last_session ANTI JOIN p_x AS x ON x.symbol = s.symbol AND x.session = day GROUP BY 1),
p_u AS (SELECT symbol, count(*) AS untraded, min(session) AS untraded_first, max(session) AS untraded_last FROM p_rows WHERE volume = 0 GROUP BY 1)
SELECT s.*, coalesce(missing_sessions, '') AS missing_sessions, coalesce(untraded, 0) AS untraded, untraded_first, untraded_last FROM p_s AS s LEFT JOIN p_m USING (symbol) LEFT JOIN p_u USING (symbol)""")
def ev16_price_audit(spark, d):
    """The audit of each symbol with its lists of days as text; weekdays are sessions."""
    calendar = tape.weekday_calendar(table(spark, d, "orders"), F.to_date("o_orderdate"), 7, 14)
    days = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)
    named = lambda c: F.array_join(F.transform(c, lambda x: x["session"].cast("string")), ";").alias(c)
    return prices.price_audit(_prices(spark, d), calendar).select(
        "symbol", "sessions", "first_session", "last_session", "rows_without_raw_close", days("bars_on_non_sessions"), named("outliers"), named("factor_steps"), days("missing_sessions"), "untraded", "untraded_first", "untraded_last",
    )


# --- stitched overnight sessions -------------------------------------------------------------------------------------

_STITCHED = _LONG + """, o_in AS (SELECT symbol AS contract, (minute - 1080 + 1440) % 1440 AS minute, CASE WHEN minute >= 1080 THEN session + 1 ELSE session END AS session, open, high, low, close, volume FROM hourly WHERE minute <> 960 AND isodow(session) < 6 AND NOT (isodow(session) = 5 AND minute >= 1080)),
o_v AS (SELECT *, sum(volume) OVER (PARTITION BY session, contract) AS traded FROM o_in WHERE minute <= 1080), o_f AS (SELECT *, first_value(contract) OVER (PARTITION BY session ORDER BY traded DESC, contract) AS front FROM o_v),
o_j AS (SELECT session, minute, open, high, low, close, volume, contract, CASE WHEN min(minute) OVER (PARTITION BY session) > 120 THEN 'evening missing' WHEN max(minute) OVER (PARTITION BY session) < 1080 THEN 'no settlement bar' END AS reason FROM o_f WHERE contract = front)
"""


def _overnight(spark, d):
    """Bars of four hours, one contract a type of event; the weekend has no bars, so Mondays miss their evening. The settlement is at noon."""
    bars = intraday_bars(spark, d, 240).filter("weekday(session) < 5 and not (weekday(session) = 4 and minute >= 1080)")
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("session").cast("timestamp")) + F.col("minute") * 60)
    told = overnight_build.session_minutes(bars.withColumnRenamed("symbol", "contract").withColumn("ts", ts).drop("session", "minute"), "UTC")
    return overnight_build.judged_bars(told.unionByName(told.filter("minute = 120")), latest_first=120, settlement=1080)


@query(_STITCHED + "SELECT * EXCLUDE (reason) FROM o_j WHERE reason IS NULL")
def ev19_stitched_bars(spark, d):
    return _overnight(spark, d).filter("reason is null").drop("reason")


@query(_STITCHED + "SELECT session, contract, reason, count(*) AS bars FROM o_j GROUP BY ALL")
def ev19_session_verdicts(spark, d):
    return overnight_build.session_verdicts(_overnight(spark, d))
