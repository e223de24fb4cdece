"""Queries on files: each writes a given table in the format of a source, reads it by the operator, and equals SQL over the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.sources import files
from asofkit.sources import tables as src
from asofkit.sources.tables import daily_bars, table, with_sql

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


_BARS = ["symbol", "session", "open", "high", "low", "close", "volume"]


@query(with_sql("daily") + "SELECT symbol, session, close, CASE WHEN volume % 5 = 0 THEN 'bad price' END AS reason FROM daily WHERE session BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'")
def src1_daily_bar_csv(spark, d):
    path = files.work_folder(spark, "bars")
    bars = daily_bars(spark, d).withColumn("low", F.when(F.col("volume") % 5 == 0, -F.col("low")).otherwise(F.col("low")))
    files.write_csv(bars, path, _BARS)
    return files.daily_bar_csv(spark, path, "1994-01-01", "1996-12-31").select("symbol", "session", "close", "reason")


@query("""SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', date_trunc('second', ts))) AS DATE) AS session, CAST(hour(timezone('America/New_York', timezone('UTC', date_trunc('second', ts)))) * 60 + minute(timezone('America/New_York', timezone('UTC', date_trunc('second', ts)))) AS INTEGER) AS minute FROM events WHERE event_id % 10 > 0
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 10 = 0""")
def src2_minute_bar_gz(spark, d):
    path = files.work_folder(spark, "minutes")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 10 > 0, "Z").otherwise(""))
    table(spark, d, "events").select(F.col("event_type").alias("symbol"), text.alias("ts"), F.col("value").alias("open"), F.col("value").alias("close"), F.col("event_id").alias("volume")).write.csv(path, header=True, compression="gzip")
    return files.minute_bar_gz(spark, path).select(F.col("volume").alias("event_id"), "session", "minute")


@query("""SELECT upper(event_type) AS symbol, date_trunc('second', ts) AS ts, min(value) AS open FROM events WHERE value > 0 GROUP BY 1, 2""")
def src3_lake_candles(spark, d):
    root = files.work_folder(spark, "lake")
    e = table(spark, d, "events").select(F.upper("event_type").alias("symbol"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.col("event_id").alias("volume"))
    for r in e.select("symbol").distinct().collect():  # one file per symbol of the universe, as the lake has
        part = f"{root}/bars/{r['symbol']}"
        e.filter(F.col("symbol") == r["symbol"]).drop("symbol").write.csv(f"{part}/1s.csv.gz", header=True, compression="gzip")
    return files.lake_candles(spark, root, "1s").select("symbol", "ts", "open")


@query(with_sql("daily") + "SELECT symbol AS contract, session, lag(close) OVER w AS prior_settlement, lag(high) OVER w AS prior_rth_high, lag(low) OVER w AS prior_rth_low FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY session)")
def src4_overnight_csv(spark, d):
    path = files.work_folder(spark, "overnight")
    rows = daily_bars(spark, d).select("session", F.col("symbol").alias("contract"), F.col("close").alias("settlement"), F.col("high").alias("rth_high"), F.col("low").alias("rth_low"), F.lit(True).alias("complete"))
    files.write_csv(rows, path, rows.columns)
    return files.overnight_csv(spark, path).select("contract", "session", "prior_settlement", "prior_rth_high", "prior_rth_low")


@query(with_sql("tape") + """SELECT index_code, index_date, CAST(revision AS INTEGER) AS revision, CASE WHEN revision % 5 = 4 THEN 'no offset' WHEN methodology = 1 AND revision = 2 THEN 'published without value' END AS reason, CASE WHEN revision % 5 <> 4 THEN published_at END AS published_at FROM tape""")
def src5_index_tape_csv(spark, d):
    path = files.work_folder(spark, "tape")
    t = src.tape(spark, d)
    value = F.when(~((F.col("methodology") == 1) & (F.col("revision") == 2)), F.col("value"))
    at = F.concat(F.date_format(F.col("published_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("revision") % 5 == 4, "").otherwise("+00:00"))
    rows = t.select("index_code", "index_date", "revision", F.lit("published").alias("status"), value.alias("value"), at.alias("published_at"))
    files.write_csv(rows, path, rows.columns)
    return files.index_tape_csv(spark, path).select("index_code", "index_date", "revision", "reason", "published_at")


@query("""SELECT 'prices' AS input, coalesce(r, 'good') AS reason, count(*) AS n FROM (SELECT CASE WHEN p_size % 9 = 0 THEN 'missing value' WHEN count(*) OVER (PARTITION BY p_type, p_size) > 1 THEN 'repeated key' END AS r FROM part) GROUP BY 1, 2
UNION ALL SELECT 'facts', coalesce(r, 'good'), count(*) FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 THEN 'repeated key' END AS r FROM lineitem) GROUP BY 1, 2
UNION ALL SELECT 'closes', 'good', count(DISTINCT (o_orderpriority, CAST(o_orderdate AS DATE))) FROM orders""")
def src6_three_inputs(spark, d):
    part, line, bars = table(spark, d, "part"), table(spark, d, "lineitem"), daily_bars(spark, d)
    price = F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice"))
    inputs = {
        "prices": (part.select("p_type", "p_size", price.alias("price")), "p_type string, p_size int, price double", ["p_type", "p_size"], ["price"]),
        "facts": (line.select("l_orderkey", "l_suppkey", "l_extendedprice"), "l_orderkey bigint, l_suppkey bigint, l_extendedprice double", ["l_orderkey", "l_suppkey"], ["l_extendedprice"]),
        "closes": (bars.select("symbol", "session", "close"), "symbol string, session date, close double", ["symbol", "session"], ["close"]),
    }
    out = None
    for name, (df, schema, keys, required) in inputs.items():
        path = files.work_folder(spark, name)
        files.write_csv(df, path, df.columns)
        one = files.keyed_csv(spark, path, schema, keys, required).groupBy(F.lit(name).alias("input"), F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_sql("facts") + """SELECT symbol AS entity, 'Revenues' AS tag, "end", accession AS accn, value AS val FROM facts""")
def src7_company_facts(spark, d):
    """One document per company, as the filings service has them: its facts are few."""
    path = files.work_folder(spark, "companyfacts")
    fact = F.struct("start", "end", F.col("value").alias("val"), F.col("accession").alias("accn"), "form", "filed")
    docs = src.ytd_facts(spark, d).groupBy(F.col("symbol").alias("entity")).agg(F.collect_list(fact).alias("list"))
    nested = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), "list").alias("units"))))
    docs.select("entity", nested.alias("facts")).write.json(path)
    return files.company_facts(spark, path, "us-gaap", "USD").select("entity", "tag", "end", "accn", "val")


@query(with_sql("facts") + "SELECT symbol AS entity, accession, form, filed FROM facts")
def src8_filings_index(spark, d):
    path = files.work_folder(spark, "filings")
    f = src.ytd_facts(spark, d).groupBy(F.col("symbol").alias("entity"), F.year("filed").alias("page")).agg(F.sort_array(F.collect_list(F.struct("accession", "form", "filed"))).alias("r"))
    f.select("entity", "page", F.struct(*[F.col(f"r.{c}").alias(c) for c in ("accession", "form", "filed")]).alias("filings")).write.json(path)
    return files.filings_index(spark, path)


@query("""SELECT c_custkey AS doc, 'Revenues' AS tag, 'seg:' || c_mktsegment AS member, c_acctbal AS value, CASE WHEN c_custkey % 4 = 0 THEN 'conflicting values' END AS reason FROM customer WHERE c_custkey % 3 > 0""")
def src9_dimensional_facts(spark, d):
    """Instance documents with a context of one member, a context of two, a nil fact, a repeat and, in every fourth, a conflict."""
    c = table(spark, d, "customer").filter("c_custkey % 3 > 0")
    balance = F.col("c_acctbal").cast("string")
    fact = lambda context, value: F.concat(F.lit(f'<f tag="Revenues" contextRef="{context}" unitRef="USD">'), value, F.lit("</f>"))
    xml = F.concat(
        F.lit('<xbrl><context id="one"><explicitMember dimension="seg">seg:'), F.col("c_mktsegment"), F.lit('</explicitMember></context><context id="two"><explicitMember dimension="seg">a</explicitMember><explicitMember dimension="geo">b</explicitMember></context>'),
        fact("one", balance), fact("one", balance), fact("two", F.lit("7")), F.lit('<f tag="Revenues" contextRef="one" unitRef="USD" nil="true"></f><f tag="Revenues" contextRef="one" unitRef="shares">9</f>'),
        F.when(F.col("c_custkey") % 4 == 0, fact("one", (F.col("c_acctbal") + 1).cast("string"))).otherwise(""), F.lit("</xbrl>"),
    )
    return files.dimensional_facts(c.select(F.col("c_custkey").alias("doc"), xml.alias("xml")), "seg")


@query(with_sql("facts") + """SELECT accession, "end", CASE WHEN accession LIKE '%a' THEN CAST(filed AS TIMESTAMP) + INTERVAL 21 HOUR END AS accepted_at FROM facts""")
def src10_acceptance_times(spark, d):
    f = src.ytd_facts(spark, d)
    known = f.filter(F.col("accession").endswith("a")).select("accession", (F.col("filed").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOUR")).alias("accepted_at"))
    return files.with_acceptance(f, known).select("accession", "end", "accepted_at")


@query(with_sql("flow", "windows") + "SELECT 'record' AS kind, symbol, count(*) AS n, round(sum(premium), 2) AS total FROM flow GROUP BY 2 UNION ALL SELECT 'window', symbol, count(*), CAST(sum(event_count) AS DOUBLE) FROM obs GROUP BY 2")
def src11_feature_export(spark, d):
    path = files.work_folder(spark, "export")
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("payload"))
    record = src.flow_records(spark, d).select("symbol", "premium")
    window = src.observation_windows(spark, d).select("symbol", "event_count")
    line(record, "record").unionByName(line(window, "window")).write.json(path)
    r, w = files.feature_export(spark, path, "symbol string, premium double", "symbol string, event_count bigint")
    one = lambda df, kind, x: df.groupBy(F.lit(kind).alias("kind"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x).cast("double"), 2).alias("total"))
    return one(r, "record", "premium").unionByName(one(w, "window", "event_count"))


@query(with_sql("daily") + "SELECT symbol, session, round(close / open - 1, 6) AS open_close FROM daily")
def src12_feature_rows(spark, d):
    path = files.work_folder(spark, "features")
    rows = daily_bars(spark, d).select("symbol", "session", F.create_map(F.lit("open_close"), F.round(F.col("close") / F.col("open") - 1, 6)).alias("features"))
    rows.write.json(path)
    return files.feature_rows(spark, path, files.content_digest(rows)).select("symbol", "session", F.element_at("features", F.lit("open_close")).alias("open_close"))


_STAGE = "CASE WHEN year(session) < 1996 THEN 'discovery' WHEN year(session) < 1998 THEN 'validation' ELSE 'holdout' END"


def _staged(bars):
    return bars.withColumn("stage", F.when(F.year("session") < 1996, "discovery").when(F.year("session") < 1998, "validation").otherwise("holdout"))


@query(with_sql("daily") + f"SELECT {_STAGE} AS stage, symbol, session, close FROM daily WHERE {_STAGE} = 'validation'")
def src13_snk2_stage_store(spark, d):
    root = files.work_folder(spark, "stages")
    files.write_stages(_staged(daily_bars(spark, d)).select("stage", "symbol", "session", "close"), root)
    return files.stage_sessions(spark, root, "validation").select("stage", "symbol", "session", "close")


@query(with_sql("daily") + f"SELECT {_STAGE} AS stage, session AS day, symbol AS strike, CAST(k AS INTEGER) AS place, CASE k WHEN 0 THEN open WHEN 1 THEN high ELSE close END AS price FROM daily, range(3) t(k) WHERE {_STAGE} = 'holdout' AND NOT (k = 1 AND volume % 2 = 0)")
def src14_snk3_quote_store(spark, d):
    root = files.work_folder(spark, "quotes")
    prices = F.array("open", F.when(F.col("volume") % 2 != 0, F.col("high")), "close")
    quotes = _staged(daily_bars(spark, d)).groupBy("stage", F.col("session").alias("day")).agg(F.map_from_entries(F.collect_list(F.struct("symbol", prices.alias("p")))).alias("strikes"))
    files.write_stages(quotes, root)
    return files.stage_quotes(spark, root, "holdout")


@query("""SELECT run, trial, CASE WHEN trial % 10 = 0 THEN 'not JSON' WHEN trial % 10 = 1 THEN 'no run or trial' END AS reason, CAST(n AS BIGINT) AS n FROM (SELECT CASE WHEN o_orderkey % 10 > 1 THEN o_orderpriority END AS run, NULL AS t0, CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN 1 ELSE 2 END AS trial, count(*) AS n FROM orders GROUP BY 1, 3)""")
def src15_run_ledger(spark, d):
    path = files.work_folder(spark, "ledger")
    k = F.col("o_orderkey") % 10
    good = F.to_json(F.struct(F.col("o_orderpriority").alias("run"), F.lit(2).alias("trial"), F.col("o_totalprice").alias("score")))
    text = F.when(k == 0, F.concat(F.lit('{"run": "'), "o_orderpriority")).when(k == 1, F.lit('{"trial": 1}')).otherwise(good)
    table(spark, d, "orders").select(text.alias("value")).write.text(path)
    rows = files.run_ledger(spark, path)
    return rows.groupBy("run", F.when(F.col("reason") == "not JSON", 0).otherwise(F.col("trial")).alias("trial"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority[1:1] IN ('1', '2', '3')")
def src16_release_calendar(spark, d):
    path = files.work_folder(spark, "calendar")
    days = lambda k: F.collect_set(F.when(F.substring("o_orderpriority", 1, 1) == k, F.to_date("o_orderdate")))
    table(spark, d, "orders").agg(days("1").alias("cpi"), days("2").alias("jobs"), days("3").alias("rates")).write.json(path)  # lists of days of a calendar
    return files.release_calendar(spark, path)


@query(with_sql("daily") + "SELECT count(*) AS rows, min(session) AS first, max(session) AS last, count(*) AS verified FROM daily")
def snk1_table_with_manifest(spark, d):
    path = files.work_folder(spark, "table")
    manifest = files.write_with_manifest(daily_bars(spark, d), path, "session").drop("digest")
    return manifest.withColumn("verified", F.lit(files.verify(spark, path).count()))


@query(with_sql("facts") + """SELECT symbol, min("end") AS "first", array_to_string(list_sort(list(accession)), ';') AS accessions FROM facts GROUP BY 1""")
def snk4_csv_export(spark, d):
    path = files.work_folder(spark, "export")
    f = src.ytd_facts(spark, d).groupBy("symbol").agg(F.min("end").alias("first"), F.sort_array(F.collect_list("accession")).alias("accessions"))
    files.write_csv(f, path, ["symbol", "first", "accessions"], lists=("accessions",))
    return spark.read.schema("symbol string, first date, accessions string").csv(path, header=True)


@query(with_sql("daily") + "SELECT symbol, count(*) AS n, max(session) AS last FROM daily GROUP BY 1")
def snk5_str1_resumed_append(spark, d):
    """Three appends whose inputs overlap: nothing is lost and nothing comes twice."""
    path = files.work_folder(spark, "store")
    bars = daily_bars(spark, d)
    for upto in ("1994-06-30", "1996-12-31", "2100-01-01"):
        files.append_new(bars.filter(F.col("session") <= F.to_date(F.lit(upto))), path, ["symbol"], "session")
    return spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("session").alias("last"))
