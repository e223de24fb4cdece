"""Domain tables derived from the provided business tables, so that every operator has real input.

Each function takes (spark, sf_dir). Ties are broken by primary keys, so the tables are the same at every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, session, open, high, low, close, volume: one bar per order priority and order date."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("session")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume"),
    )


def intraday_bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """symbol, session, minute, open, high, low, close, volume of ``minutes``-long bars of the events."""
    events = table(spark, sf_dir, "events")
    minute = (F.floor((F.hour("ts") * 60 + F.minute("ts")) / minutes) * minutes).cast("int")
    first = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("session"), minute.alias("minute")).agg(
        F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", first).alias("close"), F.count(F.lit(1)).alias("volume"),
    )


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitemporal index tape: index_code, index_date, revision, value, methodology, published_at, superseded_at."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("index_code"), F.to_date("o_orderdate").alias("index_date"), "o_orderkey", F.col("o_totalprice").alias("value"))
    key = W.partitionBy("index_code", "index_date").orderBy("o_orderkey")
    rows = orders.withColumn("revision", F.row_number().over(key))
    rows = rows.withColumn("published_at", F.timestamp_seconds(F.unix_timestamp(F.col("index_date").cast("timestamp")) + 21 * 3600 + F.col("revision") * 3600))
    rows = rows.withColumn("superseded_at", F.lead("published_at").over(key)).withColumn("methodology", F.year("index_date") % 2)
    return rows.drop("o_orderkey")


def ytd_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed year-to-date facts per nation and quarter, with restatements: symbol, start, end, value, form, accession, filed."""
    line, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    day = F.to_date("l_shipdate")
    sold = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    quarters = sold.groupBy("n_nationkey", "n_name", F.year(day).alias("y"), F.quarter(day).alias("q")).agg(F.sum("l_extendedprice").alias("v"))
    ytd = quarters.withColumn("value", F.round(F.sum("v").over(W.partitionBy("n_nationkey", "y").orderBy("q")), 2))
    start = F.make_date("y", F.lit(1), F.lit(1))
    end = F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1)))
    base = ytd.select(
        F.col("n_name").alias("symbol"), "n_nationkey", "y", "q", start.alias("start"), end.alias("end"), "value",
        F.when(F.col("q") == 4, "10-K").otherwise("10-Q").alias("form"), F.date_add(end, F.lit(30) + F.col("n_nationkey").cast("int") % 15).alias("filed"),
        F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("y").cast("string"), F.col("q").cast("string"), F.lit("a")).alias("accession"),
    )
    again = base.filter("n_nationkey % 3 = 0").withColumns({
        "value": F.round(F.col("value") * 1.01, 2), "filed": F.add_months("filed", 12), "form": F.concat("form", F.lit("/A")), "accession": F.concat(F.expr("substring(accession, 1, length(accession) - 1)"), F.lit("b")),
    })
    return base.unionByName(again).drop("n_nationkey", "y", "q")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gross trade ledger, one row per line item: trade_id, date, width, debit, settlement, priced, selected."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("width"),
        (F.col("l_quantity") * F.col("l_discount") * 5).alias("debit"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0).alias("settlement"),
        (F.col("l_linestatus") == "F").alias("priced"), (F.col("l_tax") <= 0.04).alias("selected"), F.col("l_returnflag").alias("structure"),
    )


def flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor option prints with four clocks."""
    e = table(spark, sf_dir, "events")
    available = F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("event_id") % 7) * 60)
    ingested = F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("event_id") % 7) * 60 + (F.col("event_id") % 3) * 60)
    return e.select(
        "event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("event_time"), available.alias("available_at"), ingested.alias("ingested_at"),
        F.col("value").alias("premium"), F.when(F.col("event_id") % 2 == 0, "C").otherwise("P").alias("option_type"),
        F.element_at(F.array(F.lit("buy"), F.lit("sell"), F.lit("neutral")), (F.col("event_id") % 3 + 1).cast("int")).alias("side"),
        F.get_json_object("props", "$.k").cast("int").alias("dte"), (F.col("event_id") % 5 == 0).alias("is_sweep"), (F.col("event_id") % 11 == 0).alias("is_block"),
    )


def observation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, observed_at, event_count per hour; hours whose number divides by five were not observed."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
    grid = e.select("symbol", "day").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    counts = e.groupBy("symbol", "day", "hour").agg(F.count(F.lit(1)).alias("n"))
    seen = grid.join(counts, ["symbol", "day", "hour"], "left").filter("hour % 5 <> 0")
    end = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + (F.col("hour") + 1) * 3600)
    return seen.select("symbol", "day", end.alias("observed_at"), F.coalesce("n", F.lit(0)).alias("event_count"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, decision: two decisions a day at 10:00 and 14:00."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).distinct()
    at = e.withColumn("hour", F.explode(F.array(F.lit(10), F.lit(14))))
    return at.select("symbol", "day", F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("hour") * 3600).alias("decision"))


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, session, minute, open, high, low, close, volume: bars of an hour from 9:30, over years of sessions."""
    line = table(spark, sf_dir, "lineitem")
    price, first = F.col("l_extendedprice") / 250 + 50, F.struct("l_orderkey", "l_linenumber")
    minute = ((F.col("l_orderkey") + F.col("l_linenumber")) % 7 * 60 + 570).cast("int")
    return line.groupBy(F.col("l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("session"), minute.alias("minute")).agg(
        F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, first).alias("close"), F.count(F.lit(1)).alias("volume"),
    )


def option_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, session, cp, strike, minute, price, bid, ask around the open of every bar; some strikes are missing, some quotes are old, some crossed."""
    bars = session_bars(spark, sf_dir).select("symbol", "session", F.col("minute").alias("bar"), "open", "volume", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("k"))
    v, k = F.col("volume") + F.dayofmonth("session"), F.col("k")
    x = bars.filter((v * 3 + k + 3) % 19 != 0).withColumn("strike", F.rint(F.col("open") / 5) * 5 + k * 5).withColumn("cp", F.explode(F.array(F.lit("C"), F.lit("P"))))
    inside = F.when(F.col("cp") == "C", F.col("open") - F.col("strike")).otherwise(F.col("strike") - F.col("open"))
    x = x.withColumn("price", F.round(F.greatest(inside, F.lit(0.0)) + 1.5 + (v * 7 + k * 3 + 9) % 5 * 0.7, 2))
    x = x.withColumn("minute", (F.col("bar") - F.when((v + k + 3) % 23 == 5, 20).otherwise((v + k + 3) % 4 * 5)).cast("int"))
    crossed = (v + 2 * k + 6) % 29 == 7
    side = lambda low: F.round(F.greatest(F.col("price") + F.when(crossed == F.lit(low), 0.3).otherwise(-0.3), F.lit(0.0)), 2)
    return x.select("symbol", "session", "cp", "strike", "minute", "price", side(True).alias("bid"), side(False).alias("ask"))


#: The same tables in SQL, as common table expressions.
SQL = {
    "daily": """daily AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS session, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
        min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2)""",
    "hourly": """hourly AS (SELECT symbol, session, minute, max(CASE WHEN a = 1 THEN value END) AS open, max(value) AS high, min(value) AS low, max(CASE WHEN z = 1 THEN value END) AS close, count(*) AS volume
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session, minute ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY symbol, session, minute ORDER BY ts DESC, event_id DESC) AS z
              FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS session, CAST(hour(ts) * 60 AS INTEGER) AS minute, ts, event_id, value FROM events)) GROUP BY 1, 2, 3)""",
    "tape": """tape AS (SELECT index_code, index_date, value, revision, published_at, lead(published_at) OVER (PARTITION BY index_code, index_date ORDER BY revision) AS superseded_at, year(index_date) % 2 AS methodology
        FROM (SELECT *, CAST(index_date AS TIMESTAMP) + to_hours(21) + to_hours(CAST(revision AS INTEGER)) AS published_at FROM
             (SELECT o_orderpriority AS index_code, CAST(o_orderdate AS DATE) AS index_date, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS revision FROM orders)))""",
    "facts": """fbase AS (SELECT n_name AS symbol, k, y, q, make_date(y, 1, 1) AS "start", last_day(make_date(y, q * 3, 1)) AS "end", round(sum(v) OVER (PARTITION BY k, y ORDER BY q), 2) AS value FROM
          (SELECT n_nationkey AS k, n_name, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(quarter(l_shipdate) AS INTEGER) AS q, sum(l_extendedprice) AS v
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)),
        ffirst AS (SELECT symbol, k, "start", "end", value, CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form, "end" + 30 + CAST(k % 15 AS INTEGER) AS filed, k || '-' || y || '-' || q || '-a' AS accession FROM fbase),
        facts AS (SELECT symbol, "start", "end", value, form, filed, accession FROM ffirst UNION ALL
          SELECT symbol, "start", "end", round(value * 1.01, 2), form || '/A', CAST(filed + INTERVAL 12 MONTH AS DATE), left(accession, length(accession) - 1) || 'b' FROM ffirst WHERE k % 3 = 0)""",
    "trades": """trades AS (SELECT l_orderkey * 10 + l_linenumber AS trade_id, CAST(l_shipdate AS DATE) AS date, l_quantity AS width, l_quantity * l_discount * 5 AS debit, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END AS settlement,
        l_linestatus = 'F' AS priced, l_tax <= 0.04 AS selected, l_returnflag AS structure FROM lineitem)""",
    "flow": """flow AS (SELECT event_id, event_type AS symbol, ts AS event_time, date_trunc('second', ts) + to_minutes(CAST(event_id % 7 AS INTEGER)) AS available_at, date_trunc('second', ts) + to_minutes(CAST(event_id % 7 + event_id % 3 AS INTEGER)) AS ingested_at,
        value AS premium, CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'P' END AS option_type, CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'neutral' END AS side,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS dte, event_id % 5 = 0 AS is_sweep, event_id % 11 = 0 AS is_block FROM events)""",
    "windows": """obs AS (SELECT g.symbol, g.day, CAST(g.day AS TIMESTAMP) + to_hours(CAST(g.hour + 1 AS INTEGER)) AS observed_at, coalesce(n, 0) AS event_count FROM
        (SELECT symbol, day, unnest(range(0, 24)) AS hour FROM (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS day FROM events)) g
        LEFT JOIN (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3) c ON g.symbol = c.symbol AND g.day = c.day AND g.hour = c.hour WHERE g.hour % 5 <> 0)""",
    "bars": """bars AS (SELECT l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS session, CAST((l_orderkey + l_linenumber) % 7 * 60 + 570 AS INTEGER) AS minute, min_by(l_extendedprice / 250 + 50, l_orderkey * 10 + l_linenumber) AS open,
        max(l_extendedprice / 250 + 50) AS high, min(l_extendedprice / 250 + 50) AS low, max_by(l_extendedprice / 250 + 50, l_orderkey * 10 + l_linenumber) AS close, count(*) AS volume FROM lineitem GROUP BY 1, 2, 3)""",
    "quotes": """quotes AS (SELECT symbol, session, cp, strike, CAST(bar - CASE WHEN (volume + k + 3) % 23 = 5 THEN 20 ELSE (volume + k + 3) % 4 * 5 END AS INTEGER) AS minute, price,
        round(greatest(price + CASE WHEN (volume + 2 * k + 6) % 29 = 7 THEN 0.3 ELSE -0.3 END, 0), 2) AS bid, round(greatest(price + CASE WHEN (volume + 2 * k + 6) % 29 = 7 THEN -0.3 ELSE 0.3 END, 0), 2) AS ask
        FROM (SELECT *, round(greatest(CASE WHEN cp = 'C' THEN open - strike ELSE strike - open END, 0) + 1.5 + (volume * 7 + k * 3 + 9) % 5 * 0.7, 2) AS price
        FROM (SELECT symbol, session, minute AS bar, open, volume + day(session) AS volume, k, round_even(open / 5, 0) * 5 + k * 5 AS strike, cp FROM bars, (SELECT unnest(range(-3, 4)) AS k), (SELECT unnest(['C', 'P']) AS cp) WHERE ((volume + day(session)) * 3 + k + 3) % 19 <> 0)))""",
    "decisions": """decisions AS (SELECT symbol, day, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS INTEGER)) AS decision FROM
        (SELECT symbol, day, unnest([10, 14]) AS h FROM (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS day FROM events)))""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
