"""Files of the research desk as DataFrames: bars, tapes, filings, ledgers and staged stores, and the sinks that write them.

Readers take explicit schemas. A reader with rules returns all rows with a ``reason`` column (NULL for a good row), so that a
caller can refuse the file (``require_clean``) or set the bad rows aside (``split_clean``). Nothing is inferred and no file
is listed on the driver beyond what Spark's readers do.
"""

from __future__ import annotations

import tempfile
import uuid
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that the cluster names; a local folder only where there is no cluster."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="asofkit-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def split_clean(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the reason, rows set aside with it)."""
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def require_clean(checked: DataFrame) -> DataFrame:
    """The rows, with an error in the job that reads them if one is bad; no extra pass over the file."""
    kept = checked.filter(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("refused: "), "reason")).cast("boolean")))
    return kept.drop("reason")


def _reasons(**bad: Column) -> Column:
    """The name of the first rule that is broken; an unknown value breaks it."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k.replace("_", " "))) for k, c in bad.items()])


def _repeats(*keys: str) -> Column:
    return F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1


# --- readers -------------------------------------------------------------------------------------------------------


def daily_bar_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars with positive prices in order, one per symbol and day."""
    bars = spark.read.schema("symbol string, session date, open double, high double, low double, close double, volume bigint").csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    if start or end:
        bars = bars.filter(F.col("session").between(F.to_date(F.lit(start or "0001-01-01")), F.to_date(F.lit(end or "9999-12-31"))))
    low_first = (F.least("open", "high", "low", "close") <= 0) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
    return bars.withColumn("reason", _reasons(bad_price=low_first, repeated_bar=_repeats("symbol", "session")))


def minute_bar_gz(spark: SparkSession, path: str, zone: str = "America/New_York") -> DataFrame:
    """Bars of a compressed file in UTC, with session and minute of the exchange's clock. A row without an offset is bad."""
    raw = spark.read.schema("symbol string, ts string, open double, close double, volume bigint").csv(path, header=True)
    at = F.when(F.col("ts").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp("ts"))
    utc = F.to_utc_timestamp(at, F.current_timezone())
    local = F.from_utc_timestamp(utc, zone)
    rows = raw.withColumns({"utc": utc.cast("timestamp_ntz"), "session": F.to_date(local), "minute": F.hour(local) * 60 + F.minute(local)})
    return rows.drop("ts").withColumn("reason", _reasons(no_time=F.col("utc").isNull()))


def lake_candles(spark: SparkSession, root: str, timeframe: str) -> DataFrame:
    """Candles of a lake laid out as ``bars/<SYMBOL>/<timeframe>.csv.gz``: one per symbol and time, positive prices only."""
    raw = spark.read.schema("ts timestamp_ntz, open double, high double, low double, close double, volume bigint").csv(f"{root}/bars/*/{timeframe}.csv.gz", header=True)
    symbol = F.regexp_extract(F.col("_metadata.file_path"), r"/bars/([^/]+)/", 1)
    kept = raw.withColumn("symbol", symbol).filter(F.least("open", "high", "low", "close") > 0)
    return kept.groupBy("symbol", "ts").agg(F.min(F.struct("open", "high", "low", "close", "volume")).alias("bar")).select("symbol", "ts", "bar.*")


def overnight_csv(spark: SparkSession, path: str) -> DataFrame:
    """Overnight session rows with the contract of the day, and the settlement, high and low of the session before."""
    rows = spark.read.schema("session date, contract string, settlement double, rth_high double, rth_low double, complete boolean").csv(path, header=True)
    w = W.partitionBy("contract").orderBy("session")
    return rows.withColumns({f"prior_{c}": F.lag(c).over(w) for c in ("settlement", "rth_high", "rth_low")})


def index_tape_csv(spark: SparkSession, path: str) -> DataFrame:
    """The revision history of an index: times carry an offset, and a published row has a value."""
    raw = spark.read.schema("index_code string, index_date date, revision int, status string, value double, published_at string").csv(path, header=True)
    at = F.when(F.col("published_at").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp("published_at"))
    rows = raw.withColumn("published_at", F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz"))
    return rows.withColumn("reason", _reasons(no_offset=F.col("published_at").isNull(), published_without_value=(F.col("status") == "published") & F.col("value").isNull(), repeated_revision=_repeats("index_code", "index_date", "revision")))


def keyed_csv(spark: SparkSession, path: str, schema: str, keys: list[str], required: list[str]) -> DataFrame:
    """A point-in-time input with a unique key and required columns; the header must name the columns in order."""
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return rows.withColumn("reason", _reasons(missing_value=missing, repeated_key=_repeats(*keys)))


_FACT = "struct<`start`:date,`end`:date,val:double,accn:string,form:string,filed:date>"


def company_facts(spark: SparkSession, path: str, namespace: str, unit: str) -> DataFrame:
    """Facts out of nested documents (namespace, tag, unit, list), one document a line."""
    docs = spark.read.schema(f"entity string, facts map<string,map<string,struct<units:map<string,array<{_FACT}>>>>>").json(path)
    tags = docs.select("entity", F.explode(F.element_at("facts", F.lit(namespace))).alias("tag", "body"))
    return tags.select("entity", "tag", F.explode(F.element_at("body.units", F.lit(unit))).alias("f")).select("entity", "tag", "f.*")


def filings_index(spark: SparkSession, path: str) -> DataFrame:
    """Filings kept as parallel arrays, in pages, as rows."""
    pages = spark.read.schema("entity string, page int, filings struct<accession:array<string>,form:array<string>,filed:array<date>>").json(path)
    zipped = F.arrays_zip(F.col("filings.accession").alias("accession"), F.col("filings.form").alias("form"), F.col("filings.filed").alias("filed"))
    return pages.select("entity", F.explode(zipped).alias("f")).select("entity", "f.*")


def _instance_facts(axis: str, unit: str):
    """``tag, member, value`` of the facts in an instance document that have the unit and one member on the axis. A document is parsed once, names go by their local part."""
    name = lambda x: x.rsplit("}", 1)[-1].rsplit(":", 1)[-1] if isinstance(x, str) else ""

    def facts(text: str) -> list[tuple]:
        root, members = ElementTree.fromstring(text), {}
        for c in (e for e in root.iter() if name(e.tag) == "context"):
            inner = [e for e in c.iter() if e is not c and name(e.tag) == "explicitMember"]
            if len(inner) == 1 and inner[0].get("dimension") == axis:
                members.setdefault(c.get("id"), []).append("".join(inner[0].itertext()))
        told = (e for e in root.iter() if "contextRef" in e.attrib and e.get("unitRef") == unit)
        told = (e for e in told if not any(name(k) == "nil" and v == "true" for k, v in e.attrib.items()))
        return [(e.get("tag"), m, "".join(e.itertext()) or None) for e in told for m in members.get(e.get("contextRef"), [])]

    @F.pandas_udf("array<struct<tag:string,member:string,value:string>>")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"tag": a, "member": b, "value": c} for a, b, c in facts(t)])

    return each


def dimensional_facts(documents: DataFrame, axis: str, unit: str = "USD", *, key: str = "doc", xml: str = "xml") -> DataFrame:
    """``key, tag, member, value`` of instance documents: contexts with exactly one member on the axis, one unit, nil left out.

    A fact that comes twice with one value is one fact; with different values it has a reason.
    """
    told = documents.select(key, F.explode(_instance_facts(axis, unit)(F.col(xml))).alias("f")).select(key, "f.*")
    g = told.groupBy(key, "tag", "member").agg(F.min(F.col("value").cast("double")).alias("value"), F.count_distinct(F.col("value").cast("double")).alias("n"))
    return g.withColumn("reason", F.when(F.col("n") > 1, "conflicting values")).drop("n")


def with_acceptance(facts: DataFrame, accepted: DataFrame) -> DataFrame:
    """Adds the moment of acceptance (UTC) by accession; NULL where it is not known."""
    return facts.join(accepted.select("accession", "accepted_at").dropDuplicates(["accession"]), "accession", "left")


def feature_export(spark: SparkSession, path: str, record: str, window: str) -> tuple[DataFrame, DataFrame]:
    """(records, windows) of an export of enveloped lines ``{kind, payload}``."""
    lines = spark.read.schema("kind string, payload string").json(path)
    part = lambda kind, schema: lines.filter(F.col("kind") == kind).select(F.from_json("payload", schema).alias("p")).select("p.*")
    return part("record", record), part("window", window)


def feature_rows(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """A snapshot of feature rows (symbol, session, features); with ``digest`` its content must be that of the manifest."""
    rows = spark.read.schema("symbol string, session date, features map<string,double>").json(path)
    if digest is not None and content_digest(rows) != digest:
        raise ValueError("the snapshot is not the one of the manifest")
    return rows


def stage_sessions(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """The sessions of one stage; the others are not read (the stage is a folder)."""
    return spark.read.parquet(root).filter(F.col("stage") == stage)


def stage_quotes(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """Quotes kept as strike -> prices on a grid, one row per strike and grid place with a price."""
    rows = spark.read.parquet(root).filter(F.col("stage") == stage)
    strikes = rows.select("stage", "day", F.explode("strikes").alias("strike", "prices"))
    return strikes.select("stage", "day", "strike", F.posexplode("prices").alias("place", "price")).filter("price is not null")


def run_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a ledger of trials; a line that is no JSON has a reason and its text."""
    rows = spark.read.schema("run string, trial int, score double, bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    return rows.withColumn("reason", F.when(F.col("bad").isNotNull(), "not JSON").when(F.col("run").isNull() | F.col("trial").isNull(), "no run or trial"))


def release_calendar(spark: SparkSession, path: str) -> DataFrame:
    """``day`` of every release in a calendar of three lists of dates."""
    raw = spark.read.schema("cpi array<date>, jobs array<date>, rates array<date>").json(path)
    return raw.select(F.explode(F.array_union(F.array_union("cpi", "jobs"), "rates")).alias("day")).distinct()


# --- sinks ---------------------------------------------------------------------------------------------------------


def content_digest(df: DataFrame, prefix: int = 3) -> str:
    """One digest of a table's content, whatever its order and files."""
    from asofkit.operators.integrity import table_digest

    one = df.select(F.lit(1).alias("__t"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row"))
    found = table_digest(one, ["__t"], ["row"], prefix).first()
    return found["digest"] if found else "empty"


def write_with_manifest(df: DataFrame, path: str, day: str) -> DataFrame:
    """Write the table and, next to it, its manifest: rows, first and last day, digest of what was written."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    spark = df.sparkSession
    back = spark.read.schema(df.schema).parquet(f"{path}/data")
    manifest = back.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first"), F.max(day).alias("last")).withColumn("digest", F.lit(content_digest(back)))
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``write_with_manifest``; an error if rows or content are not those of the manifest."""
    rows, told = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/manifest").first()
    if rows.count() != told["rows"] or content_digest(rows) != told["digest"]:
        raise ValueError("the table is not the one of the manifest")
    return rows


def write_stages(df: DataFrame, root: str, stages: tuple[str, ...] = ("discovery", "validation", "holdout")) -> None:
    """All stages in one write, each a folder; a store is written once, and a row of no stage is an error."""
    known = F.when(F.col("stage").isin(*stages), F.col("stage")).otherwise(F.raise_error(F.lit("a row of no stage")).cast("string"))
    df.withColumn("stage", known).write.partitionBy("stage").mode("errorifexists").parquet(root)


def write_csv(df: DataFrame, path: str, columns: list[str], lists: tuple[str, ...] = ()) -> None:
    """Columns in a fixed order, lists joined by semicolons, dates in ISO form."""
    df.select(*[F.array_join(c, ";").alias(c) if c in lists else F.col(c) for c in columns]).write.mode("errorifexists").csv(path, header=True, emptyValue="")


def append_new(df: DataFrame, path: str, keys: list[str], at: str) -> None:
    """Append the rows later than the last stored ones of their key; a rerun adds nothing."""
    spark = df.sparkSession
    try:
        last = spark.read.parquet(path).groupBy(*keys).agg(F.max(at).alias("__last"))
        df = df.join(last, keys, "left").filter(F.col("__last").isNull() | (F.col(at) > F.col("__last"))).drop("__last")
    except Exception as e:  # noqa: BLE001  the store does not exist before the first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.dropDuplicates([*keys, at]).write.mode("append").parquet(path)
