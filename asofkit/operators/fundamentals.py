"""A store of filed facts that grows by filings: the facts as filed, the chosen ones, every value a period has had, and growth.

Facts are kept in a folder per batch and never changed. What is derived from them lies in buckets of companies, as plain functions of the facts, so an append
reads and rewrites only the buckets that its filings touch, each table from the written one before it. An append that was cut short is run again with the same
rows and the same batch; the store is then what a build of all facts at once gives. One writer at a time.

Columns of a filing: ``keys, tag, start, end, value, form, accession, filed``. ``series`` has one row a series: ``keys, tags`` (array, the first one counts most),
``quarterly, annual`` (Boolean). Facts of other series or tags, without a start or a value, or of periods that end before ``since`` are not kept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.operators import vintages as vin

#: The largest number of buckets; their numbers are all that an append brings to the driver.
MOST_BUCKETS = 4096


def wanted_facts(filed: DataFrame, series: DataFrame, *, keys: tuple[str, ...] = ("symbol",), since: str = "0001-01-01") -> DataFrame:
    """The filings of the series, with ``place`` of their tag (from 1) and the kinds of period that the series has."""
    columns = [*keys, "tag", "start", "end", "value", "form", "accession", "filed"]
    x = filed.select(*columns).join(series.select(*keys, "tags", "quarterly", "annual"), list(keys))
    x = x.withColumn("place", F.array_position("tags", F.col("tag")).cast("int")).drop("tags")
    return x.filter((F.col("place") > 0) & F.col("start").isNotNull() & F.col("value").isNotNull() & (F.col("end") >= F.to_date(F.lit(since))))


def chosen_facts(wanted: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One fact of each period and filing: that of the first tag; if a filing gives several values for it, the greatest."""
    rest = ["tag", "form", "filed", "value", "quarterly", "annual"]
    best = F.min(F.struct("place", (-F.col("value")).alias("__minus"), *rest)).alias("f")
    return wanted.groupBy(*keys, "start", "end", "accession").agg(best).select(*keys, "start", "end", "accession", *[f"f.{c}" for c in rest])


def period_vintages(chosen: DataFrame, keys: tuple[str, ...] = ("symbol",), decimals: int = 2) -> DataFrame:
    """Every value of quarters (``period_type`` Q) and years (FY); values are rounded, as differences of sums carry noise."""
    quarters = vin.quarterly_vintages(chosen.filter("quarterly"), keys).withColumn("period_type", F.lit("Q"))
    years = vin.annual_vintages(chosen.filter("annual"), keys).withColumns({"period_type": F.lit("FY"), "method": F.lit("annual"), "inputs": F.array("accession")})
    return quarters.unionByName(years, allowMissingColumns=True).withColumn("value", F.round("value", decimals))


def period_growth(vintages: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Growth rows of quarters and of years."""
    parts = [vin.growth_rows(vintages.filter(F.col("period_type") == t), keys, quarterly=t == "Q").withColumn("period_type", F.lit(t)) for t in ("Q", "FY")]
    return parts[0].unionByName(parts[1])


def coverage(vintages: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """What the store holds of each series and kind of period: periods, first and last end, vintages, periods with more than one value, flagged vintages, and methods."""
    once = vintages.groupBy(*keys, "period_type", "start", "end").agg(
        F.count(F.lit(1)).alias("n"), F.count("flag").alias("flags"), F.collect_set("method").alias("methods"),
    )
    return once.groupBy(*keys, "period_type").agg(
        F.count(F.lit(1)).alias("periods"), F.min("end").alias("first"), F.max("end").alias("last"), F.sum("n").alias("vintages"), F.count_if(F.col("n") > 1).alias("restated"),
        F.sum("flags").alias("flagged"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods"),
    )


def append_filings(
    filed: DataFrame, series: DataFrame, path: str, batch: str, *, keys: tuple[str, ...] = ("symbol",), since: str = "0001-01-01", buckets: int = 64, decimals: int = 2,
) -> list[int]:
    """Put a batch of filings into the store at ``path`` and bring what depends on them up to date; returns the buckets that were rewritten.

    ``keys``, ``series``, ``since``, ``buckets`` and ``decimals`` are those of the whole store. A batch without wanted facts changes nothing.
    """
    if not re.fullmatch(r"[A-Za-z0-9-]+", batch) or not 0 < buckets <= MOST_BUCKETS:
        raise ValueError("a batch is named by letters, digits and hyphens, and a store has 1 to 4096 buckets")
    spark = filed.sparkSession
    new = wanted_facts(filed, series, keys=keys, since=since).withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
    new.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/filed/batch={batch}")
    written = spark.read.schema(new.schema).parquet(f"{path}/filed/batch={batch}")
    touched = sorted(r["bucket"] for r in written.select("bucket").distinct().collect())
    if not touched:
        return []
    schema = new.schema
    for name, step in (("chosen", lambda x: chosen_facts(x, keys)), ("vintages", lambda x: period_vintages(x, keys, decimals)), ("growth", lambda x: period_growth(x, keys))):
        source = {"chosen": "filed", "vintages": "chosen", "growth": "vintages"}[name]
        made = step(spark.read.schema(schema).parquet(f"{path}/{source}").filter(F.col("bucket").isin(touched)).drop("bucket"))
        made = made.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        made.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")
        schema = made.schema
    return touched


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the store: ``chosen``, ``vintages`` or ``growth``."""
    return spark.read.parquet(f"{path}/{table}").drop("bucket")
