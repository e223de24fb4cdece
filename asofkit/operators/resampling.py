"""Clustered resampling with counter-based draws, nearest-rank summaries and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, x: str, *, resamples: int, seed: str, alpha: float) -> DataFrame:
    """``keys, lower_bound``: the alpha quantile of the pooled mean over resamples of whole clusters.

    Clusters are summed first, and a key's sums and counts become two arrays. Draw ``slot`` of resample ``r`` is a hash of (seed, r, slot),
    the same in every engine and for every key, so the hashes are made once: as many as resamples times the most clusters of a key, which
    is small next to the data (a key has as many clusters as it has weeks or blocks), and broadcast. Each (key, resample) then folds its draws over the arrays without a shuffle.
    """
    sums = df.groupBy(*keys, cluster).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("__c"), F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("s"), F.col("n").alias("n")))).alias("__x"))
    packed = packed.select(*keys, F.col("__x.s").alias("__s"), F.col("__x.n").alias("__n"), F.size("__x").alias("__k"))
    most = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k")).agg(F.max("__k").alias("__most"))
    number = lambda slot: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("__r").cast("string"), slot.cast("string"))), 1, 8), 16, 10).cast("long")
    draws = df.sparkSession.range(resamples).withColumnRenamed("id", "__r").join(F.broadcast(most))  # one row
    draws = draws.filter("__most > 0").select("__r", F.transform(F.sequence(F.lit(0), F.col("__most").cast("int") - 1), number).alias("__draws"))
    each = packed.withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long")))).join(F.broadcast(draws), "__r")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    place = lambda d: (d % F.col("__k")).cast("int")
    total = F.aggregate(F.slice("__draws", 1, F.col("__k")), start, lambda t, d: F.struct((t["s"] + F.get("__s", place(d))).alias("s"), (t["n"] + F.get("__n", place(d))).alias("n")))
    means = each.select(*keys, total.alias("t")).select(*keys, F.try_divide("t.s", "t.n").alias("mean"))
    return means.groupBy(*keys).agg(F.percentile("mean", F.lit(alpha)).alias("lower_bound"))


def block_ids(df: DataFrame, keys: list[str], order: str, size: int, name: str = "block") -> DataFrame:
    """Consecutive blocks of ``size`` rows per key; the last may be short."""
    return df.withColumn(name, F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / size))


def nearest_rank_summary(df: DataFrame, columns: list[str], ranges: int = 64) -> DataFrame:
    """``feature, low, p10, p50, p90, high``, by the value at rank rint(f * (n - 1))."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*").filter("x is not null")
    # values are counted first, so the ranked rows are the distinct values
    counts = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c"))
    # ranges between approximate quantiles: a few per feature, which are counted, then only the ranges with a wanted rank are sorted
    cuts = counts.groupBy("feature").agg(F.percentile_approx("x", F.array(*[F.lit(k / ranges) for k in range(1, ranges)])).alias("cuts"))
    placed = counts.join(F.broadcast(cuts), "feature").withColumn("range", F.size(F.filter("cuts", lambda q: q < F.col("x")))).drop("cuts")
    total, before = W.partitionBy("feature"), W.partitionBy("feature").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("feature", "range").agg(F.sum("c").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    sizes = sizes.withColumns({"n": F.sum("m").over(total), "before": F.coalesce(F.sum("m").over(before), F.lit(0)), "low": F.min("lo").over(total), "high": F.max("hi").over(total)})
    rank = lambda f: F.rint(f * (F.col("n") - 1))
    holds = F.array_compact(F.array(*[F.when((rank(f) >= F.col("before")) & (rank(f) < F.col("before") + F.col("m")), F.struct(F.lit(name).alias("name"), (rank(f) - F.col("before")).alias("rank"))) for name, f in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))]))
    wanted = sizes.withColumn("holds", holds).filter(F.size("holds") > 0)
    w = W.partitionBy("feature", "range")
    r = placed.join(F.broadcast(wanted.select("feature", "range", "holds", "low", "high")), ["feature", "range"]).withColumn("upto", F.sum("c").over(w.orderBy("x")))
    found = r.select("feature", "x", "upto", "low", "high", F.explode("holds").alias("h"))
    at = lambda name: F.min(F.when((F.col("h.name") == name) & (F.col("upto") > F.col("h.rank")), F.col("x"))).alias(name)
    return found.groupBy("feature").agg(F.first("low").alias("low"), at("p10"), at("p50"), at("p90"), F.first("high").alias("high"))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Reliability by bin, with the Brier score and the expected calibration error of the whole."""
    g = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg(p).alias("mp"), F.avg(y).alias("my"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("e"))
    w = W.partitionBy()  # one row per bin
    return g.select("bin", "c", F.round("mp", 6).alias("mean_p"), F.round("my", 6).alias("rate"), F.round(F.sum("e").over(w) / F.sum("c").over(w), 6).alias("brier"), F.round(F.sum(F.abs(F.col("mp") - F.col("my")) * F.col("c")).over(w) / F.sum("c").over(w), 6).alias("ece"))
