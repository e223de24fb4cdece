"""The as-of operator: the latest right row that a left row may see.

Spark has no public as-of join. Both sides are united and sorted once per key, and the latest visible row is carried forward by
a window, so the cost is one shuffle and one sort, never a product. Where visibility has more clocks than the order (a row counts
only if it was also available and ingested in time), the carried row is found by range join on time buckets instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof(
    left: DataFrame, right: DataFrame, *, keys: list[str], left_ts: str, right_ts: str, values: list[str], tie: list[str] = (),
    strict: bool = False, tolerance_seconds: int | None = None,
) -> DataFrame:
    """Add ``values`` (and ``right_ts``) of the latest right row with ``right_ts <= left_ts`` (``<`` if strict).

    Among right rows of one time the largest ``tie`` wins. ``tolerance_seconds`` drops matches older than that.
    """
    side = 0 if strict else 1  # at equal times, right rows come before left rows unless strict
    packed = F.struct(F.col(right_ts).alias("__ts"), *[F.col(v).alias(v) for v in values])
    place = F.struct(*[F.col(t) for t in tie] or [F.lit(0)])  # in its own type, as numbers do not sort as text
    r = right.select(*keys, F.col(right_ts).alias("__at"), F.lit(1 - side).alias("__side"), place.alias("__tie"), packed.alias("__row"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"__l_{c}") for c in left.columns])
    l_ = left.select(*keys, F.col(left_ts).alias("__at"), F.lit(side).alias("__side"), F.lit(None).cast(right.select(place.alias("p")).schema["p"].dataType).alias("__tie"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("__row"), *[F.col(c).alias(f"__l_{c}") for c in left.columns])
    both = r.withColumn("__is_left", F.lit(False)).unionByName(l_.withColumn("__is_left", F.lit(True)))
    order = W.partitionBy(*keys).orderBy("__at", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__row", ignorenulls=True).over(order)).filter("__is_left")
    fresh = F.col("__seen")
    if tolerance_seconds is not None:
        moment = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        fresh = F.when(moment("__at") - moment("__seen.__ts") <= tolerance_seconds * 1_000_000, F.col("__seen"))
    out = seen.withColumn("__seen", fresh)
    return out.select(*[F.col(f"__l_{c}").alias(c) for c in left.columns], F.col("__seen.__ts").alias(right_ts), *[F.col(f"__seen.{v}").alias(v) for v in values])


def visible_rows(left: DataFrame, right: DataFrame, *, keys: list[str], at: str, clocks: list[str], horizon_seconds: int) -> DataFrame:
    """Pairs of left rows and right rows with all ``clocks <= at`` and the first clock within the horizon.

    An equi-join on time buckets of the horizon's length (own and previous bucket) keeps it from being a product.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / horizon_seconds)
    l_ = left.withColumn("__b", F.explode(F.array(bucket(at), bucket(at) - 1)))
    r = right.withColumn("__b", bucket(clocks[0]))
    met = l_.join(r, [*keys, "__b"])
    for c in clocks:
        met = met.filter(F.col(c) <= F.col(at))
    return met.filter(F.unix_timestamp(at) - F.unix_timestamp(clocks[0]) <= horizon_seconds).drop("__b")


def live_at(intervals: DataFrame, at: Column, start: str = "published_at", end: str = "superseded_at") -> DataFrame:
    """Rows whose transaction interval [start, end) holds the moment ``at``; an open end means still live."""
    return intervals.filter((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def nearest_prior(df: DataFrame, *, keys: list[str], end: str, value: str, low: int, high: int, unit_days: int = 400) -> DataFrame:
    """Self-join to the latest period that ends ``low`` to ``high`` days earlier: adds ``prior_end, prior_value``.

    Ends are dealt into buckets of ``unit_days`` so that the range condition meets only rows of near buckets.
    """
    day = F.datediff(F.col(end), F.to_date(F.lit("1970-01-01")))
    l_ = df.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((day - high) / unit_days), F.floor((day - low) / unit_days)))))
    r = df.select(*keys, F.floor(day / unit_days).alias("__b"), F.col(end).alias("__pe"), F.col(value).alias("__pv"))
    gap = F.datediff(F.col(end), F.col("__pe"))
    met = l_.join(r, [*keys, "__b"]).filter(gap.between(low, high))
    best = met.groupBy(*keys, end).agg(F.max(F.struct("__pe", "__pv")).alias("p")).select(*keys, end, F.col("p.__pe").alias("prior_end"), F.col("p.__pv").alias("prior_value"))
    return df.join(best, [*keys, end], "left")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (give a total order)."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
