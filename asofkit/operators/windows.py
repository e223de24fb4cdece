"""Ordered-series features over past-only windows. All take column names, so they run on any keyed series.

Missing history stays NULL: a statistic over n rows is NULL until n rows exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec


def series(keys: str | tuple[str, ...] = "symbol", order: str = "session") -> WindowSpec:
    return W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def full(value: Column, of: str, w: WindowSpec, n: int) -> Column:
    """The value only where the frame holds n rows that are not NULL."""
    return F.when(F.count(of).over(w) == n, value)


def k_returns(close: str, ks: tuple[int, ...], w: WindowSpec) -> dict[str, Column]:
    return {f"ret_{k}": F.try_divide(F.col(close), F.lag(close, k).over(w)) - 1 for k in ks}


def realized_vol(ret: str, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-n + 1, 0)
    return full(F.stddev_samp(ret).over(frame), ret, frame, n)


def moving_average(x: str, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-n + 1, 0)
    return full(F.avg(x).over(frame), x, frame, n)


def range_position(close: str, high: str, low: str, n: int, w: WindowSpec) -> Column:
    """Where the close stands between the lowest low and the highest high of n rows (0.5 if they are equal)."""
    frame = w.rowsBetween(-n + 1, 0)
    lo, hi = F.min(low).over(frame), F.max(high).over(frame)
    return full(F.coalesce(F.try_divide(F.col(close) - lo, hi - lo), F.lit(0.5)), close, frame, n)


def extreme_recency(x: str, n: int, w: WindowSpec, highest: bool) -> Column:
    """Index of the first extreme in the frame, from 0 (oldest) to 1 (now)."""
    frame = w.rowsBetween(-n + 1, 0)
    values = F.collect_list(x).over(frame)
    best = (F.max if highest else F.min)(x).over(frame)
    return full((F.array_position(values, best) - 1) / F.lit(float(n - 1)), x, frame, n)


def trend(x: str, position: str, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """(slope over mean, R squared) of a line through n rows; R squared of a constant series is 0."""
    frame = w.rowsBetween(-n + 1, 0)
    slope = F.try_divide(F.regr_slope(F.col(x), F.col(position)).over(frame), F.avg(x).over(frame))
    spread = F.stddev_pop(x).over(frame)
    return full(slope, x, frame, n), full(F.when(spread > 0, F.regr_r2(F.col(x), F.col(position)).over(frame)).otherwise(0.0), x, frame, n)


def correlation(a: str, b: str, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-n + 1, 0)
    r = F.try_divide(F.covar_pop(a, b).over(frame), F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame))
    return full(F.coalesce(r, F.lit(0.0)), a, frame, n)


def skew(x: str, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-n + 1, 0)
    return full(F.coalesce(F.skewness(x).over(frame), F.lit(0.0)), x, frame, n)


def signed_streak(df: DataFrame, x: str, w: WindowSpec, keys: tuple[str, ...], name: str = "streak", most: int = 10) -> DataFrame:
    """Length of the run of equal signs up to each row, signed, at most ``most``."""
    sign = F.signum(x)
    df = df.withColumn("__s", sign).withColumn("__new", F.when(F.col("__s") == F.lag("__s").over(w), 0).otherwise(1))
    df = df.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    order = W.partitionBy(*keys, "__run").orderBy(*[c for c in ("session", "minute") if c in df.columns])
    return df.withColumn(name, (F.coalesce("__s", F.lit(0.0)) * F.least(F.row_number().over(order), F.lit(most))).cast("int")).drop("__s", "__new", "__run")


def cross_ranks(df: DataFrame, columns: list[str], by: str = "session", tie: str = "symbol") -> DataFrame:
    """``tie, by`` and ``rank_<column>`` of every column: the rank within a cross-section from 0 to 1; 0.5 for a cross-section of one, NULL for a NULL value.

    One sort does for all columns: they are ranked as rows and put side by side again.
    """
    long = df.select(tie, by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select(tie, by, "e.*")
    known = W.partitionBy(by, "feature", F.col("x").isNull())
    place, n = F.row_number().over(known.orderBy("x", tie)), F.count(F.lit(1)).over(known)
    ranked = long.withColumn("rank", F.when(F.col("x").isNotNull(), F.when(n < 2, 0.5).otherwise((place - 1) / (n - 1))))
    return ranked.groupBy(tie, by).agg(*[F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(f"rank_{c}") for c in columns])


def bollinger(close: str, n: int, width: float, w: WindowSpec) -> tuple[Column, Column]:
    """(%B, bandwidth); %B of a constant series is 0.5."""
    frame = w.rowsBetween(-n + 1, 0)
    mid, dev = F.avg(close).over(frame), F.stddev_pop(close).over(frame)
    pct = F.coalesce(F.try_divide(F.col(close) - (mid - width * dev), 2 * width * dev), F.lit(0.5))
    return full(pct, close, frame, n), full(F.try_divide(2 * width * dev, mid), close, frame, n)


def past_zscore(x: str, n: int, w: WindowSpec) -> Column:
    """Against the n rows before this one; NULL until they are there, and for a constant history."""
    frame = w.rowsBetween(-n, -1)
    dev = F.stddev_pop(x).over(frame)
    return full(F.when(dev > 0, (F.col(x) - F.avg(x).over(frame)) / dev), x, frame, n)


def ewma_of_last(x: str, n: int, decay: float, w: WindowSpec) -> Column:
    """Weighted mean of the n rows before this one, the latest with weight 1, each older one with ``decay`` times the weight."""
    frame = w.rowsBetween(-n, -1)
    values = F.collect_list(x).over(frame)
    weights = F.array(*[F.lit(decay ** (n - 1 - k)) for k in range(n)])
    total = F.aggregate(F.zip_with(values, weights, lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)
    return full(total / F.lit(sum(decay**k for k in range(n))), x, frame, n)


def carried(x: str, w: WindowSpec) -> Column:
    """The last known value of earlier rows."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))


def reverse_sum(x: str, w: WindowSpec) -> Column:
    """Sum of the later rows of the partition."""
    return F.coalesce(F.sum(x).over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))


def drawdown(df: DataFrame, log_return: Column, w: WindowSpec) -> DataFrame:
    """Adds ``equity`` (starting at 1) and ``drawdown`` from its running maximum."""
    frame = w.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("equity", F.exp(F.sum(log_return).over(frame)))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(frame) - 1)


def chronological_split(df: DataFrame, day: str, cuts: dict[str, float]) -> DataFrame:
    """Assign each distinct day to a stage by its place in the calendar of observed days (last bound 1.0)."""
    days = df.select(day).distinct()
    order = W.orderBy(day)  # one row per day
    n = F.count(F.lit(1)).over(W.partitionBy())
    ranked = days.withColumn("__r", F.row_number().over(order)).withColumn("__n", n)
    stage = F.lit(None).cast("string")
    for name, upto in reversed(list(cuts.items())):
        stage = F.when(F.col("__r") <= F.floor(F.col("__n") * upto), name).otherwise(stage)
    return df.join(ranked.select(day, stage.alias("stage")), day)
