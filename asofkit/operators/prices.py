"""Adjusted daily prices next to the raw close, and the audit of what is odd about them.

A bar without volume and without trades is a carried-forward placeholder: it is no price and is set aside (``untraded``), and its session is missing. More than one
adjusted bar of a session is an error of the job; of several raw bars the greatest close counts. A session without a raw bar has NULL ``raw_close`` and factor.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators import windows as win

# fixed values: the log return from which a day is an outlier, and the relative step of the factor that is reported
OUTLIER, FACTOR_STEP = math.log(1.4), 0.02


def adjusted_prices(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """``symbol, session, open, high, low, close, volume, vwap, trade_count, raw_close, adj_factor, untraded``, in one shuffle of both tables."""
    columns = ["open", "high", "low", "close", "volume", "vwap", "trade_count"]
    a = adjusted.select("symbol", "session", F.struct(*columns).alias("a"))
    both = a.unionByName(raw.select("symbol", "session", F.col("close").alias("raw_close")), allowMissingColumns=True)
    g = both.groupBy("symbol", "session").agg(F.count("a").alias("n"), F.max("a").alias("a"), F.max("raw_close").alias("raw_close")).filter("n > 0")
    refuse = F.raise_error(F.concat(F.lit("more than one daily bar of "), "symbol", F.lit(" on "), F.col("session").cast("string"))).cast(g.schema["a"].dataType)
    x = g.withColumn("a", F.when(F.col("n") > 1, refuse).otherwise(F.col("a"))).select("symbol", "session", "a.*", "raw_close")
    untraded = (F.coalesce("volume", F.lit(0)) == 0) & (F.coalesce("trade_count", F.lit(0)) == 0)
    return x.withColumns({"adj_factor": F.try_divide("raw_close", "close"), "untraded": untraded})


def price_audit(prices: DataFrame, calendar: DataFrame, end=None, *, outlier: float = OUTLIER, factor_step: float = FACTOR_STEP) -> DataFrame:
    """One row a symbol with a traded bar: counts, and lists of missing sessions, bars on other days, outliers and steps of the factor.

    ``calendar``: ``day`` of every session (one row with all of them goes to each symbol); sessions are expected from the first bar to ``end`` (or the last bar),
    and days beyond the calendar's own range are not judged.
    """
    w = win.series()
    before = lambda c: F.lag(c).over(w)
    x = prices.filter("not untraded")
    x = x.withColumns({
        "move": F.when((before("close") > 0) & (F.col("close") > 0), F.log(F.col("close") / before("close"))),
        "step": F.when((before("adj_factor") != 0) & (F.col("adj_factor") != 0), F.col("adj_factor") / before("adj_factor") - 1), "raw_ratio": F.try_divide(F.col("raw_close"), before("raw_close")),
    })
    listed = lambda when, *fields: F.array_sort(F.collect_list(F.when(when, F.struct("session", *fields))))
    per = x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.collect_set("session").alias("present"),
        listed(F.abs("move") > outlier, F.round("move", 4).alias("log_return")).alias("outliers"),
        listed(F.abs("step") > factor_step, F.round("step", 4).alias("factor_change"), F.round("raw_ratio", 4).alias("raw_close_ratio")).alias("factor_steps"), F.count_if(F.col("raw_close").isNull()).alias("rows_without_raw_close"),
    )
    aside = prices.filter("untraded").groupBy("symbol").agg(F.count(F.lit(1)).alias("untraded"), F.min("session").alias("untraded_first"), F.max("session").alias("untraded_last"))
    days = calendar.agg(F.array_sort(F.collect_set("day")).alias("days")).withColumn("__one", F.lit(1))
    y = per.withColumn("__one", F.lit(1)).join(F.broadcast(days), "__one").join(aside, "symbol", "left")  # one row: at most 262 days a year
    upto = F.coalesce(F.lit(end).cast("date"), F.col("last_session"))
    known = F.filter("present", lambda d: d.between(F.element_at("days", 1), F.element_at("days", -1)))
    return y.select(
        "symbol", "sessions", "first_session", "last_session", F.array_sort(F.array_except(F.filter("days", lambda d: d.between(F.col("first_session"), upto)), "present")).alias("missing_sessions"),
        F.array_sort(F.array_except(known, "days")).alias("bars_on_non_sessions"), "outliers", "factor_steps", "rows_without_raw_close", F.coalesce("untraded", F.lit(0)).alias("untraded"), "untraded_first", "untraded_last",
    )
