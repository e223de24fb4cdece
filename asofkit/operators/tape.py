"""The change of an index tape over a number of sessions, as it could be known at the close of each session, and why it is not known.

All figures of a reading hang on the latest fixing alone, so they are computed once for each fixing and carried to the sessions that ask.
A series has at most one fixing a session, so a window by index is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators.asof import asof


def version_runs(fixings: DataFrame, calendar: DataFrame) -> DataFrame:
    """Fixings (``index_code, index_date, value, methodology``) on sessions of the calendar (``day, session_no``).

    Adds ``session_no``, ``run`` (unbroken stretches of one methodology) and ``run_start`` (session number of its first fixing). A fixing without a
    positive value is an error.
    """
    value = F.when((F.col("value") > 0) & (F.col("value") < float("inf")), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no positive value: "), "index_code", F.lit(" "), "index_date")))
    on = fixings.withColumn("value", value).join(calendar.withColumnRenamed("day", "index_date"), "index_date")
    series = W.partitionBy("index_code").orderBy("session_no")
    begins = F.lag("methodology").over(series).eqNullSafe(F.col("methodology")) & (F.row_number().over(series) > 1)
    runs = on.withColumn("run", F.sum(F.when(begins, 0).otherwise(1)).over(series.rowsBetween(W.unboundedPreceding, 0)))
    return runs.withColumn("run_start", F.min("session_no").over(W.partitionBy("index_code", "run")))


def tape_readings(asks: DataFrame, fixings: DataFrame, calendar: DataFrame, *, lookback: int = 63, tolerance: int = 3, least_coverage: float = 0.9, most_stale: int = 3) -> DataFrame:
    """One row per ask (``index_code, session``, a session): ``status`` and, where it got so far, the fixing, the anchor, the coverage and the log change.

    The anchor is the latest fixing of the same run that is ``lookback`` to ``lookback + tolerance`` sessions older than the latest fixing.
    """
    run = W.partitionBy("index_code", "run").orderBy("session_no")
    seen = version_runs(fixings, calendar).withColumn("place", F.row_number().over(run))
    anchor = F.last(F.struct("index_date", "session_no", "value", "place")).over(run.rangeBetween(-lookback - tolerance, -lookback))
    seen = seen.withColumn("a", anchor).withColumn("window_coverage", (F.col("place") - F.col("a.place") + 1) / (F.col("session_no") - F.col("a.session_no") + 1))
    seen = seen.select("index_code", F.col("session_no").alias("latest_no"), F.col("index_date").alias("latest_fixing"), "methodology", "run_start", "window_coverage", F.col("a.index_date").alias("anchor"), F.log(F.col("value") / F.col("a.value")).alias("change"))
    numbered = asks.join(calendar.withColumnRenamed("day", "session"), "session")
    carried = ["latest_fixing", "methodology", "run_start", "window_coverage", "anchor", "change"]
    known = asof(numbered, seen, keys=["index_code"], left_ts="session_no", right_ts="latest_no", values=carried)
    history = F.col("session_no") - F.col("run_start") + 1
    status = (
        F.when(F.col("latest_no").isNull(), "no_data").when(F.col("session_no") - F.col("latest_no") > most_stale, "stale").when(F.col("latest_no") - F.col("run_start") < lookback, "insufficient_history")
        .when(F.col("anchor").isNull() | (F.col("window_coverage") < least_coverage), "insufficient_coverage").otherwise("live")
    )
    reached = lambda c: F.when(F.col("status").isin("insufficient_coverage", "live"), F.col(c)).alias(c)
    return known.withColumn("status", status).select(
        "index_code", "session", "status", "latest_fixing", "methodology", F.coalesce(history, F.lit(0)).alias("history_sessions"), reached("window_coverage"), reached("anchor"),
        F.when(F.col("status") == "live", F.col("change")).alias("value"),
    )


def earliest_live(fixings: DataFrame, calendar: DataFrame, lookback: int = 63) -> DataFrame:
    """``index_code, earliest``: the first session at which the latest run can have a reading if every session publishes; NULL beyond the calendar."""
    latest = version_runs(fixings, calendar).groupBy("index_code").agg((F.max_by("run_start", "session_no") + lookback).alias("session_no"))
    return latest.join(calendar, "session_no", "left").select("index_code", F.col("day").alias("earliest"))


def weekday_calendar(days: DataFrame, day: Column, before: int = 0, after: int = 0) -> DataFrame:
    """``day, session_no`` of all weekdays from ``before`` days ahead of the first day to ``after`` days behind the last."""
    ends = days.agg(F.date_sub(F.min(day), before).alias("a"), F.date_add(F.max(day), after).alias("z")).filter("a is not null")
    open_ = ends.select(F.explode(F.sequence("a", "z")).alias("day")).filter(F.weekday("day") < 5)
    return open_.withColumn("session_no", F.row_number().over(W.orderBy("day")))  # at most 262 days a year
