"""A snapshot of sessions at a fixed minute: what the completed bars of the day and the sessions before tell, and what followed.

Bars move once, by symbol and session, where a session becomes one row; only these rows move again, along their symbol. Nothing but the opening price of the
decision bar is read at or after the decision, besides the payoffs. Every session counts for closes and volumes of later ones; a row needs a complete session
(a bar at the open, one in the last step before the close), a bar at the decision, ``prior`` sessions before it and one after it.

Identical repeats of a bar count once; repeats that differ are an error of the job. A NULL volume counts as 0. Without volume or range a feature has its neutral value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators import windows as win

# fixed values: sessions before the first row; minutes of the open, of the end of the opening range and of the first hour, and of the close
PRIOR, OPEN, OPENING_END, FIRST_END, CLOSE, STEP = 20, 570, 600, 630, 960, 5
NEUTRAL = {"or_break": 0.5, "vol_ratio_open": 1.0}


def session_rows(bars: DataFrame, decision: int, *, session_open: int = OPEN, opening_end: int = OPENING_END, first_end: int = FIRST_END, session_close: int = CLOSE, step: int = STEP) -> DataFrame:
    """One row a symbol and session, from its bars (``symbol, session, minute, open, high, low, close, volume``) between open and close."""
    numbers = F.struct(*[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"))
    inside = bars.filter((F.col("minute") >= session_open) & (F.col("minute") < session_close)).select("symbol", "session", "minute", numbers.alias("b")).repartition("symbol", "session")
    refuse = F.raise_error(F.concat(F.lit("bars of one minute differ: "), "symbol", F.lit(" "), F.col("session").cast("string"))).cast(inside.schema["b"].dataType)
    once = inside.groupBy("symbol", "session", "minute").agg(F.min("b").alias("b"), F.max("b").alias("z")).select("symbol", "session", "minute", F.when(F.col("b") == F.col("z"), F.col("b")).otherwise(refuse).alias("b"))
    x = once.select("symbol", "session", "minute", "b.*")
    before, opening, first = F.col("minute") < decision, F.col("minute") < opening_end, F.col("minute") < first_end
    return x.groupBy("symbol", "session").agg(
        F.min("minute").alias("from"), F.max("minute").alias("to"), F.min_by("open", "minute").alias("open"), F.max_by("close", "minute").alias("close"),
        F.max(F.when(F.col("minute") == decision, F.col("open"))).alias("price"), F.max(F.when(opening, F.col("high"))).alias("or_high"), F.min(F.when(opening, F.col("low"))).alias("or_low"),
        F.max_by(F.when(opening, F.col("close")), F.when(opening, F.col("minute"))).alias("or_close"), F.sum(F.when(before, F.col("close") * F.col("volume"))).alias("turnover"),
        F.sum(F.when(before, F.col("volume"))).alias("so_far"), F.coalesce(F.sum(F.when(first, F.col("volume"))), F.lit(0.0)).alias("first_volume"),
    ).withColumn("complete", (F.col("from") == session_open) & (F.col("to") >= session_close - step))


def intraday_snapshot(bars: DataFrame, decision: int, *, prior: int = PRIOR, decimals: int = 8, **clock: int) -> DataFrame:
    """``session, symbol``, ten features as of the minute ``decision``, ``next_open_to_close`` (its price to the close) and ``next_close_to_close``. ``clock``: the minutes of ``session_rows``."""
    opening_end, close, step = clock.get("opening_end", OPENING_END), clock.get("session_close", CLOSE), clock.get("step", STEP)
    start = clock.get("session_open", OPEN)
    if not opening_end <= decision < close or (decision - start) % step:
        raise ValueError("the decision is at the start of a bar between the end of the opening range and the close")
    w, share = win.series(), F.try_divide
    past = lambda k: F.lag("close", k).over(w)
    x = session_rows(bars, decision, **clock)
    x = x.withColumns({"no": F.row_number().over(w), "ret": F.coalesce(share("close", past(1)) - 1, F.lit(0.0)), "after": F.lead("close").over(w)})
    told = {
        "day_of_week": F.weekday("session").cast("double"), "session_ret_so_far": share("price", "open") - 1, "vwap_dist": share(F.col("price"), share("turnover", "so_far")) - 1, "or_ret": share("or_close", "open") - 1,
        "or_break": F.least(F.lit(1.0), F.greatest(F.lit(0.0), share(F.col("price") - F.col("or_low"), F.col("or_high") - F.col("or_low")))), "prior_ret_1d": share(past(1), past(2)) - 1, "prior_ret_5d": share(past(1), past(6)) - 1,
        "gap_open": share(F.col("open"), past(1)) - 1, "rv_5d": F.stddev_samp("ret").over(w.rowsBetween(-5, -1)), "vol_ratio_open": share(F.col("first_volume"), F.avg("first_volume").over(w.rowsBetween(-prior, -1))),
        "next_open_to_close": share("close", "price") - 1, "next_close_to_close": share("after", "close") - 1,
    }
    # or_break: without a range the quotient is NULL, which least and greatest would pass over
    told["or_break"] = F.when(F.col("or_high") > F.col("or_low"), told["or_break"])
    usable = (F.col("no") > prior) & F.col("complete") & (F.col("price") > 0) & (F.col("open") > 0) & (F.col("close") > 0) & (F.col("after") > 0)
    rows = x.select("session", "symbol", usable.alias("usable"), *[v.alias(c) for c, v in told.items()]).filter("usable")
    return rows.select("session", "symbol", *[F.round(F.coalesce(c, F.lit(NEUTRAL.get(c, 0.0))), decimals).alias(c) for c in told])
