"""Overnight sessions stitched from the bars of several contracts, each session from the contract that traded most in it.

Bars move once, by session: repeats, volumes, the front contract and the verdict on the session follow in the same partitions, as a session holds the bars of a
few contracts. The evening belongs to the next day's session (before a weekend to Monday's); bars between the close and the evening's open belong to none.

Identical repeats of a bar count once; repeats of a complete session that differ are an error of the job. Equal volumes: the contract that comes first by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values, in minutes: the evening's open and the day's close by the clock; from the open on, the latest first bar and the bar of the settlement
EVENING, CLOSE = 18 * 60, 16 * 60
LATEST_FIRST, SETTLEMENT = 60, 1315
STAGES, LEAST_SESSIONS = {"discovery": 0.6, "validation": 0.85, "holdout": 1.0}, 60


def session_minutes(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Adds ``session`` and ``minute`` (from the evening's open) to bars with ``ts`` in UTC; bars of no session are dropped."""
    local = F.from_utc_timestamp("ts", zone)
    clock = F.hour(local) * 60 + F.minute(local)
    day = F.date_add(F.to_date(local), F.when(clock >= EVENING, 1).otherwise(0))
    session = F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))
    return bars.filter((clock < CLOSE) | (clock >= EVENING)).withColumns({"session": session, "minute": F.pmod(clock - EVENING, F.lit(1440)).cast("int")})


def judged_bars(bars: DataFrame, *, latest_first: int = LATEST_FIRST, settlement: int = SETTLEMENT) -> DataFrame:
    """``session, minute, open, high, low, close, volume, contract, reason`` of each session's front contract; ``reason`` is NULL in a complete session.

    ``bars``: ``contract, session, minute, open, high, low, close, volume``; bars after the settlement are left out.
    """
    columns = ["open", "high", "low", "close", "volume"]
    x = bars.filter(F.col("minute").between(0, settlement)).select("session", "contract", "minute", F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("b")).repartition("session")
    once = x.groupBy("session", "contract", "minute").agg(F.min("b").alias("b"), F.max("b").alias("z"))
    whole = W.partitionBy("session")
    once = once.withColumn("traded", F.sum(F.coalesce("b.volume", F.lit(0.0))).over(W.partitionBy("session", "contract")))
    front = once.withColumn("front", F.min(F.struct(-F.col("traded"), "contract")).over(whole)["contract"]).filter("contract = front")
    late = F.min("minute").over(whole) > latest_first
    open_end = F.max("minute").over(whole) < settlement
    judged = front.withColumn("reason", F.when(late, "evening missing").when(open_end, "no settlement bar"))
    refuse = F.raise_error(F.concat(F.lit("bars of one minute differ: "), F.col("session").cast("string"), F.lit(" "), "contract")).cast(x.schema["b"].dataType)
    b = F.when(F.col("reason").isNotNull() | (F.col("b") == F.col("z")), F.col("b")).otherwise(refuse)
    return judged.withColumn("b", b).select("session", "minute", "b.*", "contract", "reason")


def session_verdicts(judged: DataFrame) -> DataFrame:
    """``session, contract, bars, reason``: which contract each session came from, and why it was dropped."""
    return judged.groupBy("session", "contract", "reason").agg(F.count(F.lit(1)).alias("bars"))


def require_sessions(stitched: DataFrame, least: int = LEAST_SESSIONS) -> DataFrame:
    """``stage, first, last, sessions`` of a stitched table; an error if it has too few sessions. The array holds one date a session."""
    days = stitched.agg(F.array_sort(F.collect_set("session")).alias("d")).withColumn("n", F.size("d"))
    thin = F.raise_error(F.concat(F.lit("too few complete sessions: "), F.col("n").cast("string"))).cast("boolean")
    cuts = [F.lit(0), *[F.floor(F.col("n") * upto).cast("int") for upto in STAGES.values()]]
    parts = F.array(*[F.struct(F.lit(s).alias("stage"), F.element_at("d", a + 1).alias("first"), F.element_at("d", z).alias("last"), (z - a).alias("sessions")) for s, a, z in zip(STAGES, cuts, cuts[1:])])
    return days.filter(F.when(F.col("n") < least, thin).otherwise(True)).select(F.explode(parts).alias("p")).select("p.*")
